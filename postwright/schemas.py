"""Table schemas (Spark DDL) and enumerations."""

from __future__ import annotations

# Fixed values of the data model.
INTERACTION_TYPES = ["customer_email", "agent_reply", "internal_note", "system_event"]
EMBEDDABLE = ["customer_email", "agent_reply"]
STATUSES = ["OPEN", "IN_PROGRESS", "PENDING", "WAITING_FOR_CLIENT", "RESOLVED", "CLOSED"]
TERMINAL = ["RESOLVED", "CLOSED"]
DECISIONS = ["accepted", "rejected"]
CATEGORY_LABELS = {
    "claims": "Claims",
    "payment_posting": "Payment Posting",
    "prior_authorization": "PA",
    "accounts_receivable": "AR",
    "eligibility": "Eligibility",
    "charge_entry": "Charge Entry",
}
CATEGORIES = list(CATEGORY_LABELS)
SENDER_TYPES = ["client", "account_manager"]
INTENTS = ["initial_request", "follow_up", "status_check", "documentation_provided", "thank_you", "informational"]
TIERS = ["easy", "moderate_paraphrase", "hard_semantic", "hard_negative", "boilerplate", "same_customer_disambiguation"]
TONES = ["professional", "casual"]
LENGTHS = ["short", "medium", "long"]
NOISES = ["clean", "mild", "heavy"]
SENDER_LABELS = {"customer_email": "Customer", "agent_reply": "Agent", "internal_note": "Internal Note", "system_event": "System"}
VECTOR_DIMS = {"nomic-embed-text": 768, "mxbai-embed-large": 1024, "bge-m3": 1024}

CUSTOMERS = "id string, name string, inbox_email string, created_at timestamp"
TICKETS = "id string, customer_id string, subject string, category string, status string, created_at timestamp, closed_at timestamp"
INTERACTIONS = (
    "id string, ticket_id string, customer_id string, interaction_type string, sender_email string, raw_content string, clean_content string, "
    "message_id string, conversation_id string, in_reply_to string, reference_message_ids array<string>, embedding array<float>, "
    "embedding_model string, extra_metadata map<string,string>, created_at timestamp"
)
FEEDBACK = (
    "id string, customer_id string, sender_email string, subject string, body string, should_attach boolean, recommended_ticket_id string, "
    "confidence double, explanation string, manager_decision string, corrected_ticket_id string, notes string, created_at timestamp"
)
EMAILS = (
    "query_id string, subject string, body string, sender_email string, message_id string, conversation_id string, in_reply_to string, "
    "reference_message_ids array<string>"
)
EVAL_QUERIES = (
    "key string, sender_email string, subject string, body string, conversation_id string, in_reply_to string, expected_ticket_keys array<string>, "
    "difficulty string, ambiguity_type string, category string, note string"
)
EVAL_RESULT = (
    "key string, category string, difficulty string, ambiguity_type string, expected_ticket_keys array<string>, actual_ticket_key string, correct boolean, recall20 boolean, recall3 boolean, "
    "path string, confidence double, explanation string, elapsed_s double, timings_ms map<string,double>, total_time_ms double"
)
REPEAT_FILE = (
    "queries array<struct<key: string, category: string, difficulty: string, ambiguity_type: string, expected_ticket_keys: array<string>, runs: array<struct<actual_ticket_key: string, "
    "correct: boolean, recall20: boolean, recall3: boolean, path: string, confidence: double, explanation: string, elapsed_s: double>>>>"
)
UNITS = "unit_id string, stage string, status string, batch_id string, retry_count int, raw_result string, qa_verdict string, updated_at string"
TARGETS = "dimension string, value string, target double"
QA_CUSTOMER = (
    "temp_id string, production_fields struct<name: string, inbox_email: string>, generation_metadata struct<specialty: string, practice_size: string, "
    "primary_payers: array<string>, pm_ehr_system: string, contacts: array<struct<name: string, role: string, email: string>>>"
)
QA_TICKET = (
    "temp_id string, production_fields struct<subject: string, category: string, status: string, created_at_offset_days: int, closed_at_offset_days: int>, "
    "generation_metadata struct<core_issue_summary: string, distinguishing_details: string, claim_number: string, patient_id: string, payer: string, "
    "date_of_service: string, procedure_description: string>"
)
QA_CONVERSATION = (
    "ticket_temp_id string, messages array<struct<production_fields: struct<sender_type: string, sender_email: string, day_offset: int, body_text: string>, "
    "generation_metadata: struct<intent_type: string, tone: string, length_bucket: string, noise_level: string>>>"
)
QA_LABEL = "temp_id string, matched_label string, should_match boolean, difficulty_tier string, distractor_labels array<string>, reasoning string"
TABLES = {"customers": CUSTOMERS, "tickets": TICKETS, "interactions": INTERACTIONS, "recommendation_feedback": FEEDBACK}
