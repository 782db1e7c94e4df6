"""Quality rules over nested records; each gives findings (severity, check, message), folded to a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, has_temp_id, identifiers, without_identifiers, words
from ..schemas import CATEGORIES, INTENTS, LENGTHS, NOISES, STATUSES, TERMINAL, TIERS, TONES
from .sampling import uniform

# Fixed values of the rules.
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
META_PHRASES = ["difficulty tier", "ground truth", "distractor", "should_match", "temp_id"]
REFUSALS = ["as an ai", "i cannot", "i can't help with", "this is a synthetic example", "this is a synthetic", "as a language model"]
NOISE_MARKERS = [
    " pt ", " asap", " w/", " u ", " ur ", " pls ", " b4", " thx", " asap", " acct", " clm", " auth", " amt", " wk ", " goin", " callin", " sayin",
    " startin", " takin", " askin", " everyones", "'ll not", " idk ",
]
FINDINGS = "array<struct<severity:string,check:string,message:string>>"


def finding(when: Column, severity: str, check: str, message) -> Column:
    """The finding if the condition holds, else null."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), message.alias("message")))


def findings(*some: Column) -> Column:
    return F.array_compact(F.array(*some)).cast(FINDINGS)


def blank(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def contains_any(text: Column, literals: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(x) for x in literals]), lambda x: F.contains(text, x))


def check_customers(customers: DataFrame, used_names: list[str] = ()) -> DataFrame:
    """Q1. Add findings to a batch of customer records."""
    name, inbox = F.col("production_fields.name"), F.col("production_fields.inbox_email")
    contacts = F.coalesce("generation_metadata.contacts", F.array().cast("array<struct<name:string,role:string,email:string>>"))
    mails = F.filter(F.transform(contacts, lambda c: c.email), lambda e: ~blank(e))
    bad = F.transform(F.filter(mails, lambda e: ~e.rlike(EMAIL)), lambda e: F.struct(F.lit("fail").alias("severity"), F.lit("email_format").alias("check"), F.concat(F.lit("invalid contact email: "), e).alias("message")))
    times = F.count("*").over(Window.partitionBy("inbox__key"))
    df = customers.withColumn("inbox__key", F.coalesce(inbox, F.lit(""))).withColumn("times", times)
    out = findings(
        finding(blank(name) | blank(inbox), "fail", "required_fields", "name or inbox_email is empty"),
        finding(F.size(mails) == 0, "fail", "required_fields", "no contact with an email"),
        finding(~blank(inbox) & ~F.coalesce(inbox, F.lit("")).rlike(EMAIL), "fail", "email_format", "invalid inbox_email"),
        finding(~blank(inbox) & (F.col("times") > 1), "fail", "duplicate_inbox_email", "inbox_email repeats in the batch"),
        finding(~blank(inbox) & F.array_contains(mails, inbox), "flag", "inbox_email_matches_contact", "inbox_email is a contact's"),
        finding(F.coalesce(name.isin(list(used_names)), F.lit(False)), "flag", "duplicate_name", "name is in use") if used_names else F.lit(None),
    )
    return df.withColumn("findings", F.concat(out, bad.cast(FINDINGS))).drop("inbox__key", "times")


def check_tickets(tickets: DataFrame, assignments: DataFrame) -> DataFrame:
    """Q2. Add findings to ticket seeds; assignments (temp_id, category, status, disambiguation_sibling)."""
    p, m = "production_fields", "generation_metadata"
    given = assignments.select("temp_id", F.col("category").alias("a_category"), F.col("status").alias("a_status"), F.col("disambiguation_sibling").alias("sibling"))
    # tickets without a sibling meet nobody, under keys of their own, so they don't gather in one task
    own = F.when(F.col("sibling").isNull(), F.concat(F.lit("-"), "temp_id")).otherwise(F.concat(F.lit("+"), "sibling"))
    other = tickets.select(F.concat(F.lit("+"), "temp_id").alias("s_key"), F.col(f"{m}.claim_number").alias("s_claim"), F.col(f"{m}.patient_id").alias("s_patient"), F.lit(True).alias("s_there"))
    df = tickets.join(given, "temp_id", "left")
    df = df.join(other, own == F.col("s_key"), "left").select("sibling", *[c for c in df.columns if c != "sibling"], "s_claim", "s_patient", "s_there")
    status, closed, created = F.col(f"{p}.status"), F.col(f"{p}.closed_at_offset_days"), F.col(f"{p}.created_at_offset_days")
    terminal = F.coalesce(status.isin(TERMINAL), F.lit(False))
    there = F.coalesce("s_there", F.lit(False))
    same = lambda a, b: there & ~blank(a) & F.col(a).eqNullSafe(F.col(b))
    out = findings(
        finding(~F.coalesce(F.col(f"{p}.category").isin(CATEGORIES), F.lit(False)), "fail", "category_valid", "invalid category"),
        finding(~F.coalesce(status.isin(STATUSES), F.lit(False)), "fail", "status_valid", "invalid status"),
        finding(~F.col(f"{p}.category").eqNullSafe(F.col("a_category")), "fail", "category_matches_assignment", "category isn't the assigned one"),
        finding(~status.eqNullSafe(F.col("a_status")), "fail", "status_matches_assignment", "status isn't the assigned one"),
        finding(terminal & closed.isNull(), "fail", "closed_date_logic", "terminal without a closing day"),
        finding(terminal & (closed < created), "fail", "closed_date_logic", "closed before created"),
        finding(~terminal & closed.isNotNull(), "fail", "closed_date_logic", "open with a closing day"),
        finding(there & blank(f"{m}.distinguishing_details"), "fail", "sibling_distinctness", "no distinguishing details"),
        finding(same(f"{m}.claim_number", "s_claim"), "fail", "sibling_distinctness", "claim_number is the sibling's"),
        finding(same(f"{m}.patient_id", "s_patient"), "fail", "sibling_distinctness", "patient_id is the sibling's"),
    )
    return df.withColumn("findings", out).drop("a_category", "a_status", "s_claim", "s_patient", "s_there")


def sender_streaks(messages: DataFrame, thread: str, position: str, sender: str, least: int = 3, longer_than: int = 3) -> DataFrame:
    """W7. Messages that are the least-th or later of one sender in a row, in threads of more messages than longer_than."""
    w = Window.partitionBy(thread).orderBy(position)
    df = messages.withColumn("n", F.count("*").over(Window.partitionBy(thread)))
    df = df.withColumn("change", F.when(F.col(sender).eqNullSafe(F.lag(sender).over(w)), 0).otherwise(1)).withColumn("island", F.sum("change").over(w))
    df = df.withColumn("streak", F.row_number().over(Window.partitionBy(thread, "island").orderBy(position)))
    return df.filter((F.col("streak") >= least) & (F.col("n") > longer_than)).drop("change", "island", "n")


def decreasing_offsets(messages: DataFrame, thread: str, position: str, offset: str) -> DataFrame:
    """W8. Messages whose offset is below that of the message before; null offsets aren't compared."""
    prev = F.lag(offset).over(Window.partitionBy(thread).orderBy(position))
    return messages.withColumn("previous", prev).filter(F.col(offset) < F.col("previous"))


def check_conversations(conversations: DataFrame, tickets: DataFrame) -> DataFrame:
    """Q3. Add findings to conversations (ticket_temp_id, messages), with W7 to W9 over the arrays."""
    t = tickets.select(F.col("temp_id").alias("ticket_temp_id"), F.col("production_fields").alias("tp"), F.col("generation_metadata").alias("tm"))
    df = conversations.join(t, "ticket_temp_id", "left")
    n = F.size("messages")
    first, last = F.get("messages", F.lit(0)), F.try_element_at("messages", F.lit(-1))
    indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get("messages", i)

    def each(severity: str, check: str, condition, message: str) -> Column:
        made = lambda i: F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.format_string(f"message %d: {message}", i).alias("message"))
        return F.transform(F.filter(indices, condition), made).cast(FINDINGS)

    enums = [("intent_type", INTENTS), ("tone", TONES), ("length_bucket", LENGTHS), ("noise_level", NOISES)]

    def outside(field: str, values: list[str]):
        return lambda i: ~F.coalesce(at(i).generation_metadata[field].isin(values), F.lit(False))

    bad = [each("fail", "enum_valid", outside(f, v), f"invalid {f}") for f, v in enums]
    day = lambda i: at(i).production_fields.day_offset
    sender = lambda i: at(i).production_fields.sender_type
    back = each("fail", "day_offsets_non_decreasing", lambda i: F.coalesce((i > 0) & (day(i) < day(i - 1)), F.lit(False)), "day_offset decreased")
    run = each("flag", "sender_alternation_degeneracy", lambda i: (n > 3) & (i >= 2) & sender(i).eqNullSafe(sender(i - 1)) & sender(i).eqNullSafe(sender(i - 2)), "third or later of one sender")
    terminal = F.coalesce(F.col("tp.status").isin(TERMINAL), F.lit(False))
    resolved = last.production_fields.sender_type.eqNullSafe("account_manager") | last.generation_metadata.intent_type.eqNullSafe("thank_you")
    late = F.coalesce(F.col("tp.created_at_offset_days"), F.lit(0)) + last.production_fields.day_offset > F.col("tp.closed_at_offset_days")
    text = F.array_join(F.transform("messages", lambda x: F.coalesce(x.production_fields.body_text, F.lit(""))), " ")
    some = n > 0
    echoed = lambda f: some & ~blank(f"tm.{f}") & ~F.contains(text, F.col(f"tm.{f}"))
    single = findings(
        finding(~some | F.col("messages").isNull(), "fail", "non_empty", "no messages"),
        finding(some & ~first.production_fields.sender_type.eqNullSafe("client"), "fail", "message_1_structure", "first sender isn't the client"),
        finding(some & ~first.generation_metadata.intent_type.eqNullSafe("initial_request"), "fail", "message_1_structure", "first intent isn't initial_request"),
        finding(some & terminal & ~resolved, "flag", "closed_ticket_resolution_shape", "last message is no resolution"),
        finding(some & terminal & late, "fail", "closed_ticket_resolution_shape", "last message after closing"),
        finding(echoed("claim_number"), "fail", "grounding_facts_echoed", "claim_number is nowhere in the thread"),
        finding(echoed("patient_id"), "fail", "grounding_facts_echoed", "patient_id is nowhere in the thread"),
    )
    return df.withColumn("findings", F.concat(single, *bad, back, run)).drop("tp", "tm")


def query_findings(text: Column) -> Column:
    """Q4. Of an email text: near-empty, leaked labels, tiers, phrases and ids, refusals."""
    given = F.coalesce(text, F.lit(""))

    def found(low: Column) -> Column:
        leaked = lambda what, lits: F.transform(lits, lambda x: F.struct(F.lit("fail").alias("severity"), F.lit("label_leakage").alias("check"), F.concat(F.lit(f"{what} leaked: "), x).alias("message"))).cast(FINDINGS)
        named = F.filter(F.array(*[F.lit(c) for c in CATEGORIES]), lambda x: F.contains(low, x) | F.contains(low, F.replace(x, F.lit("_"), F.lit(" "))))
        refusal = contains_any(low, REFUSALS)
        return F.concat(
            # three words need two gaps between them
            findings(finding(~low.rlike(r"\S\s+\S+\s+\S"), "fail", "non_degenerate", "fewer than three words")), leaked("category", named), leaked("tier", contains_any(low, TIERS)), leaked("phrase", contains_any(low, META_PHRASES)),
            findings(
                finding(has_temp_id(given), "fail", "label_leakage", "a temporary id leaked"),
                finding(F.size(refusal) > 0, "fail", "broke_character", F.concat(F.lit("refusal: "), F.get(refusal, F.lit(0)))),
            ),
        )

    # every rule reads the lowered text, which is made once
    return bind(F.lower(given), found)


def _word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def length_bucket(text: Column) -> Column:
    return bind(_word_count(text), lambda n: F.when(n <= 40, "short").when(n > 120, "long").otherwise("medium"))


def noise_level(text: Column) -> Column:
    """Q5. By the number of markers (one of them counts twice) in the text without identifiers, and punctuation."""

    def level(padded: Column) -> Column:
        marks = F.size(contains_any(padded, NOISE_MARKERS))
        return bind(marks, lambda m: F.when((m >= 5) | (~text.rlike("[.!?]") & (_word_count(text) > 15)), "heavy").when(m >= 1, "mild").otherwise("clean"))

    # every marker is looked for in the same text, which is made once
    return bind(F.concat(F.lit(" "), F.lower(without_identifiers(text)), F.lit(" ")), level)


def style_findings(length_found: Column, noise_found: Column, length: Column, noise: Column) -> Column:
    """Q5. From what length_bucket() and noise_level() found in a text, and what it should have."""
    return findings(
        finding(~length_found.eqNullSafe(length), "flag", "length_bucket_conformance", F.concat(F.lit("length suggests "), length_found)),
        finding(~noise_found.eqNullSafe(noise), "flag", "noise_level_conformance", F.concat(F.lit("markers suggest "), noise_found)),
    )


def truth_findings(intended: Column, judged: Column, tier: Column, judged_tier: Column, should_match: Column) -> Column:
    """Q6."""
    return findings(
        finding(~intended.eqNullSafe(judged), "fail", "ground_truth_match", "judged ticket isn't the intended one"),
        finding(~tier.eqNullSafe(judged_tier), "flag", "tier_conformance", "judged tier isn't the intended one"),
        finding(F.coalesce((tier == "hard_negative") & should_match, F.lit(False)), "fail", "hard_negative_should_not_match", "hard negative judged as a match"),
    )


def distractor_findings(pairs: DataFrame, tickets: DataFrame) -> DataFrame:
    """J17, Q7. Add findings to (query, correct, distractor[, realistic]): not the correct ticket, same customer;
    and a flag for an unrealistic one only where these hold."""
    who = lambda c, n: tickets.select(F.col("id").alias(c), F.col("customer_id").alias(n))
    df = pairs.join(who("correct", "c1"), "correct", "left").join(who("distractor", "c2"), "distractor", "left")
    own, other = F.col("correct").eqNullSafe(F.col("distractor")), ~F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))
    parts = [finding(own, "fail", "distractor_prefilter", "distractor is the correct ticket"), finding(other, "fail", "distractor_prefilter", "distractor is another customer's")]
    if "realistic" in pairs.columns:
        parts.append(finding(~own & ~other & ~F.coalesce("realistic", F.lit(True)), "flag", "distractor_realism", "distractor isn't realistic"))
    return df.withColumn("findings", findings(*parts)).drop("c1", "c2")


def verdict(found: Column, judged: Column | None = None) -> Column:
    """Q8. fail if any finding or judge says so, else flag, else pass."""
    has = lambda s: F.exists(found, lambda x: x.severity == s) | (F.array_contains(judged, s) if judged is not None else F.lit(False))
    return F.when(has("fail"), "fail").when(has("flag"), "flag").otherwise("pass")


def tier_findings(tier: Column, text: Column, seed_text: Column, candidates: Column, most_overlap: float = 0.5) -> Column:
    """Q9. Tier rules on the text: an identifier of the seed, none, little overlap, two or more candidates."""
    ids = F.size(F.array_intersect(identifiers(text), identifiers(seed_text)))
    a, b = F.array_distinct(words(text)), F.array_distinct(words(seed_text))
    overlap = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    return findings(
        finding((tier == "easy") & (ids == 0), "flag", "easy_has_identifier", "no identifier of the seed"),
        finding((tier == "hard_semantic") & (F.size(identifiers(text)) > 0), "flag", "hard_semantic_has_none", "holds an identifier"),
        finding((tier == "moderate_paraphrase") & (overlap > most_overlap), "flag", "paraphrase_overlap", "repeats the seed's words"),
        finding((tier == "same_customer_disambiguation") & (candidates < 2), "flag", "disambiguation_candidates", "fewer than two candidates"),
    )


def review_queue(units: DataFrame, seed: int = 0, percent: int = 10) -> DataFrame:
    """Q10. All flagged units first, then a hashed share of passed ones; no failed ones. priority 0 or 1."""
    picked = uniform("unit_id", "review", seed) < percent / 100
    df = units.withColumn("priority", F.when(F.col("verdict") == "flag", 0).when((F.col("verdict") == "pass") & picked, 1))
    return df.filter("priority IS NOT NULL")


def label_agreement(labels: DataFrame) -> DataFrame:
    """A26. By tier and overall (level 1): n, agreed, rate, tier_agreed; equality is null-safe."""
    ok, tier_ok = F.col("intended").eqNullSafe(F.col("judged")), F.col("tier").eqNullSafe(F.col("judged_tier"))
    df = labels.rollup("tier").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.count_if(ok).alias("agreed"), F.count_if(tier_ok).alias("tier_agreed"))
    return df.withColumn("rate", F.col("agreed") / F.col("n"))


def unit_rollup(units: DataFrame, most_attempts: int = 3) -> DataFrame:
    """A27. By stage: retryable, permanently_failed, pending, complete."""
    bad = F.col("status").isin("errored", "qa_fail")
    return units.groupBy("stage").agg(
        F.count_if(bad & (F.col("retry_count") < most_attempts)).alias("retryable"), F.count_if(bad & (F.col("retry_count") >= most_attempts)).alias("permanently_failed"),
        F.count_if(F.col("status") == "pending").alias("pending"), F.bool_and(F.col("status").isin("qa_pass", "qa_flag", "ingested")).alias("complete"),
    )


def verdict_rates(units: DataFrame, alarm: float = 0.4) -> DataFrame:
    """A28. By artifact: n, pass_rate, flag_rate, fail_rate, alarm (too many flagged)."""
    share = lambda v: F.avg((F.col("verdict") == v).cast("double"))
    df = units.groupBy("artifact").agg(F.count("*").alias("n"), share("pass").alias("pass_rate"), share("flag").alias("flag_rate"), share("fail").alias("fail_rate"))
    return df.withColumn("alarm", F.col("flag_rate") > alarm)


def resolve_ids(scenarios: DataFrame, tickets: DataFrame, conversations: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J15. Tickets of known customers that have a conversation, with real ids; scenarios with theirs.

    tickets (temp_id, id, customer_temp_id, ...), customers (temp_id, id), scenarios (temp_id, target_ticket,
    distractors array). Distractors that aren't known go, the others keep their order.
    """
    known = customers.select(F.col("temp_id").alias("customer_temp_id"), F.col("id").alias("customer_id"))
    kept = tickets.join(conversations.select(F.col("ticket_temp_id").alias("temp_id")).distinct(), "temp_id", "left_semi").join(known, "customer_temp_id")
    ids = kept.select(F.col("temp_id").alias("t"), F.col("id").alias("real"))
    each = scenarios.select("temp_id", F.posexplode("distractors").alias("pos", "t")).join(ids, "t")
    lists = each.groupBy("temp_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "real"))), lambda x: x.real).alias("distractor_ids"))
    out = scenarios.join(ids.select(F.col("t").alias("target_ticket"), F.col("real").alias("target_id")), "target_ticket", "left").join(lists, "temp_id", "left")
    empty = F.expr("filter(distractors, x -> false)")
    return kept.drop("temp_id", "customer_temp_id"), out.withColumn("distractor_ids", F.coalesce("distractor_ids", empty)).drop("distractors", "target_ticket")


def blind_candidates(queries: DataFrame, tickets: DataFrame, seed: int = 0) -> DataFrame:
    """J16. (query_id, label, ticket_id): the customer's open tickets in hashed order, lettered A, B, ..., Z, AA."""
    live = tickets.filter("status NOT IN ('RESOLVED', 'CLOSED')").select(F.col("id").alias("ticket_id"), "customer_id")
    order = Window.partitionBy("query_id").orderBy(uniform(F.concat_ws("/", "query_id", "ticket_id"), "blind", seed), "ticket_id")
    df = queries.select("query_id", "customer_id").join(live, "customer_id").withColumn("n", F.row_number().over(order) - 1)
    letter = lambda x: F.char(F.lit(65) + x)
    label = F.when(F.col("n") < 26, letter(F.col("n"))).otherwise(F.concat(letter(F.floor((F.col("n") - 26) / 26) % 26), letter(F.col("n") % 26)))
    return df.select("query_id", label.alias("label"), "ticket_id")


def judged_tickets(judged: DataFrame, candidates: DataFrame) -> DataFrame:
    """J16. judged (query_id, matched_label, ...) with the ticket_id that its letter stands for."""
    named = candidates.select("query_id", F.col("label").alias("matched_label"), "ticket_id")
    return judged.join(named, ["query_id", "matched_label"], "left")
