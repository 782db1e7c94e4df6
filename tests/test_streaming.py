import datetime as dt

from postwright.streaming.jobs import incremental_index, read_index, route_mail

ROW = "id long, interaction_type string, raw_content string, clean_content string, embedding array<float>, embedding_model string"


def test_incremental_index_runs_once_per_change(spark, tmp_path):
    rows = [(1, "customer_email", "hello there", None, None, None), (2, "internal_note", "note", None, None, None), (3, "agent_reply", "done", "done", [1.0], "m")]
    spark.createDataFrame(rows, ROW).write.parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))
        incremental_index(source, str(tmp_path / "out"), str(tmp_path / "cp"), "m").awaitTermination()
        return {r.id: r for r in read_index(spark, str(tmp_path / "out")).collect()}

    assert set(run()) == {1}
    spark.createDataFrame([(1, "customer_email", "changed", None, None, None)], ROW).write.mode("append").parquet(str(tmp_path / "in"))
    again = run()
    assert set(again) == {1} and again[1].clean_content == "changed" and len(again[1].embedding) == 64


def test_route_mail(spark, tmp_path):
    mail = "query_id string, sender_email string, conversation_id string, in_reply_to string, reference_message_ids array<string>"
    spark.createDataFrame([("a", "A@x.example", "c1", None, []), ("b", "who@x.example", None, None, [])], mail).write.parquet(str(tmp_path / "mail"))

    def tables(session):
        return {
            "customers": session.createDataFrame([(1, "a@x.example")], "id long, inbox_email string"),
            "tickets": session.createDataFrame([(7, "OPEN")], "id long, status string"),
            "interactions": session.createDataFrame([(5, 7, "c1", "m5", dt.datetime(2024, 1, 1))], "id long, ticket_id long, conversation_id string, message_id string, created_at timestamp"),
        }

    route_mail(spark.readStream.schema(mail).parquet(str(tmp_path / "mail")), tables, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.query_id: r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "auto_attach", "b": "unknown_customer"}
