"""Readers and the sink, on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from postwright import schemas
from postwright.sources import tables
from postwright.sources.json_records import json_records


def result(key, **more):
    return {"key": key, "category": None, "expected_ticket_keys": ["t1"], "actual_ticket_key": "t1", "correct": True, "path": "ai_decision", "confidence": 0.5, "elapsed_s": 1.5, **more}


def test_tables_keep_their_schemas(spark, tmp_path):
    for name, ddl in schemas.TABLES.items():
        spark.createDataFrame([], ddl).write.parquet(str(tmp_path / name))
    got = tables.read_tables(spark, str(tmp_path))
    assert set(got) == set(schemas.TABLES)
    assert all(got[n].columns == spark.createDataFrame([], ddl).columns and got[n].count() == 0 for n, ddl in schemas.TABLES.items())


def test_eval_files_of_both_shapes(spark, tmp_path):
    (tmp_path / "eval_1.json").write_text(json.dumps({"generated_at": "2024-01-02", "results": [result("a", timings_ms={"fusion": 2.0}), result("b")]}, indent=1))
    (tmp_path / "eval_2.json").write_text(" " + json.dumps([result("c", actual_ticket_key=None)]))
    rows = {r.key: r for r in tables.read_eval_runs(spark, str(tmp_path / "eval_*.json")).collect()}
    assert {k: (r.run, r.generated_at, r.actual_ticket_key) for k, r in rows.items()} == {"a": ("eval_1.json", "2024-01-02", "t1"), "b": ("eval_1.json", "2024-01-02", "t1"), "c": ("eval_2.json", None, None)}
    assert rows["a"].timings_ms == {"fusion": 2.0} and rows["b"].timings_ms is None


def test_repeat_files_give_a_row_for_each_attempt(spark, tmp_path):
    runs = [{"actual_ticket_key": x, "correct": x == "t1"} for x in ("t1", None, "t2")]
    (tmp_path / "r.json").write_text(json.dumps({"queries": [{"key": "k", "difficulty": "hard", "expected_ticket_keys": ["t1"], "runs": runs}, {"key": "none", "runs": []}]}))
    rows = tables.read_repeat_runs(spark, str(tmp_path / "*.json")).orderBy("attempt").collect()
    assert [(r.run, r.key, r.attempt, r.actual_ticket_key, r.correct) for r in rows] == [("r.json", "k", 1, "t1", True), ("r.json", "k", 2, None, False), ("r.json", "k", 3, "t2", False)]


def test_only_the_last_ab_file_counts(spark, tmp_path):
    for day, key in ((1, "old"), (2, "new")):
        (tmp_path / f"ab_2024-01-0{day}.json").write_text(json.dumps({"with_reranker": [result(key)], "no_reranker": [result(key, correct=False)]}))
    rows = sorted((r.run, r.variant, r.key, r.correct) for r in tables.read_ab_run(spark, str(tmp_path / "ab_*.json")).collect())
    assert rows == [("ab_2024-01-02.json", "no_reranker", "new", False), ("ab_2024-01-02.json", "with_reranker", "new", True)]


def test_quality_records(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"temp_id": "cust_1", "production_fields": {"name": "A", "inbox_email": "a@b.example"}, "generation_metadata": {"contacts": [{"name": "n", "role": "r", "email": "e"}]}}]))
    (tmp_path / "l.json").write_text(json.dumps([{"temp_id": "q_1", "matched_label": "B", "should_match": True, "distractor_labels": ["A"]}]))
    c = tables.read_qa_json(spark, str(tmp_path / "c.json"), "customers").first()
    assert c.production_fields.name == "A" and c.generation_metadata.contacts[0].email == "e" and c.generation_metadata.specialty is None
    label = tables.read_qa_json(spark, str(tmp_path / "l.json"), "labels").first()
    assert (label.matched_label, label.should_match, label.distractor_labels) == ("B", True, ["A"])


def test_results_are_written_by_partition_and_replaced(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, run string")
    for _ in range(2):
        tables.write_results(df, str(tmp_path / "out"), ["run"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("n", "run").collect())) == [(1, "a"), (2, "b")]
    tables.write_results(df, str(tmp_path / "json"), fmt="json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_two_corpora_keep_their_ids_apart(spark):
    import datetime as dt

    c = spark.createDataFrame([("c", "Clinic", "in@clinic.example")], "key string, name string, inbox_email string")
    t = spark.createDataFrame([("T1", "c", "claims", "s", "OPEN", 2.0, None)], "key string, customer string, category string, subject string, status string, age_days double, closed_age_days double")
    threads = spark.createDataFrame([("T1", [("customer", None, 0.0, "hi", None)])], "ticket_key string, messages array<struct<sender:string,type:string,offset_hours:double,content:string,sender_email_override:string>>")
    load = lambda ns: tables.load_fixture(c, t, threads, ns, dt.datetime(2024, 3, 1))
    one, two = load("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), load("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    both = tables.union_corpora(one, two)
    assert {n: d.select("id").distinct().count() for n, d in both.items()} == {"customers": 2, "tickets": 2, "interactions": 2}
    assert both["interactions"].join(both["tickets"].select(both["tickets"]["id"].alias("ticket_id")), "ticket_id").count() == 2
    again = tables.union_corpora(both, one)
    assert {n: d.count() for n, d in again.items()} == {"customers": 2, "tickets": 2, "interactions": 2}


def test_tables_come_from_a_database_in_ranges(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path / 'db'};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    ddl = {"people": "id string, name string, seen array<string>, made timestamp", "none": "id int, x double"}
    rows = [(f"'{i:02x}'", f"'n{i}'", """'["a","b"]'""" if i % 2 else "NULL", f"TIMESTAMP('2024-01-01 00:00:{i % 60:02d}')") for i in range(256)] + [("NULL", "'nobody'", "'[]'", "NULL")]
    base = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    run = base.createStatement().execute
    run("CREATE TABLE people_table (ID varchar(8), NAME varchar(20), SEEN varchar(50), MADE timestamp)")
    run('CREATE TABLE "none" (ID int, X int)')
    run("INSERT INTO people_table VALUES " + ", ".join(f"({', '.join(r)})" for r in rows))
    base.close()
    got = tables.read_tables_jdbc(spark, url, {"people": ["40", "80", "c0"]}, properties=options, names={"people": "people_table", "none": '"none"'}, schemas_of=ddl)
    assert got["people"].schema.simpleString() == "struct<id:string,name:string,seen:array<string>,made:timestamp>"
    assert got["people"].rdd.getNumPartitions() == 4 and got["people"].count() == 257
    sizes = sorted(r["count"] for r in got["people"].groupBy(F.spark_partition_id()).count().collect())
    assert sizes == [64, 64, 64, 65]
    assert {r.id: r.seen for r in got["people"].filter("name IN ('n3', 'n4', 'nobody')").collect()} == {"03": ["a", "b"], "04": None, None: []}
    assert got["none"].dtypes == [("id", "int"), ("x", "double")] and got["none"].count() == 0
    with pytest.raises(ValueError, match="missing"):
        tables.declared(got["none"], "id int, y int")


def test_one_file_of_many_records_is_read_by_several_tasks(spark, tmp_path):
    rnd = random.Random(9)
    odd = ['"', "}", "{", "[", "]", "\\", '\\"}', "\n", "é", "}],{", " plain "]
    word = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randrange(12)))
    record = lambda i: {"key": f"k{i}", "note": word(), "more": [{"x": word()}, {}], "deep": {"a": {"b": [1, {"c": word()}]}}}
    rows = [record(i) for i in range(300)]
    files = {
        "a.json": rows, "b.json": {"generated_at": 'a "quoted" {day}', "meta": {"x": "}"}, "empty": [], "results": rows[:150], "end": {"deep": {"a": {"b": 1}}}, "other": rows[150:], "z": 1},
        "c.json": [], "d.json": {"results": []}, "e.json": [rows[0]],
    }
    for i, (name, x) in enumerate(files.items()):
        (tmp_path / name).write_text(json.dumps(x, indent=i % 2 or None, ensure_ascii=False))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, "3000")
        assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 5
        got = json_records(spark, str(tmp_path / "*.json")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    lists = {("a.json", ""): rows, ("b.json", "results"): rows[:150], ("b.json", "other"): rows[150:], ("e.json", ""): [rows[0]]}
    for (file, name), want in lists.items():
        mine = [json.loads(r.record) for r in got if r.file.endswith(file) and r.name == name]
        assert sorted(mine, key=lambda x: x["key"]) == sorted(want, key=lambda x: x["key"]), (file, name)
    assert len(got) == sum(map(len, lists.values()))
