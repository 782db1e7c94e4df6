"""The five stages on small tables, each against a plain statement of what it keeps."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 int, salt string, n double, fold string, bucket int, node string, size string, big long"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
ITEM = "A train from Boston travels 120 km in 3 hours. How far does the train from Boston travel in 7 hours at the same speed?"


def prose(rnd, n):
    return " ".join("".join(rnd.choice("bdfglmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(n))


def rows():
    rnd = random.Random(21)
    made = {i: prose(rnd, 80) for i in range(120)}
    shared = "\n".join(prose(rnd, 30) for _ in range(3))
    made[30] += "\n" + shared + "\n" + prose(rnd, 30)
    made[31] += "\n" + shared + "\n" + prose(rnd, 30)
    made[40] = made[41]
    made[42] = " ".join(["other", *made[43].split()[1:]])
    made[50] += " " + ITEM
    made[51] += " " + ITEM.replace("120", "90").replace("7", "5").replace("Boston", "Madrid")
    made |= {500 + i: "#$%! XQZ " * 30 for i in range(4)} | {600: None, 601: "", 602: "   "}
    out = [(i, t, "en", "abc"[i % 3]) for i, t in made.items()] + [(None, prose(rnd, 80), None, None), (None, prose(rnd, 80), "en", "a"), (None, None, None, None), ((1 << 53) + 1, prose(rnd, 80), "en", "a")]
    out += out[:2]
    return [(d, t, lang, s, None if t is None else len(t), 1, "s", float("nan"), "f", 2, "x", "y", (1 << 53) + 1 if d else None) for d, t, lang, s in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    docs.select("doc_id").filter("doc_id < 100").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def key(r):
    return tuple("nan" if isinstance(x, float) and x != x else x for x in r)


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_stand_in_their_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_quality_keeps_prose_and_drops_junk(spark, folder):
    kept = stage("quality")(spark, docs_of(spark, folder), folder)
    want = [r for r in rows() if r[1] and r[1].strip() and "#$%" not in r[1]]
    assert kept.columns == COLUMNS
    assert Counter(map(key, kept.collect())) == Counter(map(key, want))


def test_line_dedup_deletes_later_runs_alone(spark, folder):
    kept = stage("line_dedup")(spark, docs_of(spark, folder), folder)
    assert kept.columns == COLUMNS
    want = []
    for r in rows():
        t = r[1]
        if r[0] == 31:
            lines = t.split("\n")
            t = "\n".join([lines[0], lines[-1]])
        if r[0] == 41 or (r[0] is not None and 501 <= r[0] < 504):
            t = ""  # all of it stands in an earlier document
        if t == "" and r[1]:
            continue
        want.append((r[0], t, *r[2:4], len(t) if t != r[1] else r[4], *r[5:]))
    assert Counter(map(key, kept.collect())) == Counter(map(key, want))


def test_near_dedup_keeps_one_of_each_group(spark, folder):
    kept = stage("near_dedup")(spark, docs_of(spark, folder), folder)
    gone = Counter({41: 1, 43: 1, 501: 1, 502: 1, 503: 1})
    want = Counter(map(key, rows())) - Counter(map(key, rows()[-2:]))
    assert Counter(map(key, kept.collect())) == Counter({r: n for r, n in want.items() if r[0] not in gone})


def test_decontamination_drops_copies_and_changed_questions(spark, folder):
    kept = stage("decontamination")(spark, docs_of(spark, folder), folder)
    assert Counter(map(key, kept.collect())) == Counter(map(key, [r for r in rows() if r[0] not in (50, 51)]))


def test_mixing_comes_near_its_targets(spark, folder):
    mixed = stage("mixing")(spark, docs_of(spark, folder), folder)
    assert mixed.columns == [c for c in COLUMNS if c != "size"] + ["size", "source_size", "target", "taken"]
    got = mixed.collect()
    total = sum(len((r[1] or "").split()) for r in rows())
    taken, target = Counter(), {}
    for r in got:
        assert 0 < r.taken <= 3 * r.size and r.taken % r.size == 0 and r.size == len(r.text.split())
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 80 for s in target) and abs(sum(target.values()) - total) < 1
    again = stage("mixing")(spark, docs_of(spark, folder).repartition(5), folder)
    assert Counter(map(key, again.collect())) == Counter(map(key, got))


def test_stages_take_an_empty_table(spark, folder):
    empty = docs_of(spark, folder).limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, folder).count() == 0, name


def test_run_puts_the_stages_together(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert got and not ids & {41, 43, 50, 51, 500, 501, 600, 601, 602}
    assert all(r.taken > 0 and r.n_chars == len(r.text) for r in got)
