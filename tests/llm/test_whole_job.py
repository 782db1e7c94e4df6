"""Cases in which an operator once did less than the whole job."""

import random

from postwright.llm import decontaminate, quality


def words_of(rnd, n):
    return " ".join("".join(rnd.choice("bdfglmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(n))


def test_unseen_clean_texts_of_a_small_language_stay(spark):
    rnd = random.Random(11)
    docs = [(i, words_of(rnd, rnd.randrange(30, 120)), "en") for i in range(240)] + [(900 + i, "#$%! XQZ " * 30, "en") for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = {r.doc_id: r.keep for r in quality.judge_quality(df, ids).collect()}
    assert sum(got[i] for i in range(40)) == 40 and sum(got[i] for i in range(40, 240)) >= 196
    assert not any(got[900 + i] for i in range(5))


def test_rows_of_one_id_go_by_their_own_verdict(spark):
    rnd = random.Random(12)
    docs = [(i, words_of(rnd, 60), "en", 0) for i in range(60)] + [(None, words_of(rnd, 60), "en", 1), (None, None, "en", 2), (None, "#$%! XQZ " * 30, "en", 3), (7, "#$%! XQZ " * 30, "en", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, k1 int")
    ids = spark.createDataFrame([(i,) for i in range(60) if i != 7], "doc_id long")
    kept = quality.keep_good(df, ids)
    assert kept.columns == df.columns
    got = kept.collect()
    assert [r.k1 for r in got if r.doc_id is None] == [1]
    assert [r.k1 for r in got if r.doc_id == 7] == [0]


def test_short_and_numeric_items_and_long_excerpts_are_found(spark):
    rnd = random.Random(13)
    long = words_of(rnd, 80)
    items = [(1, "Name three primes"), (2, "12 km + 7 km = 19 km, 30 kg"), (3, "Add 3 apples today"), (4, long), (5, "?!"), (6, "12 km + 7 km = 19 km, 31 kg")]
    docs = [(1, "We ask: Name three primes and go on"), (2, "so 12 km + 7 km = 19 km, 30 kg is it"), (3, "Please add 5 apples today again"), (4, words_of(rnd, 30) + " " + " ".join(long.split()[10:35]) + " " + words_of(rnd, 30)), (5, words_of(rnd, 50)), (6, "Name four primes"), (7, "?!"), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.changed) for r in rows) == [(1, 1, False), (2, 2, False), (3, 3, True), (4, 4, False)]


def test_short_items_in_many_texts_are_no_leaks(spark):
    rnd = random.Random(17)
    docs = [(i, f"{words_of(rnd, 20)} the {words_of(rnd, 5)}") for i in range(30)] + [(100 + i, "say zyxomma twice") for i in range(30)] + [(200, "and Zyxomma again"), (201, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "zyxomma"), (3, "The"), (4, "of the unseen")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items).collect())
    assert got == [(100 + i, 2) for i in range(30)] + [(200, 2)]  # thirty copies are one text
    assert len(decontaminate.contaminated(df, items, common_texts=30).filter("item_id = 1").collect()) == 30
    assert {r.item_id for r in decontaminate.contaminated(df, items, common_texts=0, common_share=0.07).collect()} == {2}
    assert decontaminate.drop_contaminated(df, items).count() == 31
