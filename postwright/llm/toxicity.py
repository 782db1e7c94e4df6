"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by the tail of clean texts."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_salted, row_key, table

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: A lexicon of at most so many features is sent to the workers; words meet a larger one by joins.
BROADCAST_FEATURES = 100_000
#: The most log-odds of one word.
MOST_SCORE = 8.0
BINS, BIN = 400, 0.25
#: Tables of labels of at most so many rows are broadcast, larger ones joined by shuffle.
BROADCAST_LABELS = 1_000_000


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learn_lexicon(texts: DataFrame, prior: float = 200.0, least_z: float = 4.0, least_count: int = 5) -> DataFrame:
    """(f, score) of words and word beginnings that toxic or clean texts favour, from (doc_id, text, toxic).

    Counts are of distinct words per text, each distinct text once, so neither repetition nor copies count more.
    Log-odds have a Dirichlet prior: one count of each feature and `prior` counts spread as in all texts; z is
    the log-odds over its standard error. A feature's score is its log-odds, one standard error nearer to 0; those of
    clean texts are below 0. Features within least_z errors of 0 tell nothing and aren't there.
    """
    df = texts.select("doc_id", "text", "toxic", *row_key("text"))
    one = df.groupBy("k1", "k2").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    one = cut(one.select("k1", "k2", "doc_id", F.when(2 * F.col("t") >= F.col("n"), 1).otherwise(0).alias("label")))
    df = df.join(F.broadcast(one) if one.count() <= BROADCAST_LABELS else one, ["k1", "k2", "doc_id"])
    words = df.select("label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    begins = [F.when(F.length("w") > k, F.concat(F.lit("^"), F.substring("w", 1, k))) for k in PREFIXES]
    # the empty feature counts all words
    feats = counts.select(F.explode(F.array_compact(F.array(F.lit(""), F.col("w"), *begins))).alias("f"), "t", "c").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    feats = cut(feats.filter(f"t + c >= {least_count} OR f = ''"))
    totals = feats.filter("f = ''").first()
    if not totals or not totals.t or not totals.c:
        return feats.select("f", F.lit(0.0).alias("score")).limit(0)
    a = 1 + F.lit(prior) * (F.col("t") + F.col("c")) / float(totals.t + totals.c)
    odds = lambda n, all_n: F.log((n + a) / (float(all_n) + prior + 1))
    delta = odds(F.col("t"), totals.t) - odds(F.col("c"), totals.c)
    error = F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    found = feats.filter("f <> ''").select("f", delta.alias("d"), error.alias("e")).filter(f"abs(d) >= {least_z} * e")
    return cut(found.select("f", (F.signum("d") * F.least(F.abs("d") - F.col("e"), F.lit(MOST_SCORE))).alias("score")), used=[feats])


def maximal_segments(places: list[int], scores: list[float], penalty: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, last word, score), where each word not in places costs `penalty`.

    One pass that keeps candidate segments with the running sums before and after them, and merges a new segment
    with the nearest earlier one that starts from a lower sum and ends below the new end (Ruzzo and Tompa). Scores of 0
    or less begin no segment.
    """
    out: list[list] = []
    total, last = 0.0, None
    for p, s in zip(places, scores, strict=True):
        total -= penalty * (p - last - 1) if last is not None else 0.0
        last = p
        if s <= 0:
            total += s
            continue
        new = [p, p, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], p, out[j][2], new[3]]
            del out[j:]
    return [(a, b, after - before) for a, b, before, after in out]


def _segment_batches(lexicon, penalty):
    scores = dict(lexicon)

    def of(w: str) -> float:
        return max([scores.get(w, 0.0), *[scores.get("^" + w[:k], 0.0) for k in PREFIXES if len(w) > k]], key=lambda s: (abs(s), s))

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            n, segs = [], []
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                words = WORD.findall((t or "").lower())
                for w in set(words):
                    if w not in known:
                        known[w] = of(w)
                hits = [i for i, w in enumerate(words) if known[w]]
                n.append(len(words))
                segs.append([{"first": a, "last": b, "score": s} for a, b, s in maximal_segments(hits, [known[words[i]] for i in hits], penalty)])
                if len(known) > 500_000:
                    known = {}
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(segs, kind)], ["doc_id", "words", "segments"])

    return run


def _joined_batches(penalty):
    def run(batches):
        for batch in batches:
            hits = batch.column(batch.schema.get_field_index("hits")).to_pylist()
            segs = [[{"first": a, "last": b, "score": s} for a, b, s in maximal_segments([h["pos"] for h in x], [h["score"] for h in x], penalty)] for x in hits]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
            names = ["doc_id", "words"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(segs, kind)], [*names, "segments"])

    return run


SEGMENTS = "doc_id bigint, words bigint, segments array<struct<first:int,last:int,score:double>>"


def find_segments(docs: DataFrame, lexicon: DataFrame, penalty: float, broadcast_features: int = BROADCAST_FEATURES) -> DataFrame:
    """(doc_id, words, segments) of every text. A lexicon beyond the bound is joined to the distinct words, and these
    to the words of the texts; only what was hit is scanned."""
    if lexicon.count() <= broadcast_features:
        rows = [(r.f, r.score) for r in lexicon.collect()]
        return cut(docs.mapInArrow(_segment_batches(rows, penalty), SEGMENTS))
    # letters as in WORD
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), F.lit(0))
    keyed = docs.select("doc_id", "text", *row_key("text"))
    tokens = cut(keyed.dropDuplicates(["k1", "k2"]).select("k1", "k2", F.posexplode(words).alias("pos", "w")))
    counts = tokens.groupBy("w").agg(F.count("*").alias("n"))
    features = F.array_compact(F.array(F.col("w"), *[F.when(F.length("w") > k, F.concat(F.lit("^"), F.substring("w", 1, k))) for k in PREFIXES]))
    scored = counts.select("w", "n", F.explode(features).alias("f")).join(lexicon, "f").groupBy("w").agg(F.first("n").alias("n"), F.max(F.struct(F.abs("score"), "score"))["score"].alias("score"))
    hits = join_salted(tokens, cut(scored), ["w"], "n").groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("hits"))
    none = F.array().cast("array<struct<pos:int,score:double>>")
    met = keyed.select("doc_id", "k1", "k2", F.size(words).cast("long").alias("words")).join(hits, ["k1", "k2"], "left").select("doc_id", "words", F.coalesce("hits", none).alias("hits"))
    return cut(met.mapInArrow(_joined_batches(penalty), SEGMENTS), used=[tokens])


def fit_tail(clean: DataFrame) -> tuple[float, float]:
    """K, rate of the number K * words * exp(-rate * s) of segments of score s or more in clean texts.

    Peaks over a threshold: the excess over the upper quartile of the texts' greatest scores is taken as exponential.
    With fewer than ten segments above it, all segments count.
    """
    scores = F.col("segments.score")
    over = clean.agg(F.percentile_approx(F.array_max(scores), 0.75, 10_000).alias("u"), F.min(F.array_min(scores)).alias("least"), F.sum("words").alias("words")).first()
    n = 0
    for u in (over.u, over.least):
        if u is not None and n <= 10:
            beyond = F.filter(scores, lambda x: x > F.lit(float(u)))
            t = clean.agg(F.sum(F.size(beyond)).alias("n"), F.sum(F.aggregate(beyond, F.lit(0.0), lambda a, x: a + x - F.lit(float(u)))).alias("excess")).first()
            n, excess, at = t.n or 0, t.excess or 0.0, float(u)
    if n <= 10:
        return max(n, 0.5) / max(over.words or 0, 1), 1.0
    rate = n / max(excess, 0.05 * n)
    return n * math.exp(min(rate * at, 50.0)) / max(over.words or 0, 1), rate


def fit_logistic(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a + b x))) for counts of both labels at each x; a little ridge keeps it finite."""
    a, b, n = math.log((pos.sum() + 1) / (neg.sum() + 1)), 0.0, pos + neg
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(pos - n * p).sum() - 0.01 * a, (x * (pos - n * p)).sum() - 0.01 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
    return a, b


def score_toxicity(docs: DataFrame, labels: DataFrame, penalty: float = 0.1, broadcast_features: int = BROADCAST_FEATURES) -> DataFrame:
    """(doc_id, held_out, words, passages, evidence, score, predicted): a row for each row of docs.

    Labels (doc_id, toxic) are learnt from where held_out() is false. Words score the entry of the learnt
    lexicon that fits them and is furthest from 0, others cost `penalty`; every maximal segment is found in one scan of the whole
    text. In clean training texts, a segment of score s or more occurs about K * words * exp(-rate * s) times;
    K and rate are fitted to the tail of their segments (see fit_tail). passages: array<struct<first, last, score, surprise>>,
    the segments with surprise = rate * s - ln(K * words) above 0; evidence is the sum of surprises; a logistic
    curve over binned evidence of training texts gives score, and predicted is 1 from 0.5 on.

    Null and empty texts have no words and evidence 0. Null ids aren't held out and not trained on. An id with
    several labels counts with its largest; without labels the score is 0.5 and below. Repeated rows stay.
    """
    df = docs.select("doc_id", "text")
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("lid")).agg(F.max("toxic").alias("toxic")).filter(~held_out("lid"))
    marks = cut(marks)
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    lexicon = learn_lexicon(df.join(marks, F.col("doc_id") == F.col("lid")).select("doc_id", "text", "toxic").filter("text IS NOT NULL"))
    found = find_segments(df, lexicon, penalty, broadcast_features)
    train = found.join(marks, F.col("doc_id") == F.col("lid")).select("words", "segments", "toxic")
    big_k, rate = fit_tail(train.filter("toxic = 0"))
    surprise = F.expr(f"""filter(transform(segments, x -> named_struct('first', x.first, 'last', x.last, 'score', x.score,
        'surprise', {rate}D * x.score - ln({big_k!r}D * greatest(words, 1)))), x -> x.surprise > 0)""")
    evidence = F.aggregate("passages", F.lit(0.0), lambda t, x: t + x.surprise)
    bins = train.withColumn("passages", surprise).groupBy(F.least(F.floor(evidence / BIN), F.lit(BINS)).alias("bin")).agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).collect()
    if bins:
        x, pos, neg = (np.array([float(r[i]) for r in bins]) for i in range(3))
        a, b = fit_logistic(x * BIN, pos, neg)
    else:
        a, b = 0.0, 0.0
    out = found.withColumn("passages", surprise).withColumn("evidence", evidence)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.least(F.col("evidence"), F.lit(BINS * BIN)))))
    return out.select("doc_id", held_out().alias("held_out"), "words", "passages", "evidence", score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_toxicity(spark, sf_dir):
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    passages = F.array_join(F.transform("passages", lambda x: F.concat_ws(":", x["first"], x["last"])), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", passages.alias("passages"))
