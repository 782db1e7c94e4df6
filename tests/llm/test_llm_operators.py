"""The other operators against brute force on small tables."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postwright.llm import ann, decontaminate, linededup, mixing, neardup, quality, toxicity, urlfilter


def text_of(rnd, n, vocab=4000):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


def test_nearest_vectors_with_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [1.0, None] * 4), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, df.filter("vec_id % 50 = 0"), centroids=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and i < 2000}
    for q in [i for i in good if i % 50 == 0]:
        want = sorted(((-round(float(good[q] @ v), 9), i) for i, v in good.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in want]
    assert ann.search(df.limit(0), df).count() == 0


def test_heap_visits_cells_by_summed_distance():
    d1, d2 = np.array([0.3, 0.1, 0.9]), np.array([0.2, 0.05])
    order = ann.multi_sequence(d1, d2, np.ones(6, dtype=int), 6)
    assert order == sorted(range(6), key=lambda c: d1[c // 2] + d2[c % 2])


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    wa, wb = rng.uniform(0.2, 5, 200), rng.uniform(0.2, 5, 200)
    s = neardup.dart_signatures(np.r_[ids, ids], np.r_[wa, wb], np.repeat([0, 1], 200), 2, 2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


@pytest.mark.parametrize("weighting", ["presence", "count"])
def test_near_duplicates(spark, weighting):
    rnd = random.Random(4)
    docs, n = [], 0
    for _ in range(25):
        base = text_of(rnd, 60).split()
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(60)] = f"e{rnd.randrange(10**6)}"
            docs.append((n, " ".join(w)))
            n += 1
    docs += [(n, docs[0][1].upper()), (n + 1, None), (n + 2, ""), (n + 3, "  "), (n + 4, "two words"), (n + 5, "two words"), (None, "two words")]
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    sets = {d: bag(t.lower().split()) if weighting == "count" else Counter(set(bag(t.lower().split()))) for d, t in docs if d is not None and t and t.strip()}
    parent = {d: d for d, _ in docs if d is not None}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in itertools.combinations(sets, 2):
        if (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total():
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit(1))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(df, weighting=weighting).collect() if r.doc_id is not None}
    assert got == {d: find(d) for d in parent}
    if weighting == "presence":
        kept = neardup.keep_one_of_each(df.unionByName(df.limit(3)))
        assert sorted(r.doc_id for r in kept.collect() if r.text and r.text.strip()) == sorted({find(d) for d in sets})
        assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_line_runs(spark):
    rnd = random.Random(5)
    for chunk in (50_000, 7):
        docs = [(i, "\n".join(rnd.choice(["", "x a", "b b", "c c c", "d d d d", "e", "l w", "k w"]) for _ in range(rnd.randint(0, 14)))) for i in range(60)] + [(60, None)]
        seen, gone = defaultdict(list), defaultdict(set)
        seqs = [(d, [(i, x.strip(" ")) for i, x in enumerate(t.split("\n")) if x.strip(" ")]) for d, t in docs if t is not None]
        for a, (d, lines) in enumerate(seqs):
            for p in range(len(lines)):
                best = 0
                for b, q in seen[lines[p][1]]:
                    other, n = seqs[b][1], 0
                    while p + n < len(lines) and q + n < len(other) and lines[p + n][1] == other[q + n][1]:
                        n += 1
                    best = max(best, n)
                seen[lines[p][1]].append((a, p))
                if best and sum(len(x.split()) for _, x in lines[p : p + best]) >= 4:
                    gone[d] |= set(range(lines[p][0], lines[p + best - 1][0] + 1))
        made = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").withColumn("removed", F.lit(0)), 4, chunk).collect()
        assert {r.doc_id: list(r.removed) for r in made} == {d: sorted(gone[d]) for d, _ in docs}
        assert {r.doc_id: r.text for r in made}[60] is None


def test_benchmark_leaks(spark):
    q = "A train from Boston travels 120 km in 3 hours. How far does the train from Boston travel in 7 hours at the same speed?"
    docs = [
        (1, "Before. " + q + " After it."), (2, q.replace("Boston", "Madrid").replace("120", "90").replace("7", "5")), (3, q.replace("from Boston travel in", "from Paris travel in")), (4, None), (5, ""), (6, text_of(random.Random(1), 80)),
    ]
    items = spark.createDataFrame([(1, q), (2, None), (3, "short one")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.changed) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {1: (1, False), 2: (1, True)}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df.withColumn("k1", F.lit(0)), items).collect()) == [3, 4, 5, 6]


def test_mixing_targets_and_budgets(spark):
    rnd = random.Random(6)
    docs = [(i, "w " * rnd.randrange(0, 40), rnd.choice(["a", "b", "c", None, "z"][: 1 + i % 5])) for i in range(400)] + [(None, None, "a")]
    rows = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert len(rows) == len(docs)
    size = Counter()
    for r in rows:
        size[r.source] += r.size
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, capped = sum(size.values()), {}, set()
    while True:
        free = total - sum(3 * size[s] for s in capped)
        target = {s: 3 * size[s] if s in capped else free * w[s] / sum(w[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if s not in capped and target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and r.taken <= 3 * r.size
    for s in order:
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 40
    again = mixing.mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in rows)


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/71", "http://example.com/en/1?x", "https://u.example.net/de/8#a", "https://example.net/de/1", "http://com/en/", "http://xcom/en/", "http://a.org/es/1", "http://spam-farm.x.y/", "http://myads.z/", "http://ads.z/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r.host, r.rule, r.verdict) for r in urlfilter.judge_urls(df, urlfilter.rule_table(spark)).orderBy("page_id").collect()]
    assert got[:3] == [("", None, "allow")] * 3
    assert got[3] == ("a.example.com", "example.com/en/7", "allow")
    assert [g[1:] for g in got[4:]] == [
        ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), (None, "allow"), ("org/es/", "block"), (None, "block"), (None, "allow"), (None, "block"),
    ]


def naive_kneser_ney(texts, order, alphabet):
    """p(symbol | history), interpolated modified Kneser-Ney, stated directly; texts are lists of symbols."""
    counts = {order: Counter(tuple(([0] * (order - 1) + t)[i : i + order]) for t in texts for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        d = [0.5, 1.0, 1.5]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        discount[k] = d
    after = defaultdict(list)
    for k, c in counts.items():
        for g, v in c.items():
            after[k, g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / alphabet
        k, below = len(g), p(g[1:])
        seen = after.get((k, g[:-1]))
        if not seen:
            return below
        off = lambda v: discount[k][min(v, 3) - 1]
        v = counts[k].get(g, 0)
        return ((v - off(v) if v else 0.0) + sum(map(off, seen)) * below) / sum(seen)

    return p


def test_perplexity_against_a_naive_model(spark):
    rnd = random.Random(7)
    words = ["mal", "tor", "vin", "sel", "ka", "ro", "den", "lu", "é", "😀"]
    good = lambda: " ".join("".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4))) for _ in range(60))
    docs = [(i, good(), "en") for i in range(120)] + [(500 + i, "#$%! XQZ " * 30, "en") for i in range(5)] + [(600, None, "en"), (601, "", None), (602, good(), "zz"), (None, good(), "en"), (0, None, None)]
    docs += docs[:2]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("fold", F.lit("clash"))
    ids = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    folds = {r.text: r.f for r in df.select("text", quality.fold_of("text", quality.FOLDS).alias("f")).collect()}
    symbol = lambda t: quality.symbols_of([t])[0].tolist()
    trusted = [t for d, t, _ in docs if d is not None and d < 100 and t]
    models = [naive_kneser_ney([symbol(t) for t in trusted if folds[t] != m], quality.ORDER, 256) for m in range(quality.FOLDS)]

    def perplexity(t):
        s, k = symbol(t), quality.ORDER
        p = models[folds[t]]
        return math.exp2(-sum(math.log2(p(tuple(([0] * (k - 1) + s)[i : i + k]))) for i in range(len(s))) / len(s))

    rows = quality.judge_quality(df, ids, bucket_chars=3_000).collect()
    assert Counter((r.doc_id, r.lang) for r in rows) == Counter((d, x) for d, _, x in docs)
    texts = defaultdict(list)
    for d, t, x in docs:
        texts[d, x].append(t)
    for r in rows:
        if r.perplexity is not None:
            assert any(t and abs(perplexity(t) - r.perplexity) < 1e-6 for t in texts[r.doc_id, r.lang])
    kept = {r.doc_id: r.keep for r in rows if r.perplexity is not None}
    assert all(kept[i] for i in [*range(120), 602, None]) and not any(kept[500 + i] for i in range(5))
    assert [r.keep for r in rows if r.perplexity is None] == [False] * 3
    assert quality.judge_quality(df.limit(0), ids).count() == 0
    assert all(r.keep == (r.perplexity is not None) for r in quality.judge_quality(df, ids.limit(0)).collect())


def test_segments_against_brute_force():
    rnd = random.Random(8)
    for _ in range(200):
        n = rnd.randrange(1, 15)
        scores = [rnd.choice([0, 0, 1.0, 2.0]) for _ in range(n)]
        at = [i for i, s in enumerate(scores) if s]
        full = [s or -0.7 for s in scores]
        got = toxicity.maximal_segments(at, [scores[i] for i in at], 0.7)
        if at:
            best = max(sum(full[i:j]) for i in range(n) for j in range(i + 1, n + 1))
            assert abs(max(x[2] for x in got) - best) < 1e-9
        assert all(abs(sum(full[a : b + 1]) - s) < 1e-9 for a, b, s in got)
        assert all(x[1] < y[0] for x, y in itertools.pairwise(got))


def test_toxicity_learns_from_the_allowed_rows_only(spark):
    rnd = random.Random(9)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        docs.append((i, text_of(rnd, 40).replace("w", "v") + (" you filthyword " + text_of(rnd, 5) if bad else ""), ))
        labels.append((i, int(bad)))
    df = spark.createDataFrame([*docs, (None, None), (9999, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score_toxicity(df, lab).collect()
    assert len(rows) == 602 and all(0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert test and sum(r.predicted == int(r.doc_id % 5 == 0) for r in test) >= 0.98 * len(test)
    joined = toxicity.score_toxicity(df, lab, broadcast_features=0).collect()
    assert sorted((str(r.doc_id), r.words, r.predicted, [tuple(p)[:2] for p in r.passages]) for r in joined) == sorted((str(r.doc_id), r.words, r.predicted, [tuple(p)[:2] for p in r.passages]) for r in rows)
