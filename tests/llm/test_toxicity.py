"""Toxic passages against plain statements: the recursive definition of maximal segments, log-odds counted by hand."""

import math
import random
from collections import Counter

from postwright.llm import toxicity


def by_definition(scores, first=0):
    """The segment of the greatest sum, then the same on both sides of it, while sums are above 0."""
    best = max(((sum(scores[a:b]), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    total, _, a, b = best
    return by_definition(scores[:a], first) + [(first + a, first + b - 1, total)] + by_definition(scores[b:], first + b)


def test_all_maximal_segments_of_signed_scores(rounds=300):
    rnd = random.Random(5)
    for _ in range(rounds):
        scores = [rnd.choice([-0.4, rnd.uniform(-3, 0), rnd.uniform(0, 2)]) for _ in range(rnd.randrange(0, 28))]
        hits = [i for i, s in enumerate(scores) if s != -0.4]
        got = toxicity.maximal_segments(hits, [scores[i] for i in hits], 0.4)
        want = by_definition(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert toxicity.maximal_segments([0, 4], [-1.0, -2.0], 0.1) == [] == toxicity.maximal_segments([], [], 0.1)


def log_odds(rows, prior, least_z, least_count):
    texts = {}
    for text, toxic in rows:
        texts.setdefault(text, []).append(toxic)
    counts = {0: Counter(), 1: Counter()}
    for text, marks in texts.items():
        label = int(2 * sum(marks) >= len(marks))
        for w in set(toxicity.WORD.findall(text.lower())):
            counts[label].update(["", w, *["^" + w[:k] for k in toxicity.PREFIXES if len(w) > k]])
    clean, bad = counts[0], counts[1]
    out = {}
    for f in set(clean) | set(bad):
        t, c = bad[f], clean[f]
        if f and t + c >= least_count:
            a = 1 + prior * (t + c) / (bad[""] + clean[""])
            d = math.log((t + a) / (bad[""] + prior + 1)) - math.log((c + a) / (clean[""] + prior + 1))
            e = math.sqrt(1 / (t + a) + 1 / (c + a))
            if abs(d) >= least_z * e:
                out[f] = math.copysign(min(abs(d) - e, toxicity.MOST_SCORE), d)
    return out


def test_lexicon_of_both_signs_against_counts(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 5))) for _ in range(60)]
    rows = []
    for i in range(400):
        toxic = int(i % 4 == 0)
        some = [rnd.choice(words) for _ in range(12)] + (["vilest", "vile"] if toxic and rnd.random() < 0.9 else ["gentle"] if rnd.random() < 0.9 else [])
        rows.append((" ".join(some).title() if i % 3 else " ".join(some), toxic))
    rows += rows[:40]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, toxic int")
    for least_z in (4.0, 1.0):
        got = {r.f: r.score for r in toxicity.learn_lexicon(df, least_z=least_z).collect()}
        want = log_odds(rows, 200.0, least_z, 5)
        assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)
        assert got["vile"] > 0 > got["gentle"]


def test_both_ways_of_meeting_a_signed_lexicon_agree(spark):
    lexicon = spark.createDataFrame([("vile", 2.0), ("^gent", -1.5), ("gently", 1.0), ("^vile", -3.0), ("so", 0.5)], "f string, score double")
    texts = ["so vile so vile", "gentle vile", "gently vile", "vilest so so", "so gentlest so", "", None, "so " * 2000, "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sent, joined = ({r.doc_id: (r.words, [(s["first"], s["last"], round(s["score"], 9)) for s in r.segments]) for r in toxicity.find_segments(df, lexicon, 0.1, most).collect()} for most in (100, 0))
    assert sent == joined
    assert sent[1] == (2, [(1, 1, 2.0)]) and sent[2] == (2, [(1, 1, 2.0)])  # of 'gently' the entry furthest from 0 counts, as for 'gentle'
    assert sent[3] == (3, [(1, 2, 1.0)]) and sent[4] == (3, [(0, 0, 0.5), (2, 2, 0.5)]) and sent[7] == (2000, [(0, 1999, 1000.0)])
    assert sent[5] == sent[6] == (0, [])
