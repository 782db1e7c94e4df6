"""Main text, spelling variants and phrases against brute force, and their edge cases."""

import binascii
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postwright.llm import pagetext, phrases, spelling

BIG = (1 << 53) + 1
PAGES = {
    "divs": ("""<html><body class="has-sidebar"><div id="top-nav"><a href=/>Home</a> <a href=/x>News of the day</a></div>
        <div class="cookie-notice"><p>We use small files to make this page work as you would expect it to, and to count how many readers come back to us each month.</p></div>
        <div id="content"><h1>A title &amp; more</h1><p>First   part<br>goes on, with &lt;tags&gt; and a <a href=x>link</a>.</p><p>Short.</p>
        <script>var a = "<p>no</p>";</script><style>p{}</style><p>caf&eacute; &#x4e2d;</p></div>
        <div class="sidebar"><p>Something that stands beside the text and has nothing to do with it, however long it may be for a reader.</p></div>
        <section id="comments"><div class="comment-body">I think that all of this is wrong, and I will say so at length here, with many words.</div></section>
        <form action=/s><label>Search</label><input name=q><button>Go</button></form><footer>About us</footer></body></html>""",
        "A title & more\nFirst part goes on, with <tags> and a link.\nShort.\ncafé 中"),
    "header": ("<header><h1>Site</h1></header><main><article><header><h1>Real</h1></header><p>One<p>Two<aside>not this</aside><p>Three</article></main>", "Real\nOne\nTwo\nThree"),
    "broken": ("<article><p title=\"a>b\">x < y</p><p>open <b>bold<p>next <!-- c > --> one</article><nav><p>menu", "x < y\nopen bold\nnext one"),
    "form around all": ("<form id=aspnet><nav><a>x</a></nav><main><p>The text.</p></main></form>", "The text."),
    "advert": ("<article><p>a</p><div class='post-ad'>buy now</div><div class=article-comments>no</div><p>b</p></article><div hidden>c</div>", "a\nb"),
    "plain": ("<div><a>One</a></div><div><a>Two</a></div><div>" + "word " * 40 + "</div><div>few words</div><div>" + "more " * 50 + "</div><div><a>Three</a></div>", "word " * 39 + "word\nfew words\n" + "more " * 49 + "more"),
}


def test_main_text_of_pages(spark):
    rows = [(i, h, 7) for i, (h, _) in enumerate(PAGES.values())] + [(None, None, 1), (BIG, "", 2), (BIG, "", 2), (99, "<" * 50, 3), (98, "<nav>" * 3000 + "x", 4)]
    made = pagetext.main_text(spark.createDataFrame(rows, "page_id long, html string, words int"))
    assert made.columns == ["page_id", "html", "words", "text", "n_chars"]
    got = {(r.page_id, r.words): (r.text, r.n_chars) for r in made.collect()}
    for i, (name, (_, want)) in enumerate(PAGES.items()):
        assert got[i, 7] == (want, len(want)), name
    assert got[None, 1] == got[BIG, 2] == got[98, 4] == ("", 0)
    assert made.count() == len(rows) and pagetext.main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_main_text_of_long_pages_is_whole():
    page = "<article>" + "".join(f"<p>part {i} <a>x</a>" for i in range(60_000)) + "</article>"
    found = pagetext.blocks_of(page)
    assert len(found) == 60_000 and found[-1][0] == "part 59999 x" and found[-1][1:3] == (3, 1)
    assert pagetext.blocks_of("<a <b" * 200_000)[0][0].startswith("<a <b")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap!-\"'= x&;é\n", max_size=60))
def test_any_markup_is_read(page):
    for text, words, linked, *_ in pagetext.blocks_of(page):
        assert text and text == " ".join(text.split()) and 0 <= linked <= words


def test_the_tree_agrees_with_its_table(spark):
    """The column made from the tree's text gives what the labels say, but for a few blocks."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    blocks = pagetext.labelled_blocks(spark)
    part, order = F.struct("words", "linked", "frame", "main", "form", "heading"), Window.partitionBy("page").orderBy("at")
    seen = blocks.select("kept", part.alias("o"), F.lag(part).over(order).alias("b"), F.lead(part).over(order).alias("a"))
    said = seen.select("kept", pagetext.tree_expression(pagetext.train_tree(blocks), pagetext._features(F.col("b"), F.col("o"), F.col("a"))).alias("said")).collect()
    assert sum(bool(r.kept) == r.said for r in said) >= 0.93 * len(said)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_force(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v.encode()), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("letters,groups", [("abàÿ×", 6), ("ab", 3), ("etaoinshr", 5)])
def test_variants_against_all_pairs(spark, letters, groups, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 5)
    rnd = random.Random(len(letters))
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(7, 10))): rnd.choice([2, 3, 25, 300, 4000]) for _ in range(400)}
    words |= {"x" * 5000: 9, "x" * 4999: 200, "x" * 2500 + "y" + "x" * 2499: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, groups=groups).collect()}
    assert got == variants_by_force(words)
    assert spelling.variants(df.limit(0)).count() == 0


def test_misspelt_words_and_the_query_on_a_fixture(spark, tmp_path):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(5, 10))) for _ in range(60)]
    rows = [(rnd.choice([None, BIG, 1, 2, i]), " ".join(rnd.choice(base).title() + rnd.choice(["", ",", "1", " Ā"]) for _ in range(rnd.randrange(0, 40))), "en", "n") for i in range(80)]
    rows += [(5, None, "en", "n"), (6, "", None, "n"), (7, "É" * 30_000, "de", "n"), (7, "É" * 30_000, "de", "n"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, word string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for key, text, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = binascii.crc32(f"{'' if key is None else key}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.misspelt_words(df).collect()} == words
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == variants_by_force(words)


def test_summaries_lack_little_in_any_order():
    rnd = np.random.default_rng(1)
    for least in (7, 30):
        data = np.concatenate([rnd.zipf(1.3, 40_000) % 5000, np.repeat(np.arange(10_000, 10_010), least)]).astype(np.uint64)
        rnd.shuffle(data)
        capacity = len(data) // least + 1
        parts = [phrases.Summary(capacity) for _ in range(8)]
        for s, piece in zip(parts, np.array_split(data, 8), strict=True):
            for few in np.array_split(piece, 9):
                s.merge(*np.unique(few, return_counts=True))
            s.settle()
        whole = phrases.Summary(capacity)
        for s in rnd.permutation(8):
            whole.merge(parts[s].keys, parts[s].counts)
            whole.lacks += parts[s].lacks
        whole.settle()
        exact, kept = Counter(data.tolist()), dict(zip(whole.keys.tolist(), whole.counts.tolist(), strict=True))
        assert whole.lacks < least and len(kept) <= capacity
        assert all(kept.get(k, 0) >= n - whole.lacks for k, n in exact.items() if n >= least)
        assert all(n <= exact[k] for k, n in kept.items())


def phrases_by_force(rows, least, longest, top, absorbed=80):
    f, n = Counter(), Counter()
    for text, lang in rows:
        low, g = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""), "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[g] += len(w)
            f.update((g, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    known = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = Counter()
    for (g, w), v in known.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[g, w[i : i + k]] = max(inside[g, w[i : i + k]], v)
    out = []
    for (g, w), a in known.items():
        if 100 * inside[g, w] >= absorbed * a:
            continue
        score, _, l, r = min((int(Fraction(2_000_000 * a, f[g, w[:k]] + f[g, w[k:]])), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
        out.append((g, " ".join(w), a, l, r, n[g], score))
    made = []
    for g in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == g), key=lambda x: (-x[6], -x[2], x[1].encode()))
        made += [(x[0], i + 1, *x[1:]) for i, x in enumerate(mine[:top])]
    return sorted(made)


def fixture_rows(seed):
    rnd = random.Random(seed)
    words = ["The", "of", "an", "É", "中", "x-1", "a\tb", "\U0001f600", "Straße"]
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", "  ", ", ", "\n", " ", "\t", "\x0b", " \xa0 "]) for _ in range(rnd.randrange(0, 60))), rnd.choice(["en", "de", None, ""])) for _ in range(120)]
    return rows + [(None, "en"), ("", None), ("solo", None), ("one two three four five " * 3000, "long"), rows[0]]


@pytest.mark.parametrize("least,top", [(5, 2000), (30, 40), (1, 50)])
def test_phrases_against_brute_force(spark, least, top, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 512)  # texts are cut between pieces
    rows = fixture_rows(least)
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(df, least=least, top=top).collect())
    assert got == phrases_by_force(rows, least, 4, top)


def test_no_documents_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_sql_of_phrases_on_a_fixture(spark, tmp_path):
    rows = [(i, t, g) for i, (t, g) in enumerate(fixture_rows(9))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.op13_phrases(spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(phrases.ORACLE_SQL).fetchall()) and got
