"""The tokenizer in built-in functions against the standard library's parser."""

import random
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import functions as F

from postwright.functions import html, text

PAGES = "/root/testdata/sf0.001/pages.parquet"


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in html.BREAK_TAGS:
            self.out.append("\n")
        if tag not in html.VOID_TAGS:
            quoted = any(k == "class" and v and any(m in v.lower() for m in html.QUOTE_CLASSES) for k, v in attrs)
            self.hidden.append(quoted or tag in html.HIDDEN_TAGS or bool(self.hidden and self.hidden[-1]))

    def handle_endtag(self, tag):
        if tag not in html.VOID_TAGS and self.hidden:
            self.hidden.pop()

    def handle_data(self, data):
        if not (self.hidden and self.hidden[-1]):
            self.out.append(data)


def visible(page):
    if page is None or "<" not in page or ">" not in page:
        return page
    parser = Visible()
    parser.feed(page)
    return unescape("".join(parser.out))


def random_pages(n):
    rnd = random.Random(12)
    bits = ["<p>", "</p>", "<div>", "</div>", "<br>", "<br/>", "<blockquote>", "</blockquote>", '<div class="gmail_quote x">', "<span class='a'>", "</span>", "<img src=x>", "<div/>", "<h1>", "</h1>", "</br>", "<td>", "word ", "a&amp;b ", "&amp;lt; ", "&#233;", "&#x4e2d; ", "&copy ", "&notit; ", "&bogus; ", " < 3 ", "x > y ", "\n", "<!-- c -->", "<!DOCTYPE html>", '<a title="1 > 0" href=y>', "</a>", "<script>if (a < b) {}</script>", "<style>p > a {}</style>", "<P CLASS=Yahoo_Quoted>", "é ", "&#128; ", "&#0; ", "&#xD800; ", "&#8; "]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) + " end" for _ in range(n)]


def test_html_against_a_parser(spark):
    pages = [r.html for r in spark.read.parquet(PAGES).collect()] + random_pages(600) + [None, "", "plain & text", "a <b", "x > y", "mail <a@b.c> now", "<p>" * 400 + "deep", "<p>one</p> and <b unclosed", "<p>R&D", "<blockquote>" + "<i>x</i>" * 300 + "</blockquote>after", "<p>&#99999999999;</p> ok", "</div></div><p>up</p> ok"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, page string")
    got = {r.i: r.out for r in df.select("i", text.strip_html("page").alias("out")).collect()}
    assert [(pages[i], got[i]) for i in range(len(pages)) if got[i] != visible(pages[i])][:3] == []
    plan = df.select(text.strip_html("page"))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan


def test_long_pages_are_whole(spark):
    page = "".join(f"<p>part {i} &amp; <i>x</i>" for i in range(20_000)) + " "
    got = spark.createDataFrame([(page,)], "page string").select(F.md5(text.strip_html("page")), F.length(text.strip_html("page"))).first()
    want = visible(page)
    import hashlib

    assert got[1] == len(want) and got[0] == hashlib.md5(want.encode()).hexdigest()
