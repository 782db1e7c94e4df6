"""Main text of web pages: flat text blocks, judged by word count and link density of the block and its neighbours.

A page is cut into blocks at block-level tags. A decision tree, trained on a small labelled table of blocks, keeps or
drops each one by its own and its neighbours' words and links, and by what encloses it. The tree is turned into one
column expression, so that Python only splits the markup.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

# Fixed values of HTML: elements without an end, without text of the page, inside a line, and of headings.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title svg math iframe object select datalist textarea button audio video canvas".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A new one of these ends an open one of the same kind (their ends may be left out).
SELF_ENDING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
#: Elements and roles of a page's frame, and of its main part.
FRAME_TAGS, FRAME_ROLES = {"nav", "aside", "footer", "dialog", "menu"}, set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
#: Parts of class and id names: those that begin or are so name the frame, those that are so the main part.
FRAME_STARTS = tuple("advert sponsor promo sidebar navbar navigation breadcrumb cookie consent newsletter subscri signup comment disqus social share sharing related recommend trending banner masthead footer menu popup modal overlay pagin copyright disclaimer notif alert".split())
FRAME_WORDS = set("ad ads adv nav header topbar toolbar notice notices gdpr login search form widget widgets discussion feedback reply replies respond responses tags byline meta skip bottombar aside foot toc".split())
MAIN_WORDS = set("article content main post entry story text body maincontent".split())
#: Before such a part a name tells of the layout, not of its element; these parts beside a main one hold its title.
LAYOUT, TITLES = {"has", "with", "no", "without", "is"}, {"header"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
_BARE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b")
_SPACE = re.compile(r"[\s ]+")

BLOCK = "text string, words int, linked int, frame boolean, main boolean, form boolean, heading boolean"


def _names(attributes: str) -> dict[str, str]:
    if "=" not in attributes and "hidden" not in attributes:
        return {}
    return {(k or h).lower(): unescape(v.strip("\"'")) for k, v, h in _ATTRIBUTE.findall(attributes)}


def _sides(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is of the frame, and of the main part, by its tag, role, class and id; both at once is neither."""
    if not attributes:
        return tag in FRAME_TAGS, tag in MAIN_TAGS
    have = _names(attributes)
    role, frame, main = have.get("role", "").lower(), False, False
    for name in f"{have.get('class', '')} {have.get('id', '')}".split() if tag not in ("html", "body") else []:
        parts = re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if not LAYOUT.isdisjoint(parts):
            continue
        framing = {x for x in parts if x in FRAME_WORDS or x.startswith(FRAME_STARTS)}
        of_main = not MAIN_WORDS.isdisjoint(parts)
        frame |= bool(framing - TITLES if of_main else framing)
        main |= of_main and not framing
    if tag in FRAME_TAGS or role in FRAME_ROLES or "hidden" in have or have.get("aria-hidden") == "true" or "display:none" in have.get("style", "").replace(" ", ""):
        return True, False
    return frame and not main, (main or tag in MAIN_TAGS or role in MAIN_ROLES) and not frame


def blocks_of(html: str) -> list[tuple]:
    """The text blocks of a page in order, as BLOCK has them: words, those inside links, and what encloses them."""
    out: list[tuple] = []
    stack: list[tuple] = []  # (tag, frame, main, form, heading, silent)
    piece: list[str] = []
    link: list[int] = []  # the depth at which a link stands open
    open_tags: Counter[str] = Counter()
    state, linked, at, size = (False,) * 5, 0, 0, len(html)

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not state[4]:
            raw = unescape(raw) if "&" in raw else raw
            piece.append(raw)
            if link:
                linked += len(raw.split())

    def flush() -> None:
        nonlocal linked
        if piece:
            said = _SPACE.sub(" ", "".join(piece)).strip()
            if said:
                n = said.count(" ") + 1
                out.append((said, n, min(linked, n), *state[:4]))
            piece.clear()
        linked = 0

    last_end = html.rfind(">")
    while at < size:
        open_ = html.find("<", at)
        if open_ < 0 or open_ > last_end:
            text(html[at:])
            break
        text(html[at:open_])
        m = _TOKEN.match(html, open_) or _BARE.match(html, open_)
        if m is None:  # a lone `<`
            text("<")
            at = open_ + 1
            continue
        at = m.end()
        if m.lastindex is None or not m[2]:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "a":
            link[:] = [] if closing else [len(stack)]
        if tag in ("br", "wbr"):
            piece.append(" " if tag == "br" else "")
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID or tag in INLINE:
            continue
        if closing:
            if open_tags[tag]:  # an end without its start counts for nothing
                while (last := stack.pop()[0]) != tag:
                    open_tags[last] -= 1
                open_tags[tag] -= 1
            if link and link[0] > len(stack):
                link.clear()  # an open link ends with the element that holds it
            state = stack[-1][1:] if stack else (False,) * 5
            continue
        if tag in SELF_ENDING and stack and stack[-1][0] == tag:
            open_tags[stack.pop()[0]] -= 1
            state = stack[-1][1:] if stack else (False,) * 5
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, at)
            at = size if end is None else html.find(">", end.start()) + 1 or size
            continue
        frame, main = _sides(tag, m[3])
        frame = state[0] and tag != "main" or frame or tag == "header" and not state[1]
        form = state[2] and not main or tag in ("form", "fieldset")  # some pages are one form around the main part
        open_tags[tag] += 1
        stack.append((tag, frame, not frame and (state[1] or main), form, tag in HEADINGS, state[4] or tag in SILENT))
        state = stack[-1][1:]
    flush()
    return out


def _split(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in pages:
        yield s.map(lambda h: [dict(zip(_FIELDS, b, strict=True)) for b in blocks_of(h)])


_FIELDS = [f.split()[0] for f in BLOCK.split(", ")]

#: The labelled table: pages as rows of blocks, `kind words linked kept`, kinds: - plain, f frame, m main, o form, h heading.
LABELLED = """
f 5 5 0|f 4 4 0|f 9 0 0|mh 7 0 1|m 45 0 1|m 1 0 1|m 2 0 1|m 30 4 1|m 3 0 1|f 12 1 0|f 6 6 0
f 1 1 0|f 30 0 0|mh 4 0 1|m 3 0 1|m 12 0 1|mh 2 0 1|m 80 6 1|m 2 2 1|m 5 0 1|f 40 0 0|f 25 2 0|f 3 0 0
f 2 2 0|m 60 0 1|m 8 0 1|m 4 0 1|m 110 2 1|mo 6 0 0|mo 2 0 0|mo 45 0 0|f 18 0 0|f 55 0 0
f 8 0 0|mh 9 0 1|m 1 0 1|m 2 0 1|m 1 0 1|m 6 0 1|f 14 3 0|f 2 2 0
- 1 1 0|- 1 1 0|- 2 2 0|- 1 1 0|-h 6 0 1|- 48 0 1|- 37 3 1|-h 3 0 1|- 90 11 1|- 20 0 1|- 66 0 1|- 4 4 0|- 3 3 0|- 7 2 0
- 3 3 0|- 2 2 0|- 5 5 0|- 70 12 1|- 9 0 1|- 55 0 1|- 34 8 1|- 2 2 0|- 2 2 0|- 6 6 0|- 9 1 0
- 2 0 0|- 4 4 0|- 3 3 0|-h 8 0 1|- 130 25 1|- 14 0 1|- 64 0 1|-o 3 0 0|-o 2 0 0|-o 52 0 0|- 5 5 0|- 6 2 0
- 1 1 0|- 6 0 0|- 1 1 0|- 38 0 1|- 50 9 1|- 28 0 1|- 5 0 1|- 44 10 1|- 8 7 0|- 9 9 0|- 7 6 0|- 4 0 0|- 3 3 0
f 6 6 0|f 3 0 0|- 5 5 0|-h 5 0 1|- 42 2 1|- 7 0 1|- 61 14 1|f 70 0 0|f 33 1 0|f 8 8 0
f 1 1 0|f 20 0 0|mh 6 1 1|m 6 6 1|m 25 25 1|m 10 1 1|m 1 0 1|f 90 3 0|f 16 0 0|f 5 0 0
- 1 1 0|- 1 1 0|- 12 10 0|- 40 0 1|- 3 0 1|- 60 15 1|- 18 0 1|- 85 0 1|- 11 8 0|- 24 20 0|- 30 26 0
f 3 3 0|mh 5 0 1|m 2 0 1|m 4 0 1|f 9 0 0|m 3 0 1
mh 3 0 1|m 20 1 1|m 4 0 1|m 1 0 1
f 2 0 0|m 14 0 1|m 1 0 1|m 6 0 1|f 11 0 0|m 2 0 1
- 1 1 0|- 1 1 0|- 8 0 0|-h 7 0 1|- 50 0 1|- 4 0 1|- 46 0 1|- 33 0 1|- 12 0 0|- 5 0 0|- 9 0 0
- 5 0 0|- 2 2 0|- 2 2 0|- 10 0 0|-h 9 0 1|- 28 0 1|- 75 0 1|- 8 0 0|- 6 0 0|- 3 3 0|- 7 0 0
- 2 2 0|- 3 0 0|-h 3 0 1|- 40 0 1|- 58 2 1|- 11 0 1|- 35 0 1|- 4 0 0|- 6 0 0|- 3 0 0
- 4 3 0|- 6 4 0|-h 4 0 1|- 31 5 1|- 52 0 1|- 47 6 1|- 2 0 1|- 39 0 1|- 5 4 0|- 4 2 0|- 2 0 0
"""


def labelled_blocks(spark: SparkSession, table_: str = LABELLED) -> DataFrame:
    """(page, at, words, linked, frame, main, form, heading, kept) of the labelled table."""
    rows = []
    for page, line in enumerate(table_.strip().splitlines()):
        for at, cell in enumerate(line.split("|")):
            kind, words, linked, kept = cell.split()
            rows.append((page, at, int(words), int(linked), "f" in kind, "m" in kind, "o" in kind, "h" in kind, int(kept)))
    return spark.createDataFrame(rows, "page int, at int, words int, linked int, frame boolean, main boolean, form boolean, heading boolean, kept int")


def _features(before: Column, own: Column, after: Column) -> dict[str, Column]:
    """What the tree sees of a block: word counts and link densities of it and its neighbours (0 where there is none)."""
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    density = lambda b: F.coalesce(b["linked"] / F.nullif(b["words"], F.lit(0)), F.lit(0.0))
    near = {f"{k}_{side}": f(b) for side, b in (("before", before), ("own", own), ("after", after)) for k, f in (("words", lambda b: number(b["words"])), ("density", density))}
    return near | {k: number(own[k]) for k in ("frame", "main", "form", "heading")}


def train_tree(blocks: DataFrame, depth: int = 6) -> str:
    """The debug text of a decision tree trained on labelled_blocks() or a table like it. The table must be small: a tree
    is fitted to all of it."""
    order = Window.partitionBy("page").orderBy("at")
    part = F.struct("words", "linked", "frame", "main", "form", "heading")
    rows = blocks.select("kept", part.alias("own"), F.lag(part).over(order).alias("before"), F.lead(part).over(order).alias("after"))
    seen = _features(F.col("before"), F.col("own"), F.col("after"))
    rows = VectorAssembler(inputCols=list(seen), outputCol="features").transform(rows.select("kept", *[c.alias(k) for k, c in seen.items()]))
    return DecisionTreeClassifier(labelCol="kept", maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=1).fit(rows.repartition(1)).toDebugString


def tree_expression(debug: str, seen: dict[str, Column]) -> Column:
    """The tree as one column: true where it predicts 1."""
    lines = [x.strip() for x in debug.splitlines()[1:] if x.strip()]
    names = list(seen)

    def read(i: int) -> tuple[Column, int]:
        if lines[i].startswith("Predict"):
            return F.lit(float(lines[i].split()[1]) >= 0.5), i + 1
        feature, limit = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", lines[i]).groups()
        low, i = read(i + 1)
        high, i = read(i + 1)  # past the line of `Else`
        return F.when(seen[names[int(feature)]] <= float(limit), low).otherwise(high), i

    return read(0)[0]


def main_text(pages: DataFrame, html: str = "html", tree: str | None = None) -> DataFrame:
    """Add text and n_chars: the kept blocks of each page in order, joined by line ends, and its code points.

    A null or empty page, or one without a block that is kept, has an empty text. Character references are decoded and
    white space inside a block is one space. Markup may be broken: ends may lack, quotes stay open, a lone `<` is text.
    Pages are read whole, whatever their length. Columns text and n_chars of pages are replaced, others stay; repeated
    rows stay; no pages, no rows.
    """
    tree = tree or train_tree(labelled_blocks(pages.sparkSession))
    split = F.pandas_udf(_split, f"array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>")
    some = pages.withColumn("pt__b", split(F.coalesce(F.col(html), F.lit(""))))
    beside = lambda i: F.get(F.col("pt__b"), i)
    kept = F.filter("pt__b", lambda b, i: tree_expression(tree, _features(beside(i - 1), b, beside(i + 1))))
    made = some.withColumn("text", F.array_join(F.transform(kept, lambda b: b["text"]), "\n")).drop("pt__b")
    return made.withColumn("n_chars", F.length("text").cast("long"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
