"""HTML to text in built-in functions: a tokenizer by one pattern, and a fold with a depth and a hidden level."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags and classes.
VOID_TAGS = ["br", "hr", "img", "meta", "input", "link", "area", "base", "col", "embed", "source", "track", "wbr"]
HIDDEN_TAGS = ["script", "style", "blockquote"]
QUOTE_CLASSES = ["gmail_quote", "gmail_extra", "yahoo_quoted", "moz-cite-prefix"]
BREAK_TAGS = ["br", "p", "div", "tr", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"]

#: An attribute's value may hold `>` in quotes; the pattern never goes back over what it has taken.
_START = r"<[A-Za-z](?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>"
#: In order: comment, declaration, end tag, start tag, a tag that never ends (with all behind it), text, a lone `<`.
_TOKEN = rf"(?s)<!--.*?--!?>|<(?!!--)[!?][^>]*>|</[^>]*>|{_START}|<[A-Za-z/!?].*|[^<]+|<"
_SILENT = r"(?is)(<(script|style)(?=[\s/>])[^>]*>).*?(?=</\2[\s/>]|\z)"
_CLASS = r"(?is)^class\s*=\s*[\"']?(.*?)[\"']?$"
_ATTRIBUTE = r"(?s)[^\s/>=\"']+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)"
_REFERENCE = r"(?s)&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"
#: Tokens of a step of the fold; arrays are copied once for each step, not for each token.
_CHUNK = 128


def _bind(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _character(code: Column) -> Column:
    """The text of a numeric reference: Windows-1252 for the C1 range, none for code points that no text holds."""
    as_text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    c1 = {i: bytes([i]).decode("cp1252", errors="ignore") or chr(i) for i in range(0x80, 0xA0)}
    table = F.create_map(*[F.lit(x) for kv in c1.items() for x in kv])
    never = code.between(1, 8) | code.isin(0x0B, 0x7F) | code.between(0x0E, 0x1F) | code.between(0xFDD0, 0xFDEF) | (F.shiftright(code, 1) % 0x8000 == 0x7FFF)
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return F.when(bad, "�").when(code.between(0x80, 0x9F), F.element_at(table, code.cast("int"))).when(never, "").otherwise(as_text)


def decode_references(c: Column) -> Column:
    """Character references to characters, once: decimal, hexadecimal and named ones, these also without `;` where HTML has it so."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def named(t: Column) -> Column:
        name = F.substring(t, 2, 100)
        ends = F.sequence(F.length(name) - 1, F.lit(2), F.lit(-1))
        shorter = F.filter(F.when(F.length(name) > 2, ends).otherwise(F.array().cast("array<int>")), lambda n: F.map_contains_key(names, F.left(name, n)))
        at = F.get(shorter, F.lit(0))
        return F.coalesce(F.try_element_at(names, name), F.concat(F.try_element_at(names, F.left(name, at)), F.substring(name, at + 1, F.length(name))), t)

    def numeric(t: Column) -> Column:
        digits = F.regexp_extract(t, "([0-9a-fA-F]+);?$", 1)
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        base = F.when(t.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(short)
        return _bind(F.when(F.length(short) > 9, F.lit(0x110000)).otherwise(base.cast("long")).cast("int"), _character)

    def each(t: Column) -> Column:
        return F.when(t.startswith("&#") & (F.length(t) > 2), numeric(t)).when(t.startswith("&") & (F.length(t) > 1), named(t)).otherwise(t)

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), each), "")).otherwise(c)


def _part(t: Column) -> Column:
    """What a token does: d to the depth, whether it breaks the line and hides what is in it, and its text."""
    tag = F.lower(F.regexp_extract(t, r"^</?([A-Za-z][^\s/>]*)", 1))
    start, end = t.rlike("^<[A-Za-z]") & t.endswith(">"), t.rlike("^</[A-Za-z]")
    alone = t.endswith("/>")
    classes = F.transform(F.filter(F.regexp_extract_all(t, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: a.rlike(_CLASS)), lambda a: F.lower(F.regexp_extract(a, _CLASS, 1)))
    quoted = F.exists(classes, lambda v: F.lit(False) | v.rlike("|".join(QUOTE_CLASSES)))
    depth = F.when(tag.isin(VOID_TAGS) | (start & alone), 0).when(start, 1).when(end, -1).otherwise(0)
    hides = start & ~tag.isin(VOID_TAGS) & ~alone & (tag.isin(HIDDEN_TAGS) | F.when(F.contains(F.lower(t), F.lit("class")), quoted).otherwise(False))
    text = F.when(t.rlike("^(?!<[A-Za-z/!?])"), decode_references(t))
    return F.struct(depth.alias("d"), (start & tag.isin(BREAK_TAGS)).alias("b"), hides.alias("q"), text.alias("t"))


def html_text(c: Column) -> Column:
    """Text outside hidden elements. An element hides all below it; the depth counts every tag that isn't void, so tags
    without an end keep what follows hidden or shown, as the depth has it. References are decoded twice in effect. A tag
    that never ends takes all behind it with it; a last text that may end inside a reference isn't emitted."""
    tokens = F.regexp_extract_all(F.regexp_replace(c, _SILENT, "$1"), F.lit(_TOKEN), F.lit(0))
    unsure = lambda x: F.element_at(x, -1).rlike(r"(?s)&[^\s;]{0,33}\z") & ~F.element_at(x, -1).startswith("<")
    tokens = _bind(tokens, lambda x: F.when((F.size(x) > 0) & unsure(x), F.slice(x, 1, F.size(x) - 1)).otherwise(x))
    parts = F.transform(tokens, _part)
    chunks = _bind(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _CHUNK).cast("int")), lambda i: F.slice(p, i * _CHUNK + 1, F.lit(_CHUNK))))
    none = F.array().cast("array<string>")

    def step(s: Column, x: Column) -> Column:
        depth = F.greatest(s["d"] + x["d"], F.lit(0))
        hidden = F.when((s["h"] == 0) & x["q"], depth).when((x["d"] < 0) & (s["d"] > 0) & (depth < s["h"]), 0).otherwise(s["h"])
        said = F.when(x["b"], "\n").when(s["h"] == 0, x["t"])
        return F.struct(depth.alias("d"), hidden.alias("h"), F.when(said.isNotNull(), F.array_append(s["o"], said)).otherwise(s["o"]).alias("o"))

    def chunk(s: Column, x: Column) -> Column:
        made = F.aggregate(x, F.struct(s["d"].alias("d"), s["h"].alias("h"), none.alias("o")), step)
        return _bind(made, lambda r: F.struct(r["d"].alias("d"), r["h"].alias("h"), F.array_append(s["o"], F.array_join(r["o"], "")).alias("o")))

    text = F.aggregate(chunks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("h"), none.alias("o")), chunk, lambda s: F.array_join(s["o"], ""))
    return F.when(F.contains(c, F.lit("<")) & F.contains(c, F.lit(">")), decode_references(text)).otherwise(c)
