"""Secret scans: fixed patterns plus sliding-window entropy, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, find_spans, spans_sql, table

#: Fixed patterns. hex and access carry their least length: a maximal run is kept or dropped whole either way.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "entropy": r"[A-Za-z0-9+/_=-]{20,}",
}
KINDS = ["assign", "access", "hex"]
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Least bits per character of a window, by the character class of the piece it lies in; letters are those of one case.
THRESHOLDS = {"hex": 3.0, "letters": 3.7, "alnum": 3.6, "base64": 3.8}
#: Stretches that are never part of a secret: placeholders, counters, one character over and over, rulers, paths of words.
ALLOWED = r"(?i)example|placeholder|changeme|your[_-]?(?:key|token|secret)|x{8,}|0123456789|abcdefgh|(.)\1{7,}|^[a-z]+(?:[_/-][a-z]+)+$"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20


def entropy_stretch(candidate: str, window: int, threshold: str) -> str:
    """SQL for struct<first, last>: from the first to the last window of the candidate with enough entropy.

    The counts of the window's characters are kept while it slides, five bits each, twelve to a long (n0, n1, ...):
    the character that enters and the one that leaves change one count c each, and sum(c log2 c) by one difference
    each; entropy is log2(window) - that sum / window. Terms c log2 c are whole billionths, so sums don't drift.
    """
    if window > 31:
        raise ValueError("a window holds at most 31 characters")
    longs = range(-(-len(ALPHABET) // 12))
    term = f"get(array({', '.join(f'{round(c * math.log2(c) * 1e9) if c else 0}L' for c in range(window + 2))}), {{}})"
    count = lambda at, by: f"cast(shiftright(get(array({', '.join(f'a.n{k}' for k in longs)}), {at}), {by}) & 31 AS int)"
    counts = f"named_struct('i', {count('e.w', 'e.h')}, 'o', if(e.v < 0, 0, {count('e.v', 'e.g')} + if(e.w = e.v AND e.h = e.g, 1, 0)))"
    moved = f"a.s + {term.format('n.i + 1')} - {term.format('n.i')} + if(e.v < 0, 0L, {term.format('n.o - 1')} - {term.format('n.o')})"
    hot = f"e.p >= {window} AND log2({window}) - mv.s / {window}e9D >= bits - 1e-9"
    kept = ", ".join(f"'n{k}', a.n{k} + if(e.w = {k}, shiftleft(1L, e.h), 0L) - if(e.v = {k}, shiftleft(1L, e.g), 0L)" for k in longs)
    step = f"named_struct({kept}, 's', mv.s, 'first', if({hot}, coalesce(a.first, e.p - {window}), a.first), 'last', if({hot}, e.p, a.last))"
    gone = f"get(ids, i - {window})"
    events = f"""transform(ids, (c, i) -> named_struct('w', cast(c div 12 AS int), 'h', cast(5 * (c % 12) AS int),
        'v', if(i < {window}, -1, cast({gone} div 12 AS int)), 'g', if(i < {window}, 0, cast(5 * ({gone} % 12) AS int)), 'p', i + 1))"""
    none = ", ".join(f"'n{k}', 0L" for k in longs)
    made = f"""aggregate({events}, named_struct({none}, 's', 0L, 'first', cast(null as int), 'last', cast(null as int)),
        (a, e) -> {bound(counts, 'n', bound(f"named_struct('s', {moved})", 'mv', step))},
        a -> named_struct('first', a.first, 'last', a.last))"""
    return bound(threshold, "bits", bound(f"transform(split({candidate}, ''), ch -> instr('{ALPHABET}', ch) - 1)", "ids", made))


def free_pieces(x: str, allow: str) -> str:
    """SQL for array<struct<s, h>>: what the allow-list leaves of the candidate x (s, e, h), each piece with its start.

    A window lies in a piece exactly if it touches no allowed stretch.
    """
    spans = f"transform({spans_sql('hits', 'gaps')}, y -> named_struct('s', {x}.s + y.s - char_length(y.g), 'h', y.g))"
    tail = f"array(named_struct('s', {x}.e - char_length(element_at(gaps, -1)), 'h', element_at(gaps, -1)))"
    cut = bound(f"regexp_extract_all({x}.h, '{allow}', 0)", "hits", bound(f"split({x}.h, '{allow}', -1)", "gaps", f"concat({spans}, {tail})"))
    return f"if({x}.h rlike '{allow}', {cut}, array(named_struct('s', {x}.s, 'h', {x}.h)))"


def scan_secrets(docs: DataFrame, window: int = WINDOW, thresholds: dict[str, float] | None = None, allowed: str = ALLOWED) -> DataFrame:
    """Every row of docs with `secrets`: array<struct<start, end, kind, text>>, ordered by start, then kind.

    Base kinds are assign, access and hex. Kind entropy: candidates are runs of 20 or more token characters; stretches
    that match an allow-list pattern are cut out, and only windows that touch none of them count, however long the
    candidate. A piece between them that has a digit, mixed case or letters alone is scanned, and in it the stretch
    from the first to the last window that reaches the threshold of the piece's class (hex, letters of one case,
    alnum, base64) is a span. Pieces of one case without digits but with separators, as paths of words, aren't
    scanned. Spans of different kinds may overlap. Null text counts as empty and gives an empty array; repeated rows
    stay; an empty table gives an empty result; other columns pass through, except that a column named secrets is
    replaced. A text's cost is linear in its length.
    """
    t = THRESHOLDS | (thresholds or {})
    reserved = {"secrets", "sc__text", *PATTERNS}
    kept = [c for c in docs.columns if c not in reserved]
    df = docs.select(F.struct(*kept).alias("sc__row"), F.coalesce(F.col("text"), F.lit("")).alias("sc__text"))
    df = find_spans(df, "sc__text", PATTERNS).drop("sc__text")
    order = {k: i for i, k in enumerate([*KINDS, "entropy"])}
    out = lambda k: f"x -> named_struct('start', x.s, 'ord', {order[k]}, 'end', x.e, 'kind', '{k}', 'text', x.h)"
    value = ASSIGN_VALUE.replace("\\", "\\\\").replace("'", "\\'")
    allow = allowed.replace("\\", "\\\\").replace("'", "\\'")
    df = df.withColumn("assign", F.expr(f"transform(filter(assign, x -> char_length(regexp_extract(x.h, '{value}', 1)) >= 6), {out('assign')})"))
    for k in ("access", "hex"):
        df = df.withColumn(k, F.expr(f"transform({k}, {out(k)})"))
    df = df.withColumn("entropy", F.expr(f"flatten(transform(entropy, x -> {free_pieces('x', allow)}))"))
    scanned = "(x.h rlike '[0-9]' OR x.h rlike '^[A-Za-z]+$' OR (x.h rlike '[a-z]' AND substr(x.h, 2) rlike '[A-Z]'))"
    df = df.withColumn("entropy", F.expr(f"filter(entropy, x -> char_length(x.h) >= {window} AND {scanned})"))
    least = f"""case when x.h rlike '^[0-9a-fA-F]+$' AND x.h rlike '[0-9]' then {t['hex']}D when x.h rlike '^(?:[A-Za-z]?[a-z]+|[A-Z]+)$' then {t['letters']}D
        when x.h rlike '^[0-9A-Za-z]+$' then {t['alnum']}D else {t['base64']}D end"""
    df = df.withColumn("entropy", F.expr(f"transform(entropy, x -> named_struct('x', x, 'w', {entropy_stretch('x.h', window, least)}))"))
    df = df.withColumn(
        "entropy",
        F.expr(f"""transform(filter(entropy, y -> y.w.first IS NOT NULL), y -> named_struct('start', y.x.s + y.w.first,
        'ord', {order['entropy']}, 'end', y.x.s + y.w.last, 'kind', 'entropy', 'text', substr(y.x.h, y.w.first + 1, y.w.last - y.w.first)))"""),
    )
    return df.select("sc__row.*", F.array_sort(F.concat(*[*KINDS, "entropy"])).alias("secrets"))


def joined(spans: str, where: str = "true") -> Column:
    return F.expr(f"array_join(transform(filter({spans}, x -> {where}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def op2_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("secrets", "x.kind <> 'entropy'"), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
        count("entropy").alias("n_entropy"),
    )
