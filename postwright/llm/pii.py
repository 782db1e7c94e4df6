"""Personal data: fixed patterns, and contexts learnt from their finds, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, cut, find_spans, join_salted, row_key, small, table

#: Possessive forms of the fixed patterns. A try inside a run of local-part characters or digits can only repeat
#: the failure at the run's start, so it is skipped unless the last match ended there: time stays linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![^\s,;:=\"'<>(){}\[\]|])[^\s,;:=\"'<>(){}\[\]|0-9@]*+[0-9@][^\s,;:=\"'<>(){}\[\]|]*+",
}
KINDS = ["email", "ip", "card", "phone"]
#: Base spans are listed by parts of a text of so many characters, in which tokens look up what they overlap.
PART = 2048
#: Patterns that are kept of at most so many rows are broadcast.
BROADCAST_PATTERNS = 200_000


def keeps(kind: str) -> str:
    """SQL over a hit x.h: whether the match of this kind counts."""
    digits = "regexp_replace(x.h, '[^0-9]', '')"
    if kind == "ip":
        return r"x.h rlike '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(\\.|$)){4}$'"
    if kind == "phone":
        return f"char_length({digits}) BETWEEN 9 AND 15"
    if kind == "card":
        digit = f"cast(element_at(split(reverse({digits}), ''), i) as int)"
        luhn = f"""aggregate(sequence(1, char_length({digits})), 0, (a, i) ->
            a + if(i % 2 = 1, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit})))"""
        return f"if(char_length({digits}) BETWEEN 13 AND 19, {luhn} % 10 = 0, false)"
    return "true"


def base_spans(docs: DataFrame) -> DataFrame:
    """docs (row, k1, k2, text) without text, with `base`: array<struct<ord, start, end, kind, text>> and `cand`: the
    tokens with a digit or an @, each with the two words on its left and, for a seed, the base span's text that it
    is part of.

    Tokens end at white space and at , ; : = | quotes and brackets, so that those of JSON, CSV and key=value lines
    count one by one. The words on the left are the last two runs of letters since the token before, however far.
    """
    df = find_spans(docs, "text", PATTERNS).drop("text")
    for i, k in enumerate(KINDS):
        df = df.withColumn(k, F.expr(f"transform(filter({k}, x -> {keeps(k)}), x -> named_struct('ord', {i}, 'start', x.s, 'end', x.e, 'kind', '{k}', 'text', x.h))"))
    df = df.select("row", "k1", "k2", "token", F.array_sort(F.concat(*KINDS)).alias("base"))
    near = r"""lower(reverse(regexp_extract(reverse(x.g), '^[^\\p{L}]*+(\\p{L}++)(?:[^\\p{L}]++(\\p{L}++))?', %d)))"""
    over = "b -> b.start < x.e AND x.s < b.end"
    cand = f"""transform(token, x -> {bound(f'get(filter(get(parts, x.s div {PART}), {over}), 0)', 'hit', f"""
        named_struct('start', x.s, 'end', x.e, 'text', x.h, 'l1', {near % 1}, 'l2', {near % 2}, 'seed', hit IS NOT NULL, 'entity', hit.text)""")})"""
    # a span is listed under each part of the text that tokens overlapping it may start in
    listed = f"transform(sequence(0, element_at(token, -1).s div {PART}), i -> filter(base, b -> b.start < (i + 1) * {PART} + longest AND b.end > i * {PART}))"
    parts = bound("array_max(transform(token, x -> x.e - x.s))", "longest", listed)
    df = df.withColumn("cand", F.expr(f"if(size(token) > 0, {bound(parts, 'parts', cand)}, array())"))
    return df.select("row", "k1", "k2", "base", "cand")


def learn_contexts(cands: DataFrame, rounds: int = 3, smoothing: float = 2.0, least_seeds: int = 3) -> DataFrame:
    """Patterns (word or two words on the left) with a score, from candidates (inst, seed, l1, l2).

    A bipartite graph of patterns and instances, one edge for each distinct pair. A pattern's score is the summed
    confidence of its instances over their number plus `smoothing`; an instance's confidence is 1 for a seed, else
    1 - prod(1 - score) over its patterns. `rounds` rounds; patterns with fewer than `least_seeds` distinct seed
    instances score 0, so chance contexts don't spread.
    """
    one, two = F.col("l1"), F.concat_ws(" ", "l2", "l1")
    edges = (
        cands.filter("l1 <> ''")
        .select("inst", "seed", F.explode(F.array_distinct(F.array(one, two))).alias("pattern"))
        .groupBy("pattern", "inst")
        .agg(F.max("seed").alias("seed"))
    )
    edges = cut(edges)
    conf = edges.groupBy("inst").agg(F.max(F.col("seed").cast("double")).alias("conf"), F.count("*").alias("pairs"))
    conf = cut(conf)
    for r in range(rounds):
        scored = join_salted(edges, conf, ["inst"], "pairs").drop("pairs")
        patterns = (
            scored.groupBy("pattern")
            .agg(F.sum("conf").alias("sum"), F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"))
            .select("pattern", F.when(F.col("seeds") >= least_seeds, F.col("sum") / (F.col("n") + smoothing)).otherwise(0.0).alias("score"), "seeds", "n")
        )
        if r < rounds - 1:
            patterns = cut(patterns)
            conf = cut(
                join_salted(edges, patterns.select("pattern", "score", "n"), ["pattern"], "n")
                .groupBy("inst")
                .agg(F.max("seed").alias("seed"), F.sum(F.log1p(-F.least("score", F.lit(0.999999)))).alias("log_miss"), F.count("*").alias("pairs"))
                .select("inst", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("log_miss")).alias("conf"), "pairs")
            )
    return patterns


def scan_pii(docs: DataFrame, least_score: float = 0.8, rounds: int = 3, smoothing: float = 2.0, least_seeds: int = 3) -> DataFrame:
    """A row for each row of docs: its columns but text, and `pii`: array<struct<ord, start, end, kind, text>>.

    Base kinds email, ip, card and phone come first, in this order, then kind context: tokens with 5 or more
    letters or digits, at least one a digit, not seen by a base pattern, after a context whose score reaches
    `least_score` (see learn_contexts). Within a kind, spans are ordered by start. Null text counts as empty;
    repeated rows and null ids are kept; an empty table gives an empty result. A column named pii is replaced, others
    may have any name. Texts are read once, at a cost linear in their length; later steps carry spans and tokens.
    """
    kept = [c for c in docs.columns if c not in {"pii", "text"}]
    df = cut(base_spans(docs.select(F.struct(*kept).alias("row"), F.coalesce("text", F.lit("")).alias("text"), *row_key(*kept, "text"))))
    tail = F.regexp_replace("c.text", r"^[^\p{L}0-9@+]++", "")
    core = F.regexp_replace(tail, r"[^\p{L}0-9]+$", "")
    start = F.col("c.start") + F.length("c.text") - F.length(tail)
    cands = df.select("k1", "k2", F.explode("cand").alias("c")).select(
        "k1", "k2", start.alias("start"), (start + F.length(core)).alias("end"), core.alias("text"), "c.seed", "c.l1", "c.l2", F.lower(F.coalesce("c.entity", core)).alias("inst")
    )
    patterns = learn_contexts(cands, rounds, smoothing, least_seeds).filter(F.col("score") >= least_score).select("pattern")
    patterns = small(cut(patterns), BROADCAST_PATTERNS)
    fresh = cands.filter("NOT seed AND l1 <> ''").filter(F.length(F.regexp_replace("inst", r"[^\p{L}0-9]", "")) >= 5).filter(F.col("inst").rlike("[0-9]"))
    found = (
        fresh.select("*", F.explode(F.array_distinct(F.array(F.col("l1"), F.concat_ws(" ", "l2", "l1")))).alias("pattern"))
        .join(patterns, "pattern", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.struct(F.lit(len(KINDS)).alias("ord"), "start", "end", F.lit("context").alias("kind"), "text")).alias("more"))
    )
    out = df.drop("cand").join(found, ["k1", "k2"], "left")
    return out.select("row.*", F.array_sort(F.concat("base", F.coalesce("more", F.expr("filter(base, x -> false)")))).alias("pii"))


def joined(where: str = "true") -> Column:
    return F.expr(f"array_join(transform(filter(pii, x -> {where}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def op4_personal_data(spark, sf_dir):
    found = scan_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("x.kind <> 'context'"), 256).alias("base_sha256"),
        joined().alias("spans"),
        count("context").alias("n_context"),
    )
