"""Repeated runs of lines, by a suffix array over line ids that distributed prefix doubling builds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, join_salted, row_key, table

#: Suffixes of one range of ranks, that one task sweeps at a time.
CHUNK = 50_000
OWN = 1 << 60


def repeated_lines(docs: DataFrame, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(g, pos, lid, at, run): lines of runs of repeated lines that may hold least_words words; (g, doc_id, k1, k2): their documents.

    A line is repeated if its text occurs more than once; blank lines don't count. g is a document, equal rows of
    docs being one, pos numbers its other lines from 1, at is a line's place in its run of repeated lines, from 1,
    and run the number of lines from here to the run's end. A shared run of enough words lies in such a run at both
    places, so shorter ones neither lose lines nor explain others.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    base = docs.filter("text IS NOT NULL").select(*row_key("doc_id", "text"), "doc_id", lines.alias("lines"))
    base = base.select("k1", "k2", "doc_id", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("lid"), F.length(x).alias("size"))).alias("lines"))
    base = cut(base.dropDuplicates(["k1", "k2"]).withColumn("g", F.monotonically_increasing_id()))
    every = base.select("g", F.posexplode("lines").alias("pos", "x")).select("g", (F.col("pos") + 1).alias("pos"), "x.lid", "x.size")
    counts = cut(every.groupBy("lid").agg(F.count("*").alias("n")).filter("n > 1"))
    often = join_salted(every, counts, ["lid"], "n").drop("n")
    island = often.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("g").orderBy("pos")))
    own = Window.partitionBy("g", "island").orderBy("pos")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = island.withColumns({"at": F.row_number().over(own), "n": F.count("*").over(whole), "room": F.sum(F.col("size") + 1).over(whole)})
    # n characters hold (n + 1) / 2 words at most
    found = found.filter(F.col("room") >= 2 * least_words)
    lines = cut(found.select("g", "pos", "lid", "at", (F.col("n") - F.col("at") + 1).cast("int").alias("run")), used=[counts])
    return lines, base


def start_ranks(counts: DataFrame, keys: list[str], order: str, bucket: Column) -> DataFrame:
    """Add `before` to rows (keys, order, c): the sum of c over the rows of equal keys with smaller order.

    bucket is a monotone function of order. Sums run over buckets first and then within each, so that no task
    gets all rows of a key.
    """
    b = counts.withColumn("bucket", bucket)
    sums = b.groupBy(*keys, "bucket").agg(F.sum("c").alias("s"))
    w = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.partitionBy(F.lit(0)).orderBy("bucket")
    sums = sums.withColumn("base", F.sum("s").over(w) - F.col("s")).drop("s")
    within = F.sum("c").over(Window.partitionBy(*keys, "bucket").orderBy(order)) - F.col("c")
    return b.withColumn("within", within).join(sums, [*keys, "bucket"]).withColumn("before", F.col("base") + F.col("within")).drop("bucket", "within", "base")


def suffix_ranks(lines: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(g, pos, run, at, ranks, c): array of one rank per doubling, and the number of suffixes that share the last one.

    The rank at step j orders suffixes by their first 2**j line ids: the number of suffixes that are smaller. A
    suffix ends where its run of repeated lines does; what is equal up to that end stays tied. Only suffixes
    that are still tied and go on are refined: by the pair of their rank and that of the suffix 2**j lines on. The
    others keep their last rank, and aren't written again.
    """
    first = cut(start_ranks(lines.groupBy("lid").agg(F.count("*").alias("c")), [], "lid", F.shiftright("lid", 50)))
    steps = [cut(join_salted(lines, first.select("lid", "c", "before"), ["lid"], "c").select("g", "pos", "at", "run", F.col("before").alias("r"), "c"))]
    drop(first)
    total, settled = steps[0].count(), []
    for j in range(most_rounds):
        tied = F.expr(f"c > 1 AND run >= {1 << j}")
        active = steps[j].filter(tied)
        if not (n := active.count()):
            break
        ahead = steps[j]
        for x in settled:
            ahead = ahead.unionByName(x)
        ahead = ahead.filter(F.col("at") > (1 << j)).select("g", (F.col("pos") - (1 << j)).alias("pos"), F.col("r").alias("r2"))
        active = active.drop("c").join(ahead, ["g", "pos"], "left").withColumn("r2", F.when(F.col("run") > (1 << j), F.col("r2")).otherwise(F.lit(-1)))
        active = cut(active)
        pairs = active.groupBy("r", "r2").agg(F.count("*").alias("c"))
        pairs = cut(start_ranks(pairs, ["r"], "r2", F.floor(F.col("r2") * 512 / total)))
        steps.append(cut(join_salted(active, pairs, ["r", "r2"], "c", total=n).select("g", "pos", "at", "run", (F.col("r") + F.col("before")).alias("r"), "c"), used=[active, pairs]))
        settled.append(steps[j].filter(~tied))
    else:
        raise RuntimeError("a run of repeated lines is too long")
    found = steps[0].withColumn("j", F.lit(0))
    for j, x in enumerate(steps[1:], 1):
        found = found.unionByName(x.withColumn("j", F.lit(j)))
    found = found.groupBy("g", "pos").agg(F.sort_array(F.collect_list(F.struct("j", "r", "c"))).alias("x"), F.first("run").alias("run"), F.first("at").alias("at"))
    return cut(found.select("g", "pos", "run", "at", F.col("x.r").alias("ranks"), F.element_at("x", -1)["c"].alias("c")), used=steps)


def neighbour_lcp(state: DataFrame, owners: DataFrame) -> DataFrame:
    """(r, r0, left, right, none, doc_id, k1, k2, g, pos, run): the first suffix of each tied class, in document order,
    with the lines it shares with the classes before and after it in the suffix array.

    The largest step at which two suffixes have one rank tells 2**j shared lines; what follows them is looked up for
    the pairs that may share more, until none is left.
    """
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "pos", "g", "run", "ranks", "c")
    reps = state.join(owners.select("g", "doc_id", "k1", "k2"), "g").groupBy(F.element_at("ranks", -1).alias("r")).agg(F.min(where).alias("w"))
    reps = cut(reps.select("r", "w.*", F.element_at("w.ranks", 1).alias("r0")))
    one = reps.select("r", (F.col("r") + F.col("c")).alias("next"), "r0", F.col("g").alias("ga"), F.col("pos").alias("pa"), F.col("run").alias("ra"), F.col("ranks").alias("x"))
    two = reps.select(F.col("r").alias("next"), F.col("r0").alias("n0"), F.col("g").alias("gb"), F.col("pos").alias("pb"), F.col("run").alias("rb"), F.col("ranks").alias("y"))
    levels = state.select(F.max(F.size("ranks"))).first()[0] or 0
    pairs = one.join(two, "next").filter("r0 = n0").withColumns({"off": F.lit(0), "below": F.lit(levels)})

    def stepped(pairs: DataFrame) -> DataFrame:
        """After the largest step below `below` at which the suffixes off lines on are equal; 0: none is left to try."""
        same = F.expr("size(filter(sequence(0, below - 1), j -> get(x, least(j, size(x) - 1)) = get(y, least(j, size(y) - 1))))")
        left = F.least("ra", "rb") - F.col("off")
        step = F.when(F.col("same") > 0, F.least(left, F.expr("shiftleft(1, same - 1)"))).otherwise(0)
        moved = pairs.withColumn("same", same).withColumn("step", step).withColumn("off", F.col("off") + F.col("step"))
        more = (F.col("same") > 1) & (F.least("ra", "rb") > F.col("off"))
        moved = moved.withColumn("below", F.when(more, F.col("same") - 1).otherwise(0))
        return cut(moved.select("r", "next", "ga", "pa", "ra", "gb", "pb", "rb", "off", "below"))

    found = [stepped(pairs)]
    at = state.filter("at > 2").select("g", "pos", "ranks")  # what is looked up lies two lines on at least
    while not (open_ := found[-1].filter("below > 0")).isEmpty():
        open_ = open_.withColumns({"xp": F.col("pa") + F.col("off"), "yp": F.col("pb") + F.col("off")})
        met = open_.join(at.select(F.col("g").alias("ga"), F.col("pos").alias("xp"), F.col("ranks").alias("x")), ["ga", "xp"])
        met = met.join(at.select(F.col("g").alias("gb"), F.col("pos").alias("yp"), F.col("ranks").alias("y")), ["gb", "yp"])
        found.append(stepped(met))
    shared = found[0].filter("below = 0")
    for x in found[1:]:
        shared = shared.unionByName(x.filter("below = 0"))
    left = shared.select(F.col("next").alias("r"), F.col("off").alias("left"))
    right = shared.select("r", F.col("off").alias("right"))
    out = reps.join(left, "r", "left").join(right, "r", "left")
    return out.select("r", "r0", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("right", F.lit(0)).alias("right"), "none", F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "k1", "k2", "g", "pos")


def capped(stack: list, most: int) -> list:
    """The stack of (shared lines, first document) after a step that shares `most` lines."""
    first = None
    while stack and stack[-1][0] > most:
        m = stack.pop()[1]
        first = m if first is None or m < first else first
    if first is not None and most > 0:
        if stack and stack[-1][0] == most:
            stack[-1] = (most, min(first, stack[-1][1]))
        else:
            stack.append((most, first))
    return stack


def sweep(keys: list, shared: list, stack: list) -> list:
    """For each suffix the most lines that it shares with an earlier place among those swept before it."""
    best = []
    for key, n in zip(keys, shared, strict=True):
        capped(stack, n)
        best.append(next((v for v, m in reversed(stack) if m < key), 0))
        stack.append((OWN, key))
    return best


def _rows(pdf: pd.DataFrame, forward: bool):
    pdf = pdf.sort_values("r", ascending=forward)
    ids = [(n, int(d), a, b, p) for n, d, a, b, p in zip(pdf["none"], pdf["doc_id"], pdf["k1"], pdf["k2"], pdf["pos"], strict=True)]
    return pdf, ids, pdf["left" if forward else "right"].tolist()


def _pack(stack: list) -> list:
    return [[int(v), int(m[0]), *map(int, m[1:])] for v, m in stack]


def _unpack(rows) -> list:
    return [(int(x[0]), (bool(x[1]), *map(int, x[2:]))) for x in rows]


def longest_earlier(reps: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(g, pos, earlier): for each class's first suffix, the most lines shared with an earlier place.

    Earlier places are looked for on both sides in the suffix array, range by range. A range hands on only the
    smallest place for each number of lines shared up to its end; these are combined along the ranges that one
    first line spans, before the ranges are swept again with what the others hand them.
    """
    df = cut(reps.withColumn("chunk", F.floor(F.col("r") / chunk)))
    out = "forward boolean, chain long, chunk long, enters boolean, through boolean, least int, stack array<array<long>>"

    def summary(key, pdf):
        found = []
        for forward in (True, False):
            rows, keys, shared = _rows(pdf, forward)
            stack: list = []
            sweep(keys, shared, stack)
            r0 = rows["r0"].tolist()
            found.append((forward, r0[-1], key[0], False, r0[0] == r0[-1] and shared[0] > 0, min(shared), _pack(stack)))
            if shared[0] > 0:
                found.append((forward, r0[0], key[0], True, False, 0, []))
        return pd.DataFrame(found, columns=["forward", "chain", "chunk", "enters", "through", "least", "stack"])

    def chain(key, pdf):
        order = pdf.assign(rank=~pdf["enters"]).sort_values(["chunk", "rank"], ascending=[bool(key[0]), True])
        stack, found = [], []
        for x in order.itertuples():
            if x.enters:
                found.append((key[0], x.chunk, _pack(stack)))
            else:
                kept = capped(list(stack), x.least) if x.through else []
                merged: dict = {}
                for v, m in kept + _unpack(x.stack):
                    merged[v] = min(m, merged.get(v, m))
                stack = sorted(merged.items())
        return pd.DataFrame(found, columns=["forward", "chunk", "stack"])

    summaries = df.groupBy("chunk").applyInPandas(summary, out)
    carried = cut(summaries.groupBy("forward", "chain").applyInPandas(chain, "forward boolean, chunk long, stack array<array<long>>"))

    def final(key, pdf, carry):
        parts = []
        for forward in (True, False):
            rows, keys, shared = _rows(pdf, forward)
            given = carry[carry["forward"] == forward]["stack"]
            best = sweep(keys, shared, _unpack(given.iloc[0]) if len(given) else [])
            parts.append(pd.Series(best, index=rows.index))
        return pdf[["g", "pos"]].assign(earlier=pd.concat(parts, axis=1).max(axis=1).astype("int32"))

    return df.groupBy("chunk").cogroup(carried.groupBy("chunk")).applyInPandas(lambda k, a, b: final(k, a, b) if len(a) else a.reindex(columns=["g", "pos", "earlier"]), "g long, pos int, earlier int")


def earlier_runs(docs: DataFrame, chunk: int = CHUNK, least_words: int = 0) -> DataFrame:
    """(k1, k2, runs): from line pos on, so many lines occur in the same order at an earlier place; array<struct<pos, lines>>.

    Runs that can't hold least_words words are left out.
    """
    lines, base = repeated_lines(docs, least_words)
    state = suffix_ranks(lines)
    drop(lines)
    firsts = longest_earlier(neighbour_lcp(state, base), chunk)
    rest = state.filter("c > 1").select("g", "pos", F.col("run").alias("lines"), F.lit(False).alias("first"))
    all_ = firsts.select("g", "pos", F.col("earlier").alias("lines"), F.lit(True).alias("first")).unionByName(rest)
    # a class's first suffix stands in both; its own result is the one that counts
    best = all_.groupBy("g", "pos").agg(F.coalesce(F.max(F.when(F.col("first"), F.col("lines"))), F.max("lines")).alias("lines")).filter("lines > 0")
    runs = best.groupBy("g").agg(F.collect_list(F.struct("pos", "lines")).alias("runs"))
    return cut(runs.join(base.select("g", "k1", "k2"), "g").select("k1", "k2", "runs"), used=[state, base])


def without_runs(text: str, runs: list, least_words: int) -> tuple[str, list]:
    """The text without the lines of runs (pos, lines) of enough words, and the numbers (from 0) of lines removed."""
    lines = text.split("\n")
    real = [i for i, x in enumerate(lines) if x.strip(" ")]
    words = [0]
    for i in real:
        words.append(words[-1] + len(lines[i].split()))
    gone = [0] * (len(lines) + 1)
    for pos, n in runs:
        if words[pos - 1 + n] - words[pos - 1] >= least_words:
            gone[real[pos - 1]] += 1
            gone[real[pos + n - 2] + 1] -= 1
    depth, kept, removed = 0, [], []
    for i, x in enumerate(lines):
        depth += gone[i]
        (removed if depth else kept).append(i if depth else x)
    return "\n".join(kept), removed


def dedup_lines(docs: DataFrame, least_words: int = 50, chunk: int = CHUNK) -> DataFrame:
    """Every row of docs, its text without later copies of line runs, and `removed`: the numbers of lines deleted.

    A run counts if it holds least_words words or more (50: a paragraph; shorter runs are headings, greetings and
    the like, which texts share by rights) and occurs, in the same order, at an earlier place: a smaller doc_id
    (null last), or further up in the same text. Lines are compared without blanks at their ends;
    blank lines don't interrupt a run and go with it. The first occurrence stays. Every repeat is found, however
    long or frequent. Rows that are equal in id and text count as one document and keep the same lines. Null
    texts stay null, empty ones empty; an empty table gives an empty result. All other columns keep their values
    and may have any name; a column named removed is replaced.
    """
    kept = [c for c in docs.columns if c != "removed"]
    runs = earlier_runs(docs.select("doc_id", "text"), chunk, least_words)
    keyed = docs.select(F.struct(*kept).alias("row"), *row_key("doc_id", "text"))
    met = keyed.join(runs, ["k1", "k2"], "left")

    # only texts and runs of those that have some go to Python: the other columns pass by untouched
    @F.pandas_udf("text string, removed array<int>")
    def rebuilt(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        made = [(None, []) if found is None else without_runs(t, [(x["pos"], x["lines"]) for x in found], least_words) for t, found in zip(text, runs, strict=True)]
        return pd.DataFrame({"text": [m[0] for m in made], "removed": [m[1] for m in made]})

    made = met.select("row", F.col("runs").isNotNull().alias("has"), rebuilt(F.when(F.col("runs").isNotNull(), F.col("row.text")), "runs").alias("made"))
    text = F.when(F.col("has"), F.col("made.text")).otherwise(F.col("row.text")).alias("text")
    return made.select(*[text if c == "text" else F.col("row")[c].alias(c) for c in kept], "made.removed")


def op9_line_runs(spark, sf_dir):
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"))
