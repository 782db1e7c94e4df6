"""Quality by an interpolated modified Kneser-Ney model of character n-grams, trained on trusted text."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, drop, row_key, small, table

#: An n-gram is a long: BITS bits a symbol, the last one lowest; above them the model (from MODEL_AT on) and the
#: order (from ORDER_AT on).
ORDER, BITS, MODEL_AT, ORDER_AT = 5, 8, 40, 48
SYMBOLS_MASK = (1 << MODEL_AT) - 1
#: Tables of keys, and of languages, of at most so many rows are broadcast, larger ones joined by shuffle.
BROADCAST_KEYS, BROADCAST_LANGS = 500_000, 20_000
#: About so many characters are scored by one task.
BUCKET_CHARS = 32_000_000
#: A worker holds about so many n-grams until it merges them, takes so many symbols at a time, and sends so many rows at once.
HELD, SLICE, SENT = 1_500_000, 1 << 19, 1 << 18
#: What a verdict depends on.
ROW = ("doc_id", "text", "lang")
#: Texts are parted by hash, and scored by the model that leaves out their own part.
FOLDS = 2


def symbols() -> np.ndarray:
    """Code point to symbol: 1 other, 2 digit, then ASCII, Latin letters, and the rest by remainder. 0 is the start."""
    cp = np.arange(1 << 16)
    out = 161 + cp % 95
    out[:32], out[32:127] = 1, np.arange(3, 98)
    out[0xC0:0x100] = np.arange(97, 161)
    out[48:58], out[10] = 2, 160
    return out.astype(np.uint8)


SYMBOLS = symbols()


def symbols_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, a byte each, and each text's length."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points == 0, np.uint8(3), SYMBOLS[points & 0xFFFF]), sizes


def grams_of(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each symbol; before the first of a text stand starts."""
    wide = codes.astype(np.int64)
    grams = wide.copy()
    for back in range(1, ORDER):
        grams[back:] |= wide[:-back] << (BITS * back)
    firsts = np.cumsum(sizes) - sizes
    for j in range(ORDER - 1):
        at = firsts[sizes > j] + j
        grams[at] &= (1 << (BITS * (j + 1))) - 1
    return grams


def _slices(sizes: np.ndarray, most: int = SLICE):
    """(first, last) of runs of texts that hold about `most` symbols."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _column(batch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def fold_of(text: str, folds: int) -> Column:
    """The part that a text belongs to, by its hash: copies of a text are held out together."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(folds)).cast("int")


def _gathered(folds: int):
    """(x, c0, c1, ...): the n-grams of all texts, with their counts in the trusted texts of each fold."""
    names = ["x", *[f"c{f}" for f in range(folds)]]

    def merged(keys: list, counts: list):
        codes, x = pd.factorize(np.concatenate(keys))
        return x, [np.bincount(codes, weights=np.concatenate([c[f] for c in counts]), minlength=len(x)).astype(np.int32) for f in range(folds)]

    def rows(x, counts):
        order = np.argsort(x)  # runs of near keys take less room in a shuffle
        for start in range(0, len(x), SENT):
            at = order[start : start + SENT]
            yield pa.RecordBatch.from_arrays([pa.array(x[at]), *[pa.array(c[at]) for c in counts]], names)

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            texts = _column(batch, "text")
            group = np.where(_column(batch, "trusted").to_numpy(zero_copy_only=False), _column(batch, "fold").to_numpy(zero_copy_only=False), folds)
            for a, b in _slices(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)):
                codes, sizes = symbols_of([t or "" for t in texts.slice(a, b - a).to_pylist()])
                at, x = pd.factorize(grams_of(codes, sizes))
                of = np.repeat(group[a:b], sizes)
                keys.append(x)
                counts.append([np.bincount(at[of == f], minlength=len(x)).astype(np.int32) for f in range(folds)])
                held += len(x)
                if held > HELD:
                    x, c = merged(keys, counts)
                    keys, counts, held = [x], [c], len(x)
                    if held > HELD * 2 // 3:
                        yield from rows(x, c)
                        keys, counts, held = [], [], 0
        if keys:
            yield from rows(*merged(keys, counts))

    return run


def gather_grams(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(x, c0, c1, ...): each n-gram of docs (text, trusted, fold) once, with its counts in the trusted texts by fold."""
    names = [f"c{f}" for f in range(folds)]
    found = docs.select("text", "trusted", "fold").mapInArrow(_gathered(folds), "x bigint, " + ", ".join(f"{c} int" for c in names))
    return cut(found.groupBy("x").agg(*[F.sum(c).alias(c) for c in names]))


def _key(x: str, order: str) -> str:
    """SQL for the key of the last `order` symbols of n-gram x: they, its model and the order."""
    return f"({x} & (shiftleft(1L, cast({order} * {BITS} AS int)) - 1)) | ({x} & {7 << MODEL_AT}) | shiftleft(cast({order} AS long), {ORDER_AT})"


def _context(key: str) -> str:
    """SQL for a key without its last symbol."""
    return f"shiftright({key} & {SYMBOLS_MASK}, {BITS}) | ({key} & {~SYMBOLS_MASK})"


def count_orders(grams: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(key, c): the n-grams of all orders in each model; model m leaves out the texts of fold m.

    The highest order counts occurrences, a lower one in how many contexts an n-gram was seen.
    """
    models = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), sum((F.col(f"c{f}") for f in range(folds) if f != m), F.lit(0).cast("long")).alias("c")) for m in range(folds)])
    top = grams.select("x", F.explode(models).alias("y")).filter("y.c > 0").select(F.expr(f"x | shiftleft(y.m, {MODEL_AT})").alias("x"), "y.c")
    longer = top.select(F.expr(f"explode(transform(sequence(1, {ORDER - 1}), k -> named_struct('k', k, 'x', {_key('x', '(k + 1)')})))").alias("y")).distinct()
    lower = longer.groupBy(F.expr(_key("y.x", "y.k")).alias("key")).agg(F.count("*").alias("c"))
    return cut(top.select(F.expr(_key("x", str(ORDER))).alias("key"), "c").unionByName(lower))


def discounts(orders: DataFrame) -> Column:
    """array(D1, D2, D3+) of a key's order and model, from how many n-grams have counts 1 to 4 (Chen and Goodman)."""
    out = F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5)])
    kind = F.expr(f"shiftright(key, {MODEL_AT})")
    for n in orders.filter("c < 5").groupBy(kind.alias("kind")).agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).collect():  # ORDER * folds rows
        if n.n1 and n.n2:
            y = n.n1 / (n.n1 + 2 * n.n2)
            d = [1 - 2 * y * n.n2 / n.n1, 2 - 3 * y * n.n3 / n.n2, 3 - 4 * y * n.n4 / n.n3 if n.n3 else 1.5]
            out = F.when(kind == n.kind, F.array(*[F.lit(min(max(x, 0.05), i + 0.95)) for i, x in enumerate(d)])).otherwise(out)
    return out


def log_probabilities(grams: DataFrame, folds: int = FOLDS) -> DataFrame:
    """(x, lp): for each n-gram of gather_grams() and each model, log2 p of its last symbol, given the others.

    p = max(c - D, 0) / total + off / total * p of the n-gram without its first symbol, order by order down to a
    uniform p. All orders meet their counts in one join, and the sums of their contexts in another; then each order
    meets the one below.
    """
    orders = count_orders(grams, folds)
    kept = F.get("d", F.least("c", F.lit(3)) - 1)
    counted = orders.withColumn("d", discounts(orders)).select("key", F.expr(_context("key")).alias("h"), kept.alias("off"), (F.col("c") - kept).alias("more"), "c")
    sums = counted.groupBy("h").agg(F.sum("c").alias("total"), F.sum("off").alias("off"))
    models = F.expr(f"explode(transform(sequence(0L, {folds - 1}L), m -> x | shiftleft(m, {MODEL_AT})))")
    wanted = grams.select(models.alias("x")).select(F.expr(f"explode(transform(sequence(1, {ORDER}), k -> {_key('x', 'k')}))").alias("key")).distinct()
    parts = wanted.join(counted.select("key", "more"), "key", "left").withColumn("h", F.expr(_context("key"))).join(sums, "h", "left")
    order = F.expr(f"shiftright(key, {ORDER_AT})")
    a, b = F.coalesce(F.coalesce("more", F.lit(0.0)) / F.col("total"), F.lit(0.0)), F.coalesce(F.col("off") / F.col("total"), F.lit(1.0))
    parts = cut(parts.select(order.alias("ord"), "key", a.alias("a"), b.alias("b")), used=[orders])
    below = parts.filter("ord = 1").select("key", (F.col("a") + F.col("b") / (1 << BITS)).alias("p"))
    for k in range(2, ORDER + 1):
        own = parts.filter(f"ord = {k}").withColumn("s", F.expr(_key("key", str(k - 1))))
        below = own.join(below.select(F.col("key").alias("s"), "p"), "s").select("key", (F.col("a") + F.col("b") * F.col("p")).alias("p"))
    return cut(below.select(F.expr(f"key & {(1 << ORDER_AT) - 1}").alias("x"), F.log2("p").alias("lp")), used=[parts])


def _packed(buckets: int, folds: int, names: list[str]):
    """Rows (bucket, codes, rows): the symbols of a batch's texts of one bucket, and lists of their columns.

    A bucket holds texts of one fold, so that it asks one model.
    """

    def run(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            part = (_column(batch, "r1").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(20)) % np.uint64(max(1, buckets // folds))
            bucket = part.astype(np.int64) * folds + _column(batch, "fold").to_numpy(zero_copy_only=False)
            for b in np.unique(bucket):
                at = np.flatnonzero(bucket == b)
                codes, sizes = symbols_of([t or "" for t in _column(batch, "text").take(pa.array(at)).to_pylist()])
                ends = pa.array([0, len(at)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, _column(batch, n).take(pa.array(at))) for n in names]
                columns = [pa.array([int(b)], pa.int64()), pa.array([codec.compress(codes.tobytes(), asbytes=True)], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(sizes)), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "codes", "sizes", *names])

    return run


def _gram_runs(table, folds: int):
    """(row, first, last, n-grams, sizes): runs of the texts of each packed row; n-grams are marked with their model."""
    codec = pa.Codec("zstd")
    for i in range(table.num_rows):
        sizes = np.array(table.column("sizes")[i].as_py(), dtype=np.int64)
        data = codec.decompress(table.column("codes")[i].as_py(), decompressed_size=int(sizes.sum()), asbytes=True) if sizes.sum() else b""
        codes, ends, model = np.frombuffer(data, dtype=np.uint8), np.r_[0, np.cumsum(sizes)], table.column("bucket")[i].as_py() % folds
        for a, b in _slices(sizes):
            yield i, a, b, grams_of(codes[ends[a] : ends[b]], sizes[a:b]) | model << MODEL_AT, sizes


def _needed(folds: int):
    """(bucket, x): the distinct n-grams of each bucket."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for i, _, _, grams, _ in _gram_runs(rows, folds):
                own = held.setdefault(rows.column("bucket")[i].as_py(), [])
                own.append(pd.unique(grams))
                if sum(map(len, own)) > HELD:
                    own[:] = [pd.unique(np.concatenate(own))]
        for bucket, own in held.items():
            x = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
            for start in range(0, len(x), SENT):
                part = x[start : start + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket)), pa.array(part)], ["bucket", "x"])

    return run


def _summed(names: list[str], types: list, folds: int):
    def run(left, right):
        x, lp = (right.column(c).to_numpy() for c in ("x", "lp"))
        order = np.argsort(x)
        x, lp = x[order], lp[order]
        totals = [np.zeros(len(sizes)) for sizes in left.column("sizes").to_pylist()]
        for i, a, b, grams, sizes in _gram_runs(left, folds):
            if len(grams):
                at, distinct = pd.factorize(grams)
                totals[i][a:b] = np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), weights=lp[np.searchsorted(x, distinct)][at], minlength=b - a)
        columns = [pa.concat_arrays([v.values for v in left.column(n)]).cast(t) if left.num_rows else pa.array([], t) for n, t in zip(names, types, strict=True)]
        sizes = [n for v in left.column("sizes").to_pylist() for n in v]
        total = np.concatenate(totals) if totals else np.zeros(0)
        return pa.Table.from_arrays([*columns, pa.array(total), pa.array(sizes, pa.int64())], [*names, "logp", "chars"])

    return run


def score(docs: DataFrame, folds: int = FOLDS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """docs (text, trusted, fold, r1, ...) without text, with logp (log2 of the text's probability) and chars (its length).

    Texts are dealt to buckets of about bucket_chars characters by the hash r1. A bucket asks for the probabilities
    of its distinct n-grams, which the model's shards send, and sums them up for each text: neither texts nor a
    model ever lie whole in one place, and the rows exchanged grow with the texts.
    """
    names = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    grams = gather_grams(docs, folds)
    lps = log_probabilities(grams, folds)
    drop(grams)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // bucket_chars))
    schema = "bucket bigint, codes binary, sizes array<bigint>, " + ", ".join(f"`{n}` array<{kinds[n].simpleString()}>" for n in names)
    packed = docs.mapInArrow(_packed(buckets, folds, names), schema).repartition(buckets, "bucket")
    asked = packed.mapInArrow(_needed(folds), "bucket bigint, x bigint").join(lps, "x")
    out = ", ".join([f"`{n}` {kinds[n].simpleString()}" for n in names] + ["logp double", "chars bigint"])
    found = packed.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_summed(names, [to_arrow_type(kinds[n]) for n in names], folds), out)
    return cut(found, used=[lps])


def judge_quality(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.001, most_chars: int = 4096, folds: int = FOLDS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, lang, perplexity (per character), deviation, low, high, keep: a row for each row of docs.

    trusted_ids (doc_id) names the rows whose texts train the model; all of them are counted, and every row is
    scored on its whole text. Every text, trusted or not, is scored by the model without its fold (by hash of the
    text), so trusted texts score like unseen ones, and copies of a trusted text like it. A text's mean log2 p is
    compared with the mean of its language's trusted texts (the others, where it is one of them); times
    sqrt(min(chars, most_chars)) the difference spreads alike at all lengths. keep: the deviation lies within the
    language's quantiles (quantile, 1 - quantile) of trusted texts. Fewer than 1 / quantile texts don't show such
    quantiles: then the ends reach as far as those of a normal distribution, and as those of all languages'
    deviations from their own means. Languages without trusted text are compared with the mean of all; a null
    language is one of its own. Both ends count: symbols and shouting are unlikely, and repetition strays further
    than its length allows. Null, empty and blank texts have a null perplexity and aren't kept. Without two trusted texts,
    all others are kept. Repeated rows and null ids are scored like others. Other columns aren't read.
    """
    return _judge(docs, trusted_ids, quantile, most_chars, folds, bucket_chars).drop("r1", "r2")


def _judge(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.001, most_chars: int = 4096, folds: int = FOLDS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """judge_quality() with r1, r2: row_key() of doc_id, text and lang. Rows equal in these have one verdict."""
    ids = small(cut(trusted_ids.select(F.col("doc_id").alias("tid")).filter("tid IS NOT NULL").distinct()).withColumn("trusted", F.lit(True)), BROADCAST_KEYS)
    df = docs.select("doc_id", "lang", "text").join(ids, F.col("doc_id") == F.col("tid"), "left")
    r1, r2 = row_key(*ROW)
    # blank texts say nothing, like empty ones
    said = F.when(F.col("text").rlike(r"\S"), F.col("text")).alias("text")
    df = df.select("doc_id", "lang", said, r1.alias("r1"), r2.alias("r2"), F.coalesce("trusted", F.lit(False)).alias("trusted"), fold_of("text", folds).alias("fold"))
    scored = score(df, folds, bucket_chars)
    good = scored.filter("trusted AND chars > 0").select("lang", "logp", "chars")
    sums = [F.sum("logp").alias("lp"), F.sum("chars").alias("ch")]
    langs = small(cut(good.groupBy(F.col("lang").alias("ml")).agg(*sums)), BROADCAST_LANGS)
    scale = F.sqrt(F.least("chars", F.lit(most_chars)))
    others = (F.col("lp") - F.col("logp")) / F.nullif(F.col("ch") - F.col("chars"), F.lit(0))
    dev = ((F.col("logp") / F.col("chars") - others) * scale).alias("dev")
    z, few = NormalDist().inv_cdf(1 - quantile), F.col("n") * F.lit(quantile) < 1
    spread = [F.percentile_approx("dev", F.lit(quantile), F.lit(100_000)).alias("p0"), F.percentile_approx("dev", F.lit(1 - quantile), F.lit(100_000)).alias("p1")]
    spread += [F.avg("dev").alias("mu"), F.stddev("dev").alias("sd"), F.count("dev").alias("n")]
    far = z * F.col("sd") * F.sqrt(1 + 1 / F.col("n"))
    ends = lambda low, high: [F.when(few, F.least("p0", F.col("mu") - far)).otherwise(F.col("p0")).alias(low), F.when(few, F.greatest("p1", F.col("mu") + far)).otherwise(F.col("p1")).alias(high)]
    own = cut(good.join(langs, F.col("lang").eqNullSafe(F.col("ml"))).select("lang", dev))
    pool = F.broadcast(own.agg(*spread).select(*ends("a0", "a1")))
    stats = own.groupBy("lang").agg(*spread).select("lang", few.alias("few"), *ends("q0", "q1")).crossJoin(pool)
    stats = stats.select(F.col("lang").alias("sl"), F.when(F.col("few"), F.least("q0", "a0")).otherwise(F.col("q0")).alias("q0"), F.when(F.col("few"), F.greatest("q1", "a1")).otherwise(F.col("q1")).alias("q1"))
    stats = small(stats.join(langs, F.col("sl").eqNullSafe(F.col("ml"))).select("sl", (F.col("lp") / F.col("ch")).alias("mean"), "q0", "q1"), BROADCAST_LANGS)
    total = F.broadcast(good.agg(*sums))
    whole = good.crossJoin(total).select(dev).agg(*spread).select(*ends("w0", "w1")).crossJoin(total.select((F.col("lp") / F.col("ch")).alias("mean0")))
    df = scored.join(stats, F.col("lang").eqNullSafe(F.col("sl")), "left").crossJoin(F.broadcast(whole))
    df = df.withColumns({"mean": F.coalesce("mean", "mean0"), "low": F.coalesce("q0", "w0"), "high": F.coalesce("q1", "w1")})
    dev = (F.col("logp") / F.col("chars") - F.col("mean")) * scale
    return df.select(
        "r1",
        "r2",
        "doc_id",
        "lang",
        F.when(F.col("chars") > 0, F.pow(F.lit(2.0), -F.col("logp") / F.col("chars"))).alias("perplexity"),
        F.when(F.col("chars") > 0, dev).alias("deviation"),
        "low",
        "high",
        F.when(F.col("chars") == 0, False).otherwise(F.coalesce(dev.between(F.col("low"), F.col("high")), F.lit(True))).alias("keep"),
    )


def trusted_documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")


def keep_good(docs: DataFrame, trusted_ids: DataFrame, **options) -> DataFrame:
    """The rows of docs that judge_quality() keeps, each by its own verdict; all columns, whatever their names."""
    bad = small(cut(_judge(docs, trusted_ids, **options).filter("NOT keep").select(F.col("r1").alias("b1"), F.col("r2").alias("b2")).distinct()), BROADCAST_KEYS)
    key = docs.select(F.struct("*").alias("row"), *ROW).select("row", *row_key(*ROW))
    return key.join(bad, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")), "left_anti").select("row.*")


def op8_quality(spark, sf_dir):
    judged = judge_quality(table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir))
    return judged.filter("keep").drop("keep")
