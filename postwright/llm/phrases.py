"""Collocations: phrases whose words stand together far more often than apart, by mergeable Misra-Gries summaries.

A summary keeps at most `capacity` counters. Two summaries merge by adding their counters; where more than `capacity`
are left, all lose the (capacity + 1)-th largest count, and what falls to zero goes. Such a step with loss d takes at
least d * (capacity + 1) from the mass, so with capacity above mass / threshold no counter lacks `threshold` in the end,
in whatever order summaries meet: each n-gram that occurs often enough survives. The second pass counts the survivors
exactly, as text. N-grams are dealt to hash partitions, each with a summary and a capacity of its own mass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table

#: Frequent n-grams are marked in so many bits (16 MB), whatever their number: a wrong hit costs a count, never a result.
BITS = 27
#: Capacity is so many times mass / threshold: no counter lacks more than threshold / SLACK.
SLACK = 4
#: n-grams for each hash partition, about; there are 2 ** 6 to 2 ** 14 partitions.
PART_MASS = 4_000_000
#: Bytes of text looked at together (more where a piece is longer), and counters that a task holds before it hands them on.
CHUNK, HELD = 4 << 20, 1_000_000
_BASES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """The words of a chunk in order: key (of group and word), piece, group code, where its bytes begin, and all bytes."""

    key: np.ndarray
    piece: np.ndarray
    group: np.ndarray
    at: np.ndarray
    data: np.ndarray


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(data: np.ndarray, at: np.ndarray, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """Polynomial hashes of the words that begin at `at` in data, modulo 2 ** 64."""
    length = np.diff(np.append(at, len(data)))
    powers = np.multiply.accumulate(np.full(int(length.max()), base, np.uint64))
    place = np.arange(len(data)) - np.repeat(at, length)
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], at)


def _group_seeds(groups: list[str]) -> np.ndarray:
    seeds = [_mix(_hashed(np.frombuffer(b"\0" + g.encode(), np.uint8), np.zeros(1, np.int64))) for g in groups]
    return np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)


def _words(batch: pa.RecordBatch) -> Iterator[tuple[list[str], Words]]:
    """(groups, words) of each chunk of a batch (group, text). No phrase crosses a chunk: chunks end where pieces do."""
    codes = pc.dictionary_encode(batch.column(0))
    groups = codes.dictionary.to_pylist()
    seeds, code = _group_seeds(groups), codes.indices.to_numpy(zero_copy_only=False)
    texts = batch.column(1).cast(pa.large_binary())
    if not len(texts) or texts.buffers()[2] is None:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begin = 0
    while begin < len(whole):
        end = min(begin + CHUNK, len(whole))
        if end < len(whole):
            following = int(ends[np.searchsorted(ends, end)])
            hits = _KIND[whole[end:following]] == 2
            end = end + int(hits.argmax()) if hits.any() else following
        data, kind = _LOWER[whole[begin:end]], _KIND[whole[begin:end]]
        first = ends[np.searchsorted(ends, begin) : np.searchsorted(ends, end)] - begin
        inside = kind == 0
        new, breaks = inside.copy(), kind == 2
        new[1:] &= ~inside[:-1]
        new[first] = inside[first]
        breaks[first] = True
        start = np.flatnonzero(new)
        if len(start):
            at, data = np.cumsum(inside)[start] - 1, data[inside]
            group = code[np.searchsorted(ends, start + begin, side="right") - 1]
            key = _mix(_hashed(data, at) ^ seeds[group])
            yield groups, Words(key, np.cumsum(breaks, dtype=np.int32)[start], group, at, data)
        begin = end


def _grams(w: Words, longest: int, known: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, positions, keys) of the n-grams of 2 to longest words whose known parts are all marked.

    known: bit maps of the frequent n-grams by size; of sizes beyond 2, that of 2 stands for the parts.
    """
    ok, gram = _marked(known[1], w.key), w.key
    pairs = None
    for size in range(2, longest + 1):
        if len(w.key) < size:
            return
        gram = _mix(gram[:-1] * _STEP + w.key[size - 1 :])
        if size == 2:
            ok = ok[:-1] & ok[1:] & (w.piece[:-1] == w.piece[1:])
            if 2 in known:
                ok &= _marked(known[2], gram)
            pairs = ok
        else:
            ok = ok[:-1] & pairs[size - 2 :]
        at = np.flatnonzero(ok)
        yield size, at, gram[at]


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (keys >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _mark(bits: np.ndarray, keys: np.ndarray) -> None:
    """Set the bits of keys in a slice of a bit map, which holds the keys with the same first bits."""
    slot = (keys >> np.uint64(64 - BITS)).astype(np.int64) & (8 * len(bits) - 1)
    np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class Summary:
    """A mergeable Misra-Gries summary of 64-bit keys; `lacks` bounds what any counter is short of."""

    def __init__(self, capacity: int):
        self.capacity, self.lacks, self.waiting, self.buffered = capacity, 0, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.buffered += len(keys)
        if self.buffered > max(self.capacity, 100_000):
            self.settle()

    def settle(self) -> Summary:
        self.keys, self.counts = _summed(np.concatenate([self.keys, *[k for k, _ in self.waiting]]), np.concatenate([self.counts, *[n for _, n in self.waiting]]))
        self.waiting, self.buffered = [], 0
        if len(self.keys) > self.capacity:
            loss = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            left = self.counts > loss
            self.keys, self.counts, self.lacks = self.keys[left], self.counts[left] - loss, self.lacks + loss
        return self


def _batch(names: list[str], kinds: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, word, key, n) of the words of each chunk."""
    for batch in batches:
        for groups, w in _words(batch):
            yield _texts(groups, w, w.key, np.arange(len(w.key)), 1)


def _texts(groups: list[str], w: Words, key: np.ndarray, at: np.ndarray, size: int) -> pa.RecordBatch:
    """(grp, phrase, size, key, n) of the n-grams with these keys at these words. A second hash guards the grouping."""
    second = _hashed(w.data, w.at, _BASES[1])
    check = second[at] + w.group[at].astype(np.uint64)
    for j in range(1, size):
        check = check * _STEP + second[at + j]
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))
    n = np.diff(np.append(new, len(k)))
    first = at[order[new]]
    words = pa.LargeStringArray.from_buffers(len(w.at), pa.py_buffer(np.append(w.at, len(w.data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(w.data)))
    parts = [words.take(pa.array(first + j)) for j in range(size)]
    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if size > 1 else parts[0]
    grp = pa.array(groups, pa.string()).take(pa.array(w.group[first]))
    return pa.RecordBatch.from_arrays([grp, phrase.cast(pa.string()), pa.array(np.full(len(first), size, np.int32)), pa.array(k[new].view(np.int64)), pa.array(n.astype(np.int64))], ["grp", "phrase", "size", "key", "n"])


COUNTED = "grp string, phrase string, size int, key long, n long"
SUMMARIES = "part int, kind int, mass long, keys binary, counts binary"


def _summarise(maps, sizes: set[int], longest: int, shift: int):
    """Summaries (exact as yet) of the n-grams of these sizes, by hash partition; kind 0 has a partition's mass alone."""

    def handed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (keys >> np.uint64(shift)).astype(np.int64)
        new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(new[1:], len(keys))
        rows = [(int(part[a]), int(counts[a:b].sum()), keys[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(new, ends, strict=True)]
        columns = [[r[0] for r in rows] * 2, [0] * len(rows) + [1] * len(rows), [r[1] for r in rows] * 2, [None] * len(rows) + [r[2] for r in rows], [None] * len(rows) + [r[3] for r in rows]]
        return _batch(["part", "kind", "mass", "keys", "counts"], [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: np.frombuffer(v.value, np.uint8) for k, v in maps.items()}
        held, n = [], 0
        for batch in batches:
            for _, w in _words(batch):
                for size, _, keys in _grams(w, longest, known):
                    if size in sizes and len(keys):
                        held.append(_summed(keys, np.ones(len(keys), np.int64)))
                        n += len(held[-1][0])
                if n > 2 * HELD:
                    held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    n = len(held[0][0])
                    if n > HELD:
                        yield handed(*held[0])
                        held, n = [], 0
        if n:
            yield handed(*_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])))

    return run


def _survivors(least: int, bits_each: int):
    """(part, bits) from the summaries of whole hash partitions, each partition's masses first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary = None, 0, None

        def done() -> pa.RecordBatch:
            summary.settle()
            bits = np.zeros(1 << (bits_each - 3), np.uint8)
            _mark(bits, summary.keys[summary.counts >= least - summary.lacks])
            return _batch(["part", "bits"], [pa.int32(), pa.binary()], [[now], [bits.tobytes()]])

        for batch in batches:
            columns = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                part = columns[0][i].as_py()
                if part != now:
                    if summary is not None:
                        yield done()
                    now, mass, summary = part, 0, None
                if columns[1][i].as_py() == 0:
                    mass += columns[2][i].as_py()
                    continue
                summary = summary or Summary(SLACK * mass // least + 1)
                summary.merge(np.frombuffer(columns[3][i].as_buffer(), np.uint64), np.frombuffer(columns[4][i].as_buffer(), np.uint32).astype(np.int64))
        if summary is not None:
            yield done()

    return run


def _marks_of_keys(bits_each: int):
    """(part, bits) of a column of keys; parts that several tasks hold are joined on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.sort(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            part = (keys >> np.uint64(64 - BITS + bits_each)).astype(np.int64)
            for p in np.unique(part):
                _mark(slices.setdefault(int(p), np.zeros(1 << (bits_each - 3), np.uint8)), keys[part == p])
        yield _batch(["part", "bits"], [pa.int32(), pa.binary()], [list(slices), [b.tobytes() for b in slices.values()]])

    return run


def _gathered(spark: SparkSession, slices: DataFrame, bits_each: int):
    """Broadcast bit map of 2 ** BITS bits from its slices, which are all that comes to the driver."""
    whole, each = np.zeros(1 << (BITS - 3), np.uint8), 1 << (bits_each - 3)
    for r in slices.collect():
        whole[r.part * each : (r.part + 1) * each] |= np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(whole.tobytes())


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text: str = "text", group: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases): words (grp, phrase, n) are all words with their exact counts in a group, phrases (grp, phrase, size, n)
    all n-grams of 2 to `longest` words that occur `least` times in a group or more, with exact counts.

    First the words are counted, then pairs of frequent words are summarised, then longer n-grams of frequent pairs (a
    frequent n-gram has frequent parts), last the survivors are counted. Each pass reads the documents, at every size.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("grp"), F.coalesce(F.col(text), F.lit("")).alias("txt")).filter(F.length("txt") > 0)
    words = cut(rows.mapInArrow(_count_words, COUNTED).groupBy("grp", "phrase").agg(F.first("key").alias("key"), F.sum("n").alias("n")))
    mass = words.agg(F.sum("n")).first()[0] or 0
    bits = min(14, max(6, int(mass // PART_MASS).bit_length()))
    parts, each = 1 << bits, BITS - bits
    by_key = words.filter(F.col("n") >= least).select("key").repartition(parts, F.shiftrightunsigned("key", 64 - bits))
    maps = {1: _gathered(spark, by_key.mapInArrow(_marks_of_keys(each), "part int, bits binary"), each)}
    for name, sizes, most in ((2, {2}, 2), (3, set(range(3, longest + 1)), longest)):
        if not sizes:
            continue
        made = rows.mapInArrow(_summarise(dict(maps), sizes, most, 64 - bits), SUMMARIES).repartition(parts, "part").sortWithinPartitions("part", "kind")
        maps[name] = _gathered(spark, made.mapInArrow(_survivors(least, each), "part int, bits binary"), each)

    def count_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: np.frombuffer(v.value, np.uint8) for k, v in maps.items()}
        for batch in batches:
            for groups, w in _words(batch):
                for size, at, keys in _grams(w, longest, known):
                    if size > 2:
                        ok = _marked(known[3], keys)
                        at, keys = at[ok], keys[ok]
                    if len(at):
                        yield _texts(groups, w, keys, at, size)

    counted = rows.mapInArrow(count_survivors, COUNTED).groupBy("grp", "phrase", "size").agg(F.sum("n").alias("n"))
    phrases = cut(counted.filter(F.col("n") >= least))
    for m in maps.values():
        m.unpersist()
    return words, phrases


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, absorbed: int = 80, scale: int = 2_000_000, text: str = "text", group: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's first `top` phrases of 2 to `longest` words.

    Words are runs without space and tab in pieces between `.,;:!?` and line ends; A-Z are lower-cased. a counts the
    phrase, l and r the two parts of the cut with the lowest score floor(scale * a / (l + r)) (ties: the first), n all
    words of the group. Phrases below `least` are none; those inside a longer one that has `absorbed` per cent or more
    of their count go. A null text is empty, a null group `und`; repeated rows count each time; an empty table gives no
    row. A very long text is read in chunks that end where a piece does, so memory follows the longest piece. Other
    columns of docs, whatever their names, are left alone.
    """
    words, phrases = frequent_phrases(docs, least, longest, text, group)
    known = words.filter(F.col("n") >= least).select("grp", F.col("phrase").alias("part"), "n").unionByName(phrases.select("grp", F.col("phrase").alias("part"), "n"))
    known = cut(known)
    some = phrases.withColumn("w", F.split("phrase", " "))
    joined = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = some.select("grp", "phrase", "size", "w", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("grp", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("before"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("after"))
    cuts = cuts.join(known.select("grp", F.col("part").alias("before"), F.col("n").alias("l")), ["grp", "before"])
    cuts = cuts.join(known.select("grp", F.col("part").alias("after"), F.col("n").alias("r")), ["grp", "after"])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr(f"(cast({scale} as decimal(12,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("grp", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("x"))
    inner = some.filter("size > 2").select("grp", "w", "size", F.col("n").alias("f"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("grp", "w", "m", "f", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    inner = inner.select("grp", joined(F.col("i"), F.col("m")).alias("phrase"), "f").groupBy("grp", "phrase").agg(F.max("f").alias("f"))
    whole = F.coalesce(big("f") * 100 < big("a") * absorbed, F.lit(True))
    left = best.join(inner, ["grp", "phrase"], "left").filter(whole).select("grp", "phrase", "a", "x.l", "x.r", "x.score")
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a group's first rows are among the first of its parts, so no task gets all phrases of a group
    for keys in (["grp", F.pmod(F.xxhash64("phrase"), F.lit(32))], ["grp"]):
        left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    total = words.groupBy("grp").agg(F.sum("n").alias("total"))
    made = left.join(total, "grp").select(F.col("grp").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
    made = cut(made)
    drop(words, phrases, known)
    return made


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), tokens AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, s.size, w[i:i + s.size - 1] AS words, count(*) AS f
    FROM tokens, (SELECT unnest([1, 2, 3, 4]) AS size) s, unnest(generate_series(1, len(w) - s.size + 1)) AS u(i)
    GROUP BY ALL
), counts AS (
    SELECT lang, size, words, array_to_string(words, ' ') AS phrase, f FROM grams WHERE f >= 30
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE size = 1 GROUP BY lang
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f::HUGEINT + y.f::HUGEINT))::BIGINT AS score
    FROM counts c, unnest(generate_series(1, c.size - 1)) AS u(k)
    JOIN counts x ON x.lang = c.lang AND x.words = c.words[1:k]
    JOIN counts y ON y.lang = c.lang AND y.words = c.words[k + 1:]
    WHERE c.size > 1
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
    SELECT DISTINCT c.lang, array_to_string(c.words[i:i + m - 1], ' ') AS phrase, c.f
    FROM counts c, unnest(generate_series(2, c.size - 1)) AS v(m), unnest(generate_series(1, c.size - m + 1)) AS u(i)
    WHERE c.size > 2
), kept AS (
    SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.f::HUGEINT >= 80 * b.a::HUGEINT)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
