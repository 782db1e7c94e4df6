"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of the sample that the codebooks are fitted on, at most, whatever the size of the table.
SAMPLE_ROWS = 20_000
BLOCK_ROWS, BLOCK_QUERIES = 4_000, 2_000


def valid_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors as doubles, without null, empty, zero, non-finite ones and those of a rarer dimension."""
    v = F.col(vector).cast("array<double>")
    df = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    df = df.filter("size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    dim = df.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return df.filter(F.size("v") == (dim.d if dim else 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_codebooks(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> list[np.ndarray]:
    """Lloyd's k-means for each half of the unit vectors of a bounded sample."""
    rng, x = np.random.default_rng(seed), unit(sample)
    half = x.shape[1] // 2
    books = []
    for part in (x[:, :half], x[:, half:]):
        c = part[rng.choice(len(part), min(k, len(part)), replace=False)]
        for _ in range(rounds):
            at = ((c * c).sum(1) - 2 * part @ c.T).argmin(1)
            n = np.bincount(at, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, at, part)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        books.append(c)
    return books


def half_distances(x: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    half = books[0].shape[1]
    return [((p * p).sum(1)[:, None] + (c * c).sum(1) - 2 * p @ c.T) for p, c in ((x[:, :half], books[0]), (x[:, half:], books[1]))]


def multi_sequence(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, least: int) -> list[int]:
    """Cells in order of d1[i] + d2[j], by a heap, until they hold `least` entries."""
    o1, o2, k2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable"), len(d2)
    heap, seen, out, held = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        cell = int(o1[i]) * k2 + int(o2[j])
        if counts[cell]:
            out.append(cell)
            held += counts[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < k2 and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


def best_of_block(queries: pd.DataFrame, entries: pd.DataFrame, top: int) -> pd.DataFrame:
    """Each query's best entries of one block, by exact cosine; equal scores go to the smaller id.

    One product of matrices tells which entries can be among the best; only these get their score, by sums over the
    dimensions in one order for every pair, so that equal vectors get equal scores. Vectors are scaled by powers of
    two alone, which doesn't round.
    """
    scaled = lambda v: v / np.ldexp(1.0, np.frexp(np.abs(v).max(axis=1))[1])[:, None]
    q, e = scaled(np.stack(queries["v"].to_numpy())), scaled(np.stack(entries["v"].to_numpy()))
    q_id, e_id = queries["vec_id"].to_numpy(), entries["vec_id"].to_numpy()
    n = min(top, len(e))
    near = unit(q) @ unit(e).T
    near[q_id[:, None] == e_id[None, :]] = -np.inf
    least = -np.partition(-near, n - 1, axis=1)[:, n - 1 : n]
    rows, columns = np.nonzero((near >= least - 1e-9) & np.isfinite(near))
    dot, qn, en = np.zeros(len(rows)), np.zeros(len(q)), np.zeros(len(e))
    for d in range(q.shape[1]):
        dot += q[rows, d] * e[columns, d]
        qn += q[:, d] * q[:, d]
        en += e[:, d] * e[:, d]
    score = dot / (np.sqrt(qn)[rows] * np.sqrt(en)[columns])
    order = np.lexsort((e_id[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = place < n
    return pd.DataFrame({"query_id": q_id[rows[kept]], "vec_id": e_id[columns[kept]], "score": score[kept]})


def search(vectors: DataFrame, queries: DataFrame, top: int = 5, vec_id: str = "vec_id", vector: str = "embedding", centroids: int | None = None, share: float = 0.5, least: int = 2_000, power: float = 0.8, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its nearest rows of vectors by cosine, without itself.

    Codebooks of `centroids` (None: sqrt(rows) / 4.7, from 8 to 256) for each half of the vectors are fitted on a sample of at most sample_rows rows (those
    with the smallest hashed ids); every row is indexed under its pair of centroids. A query visits pairs in order
    of summed distance until these hold `candidates` rows: share * rows up to 50,000 rows, beyond that growing as
    rows to the given power, and never fewer than `least`. All visited rows are ranked by exact cosine in double
    precision; equal scores go to the smaller id.

    Pairs of centroids are cut into blocks of about BLOCK_ROWS rows and BLOCK_QUERIES queries; a task holds one
    block at a time, which gives its best `top` of each query, so crowded pairs and copies of one vector cost no
    more than their rows. Vectors that are null, empty, zero, of another dimension than most, or hold null or
    non-finite components take no part, as queries or as candidates. Rows without an id take no part. A repeated
    id is listed once for each distinct score. With fewer candidates than `top`, all are returned.
    """
    spark = vectors.sparkSession
    every = cut(valid_vectors(vectors, vec_id, vector))
    asked = valid_vectors(queries, vec_id, vector)
    out_schema = "query_id long, vec_id long, score double"
    n = every.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    keyed = every.withColumn("h", F.xxhash64("vec_id"))
    most = -(1 << 63) + int(min(1.0, 1.5 * sample_rows / n) * ((1 << 64) - 1) * (1 - 1e-9))
    sample = keyed.filter(F.col("h") <= most).orderBy("h").limit(sample_rows).select("v").toPandas()
    if not len(sample):
        sample = every.limit(sample_rows).select("v").toPandas()
    centroids = centroids or int(min(256, max(8, n**0.5 / 4.7)))
    books = fit_codebooks(np.stack(sample["v"].to_numpy()), centroids)
    k2 = len(books[1])
    dim = sum(b.shape[1] for b in books)
    asked = asked.filter(F.size("v") == dim)
    candidates = max(least, int(share * min(n, 50_000) * max(1.0, n / 50_000) ** power))

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d1, d2 = half_distances(unit(np.stack(pdf["v"].to_numpy())), books)
                yield pdf.assign(cell=d1.argmin(1) * k2 + d2.argmin(1))

    placed = cut(every.mapInPandas(place, "vec_id long, v array<double>, cell long"))
    counts = np.zeros(len(books[0]) * k2, dtype=np.int64)
    for r in placed.groupBy("cell").count().collect():  # one row per pair of centroids
        counts[r["cell"]] = r["count"]

    # A bin is a set of small cells or a part of a large one; a query goes once to each bin it visits.
    parts = np.maximum(1, -(-counts // BLOCK_ROWS))
    small, bin_of, bins, room = np.argsort(counts, kind="stable"), np.zeros(len(counts), dtype=np.int64), 0, 0
    for c in small:
        if counts[c] and parts[c] == 1 and counts[c] <= room:
            bin_of[c], room = bins - 1, room - counts[c]
        elif counts[c]:
            bin_of[c], bins, room = bins, bins + parts[c], BLOCK_ROWS - counts[c] if parts[c] == 1 else 0
    shape = spark.createDataFrame([(int(c), int(bin_of[c]), int(parts[c])) for c in np.flatnonzero(counts)], "cell long, bin long, parts long")
    shape = F.broadcast(shape)  # at most centroids squared rows
    entries = placed.join(shape, "cell").select((F.col("bin") + F.pmod(F.xxhash64("vec_id"), "parts")).alias("bin"), "cell", "vec_id", "v")
    def visit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            d1, d2 = half_distances(unit(np.stack(pdf["v"].to_numpy())), books)
            rows = []
            for q, v, a, b in zip(pdf["vec_id"], pdf["v"], d1, d2, strict=True):
                cells = np.array(multi_sequence(a, b, counts, candidates), dtype=np.int64)
                for first in np.unique(bin_of[cells]):
                    own = cells[bin_of[cells] == first]
                    rows += [(q, v, own, first + i) for i in range(parts[own[0]])]
            yield pd.DataFrame(rows, columns=["vec_id", "v", "cells", "bin"])

    visits = asked.repartition(max(8, spark.sparkContext.defaultParallelism), "vec_id").mapInPandas(visit, "vec_id long, v array<double>, cells array<long>, bin long")
    visits = cut(visits)
    q_parts = visits.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("long").alias("q_parts"))
    visits = visits.join(q_parts, "bin").withColumn("q_part", F.pmod(F.xxhash64("vec_id", F.lit(5)), "q_parts")).drop("q_parts")
    entries = entries.join(q_parts, "bin").withColumn("q_part", F.explode(F.expr("sequence(0L, q_parts - 1)"))).drop("q_parts")

    def rank(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(e):
            wanted = [set(c) for c in q["cells"]]
            for cell, part in e.groupby("cell"):
                at = np.fromiter((cell in w for w in wanted), bool, len(q))
                if at.any():
                    found.append(best_of_block(q[at], part, top))
        if found:
            best = pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            return best.groupby("query_id").head(top)
        return pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})

    found = visits.groupBy("bin", "q_part").cogroup(entries.groupBy("bin", "q_part")).applyInPandas(rank, out_schema).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op1_nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))
