"""Keyword and vector retrieval, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import l2_normalize
from ..sources.scratch import Scratch
from .filters import is_embeddable

KEYWORD_TOP, VECTOR_TOP, FUSED_TOP, RRF_K = 50, 100, 100, 60


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """W1, W2. The first n rows of each group with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def keyword_search(queries: DataFrame, documents: DataFrame, match: str = "all", n: int = KEYWORD_TOP, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """J9. (query_id, interaction_id, score, rank) by BM25 within a customer.

    queries (query_id, customer_id, lexemes) and documents (interaction_id, customer_id, lexemes): arrays of
    distinct lexemes. match="all" needs every lexeme of the query, "any" one. Queries without lexemes have no
    hits. Postings meet on (customer, lexeme). With "any", blocks of a customer's postings meet parts of its queries, and
    only each query's first n of a block go on; documents, postings and the result are written. With "all", only postings of the
    query's rarest lexeme choose the candidates, and the others are checked on the candidate alone, so common lexemes
    spread nothing.
    """
    docs = documents.select("interaction_id", "customer_id", "lexemes").withColumn("len", F.size("lexemes"))
    scratch = Scratch(docs.sparkSession)
    if match == "any":
        docs = scratch.write(docs)
    stats = docs.groupBy("customer_id").agg(F.count("*").alias("docs"), F.avg("len").alias("avg_len"))
    asked = queries.select("query_id", "customer_id", "lexemes", F.size("lexemes").alias("terms")).filter("terms > 0")
    lexes = asked.select("query_id", "customer_id", "terms", F.explode("lexemes").alias("lex"))
    wanted = lexes.select("customer_id", "lex").distinct()
    # of the postings only those of asked lexemes go on
    postings = docs.select("customer_id", "interaction_id", "len", F.explode("lexemes").alias("lex")).join(wanted, ["customer_id", "lex"], "left_semi")
    if match == "any":
        postings = scratch.write(postings)
    df = postings.groupBy("customer_id", "lex").agg(F.count("*").alias("df"))
    weighed = lexes.join(df, ["customer_id", "lex"], "left").join(stats, "customer_id")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    if match == "any":
        terms = weighed.filter("df IS NOT NULL AND query_id IS NOT NULL").select("query_id", "customer_id", "lex", idf.alias("idf"))
        scored = _any_of_the_terms(scratch.write(terms), postings.filter("interaction_id IS NOT NULL"), stats, n, k1, b)
    else:
        per_query = weighed.groupBy("query_id", "customer_id").agg(
            F.count("df").alias("known"), F.first("terms").alias("terms"), F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "lex")).alias("rare"),
            F.sum(idf).alias("idf"), F.first("avg_len").alias("avg_len"),
        )
        per_query = per_query.filter("known = terms").select("query_id", "customer_id", F.col("rare.lex").alias("lex"), "idf", "avg_len")
        near = per_query.join(postings.select("customer_id", "lex", "interaction_id"), ["customer_id", "lex"])
        full = near.join(asked.select("query_id", F.col("lexemes").alias("terms")), "query_id").join(docs.select("interaction_id", "lexemes", "len"), "interaction_id")
        full = full.filter(F.size(F.array_except("terms", "lexemes")) == 0)
        scored = full.select("query_id", "interaction_id", (F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))).alias("score"))
        scored = scored.withColumn("near", F.round("score", 9))
    best = top_n(scored, ["query_id"], [F.desc("near"), "interaction_id"], n).drop("near")
    return scratch.last(best) if match == "any" else best


#: Documents are put into blocks of lengths within a factor of 2 ** (1 / BLOCKS_PER_DOUBLING).
BLOCKS_PER_DOUBLING = 4
_SLACK = 1e-7


def _saturation(length: Column, k1: float, b: float) -> Column:
    """What a lexeme's idf is multiplied by in a document of a length: it falls as the length grows."""
    return (k1 + 1) / (1 + k1 * (1 - b + b * length / F.col("avg_len")))


def _idf_within(terms: str) -> Column:
    """The sum of idf of those terms that stand in a document's lexemes."""
    return F.aggregate(F.filter(terms, lambda t: F.array_contains("lexemes", t["lex"])), F.lit(0.0), lambda acc, t: acc + t["idf"])


def impact_hits(terms: DataFrame, postings: DataFrame, n: int, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(plan, hits) of a search for any term by joins; only hits that a query's first n documents may need. keyword_search()
    doesn't go this way, as even these hits, each of them a row, grow with queries times documents.

    terms (query_id, customer_id, lex, avg_len, idf), postings (customer_id, interaction_id, len, lex). A lexeme's
    postings are ordered by impact, that is by length. First each term's n shortest documents are scored: the n-th best
    sum is a score that the first n reach (the query's threshold). Terms whose greatest scores together stay below it
    can't bring a document in by themselves: their postings aren't read. Of the others only blocks of lengths count in
    which all terms together can reach the threshold. plan (query_id, least, idf of all terms, and the array of terms not
    read); hits (query_id, interaction_id, customer_id, len, avg_len, part: the score of the terms that are read).
    """
    short = [F.asc("len"), F.asc("interaction_id")]
    heads = postings.withColumn("salt", F.pmod(F.xxhash64("interaction_id"), F.lit(16)))
    heads = top_n(top_n(heads, ["customer_id", "lex", "salt"], short, n), ["customer_id", "lex"], short, n)
    seeds = terms.join(heads, ["customer_id", "lex"]).withColumn("w", F.col("idf") * _saturation(F.col("len"), k1, b))
    reached = top_n(seeds.groupBy("query_id", "interaction_id").agg(F.sum("w").alias("s")), ["query_id"], [F.desc("s")], n).groupBy("query_id").agg(F.min("s").alias("s"), F.count("*").alias("m"))
    reached = reached.select("query_id", F.when(F.col("m") == n, F.col("s")).otherwise(0.0).alias("least"))
    first = heads.filter("rank = 1").select("customer_id", "lex", F.col("len").alias("shortest"))
    bounded = terms.join(first, ["customer_id", "lex"]).withColumn("most", F.col("idf") * _saturation(F.col("shortest"), k1, b)).join(reached, "query_id")
    upto = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "lex"))
    bounded = bounded.withColumn("read", upto >= F.col("least") - _SLACK)
    plan = bounded.groupBy("query_id").agg(
        F.first("least").alias("least"), F.first("avg_len").alias("avg_len"), F.first("customer_id").alias("customer_id"), F.sum("idf").alias("idf"),
        F.coalesce(F.sum(F.when(~F.col("read"), F.col("idf"))), F.lit(0.0)).alias("rest_idf"), F.collect_list(F.when(~F.col("read"), F.struct("lex", "idf"))).alias("rest"),
    )
    block = F.floor(F.log2(F.col("len")) * BLOCKS_PER_DOUBLING).cast("int")
    placed = postings.withColumn("block", block)
    blocks = placed.groupBy("customer_id").agg(F.collect_set("block").alias("blocks"))
    lowest = F.pow(F.lit(2.0), F.col("block") / BLOCKS_PER_DOUBLING) * (1 - 1e-9)
    wanted = plan.join(blocks, "customer_id").select("query_id", "idf", "avg_len", "least", F.explode("blocks").alias("block"))
    wanted = wanted.filter(F.col("idf") * _saturation(lowest, k1, b) >= F.col("least") - _SLACK).select("query_id", F.col("idf").alias("all_idf"), "least", "block")
    asked = bounded.filter("read").select("query_id", "customer_id", "lex", "idf", "avg_len").join(wanted, "query_id")
    fits = F.col("all_idf") * _saturation(F.col("len"), k1, b) >= F.col("least") - _SLACK
    hits = asked.join(placed, ["customer_id", "lex", "block"]).filter(fits)
    return plan, hits.withColumn("part", F.col("idf") * _saturation(F.col("len"), k1, b))


#: Postings of a block of documents and terms of a part of queries: what meets in a task, some 60 bytes each.
BLOCK_POSTINGS, PART_TERMS = 1_000_000, 1_000_000


def _best_sums_of_block(n: int):
    """Each query's best n documents of a block: its terms' postings are summed in one array of the block's documents."""

    def in_groups(keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The order that sorts keys from 0 to count - 1, and where each key's rows begin in it (and end: the next one's)."""
        return np.argsort(keys, kind="stable"), np.r_[0, np.cumsum(np.bincount(keys, minlength=count))]

    def numbered(ids: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        """The distinct ids in order, and each row's place among them."""
        known = ids.unique()
        known = known.take(pc.array_sort_indices(known))
        return known, pc.index_in(ids, known).to_numpy().astype(np.int64)

    def run(asked: pa.Table, postings: pa.Table) -> pa.Table:
        lexes = asked["lex"].unique()
        places = pc.index_in(postings["lex"], lexes)
        postings, places = postings.filter(places.is_valid()), places.drop_null().to_numpy().astype(np.int64)
        d_ids, docs = numbered(postings["interaction_id"])
        q_ids, queries = numbered(asked["query_id"])
        saturation = np.zeros(len(d_ids))
        saturation[docs] = postings["saturation"].to_numpy()
        order, begins = in_groups(places, len(lexes))
        docs = docs[order]
        order, first = in_groups(queries, len(q_ids))
        terms, idf = pc.index_in(asked["lex"], lexes).to_numpy().astype(np.int64)[order], asked["idf"].to_numpy()[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for q in range(len(q_ids)):
            mine, weights = terms[first[q] : first[q + 1]], idf[first[q] : first[q + 1]]
            hits = np.concatenate([docs[begins[t] : begins[t + 1]] for t in mine])
            if not len(hits):
                continue
            score = np.bincount(hits, np.repeat(weights, begins[mine + 1] - begins[mine]), len(d_ids)) * saturation
            least = np.partition(score, -n)[-n] - 1e-8 if len(score) > n else 0.0
            at = np.flatnonzero((score >= least) & (score > 0))
            at = at[np.argsort(-np.round(score[at], 9), kind="stable")[:n]]  # equal ones stand by id
            found.append((np.full(len(at), q), at, score[at]))
        rows, at, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": q_ids.take(pa.array(rows)), "interaction_id": d_ids.take(pa.array(at)), "score": score, "near": np.round(score, 9)})

    return run


def _any_of_the_terms(terms: DataFrame, postings: DataFrame, stats: DataFrame, n: int, k1: float, b: float) -> DataFrame:
    """(query_id, interaction_id, score, near: the score to nine decimals) of each query's best n documents of every block.

    terms (query_id, customer_id, lex, idf), postings (customer_id, interaction_id, len, lex), stats (customer_id,
    avg_len). A customer's postings are split into blocks of documents of about BLOCK_POSTINGS, its terms into parts of
    queries of about PART_TERMS. Each pair of them is summed in one task, so no row is made of a hit: what is shuffled
    are the postings once a part and the terms once a block.
    """
    shares = lambda df, most, to: df.groupBy("customer_id").agg(F.ceil(F.count("*") / most).cast("int").alias(to))
    grid = shares(postings, BLOCK_POSTINGS, "blocks").join(shares(terms, PART_TERMS, "parts"), "customer_id")
    spread = lambda key, count: F.pmod(F.xxhash64(key), count).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asked = terms.join(grid, "customer_id").select(F.col("customer_id").alias("scope"), "query_id", "lex", "idf", spread("query_id", F.col("parts")).alias("part"), each("blocks").alias("block"))
    held = postings.join(grid.join(stats, "customer_id"), "customer_id")
    held = held.select(F.col("customer_id").alias("scope"), "interaction_id", "lex", _saturation(F.col("len"), k1, b).alias("saturation"), spread("interaction_id", F.col("blocks")).alias("block"), each("parts").alias("part"))
    keys = ["scope", "block", "part"]
    kinds = dict(terms.dtypes)["query_id"], dict(postings.dtypes)["interaction_id"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_best_sums_of_block(n), f"query_id {kinds[0]}, interaction_id {kinds[1]}, score double, near double")


#: Queries whose cosines with a block lie in memory at once.
ROWS_AT_ONCE = 64


def _best_of_block(n: int, exclude_self: bool):
    """Each query's best n rows of a block, from products of two matrices."""

    def best_of_rows(asked: np.ndarray, held: np.ndarray, q_ids: np.ndarray, d_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, place of the document, cosine to nine decimals) of each query's best n documents, which stand by id."""
        score = asked @ held
        score[~np.isfinite(score)] = -np.inf
        if exclude_self:
            score[q_ids[:, None] == d_ids[None, :]] = -np.inf
        found = []
        for row, mine in enumerate(score):
            least = np.partition(mine, -n)[-n] - 1e-8 if len(mine) > n else -np.inf
            at = np.flatnonzero((mine >= least) & (mine > -np.inf))
            best = np.round(mine[at], 9)
            first = np.argsort(-best, kind="stable")[:n]
            found.append((np.full(len(first), row), at[first], best[first]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def run(key, queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        q_ids, d_ids = queries["query_id"].to_numpy(), docs["interaction_id"].to_numpy()
        by_id = np.argsort(d_ids, kind="stable")
        d_ids = d_ids[by_id]
        found = {"query_id": q_ids[:0], "interaction_id": d_ids[:0], "score": np.zeros(0)}
        if len(q_ids) and len(d_ids):
            asked, held = np.stack(queries["qv"].to_numpy()), np.ascontiguousarray(np.stack(docs["dv"].to_numpy())[by_id].T)
            parts = [best_of_rows(asked[i : i + ROWS_AT_ONCE], held, q_ids[i : i + ROWS_AT_ONCE], d_ids) for i in range(0, len(q_ids), ROWS_AT_ONCE)]
            rows, at, best = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows += np.repeat(np.arange(len(parts)) * ROWS_AT_ONCE, [len(x[0]) for x in parts])
            found = {"query_id": q_ids[rows], "interaction_id": d_ids[at], "score": best}
        return pd.DataFrame(found)

    return run


def vector_search(queries: DataFrame, documents: DataFrame, n: int = VECTOR_TOP, exclude_self: bool = False, block_rows: int = 20_000, block_queries: int = 5_000) -> DataFrame:
    """J10. (query_id, interaction_id, score, rank) by exact cosine within a customer; scores to nine decimals.

    queries (query_id, customer_id, embedding), documents (interaction_id, customer_id, embedding); ids aren't null.
    Vectors are normalised once. A customer's documents are split into blocks of about block_rows, and queries into
    parts of about block_queries; each pair of them gives its own top n of every query by products of ROWS_AT_ONCE
    queries with the block, and these are ranked again. That is exact, emits no pair rows, and keeps a large customer out
    of one task. Documents are shuffled once a part, so parts are as large as memory allows, not as a product does.
    """
    docs = documents.filter("embedding IS NOT NULL AND interaction_id IS NOT NULL").select("interaction_id", "customer_id", l2_normalize("embedding").alias("dv")).filter("dv IS NOT NULL")
    asked = queries.filter("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", "customer_id", l2_normalize("embedding").alias("qv")).filter("qv IS NOT NULL")
    blocks = docs.groupBy("customer_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    parts = asked.groupBy("customer_id").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("parts"))
    grid = blocks.join(parts, "customer_id")
    spread = lambda key, count: F.pmod(F.xxhash64(key), count).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asked = asked.join(grid, "customer_id").select("query_id", F.col("customer_id").alias("scope"), "qv", spread("query_id", F.col("parts")).alias("part"), each("blocks").alias("block"))
    docs = docs.join(grid, "customer_id").select("interaction_id", F.col("customer_id").alias("scope"), "dv", spread("interaction_id", F.col("blocks")).alias("block"), each("parts").alias("part"))
    kinds = dict(queries.dtypes)["query_id"], dict(documents.dtypes)["interaction_id"]
    keys = ["scope", "block", "part"]
    local = asked.groupBy(*keys).cogroup(docs.groupBy(*keys)).applyInPandas(_best_of_block(n, exclude_self), f"query_id {kinds[0]}, interaction_id {kinds[1]}, score double")
    return top_n(local, ["query_id"], [F.desc("score"), "interaction_id"], n)


#: Queries that lie in memory at once, and documents of a product: a worker holds some ten matrices of that size (8 MB each).
CHUNK_QUERIES, CHUNK_DOCUMENTS = 2_000, 512


def _running_best(ids: list, vectors: list, n: int, exclude_self: bool, fields: list[str]):
    """Each query's best n documents of a partition: what is kept so far and a batch's products give the next best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.stack([np.asarray(v) for v in vectors])
        own = pa.array(ids)
        width = asked.shape[1]
        best, found = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
        kept: pa.Array | None = None  # ids of the documents that some query holds
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), width))
            for start in range(0, batch.num_rows, CHUNK_DOCUMENTS):
                part = batch.slice(start, CHUNK_DOCUMENTS)
                score = np.round(asked @ part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).T, 9)
                if exclude_self:
                    same = pc.index_in(part.column(0), own)
                    at = np.flatnonzero(same.is_valid().to_numpy(zero_copy_only=False))
                    score[same.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64), at] = -np.inf
                known = part.column(0) if kept is None else pa.concat_arrays([kept, part.column(0)])
                place = np.asarray(pc.array_sort_indices(known)).argsort(kind="stable")  # ties go to the smaller id
                every = np.hstack([best, score])
                cols = np.hstack([found, np.broadcast_to(np.arange(len(known) - part.num_rows, len(known)), score.shape)])
                order = np.lexsort((place[cols], -every), axis=1)[:, :n]
                best, cols = np.take_along_axis(every, order, 1), np.take_along_axis(cols, order, 1)
                used, again = np.unique(cols, return_inverse=True)
                kept, found = known.take(pa.array(used)), again.reshape(cols.shape)
        if kept is not None:
            row, col = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), kept.take(pa.array(found[row, col])), pa.array(best[row, col])], fields)

    return run


def vector_search_global(queries: DataFrame, documents: DataFrame, n: int = 10, exclude_self: bool = False, chunk: int = CHUNK_QUERIES) -> DataFrame:
    """J11. (query_id, interaction_id, score, rank): the n documents of largest cosine, whatever their customer.

    Exact; ties to the smaller id. The queries' matrix goes to the documents in chunks of at most `chunk` queries (they
    are counted), so documents are neither shuffled nor copied: each partition keeps a running best n of every query, and
    only those rows meet, first by parts, then by query. Each chunk reads the documents once.
    """
    docs = documents.filter("embedding IS NOT NULL AND interaction_id IS NOT NULL").select("interaction_id", l2_normalize("embedding").alias("dv")).filter("dv IS NOT NULL")
    asked = queries.filter("embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", l2_normalize("embedding").alias("qv")).filter("qv IS NOT NULL")
    kinds = dict(queries.dtypes)["query_id"], dict(documents.dtypes)["interaction_id"]
    schema = f"query_id {kinds[0]}, interaction_id {kinds[1]}, score double"
    parts = max(1, -(-asked.count() // chunk))
    found = docs.sparkSession.createDataFrame([], schema)
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).collect()
        by_width: dict[int, list] = {}
        for r in rows:
            by_width.setdefault(len(r.qv), []).append(r)
        for some in by_width.values():
            best = _running_best([r.query_id for r in some], [r.qv for r in some], n, exclude_self, ["query_id", "interaction_id", "score"])
            found = found.unionByName(docs.mapInArrow(best, schema))
    order = [F.desc("score"), "interaction_id"]
    found = found.withColumn("part", F.spark_partition_id() % 64)
    found = top_n(found, ["query_id", "part"], order, n, "place").drop("place", "part")
    return top_n(found, ["query_id"], order, n)


def fuse(keyword: DataFrame, vector: DataFrame, k: int = RRF_K, n: int = FUSED_TOP) -> DataFrame:
    """J12. Reciprocal ranks of both lists: (query_id, interaction_id, fused, keyword_score, vector_score, rank).

    Ties stand in the order of the keyword list, then the vector list.
    """
    kw = keyword.select("query_id", "interaction_id", F.col("score").alias("keyword_score"), F.col("rank").alias("kr"))
    vec = vector.select("query_id", "interaction_id", F.col("score").alias("vector_score"), F.col("rank").alias("vr"))
    both = kw.join(vec, ["query_id", "interaction_id"], "full_outer")
    part = lambda r: F.coalesce(1 / (F.lit(k) + F.col(r)), F.lit(0.0))
    both = both.withColumn("fused", part("kr") + part("vr"))
    order = [F.desc(F.round("fused", 12)), F.asc_nulls_last("kr"), F.asc_nulls_last("vr")]
    return top_n(both, ["query_id"], order, n).select("query_id", "interaction_id", "fused", "keyword_score", "vector_score", "rank")


def hybrid_search(queries: DataFrame, interactions: DataFrame, keyword_n: int = KEYWORD_TOP, vector_n: int = VECTOR_TOP, fused_n: int = FUSED_TOP, k: int = RRF_K, match: str = "all", tickets: DataFrame | None = None, open_only: bool = False) -> DataFrame:
    """J13. J9, J10 and J12 over embeddable interactions (interaction_id, customer_id, lexemes, embedding, ...).

    All statuses take part; open_only leaves out those of terminal tickets.
    """
    docs = interactions.filter(is_embeddable())
    if open_only:
        live = tickets.filter("status NOT IN ('RESOLVED', 'CLOSED')").select(F.col("id").alias("ticket_id"))
        docs = docs.join(live, "ticket_id", "left_semi")
    return fuse(keyword_search(queries, docs, match, keyword_n), vector_search(queries, docs, vector_n), k, fused_n)
