"""Near duplicates by DartMinHash signatures, banded joins, exact checks and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, join_salted, small, table
from .components import connected_components

#: A list of at most so many candidate texts or buckets, or pairs, is broadcast, a longer one joined by shuffle.
BROADCAST_NODES, BROADCAST_PAIRS = 500_000, 100_000
GOLDEN, CHUNK = np.uint64(0x9E3779B97F4A7C15), 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, k: int, seed: int = 1) -> np.ndarray:
    """DartMinHash: an (n_docs, k) array with the identity of the earliest dart in each of k coordinates.

    elements: 64-bit ids, weights > 0, docs: the set each belongs to, from 0. Over every element lies a strip of
    darts, a Poisson process in weight and time that depends on the element alone. A set owns the darts that fall
    below its weights. Each dart carries a coordinate; a set keeps its earliest dart of each. Two sets agree in a
    coordinate with the probability of their weighted Jaccard similarity. The strip is cut into slabs of weight
    [0, 1), [1, 2), [2, 4), ..., in each of which darts arrive at the rate of its width. A set of weight W needs
    about k ln k + 2 k darts, thus only times up to that over W: in large sets most elements throw none. Sets with
    a coordinate still open are thrown again for twice the time.
    """
    out = np.zeros((n_docs, k), dtype=np.uint64)
    total = np.bincount(docs, weights=weights, minlength=n_docs)
    until = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    open_docs = total > 0
    while open_docs.any():
        pick = open_docs[docs]
        el, w, d = elements[pick], weights[pick], docs[pick]
        slab = 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(el):
            low, width = (0.0, 1.0) if slab == 0 else (2.0 ** (slab - 1), 2.0 ** (slab - 1))
            inside = w > low
            el, w, d = el[inside], w[inside], d[inside]
            state, at, lw, ld = mixed(el ^ mixed(np.full(1, seed * 1000 + slab, dtype=np.uint64))), np.zeros(len(el)), w, d
            while len(state):
                state = mixed(state + GOLDEN)
                at = at - np.log(uniform(state)) / width
                live = at <= until[ld]
                state, at, lw, ld = state[live], at[live], lw[live], ld[live]
                place = mixed(state ^ GOLDEN)
                hit = low + width * uniform(mixed(place + GOLDEN)) < lw if (lw < low + width).any() else np.ones(len(lw), dtype=bool)
                found.append((ld[hit] * k + (place[hit] % np.uint64(k)).astype(np.int64), at[hit], state[hit]))
            slab += 1
        key, at, dart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))
        first = np.full(n_docs * k, np.inf)
        np.minimum.at(first, key, at)
        won = at == first[key]
        out.reshape(-1)[key[won]] = dart[won]
        open_docs = open_docs & np.isinf(first.reshape(n_docs, k)).any(axis=1)
        until = np.where(open_docs, 2 * until, until)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), dtype=np.uint64)
    for b in range(bands):
        x = np.full(len(signatures), b + 1, dtype=np.uint64)
        for r in range(rows):
            x = mixed(x * GOLDEN + signatures[:, b * rows + r])
        out[:, b] = x
    return out.view(np.int64)


def _band_batches(bands: int, rows: int, counted: bool):
    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("shingles"))
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            keys, start = [], 0
            while start < len(lists):
                end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, side="right")) - 1)
                end = min(end, len(lists), start + 4096)
                el = flat[offsets[start] : offsets[end]]
                docs = np.repeat(np.arange(end - start), np.diff(offsets[start : end + 1]))
                weights = np.ones(len(el))
                if counted and len(el):
                    order = np.lexsort((el, docs))
                    el, docs = el[order], docs[order]
                    new = np.r_[True, (el[1:] != el[:-1]) | (docs[1:] != docs[:-1])]
                    at = np.flatnonzero(new)
                    weights, el, docs = np.diff(np.r_[at, len(el)]).astype(float), el[at], docs[at]
                keys.append(band_keys(dart_signatures(el, weights, docs, end - start, bands * rows), bands, rows))
                start = end
            made = np.concatenate(keys) if keys else np.zeros((0, bands), dtype=np.int64)
            sizes = np.where(np.diff(offsets) > 0, bands, 0)
            values = made[np.diff(offsets) > 0].reshape(-1)
            column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, f in enumerate(batch.schema) if f.name != "shingles"], column], [*[f.name for f in batch.schema if f.name != "shingles"], "bands"])

    return run


def normal_text(text: str = "text") -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def with_shingles(docs: DataFrame, shingle: int, distinct: bool) -> DataFrame:
    """(doc_id, node, shingles): node names the normalised text, shingles hashes its runs of `shingle` words.

    Words are split at white space, in lower case. A text of fewer words is one shingle; one of none has none.
    """
    df = docs.select("doc_id", normal_text().alias("norm")).select("doc_id", F.unhex(F.md5("norm")).alias("node"), F.when(F.col("norm") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))).alias("w"))
    made = F.expr(f"""if(size(w) > {shingle}, transform(sequence(1, size(w) - {shingle - 1}), i -> xxhash64(slice(w, i, {shingle}))),
        if(size(w) > 0, array(xxhash64(w)), w))""")
    return df.select("doc_id", "node", (F.array_distinct(made) if distinct else made).alias("shingles"))


def _occurrences(batches):
    """(node, shingles): a bag of shingles as a set, in which the second, third, ... of a kind have ids of their own.

    The Jaccard similarity of these sets is the weighted one of the bags.
    """
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("shingles"))
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        el, docs = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(lists)), np.diff(offsets))
        order = np.lexsort((el, docs))
        el, docs = el[order], docs[order]
        new = np.flatnonzero(np.r_[True, (el[1:] != el[:-1]) | (docs[1:] != docs[:-1])][: len(el)])
        nth = np.arange(len(el)) - np.repeat(new, np.diff(np.r_[new, len(el)]))
        el = np.where(nth > 0, mixed(el + nth.astype(np.uint64) * GOLDEN), el)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(el.view(np.int64)))], ["node", "shingles"])


def link_documents(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 25, rows: int = 5, weighting: str = "count") -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of all rows, and (node, comp) of the nodes that are linked.

    Exact copies are one node. Nodes that share a band are candidates; the exact weighted Jaccard similarity of
    their bags of shingles (weighting="presence": of the sets) decides. In each bucket, first every node is checked
    against the most central one, whose buckets are the largest, and what holds is joined to components. Then, in buckets whose nodes are of
    several components, the pairs across components are checked too, but for those that can't reach the threshold
    because too many of their shingles occur in no other text there. So no link between components is lost, and a
    bucket of many near copies doesn't emit its pairs. At 0.8 a pair shares no band once in 20,000.
    """
    counted = weighting == "count"
    sketches = cut(with_shingles(docs, shingle, not counted).mapInArrow(_band_batches(bands, rows, counted), "doc_id bigint, node binary, bands array<bigint>"))
    members = cut(sketches.select("doc_id", "node"))
    nodes = cut(sketches.filter("size(bands) > 0").groupBy("node").agg(F.min(F.struct("doc_id", "bands")).alias("x")), used=[sketches])
    places = nodes.select("node", F.explode("x.bands").alias("bucket"))
    many = bands * nodes.count()
    sizes = cut(places.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    # most places are alone in their bucket: as long as the list of others is short, they aren't shuffled
    met = places.join(F.broadcast(sizes), "bucket") if sizes.count() <= BROADCAST_NODES else join_salted(places, sizes, ["bucket"], "n", total=many)
    crowded = cut(met.select("bucket", "node", "n"), used=[sizes])
    # the middle of a group meets more of it than others do, so it is in larger buckets
    weights = crowded.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = crowded.join(weights, "node").select("bucket", "node", "weight")
    hubs = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("x"), F.count("*").alias("n")).select("bucket", F.col("x.node").alias("hub"), "n")
    many = crowded.count()
    shared = cut(join_salted(crowded.drop("n"), hubs, ["bucket"], "n", total=many).select("bucket", "node", "hub"), used=[crowded])
    wanted = cut(shared.select("node").distinct().join(nodes.select("node", F.col("x.doc_id").alias("rep")), "node"), used=[nodes])
    named = docs.select("doc_id", "text", F.unhex(F.md5(normal_text())).alias("node")).join(small(wanted, BROADCAST_NODES), "node").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    texts = with_shingles(named.select("doc_id", "text"), shingle, not counted).select("node", "shingles")
    texts = texts.mapInArrow(_occurrences, "node binary, shingles array<bigint>") if counted else texts
    texts = cut(texts.withColumn("size", F.size("shingles")))
    if texts.count() > wanted.count():  # of repeated rows one is enough
        texts = cut(texts.dropDuplicates(["node"]), used=[texts])
    drop(wanted)

    def checked(pairs: DataFrame) -> DataFrame:
        # only texts of these pairs are shuffled; few pairs go to the texts of one end, which then move once
        n, ends = pairs.count(), pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        few = n <= BROADCAST_PAIRS
        met = texts.join(F.broadcast(ends) if few else small(cut(ends), BROADCAST_NODES), "node", "left_semi")
        one, two = met.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), met.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        df = join_salted(join_salted(F.broadcast(pairs) if few else pairs, one, ["a"], total=n), two, ["b"], counted=pairs, total=n)
        # 1e-9 keeps pairs at the very threshold
        df = df.withColumn("both", F.size(F.array_intersect("sa", "sb"))).withColumn("linked", F.expr(f"both >= ({threshold} - 1e-9) * (size(sa) + size(sb) - both)"))
        return df.select("a", "b", "both", "linked").distinct()

    first = cut(shared.filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    to_hubs = cut(checked(first))
    links = to_hubs.filter("linked").select("a", "b")
    comps = connected_components(links)
    named = cut(shared.join(comps, "node", "left").select("bucket", "node", "hub", F.coalesce("comp", "node").alias("comp")), used=[shared])
    groups = named.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    several = groups.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("n")).filter("k > 1").select("bucket", "main", "n")
    mixed_up = cut(join_salted(named, several, ["bucket"], "n", total=many).drop("n"), used=[named])
    # shingles that no other text of these buckets has can't be shared: they bound the similarity of every pair
    met = mixed_up.select("node").distinct()
    met = F.broadcast(met) if mixed_up.count() <= BROADCAST_NODES else met
    alive = texts.join(met, "node", "left_semi")
    own = alive.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    alive = texts.select("node", "size").join(met, "node", "left_semi").join(own, "node", "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("both"))
    alive = alive.filter(f"both >= ({threshold} - 1e-9) * size")
    pairs = mixed_up.join(alive, "node").withColumn("a", F.least("hub", "node")).withColumn("b", F.greatest("hub", "node"))
    pairs = pairs.join(to_hubs.select("a", "b", F.col("both").alias("met")), ["a", "b"], "left").drop("a", "b")
    # shingles that the hub has too, and others that aren't the text's own: a pair shares no more than the lesser of each
    pairs = cut(pairs.withColumn("with_hub", F.when(F.col("node") == F.col("hub"), F.col("size")).otherwise(F.coalesce("met", "both"))), used=[mixed_up])
    others = pairs.filter("comp <> main").select("bucket", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("size").alias("zx"), F.col("both").alias("bx"), F.col("with_hub").alias("hx"))
    most = "least(bx, both, least(hx, with_hub) + least(greatest(bx - hx, 0), greatest(both - with_hub, 0)))"
    bound = f"{most} >= ({threshold} - 1e-9) * (zx + size - {most})"
    rest = (
        join_salted(pairs.select("bucket", F.col("node").alias("y"), F.col("comp").alias("cy"), "main", "size", "both", "with_hub"), others, ["bucket"], total=pairs.count())
        .filter(f"cx <> cy AND (cy = main OR x < y) AND {bound}")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
        .join(first, ["a", "b"], "left_anti")
    )
    rest = cut(rest, used=[pairs])
    more = cut(checked(rest).filter("linked").select("a", "b"), used=[rest, texts, first])
    if more.isEmpty():
        drop(to_hubs, more)
        return members, comps
    return members, connected_components(links.unionByName(more))


def _with_classes(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members with comp; a node with very many exact copies doesn't go to one task."""
    copies = members.groupBy("node").agg(F.count("*").alias("n")).join(comps, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"))
    return join_salted(members, copies, ["node"], "n", total=members.count()).drop("n")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, class_size): a row for each row of docs; class_id is the smallest doc_id of its class.

    Texts that are equal but for case and white space are of one class, and so are texts joined by a chain of
    links of link_documents(). Null and blank texts have no shingles: each row of them is a class of its own, with
    its own doc_id. Null doc_ids rank after others; a class without any id has a null class_id. Repeated rows are
    copies of each other. Other columns of docs aren't read.
    """
    members, comps = link_documents(docs, **options)
    blank = F.col("node") == F.unhex(F.md5(F.lit("")))
    full = cut(_with_classes(members.filter(~blank), comps).select("doc_id", "comp"))
    classes = full.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    out = join_salted(full, classes, ["comp"], "class_size", total=members.count()).select("doc_id", "class_id", "class_size")
    return out.unionByName(members.filter(blank).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, one of each class of near_duplicates(): that with the smallest doc_id; all columns.

    Blank and null texts all stay. Of repeated rows with that doc_id and text, one stays.
    """
    members, comps = link_documents(docs, **options)
    blank = F.unhex(F.md5(F.lit("")))
    full = cut(_with_classes(members.filter(F.col("node") != blank), comps))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node"))
    kept = full.groupBy("comp").agg(one.alias("x")).select(F.col("x.doc_id").alias("kept_id"), F.col("x.node").alias("kept_node"))
    copies = full.groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
    kept = kept.join(copies, (F.col("kept_node") == F.col("node")) & F.col("kept_id").eqNullSafe(F.col("doc_id")))
    kept = cut(kept.select("kept_id", "kept_node", "copies"))
    kept = small(kept, BROADCAST_NODES)
    named = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(normal_text())).alias("node"))
    found = named.join(kept, (F.col("node") == F.col("kept_node")) & F.col("row.doc_id").eqNullSafe(F.col("kept_id")))
    single = found.filter("copies = 1").select("row.*")
    repeated = found.filter("copies > 1").dropDuplicates(["kept_id", "kept_node"]).select("row.*")
    return single.unionByName(repeated).unionByName(named.filter(F.col("node") == blank).select("row.*"))


def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
