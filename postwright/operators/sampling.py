"""Reproducible draws by hashed ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import global_rank


def uniform(key, dimension: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the row's key, the dimension and the seed alone (52 bits of an MD5)."""
    text = F.concat_ws("|", F.col(key).cast("string") if isinstance(key, str) else key, F.lit(dimension), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted_value(key, dimension: str, weights: dict[str, float], seed: int = 0) -> Column:
    """R1. A value drawn by its weight: the first whose cumulated share exceeds the row's number."""
    total, upto = sum(weights.values()), 0.0
    u, out = uniform(key, dimension, seed), None
    for v, w in list(weights.items())[:-1]:
        upto += w / total
        out = F.when(u < upto, v) if out is None else out.when(u < upto, v)
    last = list(weights)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def floor_then_weighted(df: DataFrame, key: str, dimension: str, weights: dict[str, float], floor: int, total: int, seed: int = 0) -> DataFrame:
    """R2. Add the dimension: each value min(floor, max(1, total // values)) times, the rest drawn by weight.

    Which rows are forced is settled by their place in hashed order, counted over ranges of that order, so the number
    of forced rows isn't bounded by what one task can sort. Rows with a null key are never forced.
    """
    values = list(weights)
    need = min(min(floor, max(1, total // max(1, len(values)))) * len(values), total)
    u = uniform(key, f"{dimension}/order", seed)
    keyed = df.filter(F.col(key).isNotNull())
    ranked = global_rank(keyed.select(F.col(key).alias("fl__k"), u.alias("fl__u")), [F.col("fl__u"), F.col("fl__k")], "fl__p").filter(F.col("fl__p") <= need)
    names = F.array(*[F.lit(v) for v in values])
    forced = ranked.select("fl__k", F.get(names, ((F.col("fl__p") - 1) % len(values)).cast("int")).alias("fl__v"))
    df = df.join(forced, F.col(key) == F.col("fl__k"), "left")
    return df.withColumn(dimension, F.coalesce("fl__v", weighted_value(key, dimension, weights, seed))).drop("fl__k", "fl__v")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """R3. n rows of each stratum in hashed order."""
    order = Window.partitionBy(stratum).orderBy(uniform(key, "stratified", seed), key)
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("place")
