"""Exact ranks and percentiles without one task holding a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled, stored

PARTS = 64


def same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)], F.lit(True))


def ranked(df: DataFrame, keys: list[str], value: str, *ties: str) -> DataFrame:
    """df with rank_i (from 0, by value, then ties) and rank_n (rows) within keys; rows whose value is null are left out.

    A mergeable sketch of each group cuts its values into 64 parts of about equal size; a rank is the size of the parts
    before plus the place within the part, so that the largest sort is that of a part. A sketch depends on the order in which
    rows and partial sketches come, so the cuts are stored: parts are counted and ranked by the same ones.
    """
    own = df.columns
    df = df.filter(F.col(value).isNotNull()).withColumn("rank_v", F.col(value).cast("double"))
    named = [f"rank_k{i}" for i in range(len(keys))]
    to = lambda frame, *more: frame.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], *more)
    cuts = stored(df.groupBy(*keys).agg(F.percentile_approx("rank_v", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), F.lit(1000)).alias("rank_cuts"), F.count("*").alias("rank_n")))
    rows = df.join(to(cuts, "rank_cuts", "rank_n"), same(keys, named))
    rows = rows.select(*own, "rank_v", "rank_n", F.size(F.filter("rank_cuts", lambda x: x < F.col("rank_v"))).alias("rank_p"))
    w = Window.partitionBy(*keys).orderBy("rank_p").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows a group
    before = rows.groupBy(*keys, "rank_p").agg(F.count("*").alias("rank_c")).withColumn("rank_b", F.coalesce(F.sum("rank_c").over(w), F.lit(0)))
    out = rows.join(to(before, F.col("rank_p").alias("rank_q"), "rank_b"), same(keys, named) & (F.col("rank_p") == F.col("rank_q")))
    place = F.row_number().over(Window.partitionBy(*keys, "rank_p").orderBy("rank_v", *ties)) - 1
    return out.select(*own, "rank_n", (F.col("rank_b") + place).alias("rank_i"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float], few: int = 100_000) -> DataFrame:
    """keys and an array of the exact percentiles of value, between two values linear; equal values are counted first.

    Where no group is counted to have more than `few` different values they are one aggregate, else they are ranked in parts.
    """
    # read several times below, while what it is made of may be dear
    counts = settled(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("pct_v")).agg(F.count("*").alias("pct_c")))
    if (counts.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0) <= few:
        return counts.groupBy(*keys).agg(F.percentile("pct_v", F.array(*map(F.lit, at)), F.col("pct_c")).alias("percentiles"))
    rows = ranked(counts, keys, "pct_v")
    # ranks of distinct values become ranks of rows by the same parts: sums of counts before
    named = [f"pct_k{i}" for i in range(len(keys))]
    part = F.floor(F.col("rank_i") * PARTS / F.col("rank_n"))
    rows = rows.withColumn("pct_p", part)
    w = Window.partitionBy(*keys).orderBy("pct_p").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "pct_p").agg(F.sum("pct_c").alias("pct_s")).withColumn("pct_b", F.coalesce(F.sum("pct_s").over(w), F.lit(0))).withColumn("pct_t", F.sum("pct_s").over(Window.partitionBy(*keys)))
    before = before.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col("pct_p").alias("pct_q"), "pct_b", "pct_t")
    rows = rows.join(before, same(keys, named) & (F.col("pct_p") == F.col("pct_q")))
    upto = F.col("pct_b") + F.sum("pct_c").over(Window.partitionBy(*keys, "pct_p").orderBy("pct_v"))
    rows = rows.withColumn("pct_u", upto)
    holds = lambda rank: (F.col("pct_u") > rank) & (F.col("pct_u") - F.col("pct_c") <= rank)
    one = []
    for i, p in enumerate(at):
        pos = F.lit(p) * (F.col("pct_t") - 1)
        one += [F.max(F.when(holds(F.floor(pos)), F.col("pct_v"))).alias(f"lo{i}"), F.max(F.when(holds(F.ceil(pos)), F.col("pct_v"))).alias(f"hi{i}"), F.max(pos - F.floor(pos)).alias(f"f{i}")]
    got = rows.groupBy(*keys).agg(*one)
    return got.select(*keys, F.array(*[F.col(f"lo{i}") + F.col(f"f{i}") * (F.col(f"hi{i}") - F.col(f"lo{i}")) for i in range(len(at))]).alias("percentiles"))
