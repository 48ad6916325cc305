"""Reports over pairs, clusters, scores and tables: distributions, shares, contracts, top lists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranks import percentiles


def gap_distribution(pairs: DataFrame, gap: str) -> DataFrame:
    """One row: min, p10, median, p90, max and mean of a gap."""
    all_ = pairs.agg(F.min(gap).cast("double").alias("min"), F.max(gap).cast("double").alias("max"), F.avg(gap).alias("mean"))
    at = percentiles(pairs, [], gap, [0.1, 0.5, 0.9])
    # one row each
    return all_.join(at).select("min", F.col("percentiles")[0].alias("p10"), F.col("percentiles")[1].alias("median"), F.col("percentiles")[2].alias("p90"), "max", "mean")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def normal_percentiles(mean: Column, deviation: Column) -> tuple[Column, Column]:
    """10th and 90th percentile of a normal distribution."""
    return mean - 1.2816 * deviation, mean + 1.2816 * deviation


def cluster_report(labels: DataFrame, group: str, eps: DataFrame, silhouettes: DataFrame | None = None) -> DataFrame:
    """group, n_rows, n_clusters, noise_pct, eps and, if given, silhouette; eps is null for groups that were not fitted."""
    out = labels.groupBy(group).agg(F.count("*").alias("n_rows"), F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"), F.round(100 * F.avg((F.col("label") == -1).cast("int")), 2).alias("noise_pct"))
    out = out.join(eps.select(group, "eps"), group, "left")
    return out if silhouettes is None else out.join(silhouettes, group, "left")


def share_check(rows: DataFrame, column: str, known: list[str], least: float = 0.9) -> DataFrame:
    """One row: the share of rows whose value is one of the known, and whether it is at least `least`."""
    share = F.avg(F.coalesce(F.col(column).isin(known), F.lit(False)).cast("int"))
    return rows.agg(share.alias("share")).withColumn("status", F.when(F.col("share") >= least, "pass").otherwise("fail"))


def schema_contract(feeds: dict[str, DataFrame], wanted: StructType, required: list[str]) -> DataFrame:
    """feed, field, problem: fields of the contract that a feed lacks or has as another type, and required ones with nulls.

    Only names and one count for each required field come together; feeds are read once each.
    """
    spark = next(iter(feeds.values())).sparkSession
    found, nulls = [], None
    for name, df in feeds.items():
        own = {f.name: f.dataType for f in df.schema}
        found += [(name, f.name, "missing" if f.name not in own else f"type {own[f.name].simpleString()}") for f in wanted if own.get(f.name) != f.dataType]
        some = [c for c in required if c in own]
        row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in some]).select(F.lit(name).alias("feed"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in some])).alias("e"))
        row = row.filter("e.n > 0").select("feed", "e.field", F.concat(F.lit("nulls "), F.col("e.n").cast("string")).alias("problem"))
        nulls = row if nulls is None else nulls.unionByName(row)
    return spark.createDataFrame(found, "feed string, field string, problem string").unionByName(nulls)


def negative_rows(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows (table, value) of tables whose count column is negative: a check that holds if there are none."""
    out = None
    for name, (df, column) in tables.items():
        rows = df.filter(F.col(column) < 0).select(F.lit(name).alias("table_name"), F.col(column).cast("long").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in order with `total`, the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def top(rows: DataFrame, order: list[Column], n: int, then: list[Column] | None = None) -> DataFrame:
    """The first n rows by order, given back in another order if wanted."""
    out = rows.orderBy(*order).limit(n)
    return out.orderBy(*then) if then else out


def with_bridge(observed: DataFrame, predicted: DataFrame, day: str, value: str) -> DataFrame:
    """Observed and predicted series in one table; the last observed day is in both, so that lines meet.

    observed: day, value. predicted: day, predicted, low, high.
    """
    last = observed.orderBy(F.desc(day)).limit(1)
    bridge = last.select(day, F.col(value).alias("observed"), F.col(value).alias("predicted"))
    rest = observed.join(last.select(day), day, "left_anti").select(day, F.col(value).alias("observed"))
    return rest.unionByName(bridge, allowMissingColumns=True).unionByName(predicted.select(day, "predicted", "low", "high"), allowMissingColumns=True)


def altitude_source(rows: DataFrame) -> Column:
    """altitude_ft where the table has it, else barometric altitude in feet."""
    return F.col("altitude_ft") if "altitude_ft" in rows.columns else F.col("baro_altitude") * 3.28084


def for_write(corridors: DataFrame) -> DataFrame:
    """A corridor table as it is stored: without mean and deviation of the altitude."""
    return corridors.drop("altitude_mean_ft", "altitude_std_ft")
