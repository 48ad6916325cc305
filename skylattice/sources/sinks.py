"""Sinks: partitioned appends, table replacement, mirrors, runs, and a keyed upsert on plain Parquet."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..operators.joins import keep_last


def append_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Replace all of a table on files."""
    df.write.mode("overwrite").parquet(path)


def fixed(df: DataFrame, schema: str) -> DataFrame:
    """df with just the columns of a schema, in its order and types; a column that it lacks is null."""
    return df.to(_parse_datatype_string(schema))


def split_valid(batch: DataFrame, good_path: str, bad_path: str, batch_id: int | None = None) -> None:
    """A batch of raw messages: valid ones as (key, value) to one place, others as (raw, error, source) to the other.

    With its id each place has one folder for the batch, which a replay of the batch overwrites, so that both hold it once.
    """
    from ..streaming.jobs import rejected, valid

    for rows, path in ((valid(batch), good_path), (rejected(batch), bad_path)):
        if batch_id is None:
            rows.write.mode("append").parquet(path)
        else:
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def drop_expired(spark: SparkSession, path: str, day: str, today: str, days: int = 30, table: str | None = None) -> list[str]:
    """Remove the folders `day`=yyyy-mm-dd under path that are `days` old or older at `today`, and their partitions from a
    table of the catalog; the days removed. Folders of other names, and those that are no days, stay.
    """
    oldest = datetime.date.fromisoformat(today) - datetime.timedelta(days)
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        name, _, value = status.getPath().getName().partition("=")
        try:
            old = name == day and datetime.date.fromisoformat(value) <= oldest
        except ValueError:
            continue
        if old:
            if table is not None:
                spark.sql(f"alter table {table} drop if exists partition ({day} = '{value}')")
            fs.delete(status.getPath(), True)
            gone.append(value)
    return sorted(gone)


def register_run(spark: SparkSession, name: str, path: str, schema: str, run_ts: str) -> None:
    """Make a run's partition known to the catalog; the table is created with the first, one that is known stays."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _parse_datatype_string(schema))
    spark.sql(f"create table if not exists {name} ({columns}, run_ts string) using parquet partitioned by (run_ts) location '{path}'")
    spark.sql(f"alter table {name} add if not exists partition (run_ts = '{run_ts}') location '{path}/run_ts={run_ts}'")


def retained(table: DataFrame, day: str, today: str, days: int = 30) -> DataFrame:
    """Rows of the partitions (by a day column) that are kept at `today`; written to a new place, it is the retention job."""
    return table.filter(F.to_date(day) > F.date_sub(F.lit(today).cast("date"), days))


def replace_table(df: DataFrame, name: str) -> None:
    """Replace a table's rows and keep the table, so that views on it live on."""
    if df.sparkSession.catalog.tableExists(name):
        df.write.insertInto(name, overwrite=True)
    else:
        df.write.saveAsTable(name)


def mirror(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    """Truncate a table of another database and fill it."""
    df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", batchsize=str(batch), **options).mode("overwrite").save()


def append_run(df: DataFrame, path: str, run_ts: str) -> None:
    """One partition per run; a run that is there already is left as it is."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_ts={run_ts}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").parquet(f"{path}/run_ts={run_ts}")


def write_artifact(corridors: DataFrame, params: dict, path: str, run: str, min_rows: int = 5000) -> bool:
    """The corridor table as JSON under its version, and as the canonical one if enough rows went into it."""
    doc = corridors.withColumn("params", F.lit(json.dumps(params, sort_keys=True)))
    doc.coalesce(1).write.mode("overwrite").json(f"{path}/v={run}")  # a few hundred rows
    enough = (corridors.agg(F.sum("member_count")).head()[0] or 0) >= min_rows
    if enough:
        doc.coalesce(1).write.mode("overwrite").json(f"{path}/current")
    return enough


class Upsert:
    """A table of one row per key, the latest, on plain Parquet: hash buckets in versions, with a pointer written last.

    A batch rewrites only the buckets that it has keys of; the others stay where they are. The pointer lists each
    bucket's folder and the last batch, so a reader sees all of a batch or nothing, and a replayed batch is skipped.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets
        jvm = spark._jvm
        self.fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")

    def pointer(self, batch: int | None = None) -> dict:
        """The newest pointer, or the newest up to a batch."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []
        versions = sorted(n for n in names if n.startswith("pointer-") and (batch is None or n <= f"pointer-{batch:020d}"))
        if not versions:
            return {"batch": -1, "buckets": {}}
        stream = self.fs.open(self.at(versions[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, batch: int | None = None) -> DataFrame | None:
        """The table, now or as it was after a batch."""
        folders = [f"{self.path}/{v}" for v in sorted(set(self.pointer(batch)["buckets"].values()))]
        return self.spark.read.parquet(*folders) if folders else None

    def clear(self, before: int) -> None:
        """Remove what no pointer from batch `before` on needs; older versions can't be read after it."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(""))]
        oldest = self.pointer(before)
        kept = [oldest, *(self.pointer(int(n[8:])) for n in names if n.startswith("pointer-") and int(n[8:]) > before)]
        needed = {v for p in kept for v in p["buckets"].values()}
        for n in names:
            if n.startswith("pointer-") and int(n[8:]) < oldest["batch"]:
                self.fs.delete(self.at(n), False)
            elif n.startswith("v="):
                for s in self.fs.listStatus(self.at(n)):
                    if s.isDirectory() and f"{n}/{s.getPath().getName()}" not in needed:
                        self.fs.delete(s.getPath(), True)

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        held = self.pointer()
        if batch_id <= held["batch"] or batch.isEmpty():
            return
        rows = batch.withColumn("__b", F.pmod(F.xxhash64("icao24"), F.lit(self.buckets)))
        touched = [str(r[0]) for r in rows.select("__b").distinct().collect()]  # at most `buckets`
        old = [f"{self.path}/{held['buckets'][b]}" for b in touched if b in held["buckets"]]
        if old:
            rows = rows.unionByName(self.spark.read.parquet(*old).withColumn("__b", F.pmod(F.xxhash64("icao24"), F.lit(self.buckets))))
        keep_last(rows).write.mode("overwrite").partitionBy("__b").parquet(f"{self.path}/v={batch_id:020d}")
        held["buckets"].update({b: f"v={batch_id:020d}/__b={b}" for b in touched})
        # under another name until it is whole
        new, name = self.at(f"_new-{batch_id:020d}"), self.at(f"pointer-{batch_id:020d}")
        out = self.fs.create(new, True)
        out.write(bytearray(json.dumps({"batch": batch_id, "buckets": held["buckets"]}).encode()))
        out.close()
        if not self.fs.rename(new, name):
            raise OSError(f"{name.toString()} could not be written")
