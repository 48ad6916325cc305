"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs free of ASCII white space, and runs of letters, digits and non-ASCII.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A table for bytes.translate: A-Z to a-z, other ASCII that is not a letter or digit to a space.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, so that other columns are neither read nor clash; a null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where a local session names none, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skylattice-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and outlives executors.

    Results are lazy and may read it at any later time, so folders are left to whoever clears the shared folder.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def uncollected():
    """No garbage collection meanwhile: for work that makes many objects and no cycles, in workers that are used again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def without_collection(run):
    """A task's function over batches, without garbage collection until it ends."""

    def all_of(batches):
        with uncollected():
            yield from run(batches)

    return all_of


class Places(dict):
    """Words (or their bytes) and their places, by first occurrence."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of all: the high ones are mostly zero."""
    if len(numbers) and not 0 <= int(numbers.min()) <= int(numbers.max()) < 1 << 32:
        raise OverflowError("a number does not fit four bytes")
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def rows_where(df: DataFrame, condition: Column) -> DataFrame:
    """df.filter(condition) for conditions on computed arrays.

    The optimizer moves a filter below the projections that compute what it reads and so computes that again, within
    lambdas once for each element; it doesn't move a generator.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(1)))).alias("__row")).drop("__row")


def text_slices(batches, max_bytes: int = 4 << 20):
    """Cut Arrow batches into runs of rows with about max_bytes of text each, so that memory does not follow the batch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist() if batch.num_rows else []
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if sizes:
            yield batch.slice(start)


def runs(batches, *keys: str):
    """Tables of rows that lie side by side with equal keys (never null), across Arrow batches; one run is held at a time."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])  # without copies
        n = table.num_rows
        new = np.zeros(n - 1, bool)
        for key in keys:
            column = table.column(key).combine_chunks()
            new |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(new) + 1).tolist()
        for start, end in zip(starts, starts[1:]):
            yield table.slice(start, end - start)
        held = table.slice(starts[-1])
    if held is not None:
        yield held
