"""Sums of distances between all points of a group: parts of its points meet in tiles, each a pair of parts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

HIGH, WIDE = 16, 2048  # distances held at a time stay in a core's cache
PACKED = "g string, label long, first long, n long, ids binary, weights binary, names binary, counts binary, wholes binary, x binary"


class Part(NamedTuple):
    ids: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    names: np.ndarray  # of labels, in order
    starts: np.ndarray  # where they start
    n: np.ndarray  # points that they have here, equal ones counted
    cut: np.ndarray  # whether they have others


def packed(points: DataFrame, dims: list[str], size: int) -> DataFrame:
    """Blocks of up to `size` points of one group (null: the empty text) as bytes, in order of labels; labels as runs."""
    rows = points.select(F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit("")).alias("g"), "event_id", "label", "weight", "whole", *dims)
    rows = rows.repartitionByRange("g", "label", "event_id").sortWithinPartitions("g", "label", "event_id")

    def run(batches):
        for batch in batches:
            g = batch.column("g").to_pylist()
            ids, labels, weights, wholes = (batch.column(c).to_numpy().astype(np.int64) for c in ("event_id", "label", "weight", "whole"))
            x = np.stack([batch.column(d).to_numpy() for d in dims], 1)
            starts = [i for i in range(len(g)) if not i or g[i] != g[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(g)]):
                for at in range(start, end, size):
                    b = slice(at, min(at + size, end))
                    runs = np.flatnonzero(np.append(True, labels[b][1:] != labels[b][:-1]))
                    counts = np.diff(np.append(runs, len(ids[b])))
                    blobs = [ids[b], weights[b], labels[b][runs], counts, wholes[b][runs], x[b]]
                    yield pa.RecordBatch.from_arrays([pa.array([g[start]]), *[pa.array([int(v)]) for v in (labels[at], ids[at], len(ids[b]))], *[pa.array([v.tobytes()], pa.binary()) for v in blobs]], PACKED_NAMES)

    return rows.mapInArrow(run, PACKED)


PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def part(table: pa.Table, width: int) -> Part:
    """The points of some blocks."""
    table = table.sort_by([("label", "ascending"), ("first", "ascending")])
    whole = lambda c, kind=np.int64: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    weights, names, counts = whole("weights"), whole("names"), whole("counts")
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))  # labels go on in the next block
    starts = (np.cumsum(counts) - counts)[first]
    n = np.add.reduceat(weights, starts)
    return Part(whole("ids"), weights.astype(float), whole("x", float).reshape(-1, width), names[first], starts, n, n < whole("wholes")[first])


def sums(a: Part, b: Part):
    """(event_id, other, s, n) of the points of a by the labels of b and, if they are two parts, of those of b by the labels of a.

    Of labels that have no points elsewhere a point gets the nearest only, besides its own.
    """
    same = a is b
    middle = b.x.mean(0)  # small numbers cancel less
    x, y = a.x - middle, b.x - middle
    # products are squared distances times squared weights
    rows = np.column_stack([-2 * x, (x**2).sum(1), np.ones(len(x))]) * a.weights[:, None] ** 2
    columns = np.vstack([y.T, np.ones(len(y)), (y**2).sum(1)]) * b.weights**2
    pieces = []
    for at in range(0, len(y), WIDE):
        end = min(at + WIDE, len(y))
        label = np.searchsorted(b.starts, at, "right") - 1
        inner = b.starts[(b.starts > at) & (b.starts < end)] - at
        pieces.append((at, end, np.ascontiguousarray(columns[:, at:end]), np.append(0, inner), slice(label, label + 1 + len(inner))))
    room = np.empty((HIGH, WIDE))
    near = np.full(len(y), np.inf)  # of the points of b: the nearest whole label of a
    near_s, near_label = np.zeros((2, len(y)))
    near_label = near_label.astype(np.int64)
    ends = np.append(a.starts[1:], len(x))
    for label, (start, stop) in enumerate([(0, len(x))] if same else zip(a.starts, ends)):
        down = np.zeros(len(y))
        for at in range(start, stop, HIGH):
            some = rows[at : min(at + HIGH, stop)]
            h = len(some)
            total = np.zeros((h, len(b.names)))
            for left, right, piece, inner, labels in pieces:
                far = room[:h, : right - left]
                np.matmul(some, piece, out=far)
                np.abs(far, out=far)  # zero may come out as less
                np.sqrt(far, out=far)
                if same:
                    i = np.arange(max(at, left), min(at + h, right))
                    far[i - at, i - left] = 0
                else:
                    down[left:right] += far.sum(0)
                if len(inner) == 1:
                    total[:, labels.start] += far.sum(1)
                else:
                    total[:, labels] += np.add.reduceat(far, inner, axis=1)
            total /= a.weights[at : at + h, None]
            own = np.searchsorted(a.starts, np.arange(at, at + h), "right") - 1
            kept = (a.names[own][:, None] == b.names) | b.cut
            means = np.where(kept, np.inf, total / b.n)
            i, best = np.arange(h), means.argmin(1)
            kept[i, best] |= np.isfinite(means[i, best])
            i, j = np.nonzero(kept)
            yield a.ids[at + i], b.names[j], total[i, j], b.n[j]
        if not same:
            down /= b.weights
            if a.cut[label]:
                yield b.ids, np.full(len(y), a.names[label]), down, np.full(len(y), a.n[label])
            else:
                nearer = np.flatnonzero(down / a.n[label] < near)
                near[nearer], near_s[nearer], near_label[nearer] = down[nearer] / a.n[label], down[nearer], label
    i = np.flatnonzero(np.isfinite(near))
    yield b.ids[i], a.names[near_label[i]], near_s[i], a.n[near_label[i]]


def distance_sums_of_all(points: DataFrame, dims: list[str], part_size: int = 1 << 17, block: int = 10_000, least: int = 8) -> DataFrame:
    """(event_id, other, s, n): the sum of distances from each point (g, event_id, label, weight, whole, dims) to the points
    of its own label, and of the other label of its group with the least mean distance and some more, and their numbers.

    weight: how many equal points one stands for; whole: how many points its label has, equal ones counted. Points of a
    group are cut into parts in order of labels, `least` or as many as hold `part_size` points. Each pair of parts is a
    tile and a distance is computed once for both its points. A task holds two parts; work grows with the square of a
    group's size, what is moved with that square over the part size.
    """
    found = stored(packed(points, dims, block))
    of = Window.partitionBy("g")
    wide = F.least(F.lit(part_size), F.greatest(F.lit(block), F.ceil(F.sum("n").over(of) / least)))
    at = found.select("g", "label", "first", "n").withColumn("before", F.sum("n").over(of.orderBy("label", "first")) - F.col("n"))  # a row per block
    at = at.select("g", F.col("first").alias("__first"), F.floor(F.col("before") / wide).alias("part"))
    at = stored(at.withColumn("parts", F.max("part").over(of) + 1))
    n = at.select("g", "parts").distinct().agg(F.sum(F.col("parts") * (F.col("parts") + 1) / 2)).head()[0] or 1
    tiles = found.join(at.drop("g"), F.col("first") == F.col("__first")).drop("__first")
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>")))
    tiles = tiles.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "parts", "n")
    schema = pa.schema([("event_id", pa.int64()), ("other", pa.int64()), ("s", pa.float64()), ("n", pa.int64())])

    def run(tile: pa.Table) -> pa.Table:
        parts = tile.column("part").to_numpy()
        sides = [part(tile.take(pa.array(np.flatnonzero(parts == p))), len(dims)) for p in np.unique(parts)]
        if len(sides) == 1 and tile.column("lo")[0] != tile.column("hi")[0]:
            return schema.empty_table()
        rows = list(sums(sides[0], sides[-1]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], schema=schema)

    # more partitions than tiles, as hashes collide
    met = tiles.repartition(min(3 * int(n), 2000), "g", "lo", "hi").groupBy("g", "lo", "hi").applyInArrow(run, "event_id long, other long, s double, n long")
    return met.groupBy("event_id", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
