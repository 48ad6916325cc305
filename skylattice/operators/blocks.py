"""Points within a radius of others, worked by blocks of space: a block's points and those around it are one unit."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.shared import stored

WIDE, EDGE = 4.0, 1e-9  # blocks are so many radii wide; what lies on the edge of a radius is dealt to both sides
PAIRS = 1 << 16  # distances held at a time
FEW = 100_000  # blocks that are broadcast


def dealt(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Rows (__group, __r, __asks, dims, ...) once for each block that they are in or at most a radius away from, as __block; __mine: asking rows in their own block."""
    schema = StructType([*rows.schema.fields]).add("__block", "long").add("__mine", "boolean")

    def mixed(h, cell):
        h = (h ^ cell.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def run(batches):
        for batch in batches:
            r = batch.column("__r").to_numpy()
            start = batch.column("__group").to_numpy().view(np.uint64)
            asks = batch.column("__asks").to_numpy(zero_copy_only=False)
            cells = []
            for d in dims:
                x = batch.column(d).to_numpy()
                cells.append([np.floor((x + s * (1 + EDGE) * r) / (WIDE * r) + 0.5).astype(np.int64) for s in (-1, 0, 1)])  # zero is the middle of a block
            home = start
            for _, own, _ in cells:
                home = mixed(home, own)
            for sides in product((0, 2), repeat=len(dims)):
                block, here = start, np.full(len(r), True)
                for side, cell in zip(sides, cells):
                    block = mixed(block, cell[side])
                    if side:
                        here &= cell[2] != cell[0]
                at = np.flatnonzero(here)
                if len(at):
                    out = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(block[at].view(np.int64)), pa.array((asks & (block == home))[at])], [*out.schema.names, "__block", "__mine"])

    return rows.mapInArrow(run, schema)


def by_block(rows: DataFrame, asking: Column, group: str, radius: Column, dims: list[str], run, schema: str, kept: tuple = ("event_id",), all_ask: bool = False) -> DataFrame:
    """What run makes of the blocks that have asking rows, as (columns, x, mine, radius) of a block.

    A block is four radii wide and has the rows in it and those up to a radius around, so that a row is dealt to a few
    blocks (in d dimensions 1.5 ** d of them on average), not to 3 ** d cells. mine marks the asking rows that lie in the
    block; each is asked for in one block only. radius is the same throughout a group. Where few blocks have asking rows,
    which is counted unless all rows ask, rows of other blocks are left out before the shuffle. Of columns only kept ones are dealt.
    """
    one = rows.select(*kept, *dims, F.xxhash64(group).alias("__group"), radius.cast("double").alias("__r"), asking.alias("__asks"))
    met = dealt(one, dims)
    if not all_ask:
        asked = one.filter("__asks").select(*dims, "__group", "__r", "__asks")
        wanted = stored(dealt(asked, dims).filter("__mine").select(F.col("__block").alias("__w")).distinct())
        if wanted.count() <= FEW:
            met = met.join(F.broadcast(wanted), F.col("__block") == F.col("__w"), "left_semi")
    met = met.drop("__group", "__asks")

    def work(batches):
        held = []  # of the last block, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = batch.column("__block").to_numpy()
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for start, end in zip([0, *ends], ends):
                if held and (start or held[0].column("__block")[0].as_py() != keys[0]):
                    yield from answers(pa.concat_tables(held))
                    held = []
                held.append(table.slice(start, end - start))
        if held:
            yield from answers(pa.concat_tables(held))

    def answers(block: pa.Table):
        mine = np.flatnonzero(block.column("__mine").to_numpy())
        if len(mine):
            block = block.combine_chunks()
            x = np.stack([block.column(d).to_numpy() for d in dims])
            yield from pa.table(run(block, x, mine, block.column("__r")[0].as_py())).to_batches()

    return met.repartition("__block").sortWithinPartitions("__block").mapInArrow(work, schema)


def squares(x: np.ndarray, asked: np.ndarray):
    """(some columns of asked, their squared distances to the columns of x), in pieces of bounded size that share memory."""
    n, step = x.shape[1], max(1, PAIRS // max(1, x.shape[1]))
    total, part = np.empty((2, min(step, asked.shape[1]), n))
    for at in range(0, asked.shape[1], step):
        some = np.arange(at, min(at + step, asked.shape[1]))
        t, p = total[: len(some)], part[: len(some)]
        t[:] = 0
        for row, own in zip(x, asked):
            np.subtract(own[some, None], row, out=p)
            np.multiply(p, p, out=p)
            np.add(t, p, out=t)
        yield some, t


def kth_distances(points: DataFrame, asking: Column, group: str, radius: Column, dims: list[str], k: int, all_ask: bool = False) -> DataFrame:
    """(event_id, k_distance) of asking points with at least k points, themselves included, within the radius."""

    def run(table, x, mine, r):
        ids, found = [], []
        if x.shape[1] >= k:
            for some, far in squares(x, x[:, mine]):
                far = np.sqrt(np.partition(far, k - 1, axis=1)[:, k - 1])
                ids.append(mine[some[far <= r]])
                found.append(far[far <= r])
        ids = np.concatenate(ids) if ids else mine[:0]
        return {"event_id": table.column("event_id").take(pa.array(ids)), "k_distance": np.concatenate(found) if found else np.zeros(0)}

    return by_block(points, asking, group, radius, dims, run, "event_id long, k_distance double", all_ask=all_ask)


def counts_within(points: DataFrame, asking: Column, group: str, radius: Column, dims: list[str]) -> DataFrame:
    """(event_id, count): the number of points within the radius of asking points, themselves included."""

    def run(table, x, mine, r):
        n = [(np.sqrt(far) <= r).sum(1) for _, far in squares(x, x[:, mine])]
        return {"event_id": table.column("event_id").take(pa.array(mine)), "count": np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)}

    return by_block(points, asking, group, radius, dims, run, "event_id long, count long")


def linked_within(points: DataFrame, asking: Column, own: str, group: str, radius: Column, dims: list[str]) -> DataFrame:
    """(event_id, node, root) from the core points around each asking point; own: a core point's node, null for others.

    Nodes that asking core points link within a block come as (null, node, root), root the smallest node they are linked
    to there; an asking point that is not core as (event_id, null, root) for each root next to it. A block returns a row for
    a node, however many pairs it has.
    """

    def run(table, x, mine, r):
        owns = table.column(own).combine_chunks()
        core = owns.is_valid().to_numpy(zero_copy_only=False)
        nodes, at = np.unique(owns.fill_null(0).to_numpy()[core], return_inverse=True)
        place = np.full(len(core), -1)
        place[core] = at
        inside, beside = [], []
        for some, far in squares(x[:, core], x[:, mine]) if len(nodes) else ():
            i, j = np.nonzero(np.sqrt(far) <= r)
            i, j = mine[some[i]], at[j]
            mid = core[i]
            inside.append(np.unique(place[i[mid]] * len(nodes) + j[mid]))
            beside.append(np.unique(i[~mid] * len(nodes) + j[~mid]))
        a, b = np.divmod(np.concatenate(inside), len(nodes)) if inside else (place[:0], place[:0])
        up = np.arange(len(nodes))
        while True:
            x1, x2 = up[a], up[b]
            open_ = x1 != x2
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(up, np.maximum(x1, x2)[open_], np.minimum(x1, x2)[open_])
            while (up[up] != up).any():
                up = up[up]
        moved = np.flatnonzero(up != np.arange(len(up)))
        e, b = np.divmod(np.concatenate(beside), len(nodes)) if beside else (place[:0], place[:0])
        e, b = np.divmod(np.unique(e * max(1, len(nodes)) + up[b]), max(1, len(nodes)))
        gap = lambda n: pa.nulls(n, pa.int64())
        ids = table.column("event_id").take(pa.array(e)).combine_chunks()
        return {
            "event_id": pa.concat_arrays([gap(len(moved)), ids]), "node": pa.concat_arrays([pa.array(nodes[moved]), gap(len(e))]),
            "root": pa.concat_arrays([pa.array(nodes[up[moved]]), pa.array(nodes[b])]),
        }

    return by_block(points, asking, group, radius, dims, run, "event_id long, node long, root long", ("event_id", own))
