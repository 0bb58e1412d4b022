"""Near-duplicate embeddings by collision counting on sorted random projections.

Which vectors meet: a table draws Gaussian directions and sorts each vector's projections on them; the vector stands in the cells of the few
directions where it reaches farthest out, on their side. Two vectors of one cell meet. For Gaussian directions the projections of two unit
vectors are bivariate normal with their cosine as correlation, whatever their dimension, so the probability to share a cell is simulated once, and
tables are added until a linked pair misses them all with a probability below MISS. With more vectors a cell takes a combination of several such draws.

What is counted: vectors that meet are sorted on many more projections; each query's windows around its own projections are counted for each
pair, pairs with the calibrated count are verified by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import skew_join, work_table
from dirlake.llm.graph import components

#: Least cosine of a link, counted projections, half width of a window in standard deviations of a linked pair's difference, chance to miss a link.
COSINE, PROJECTIONS, REACH, MISS = 0.93, 24, 2.0, 1e-6
#: Directions that a draw may have, the farthest of them that a vector stands in, members of a cell that are aimed at, and of a block that a larger cell is dealt into.
DIRECTIONS, FARTHEST, LEAF, BLOCK = (8, 16, 32, 64, 128, 256), 3, 512, 1024


@lru_cache(maxsize=8)
def least_count(projections: int = PROJECTIONS, reach: float = REACH, miss: float = MISS / 2) -> int:
    """The largest number of collisions that a pair at the least cosine falls short of with probability `miss` at most."""
    p = math.erf(reach / math.sqrt(2))
    below, k = 0.0, 0
    while below + math.comb(projections, k) * p**k * (1 - p) ** (projections - k) <= miss:
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        k += 1
    return k


@lru_cache(maxsize=64)
def sharing(cosine: float, directions: int, farthest: int = FARTHEST, pairs: int = 8192) -> float:
    """How often two unit vectors at a cosine share a cell of one draw; three standard errors less, so that tables err on the safe side."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(pairs, directions)).astype(np.float32)
    y = (cosine * x + math.sqrt(1 - cosine * cosine) * rng.normal(size=x.shape)).astype(np.float32)
    a, b = _farthest(x, farthest), _farthest(y, farthest)
    p = (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()
    return float(p - 3 * math.sqrt(p * (1 - p) / pairs))


def plan(n: int, cosine: float = COSINE, leaf: int = LEAF, miss: float = MISS / 2) -> tuple[int, int, int]:
    """(directions of a draw, draws that make up a cell, tables) for groups of `n` vectors: the fewest whose cells have about `leaf` members at most. Up to `leaf` vectors meet all, in one table."""
    if n <= leaf:
        return DIRECTIONS[0], 0, 1
    draws, few = 1, [d for d in DIRECTIONS if n * FARTHEST / (2 * d) <= leaf]
    while n * (FARTHEST / (2 * DIRECTIONS[-1])) ** draws > leaf:
        draws += 1
    directions = few[0] if few else DIRECTIONS[-1]
    return directions, draws, math.ceil(math.log(miss) / math.log(1 - sharing(cosine, directions) ** draws))


@lru_cache(maxsize=8)
def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, n)).astype(np.float32)


def _farthest(p: np.ndarray, k: int) -> np.ndarray:
    """The cells, twice the direction's number plus its side, of the `k` farthest projections of each row."""
    k = min(k, p.shape[1])
    at = np.argpartition(-np.abs(p), k - 1, axis=1)[:, :k]
    return (2 * at + (np.take_along_axis(p, at, 1) > 0)).astype(np.int64)


def _cells(v: np.ndarray, directions: int, draws: int, tables: int) -> np.ndarray:
    """(rows, tables, FARTHEST ** draws) cells of unit vectors."""
    if draws == 0:
        return np.zeros((len(v), 1, 1), np.int64)
    out = np.empty((len(v), tables, FARTHEST**draws), np.int64)
    for t in range(tables):
        cell = np.zeros((len(v), 1), np.int64)
        for d in range(draws):
            own = _farthest(v @ _directions(v.shape[1], directions, 1 + t * draws + d), FARTHEST)
            cell = (cell[:, :, None] * (2 * directions) + own[:, None, :]).reshape(len(v), -1)
        out[:, t] = cell
    return out


def cells_of(embedding: Column, directions: int, draws: int, tables: int) -> Column:
    """The cells of a vector, table by table."""

    @F.arrow_udf("array<bigint>")
    def cells(lists: pa.Array) -> pa.Array:
        size = np.diff(lists.offsets.to_numpy())
        flat, start = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        width = tables * FARTHEST**draws if draws else 1
        out = np.empty((len(lists), width), np.int64)
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            for lo in range(0, len(rows), 4096):
                own = rows[lo : lo + 4096]
                out[own] = _cells(_unit(flat[start[own][:, None] + np.arange(dim)]), directions, draws, tables).reshape(len(own), -1)
        return pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.int64()))

    return cells(embedding)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors; scaled first, so that no square overflows or vanishes."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1))[:, None]).astype(np.float32)


def _counted(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in x, in y) of the linked pairs of two sets of unit vectors; `same`: y is x, and a pair counts once."""
    width = REACH * math.sqrt(2 - 2 * cosine)
    a = _directions(x.shape[1], PROJECTIONS, 0)
    px, py = x @ a, y @ a
    if len(x) * len(y) <= 1 << 13:
        # few pairs: the windows are compared as they are, without ranks
        counts = (np.abs(px[:, None, :] - py[None, :, :]) <= width).sum(2)
    else:
        counts = _collisions(px, py, width)
    i, j = np.nonzero(counts >= least_count())
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def _collisions(px: np.ndarray, py: np.ndarray, width: float) -> np.ndarray:
    """For each pair, in how many sorted projections y stands in x's window."""
    counts = np.zeros((len(px), len(py)), np.int8)
    for k in range(PROJECTIONS):
        order = np.argsort(py[:, k])
        ranked = py[order, k]
        # each query's window in the sorted projection, from its first to its last collision
        lo, hi = np.searchsorted(ranked, px[:, k] - width), np.searchsorted(ranked, px[:, k] + width, "right")
        place = np.empty(len(py), np.int16 if len(py) < 1 << 15 else np.int32)
        place[order] = np.arange(len(py))
        counts += (place >= lo[:, None].astype(place.dtype)) & (place < hi[:, None].astype(place.dtype))
    return counts


def _linked(e: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosine of each pair of rows of `e`, in double precision, is `cosine` or more. Rows are scaled by powers of two first, which changes no cosine, so that no square overflows or vanishes."""
    e = np.ldexp(e, -np.frexp(np.abs(e).max(1))[1][:, None])
    n = np.sqrt((e * e).sum(1))
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 15):
        own = slice(s, s + (1 << 15))
        out[own] = np.einsum("nd,nd->n", e[i[own]], e[j[own]]) / (n[i[own]] * n[j[own]]) >= cosine
    return out


def _first_meeting(cells: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, cell: int) -> np.ndarray:
    """Whether this cell is the first, by table and number, that each pair shares: where it counts."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 1 << 13):
        own = slice(s, s + (1 << 13))
        a, b = cells[i[own]], cells[j[own]]
        shared = np.where((a[:, :, :, None] == b[:, :, None, :]).any(3), a, np.iinfo(np.int64).max).min(2)
        first = (shared < np.iinfo(np.int64).max).argmax(1)
        out[own] = (first == table) & (shared[:, table] == cell)
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of links that keep all components: a spanning forest."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    out = []
    for k, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            out.append(k)
    return out


def _usable(embedding: str) -> Column:
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_links(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row (vec_id, embedding, label) of `vectors`; ids and labels may have any type that has an order.

    Rows of equal, non-null labels and of the same length link where their cosine in double precision is `cosine` or more. A null or
    zero vector, one with a null or non-finite component, and one without a label link with nothing and stand alone. Equal vectors of one
    label are one candidate with a count, so copies are never paired; repeated rows are vectors of their own. An empty table gives none.

    Cells hold narrow rows; a cell of more than `block` members is dealt into blocks that meet two by two, so no task holds more than two of
    them. Vectors go to their cells once these are known; each pair counts in the first cell that both share, and only each candidate's
    number of links and a spanning forest are put out.
    """
    rows = work_table(vectors.select("vec_id", "label", F.col("embedding").alias("e")).withColumn("ok", _usable("e")).withColumn("k1", F.xxhash64("label", "e")).withColumn("k2", F.xxhash64(F.lit(7), "e", "label")))
    reps = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").cast("string").alias("label"), F.first("e").alias("e"))
    reps = work_table(reps.withColumn("node", F.monotonically_increasing_id()))
    largest = reps.groupBy("label", F.size("e")).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    directions, draws, tables = plan(largest, cosine, leaf)
    nodes = work_table(reps.withColumn("cells", cells_of(F.col("e"), directions, draws, tables)))
    each = nodes.select("node", F.xxhash64("label", F.size("e")).alias("g"), F.posexplode("cells").alias("at", "cell"))
    each = work_table(each.select("node", F.floor(F.col("at") / FARTHEST**draws).cast("int").alias("t"), "cell", F.xxhash64("g", F.floor(F.col("at") / FARTHEST**draws), "cell").alias("key")))
    full = work_table(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    placed = skew_join(each, full, ["key"], "n").withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("of")).cast("int"))
    # a block meets itself and every other one of its cell
    met = placed.select("node", "key", "t", "cell", "own", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    met = met.select("node", "key", "t", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"))
    full_rows = met.join(nodes.select("node", "label", "copies", "cells", "e"), "node")
    meetings = full_rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "t", "cell", "label", F.size("e"))
    found = work_table(meetings.mapInArrow(_meetings(cosine, tables), "node bigint, n bigint, other bigint"))
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(counts, "node", "left").join(parts, "node", "left").select("k1", "k2", "least", "copies", F.coalesce("component", "node").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = work_table(known)
    least = work_table(known.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("size")))
    classes = work_table(skew_join(known, least, ["c"], "size").select("k1", "k2", "copies", "n_links", "component_id"))
    out = skew_join(rows.where("ok").select("vec_id", "k1", "k2"), classes, ["k1", "k2"], "copies").select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("not ok").select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _meetings(cosine: float, tables: int):  # noqa: ANN202
    """Sorted members of meetings to (node, n, null), the copies it links with, and (node, 0, other), links of a spanning forest."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def one(m: pa.Table) -> pa.RecordBatch | None:
        e = m.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(m.num_rows, -1)
        cells = m.column("cells").combine_chunks().flatten().to_numpy().reshape(m.num_rows, tables, -1)
        node, copies = m.column("node").to_numpy(), m.column("copies").to_numpy()
        right = m.column("right").to_numpy(zero_copy_only=False).astype(bool)
        same = m.column("i")[0].as_py() == m.column("j")[0].as_py()
        u = _unit(e)
        left_at, right_at = (np.arange(len(e)),) * 2 if same else (np.flatnonzero(~right), np.flatnonzero(right))
        if not len(left_at) or not len(right_at):
            return None
        i, j = _counted(u[left_at], u[right_at], cosine, same)
        i, j = left_at[i], right_at[j]
        own = _linked(e, i, j, cosine)
        i, j = i[own], j[own]
        own = _first_meeting(cells, i, j, m.column("t")[0].as_py(), m.column("cell")[0].as_py())
        i, j = i[own], j[own]
        if not len(i):
            return None
        n = (np.bincount(i, copies[j], len(e)) + np.bincount(j, copies[i], len(e))).astype(np.int64)
        some = np.flatnonzero(n)
        tree = _forest(node[i], node[j])
        others = np.concatenate([np.zeros(len(some), np.int64), node[j][tree]])
        return pa.record_batch([pa.array(np.concatenate([node[some], node[i][tree]])), pa.array(np.concatenate([n[some], np.zeros(len(tree), np.int64)])), pa.array(others, mask=np.arange(len(others)) < len(some))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for m in _runs(batches, held):
            if m.num_rows > 1 and (got := one(m)) is not None:
                yield got

    return run


def _runs(batches: Iterator[pa.RecordBatch], held: list[pa.Table]) -> Iterator[pa.Table]:
    """The members of one meeting at a time: rows of equal key, blocks, cell, label and length, which stand together."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(batch.column("e").offsets.to_numpy())
        label = batch.column("label").dictionary_encode()
        marks = [*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "t", "cell")), label.indices.to_numpy(), size]
        cut = np.zeros(batch.num_rows, bool)
        for x in marks:
            cut[1:] |= x[1:] != x[:-1]
        ends = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
        for lo, hi in zip(ends, ends[1:], strict=False):
            mark = tuple(batch.column(c)[lo].as_py() for c in ("key", "i", "j", "t", "cell", "label")) + (int(size[lo]),)
            if mark != last and held:
                yield pa.concat_tables(held)
                held.clear()
            held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
            last = mark
    if held:
        yield pa.concat_tables(held)
        held.clear()
