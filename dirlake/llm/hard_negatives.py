"""Hard negatives by ball trees: for each anchor its best rows of the same label, and for each of these the best rows of other labels within a score window.

A range shuffle by length and label makes blocks; each block is a ball (centre, radius) and builds a ball tree. An inner product with a
vector of a ball lies within the query's norm times the radius of its product with the centre, so a ball above or below a query's window, or
strictly beneath its current kth score, holds nothing for it. Queries are first routed by the balls of the blocks, then go down the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirlake.llm.common import work_table

#: Vectors of a block that are aimed at, and of a leaf; queries that one task takes to a block at most; balls in one list of the routing; queries that a task scores at a time.
BLOCK, LEAF, QUERIES, BALLS, AT_ONCE = 4096, 128, 1 << 16, 1024, 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Tree:
    """A ball tree over the rows of an integer matrix, and its search for many queries at once."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.exact = ids, x
        self.x = x.astype(np.float64)
        self.order = np.arange(len(x))
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres: list[np.ndarray] = []
        radii: list[float] = []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = self.order[lo:hi]
            centre, radius, far = _ball(self.x[own])
            at = len(self.spans)
            self.spans.append((lo, hi))
            self.children.append(None)
            centres.append(centre)
            radii.append(radius)
            if parent >= 0:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (at, pair[1]) if side == 0 else (pair[0], at)
            if hi - lo > leaf and radius > 0:
                # halved along the line from the farthest row to the row farthest from it
                away = self.x[own] - self.x[own[far]]
                line = away @ away[np.argmax((away * away).sum(1))]
                mid = (hi - lo) // 2
                self.order[lo:hi] = own[np.argpartition(line, mid)]
                todo += [(lo, lo + mid, at, 0), (lo + mid, hi, at, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.reach = np.sqrt((self.centres**2).sum(1)) + self.radii
        self.names, codes = np.unique(labels, return_inverse=True)
        self.codes = codes.reshape(-1)
        self.least = np.array([self.codes[self.order[lo:hi]].min() for lo, hi in self.spans])
        self.most = np.array([self.codes[self.order[lo:hi]].max() for lo, hi in self.spans])
        self.scanned = 0

    def search(self, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, row id, score) of the first `k` rows in each window, by falling score, then by id.

        Window w belongs to query of[w] and takes scores from lo[w] to hi[w]; rows have the query's label (`same`) or another, and another id.
        """
        f = q.astype(np.float64)
        norm = np.sqrt((f * f).sum(1))
        mid, wide = f @ self.centres.T, norm[:, None] * self.radii
        slack = 1e-9 * (1 + norm[:, None] * self.reach)
        up, down = mid + wide + slack, mid - wide - slack
        place = np.minimum(np.searchsorted(self.names, labels), len(self.names) - 1)
        code = np.where(self.names[place] == labels, place, -1)
        safe = norm.max(initial=0.0) * self.reach.max(initial=0.0) < 2.0**51
        scores, found = np.full((len(of), k), LEAST, np.int64), np.full((len(of), k), MOST, np.int64)
        held = np.zeros(len(of), np.int64)
        kth = np.full(len(of), -np.inf)

        def visit(at: int, own: np.ndarray) -> None:
            u = of[own]
            stay = (up[u, at] >= np.maximum(lo[own], kth[own])) & (down[u, at] <= hi[own])
            one = (self.least[at] == self.most[at]) & (code[u] == self.least[at])
            stay &= (code[u] >= self.least[at]) & (code[u] <= self.most[at]) if same else ~one
            own = own[stay]
            if not len(own):
                return
            if self.children[at] is None:
                scan(at, own)
                return
            left, right = self.children[at]
            nearer = mid[of[own], left] > mid[of[own], right]
            visit(left, own[nearer])
            visit(right, own)
            visit(left, own[~nearer])

        def scan(at: int, own: np.ndarray) -> None:
            self.scanned += len(own)
            rows = self.order[slice(*self.spans[at])]
            some, back = np.unique(of[own], return_inverse=True)
            s = _products(q[some], f[some], self.exact[rows], self.x[rows], safe)
            fits = (code[some][:, None] == self.codes[rows]) if same else (code[some][:, None] != self.codes[rows])
            fits &= ids[some][:, None] != self.ids[rows]
            s, fits = s[back], fits[back]
            fits &= (s >= lo[own][:, None]) & (s <= hi[own][:, None]) & (s >= kth[own][:, None])
            w, r = np.nonzero(fits)
            if not len(w):
                return
            new, start = np.unique(w, return_index=True)
            # what is held joins what is new; the first k of each window stay
            wins = own[new]
            old = np.arange(k)[None, :] < held[wins][:, None]
            ow = np.repeat(new, old.sum(1))
            w, c, i = np.concatenate([w, ow]), np.concatenate([s[w, r], scores[wins][old]]), np.concatenate([self.ids[rows[r]], found[wins][old]])
            ranked = np.lexsort((i, ~c, w))
            w, c, i = w[ranked], c[ranked], i[ranked]
            rank = np.arange(len(w)) - np.searchsorted(w, w)
            top = rank < k
            w, c, i, rank = own[w[top]], c[top], i[top], rank[top]
            scores[w, rank], found[w, rank] = c, i
            np.maximum.at(held, w, rank + 1)
            kth[wins] = np.where(held[wins] == k, scores[wins, k - 1].astype(np.float64), -np.inf)

        visit(0, np.arange(len(of)))
        got = np.arange(k)[None, :] < held[:, None]
        return np.repeat(np.arange(len(of)), held), found[got], scores[got]


def _ball(x: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Centre and radius of a ball around rows, and the row farthest out."""
    centre = x.mean(0)
    d = ((x - centre) ** 2).sum(1)
    far = int(np.argmax(d))
    return centre, float(np.sqrt(d[far])), far


def _products(q: np.ndarray, fq: np.ndarray, x: np.ndarray, fx: np.ndarray, safe: bool) -> np.ndarray:
    """Integer inner products; what leaves 64 bits is held at their end. Doubles are exact while all partial sums are `safe`."""
    if safe:
        return np.rint(fq @ fx.T).astype(np.int64)
    wide = np.dot(q.astype(object), x.T.astype(object)) if x.shape[1] else np.zeros((len(q), len(x)), object)
    return np.minimum(np.maximum(wide, LEAST), MOST).astype(np.int64)


def quantised(embedding: Column, scale: int = 256) -> Column:
    """Components as floor(scale * x), x in double precision; null where the vector or a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(embedding.isNotNull() & finite, F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: str = "0.50", high: str = "0.95", block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows for which `anchors` holds.

    `vectors` has rows (vec_id, label, v): a bigint id, a label of any type, an array of bigints. A score is the inner product with the
    anchor, held at the ends of 64 bits; higher ones come first, ties by smaller id. An anchor's positives are its first `positives`
    rows of the same label; each has as negatives the first `negatives` rows of other labels whose score is at least `low` and at most
    `high` times the positive's. Only rows of the anchor's length are compared. Rows without id, label, vector or a component take no part;
    rows with the anchor's own id are never its partners; equal rows count once; an anchor without positives or negatives gives no rows.
    """
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    rows = vectors.where(whole).withColumn("anchor", F.coalesce(anchors, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<bigint>").alias("v"), "anchor")
    rows = rows.distinct().withColumn("dim", F.size("v"))
    rows = work_table(rows)
    n = rows.count()
    ranged = rows.repartitionByRange(max(1, -(-n // block)), "dim", "label", F.xxhash64("id")).sortWithinPartitions("dim", "label")
    ranged = ranged.withColumn("block", F.spark_partition_id()).withColumn("node", F.monotonically_increasing_id())
    # each partition is a block; the first row of each of its lengths carries the ball
    index = work_table(ranged.mapInArrow(_with_balls, "id bigint, label string, v array<bigint>, anchor boolean, dim int, block int, node bigint, ball struct<centre: array<double>, radius: double, least: string, most: string>"))
    asked = index.where("anchor").select("node", F.col("id").alias("anchor_id"), "label", "v", "dim")
    all_scores = asked.withColumn("lo", F.array(F.lit(LEAST))).withColumn("hi", F.array(F.lit(MOST)))
    best = work_table(_first(_search(index, all_scores, positives, True), positives))
    score = F.col("score").cast("decimal(20,0)")
    lo, hi = F.ceil(score * F.lit(Decimal(low))).cast("bigint"), F.floor(score * F.lit(Decimal(high))).cast("bigint")
    found = best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi")))).alias("p"))
    windows = work_table(asked.join(found, "node").withColumn("lo", F.col("p.lo")).withColumn("hi", F.col("p.hi")))
    hard = _first(_search(index, windows.drop("p"), negatives, False), negatives)
    out = hard.join(windows.select("node", "anchor_id", "p"), "node").withColumn("p", F.get("p", F.col("w")))
    return out.select("anchor_id", "p.positive_id", "rank", F.col("id").alias("negative_id"), "p.positive_score", F.col("score").alias("negative_score"))


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first `k` of what all blocks found, ranked."""
    at = Window.partitionBy("node", "w").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)


def _search(index: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(node, w, id, score): the first `k` rows that each block has for each window of each query."""
    balls = work_table(index.where("ball is not null").select("block", "dim", "ball").withColumn("list", F.floor(F.col("block") / BALLS).cast("int")))
    last = balls.agg(F.coalesce(F.max("list"), F.lit(0))).first()[0]
    salts = max(1, -(-queries.count() // QUERIES))
    salted = queries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    sent = salted.select("node", "label", "v", "dim", "lo", "hi", "salt", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("list"))
    met = balls.withColumn("salt", each).withColumn("side", F.lit(0)).unionByName(sent.withColumn("side", F.lit(1)), allowMissingColumns=True)
    met = met.repartition("list", "salt").sortWithinPartitions("list", "salt", "side")
    routed = work_table(met.mapInArrow(_streamed(["list", "salt"], _Balls, lambda balls, q: balls.route(q, same)), "node bigint, block int, dim int, salt int"))
    # a block goes to the tasks that have queries for it
    wanted = routed.groupBy("block", "dim", "salt").count().drop("count")
    blocks = index.select("id", "label", "v", "dim", "block").join(wanted, ["block", "dim"]).withColumn("side", F.lit(0))
    asked = routed.join(queries.select("node", "label", "v", "lo", "hi", F.col("anchor_id").alias("id")), "node").withColumn("side", F.lit(1))
    met = blocks.unionByName(asked, allowMissingColumns=True).repartition("block", "dim", "salt").sortWithinPartitions("block", "dim", "salt", "side")
    return met.mapInArrow(_streamed(["block", "dim", "salt"], _built, lambda tree, q: _searched(tree, q, k, same)), "node bigint, w int, id bigint, score bigint")


def _matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1) if len(column.flatten()) else np.zeros((len(column), 0), kind)


def _with_balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, a ball at the first row of each length. A partition is one block, so it is held whole."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    dims = rows.column("dim").to_numpy()
    balls: list = [None] * len(dims)
    for dim, first in zip(*np.unique(dims, return_index=True), strict=True):
        own = rows.slice(first, int((dims == dim).sum()))
        centre, radius, _ = _ball(_matrix(own.column("v").chunk(0)).astype(np.float64))
        labels = own.column("label")
        balls[first] = {"centre": centre.tolist(), "radius": radius, "least": labels[0].as_py(), "most": labels[own.num_rows - 1].as_py()}
    kind = pa.struct([("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("least", pa.string()), ("most", pa.string())])
    yield from rows.append_column("ball", pa.array(balls, kind)).combine_chunks().to_batches()


def _streamed(key: list[str], build, ask):  # noqa: ANN001, ANN202
    """A function over sorted rows: those of side 0 of a key are held and built into one thing, which all rows of side 1 ask as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, thing = None, [], None
        for batch in batches:
            marks = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "side")]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in marks], axis=0)) + 1 if batch.num_rows else []
            ends = [0, *map(int, cut), batch.num_rows]
            for lo, hi in zip(ends, ends[1:], strict=False):
                if lo == hi:
                    continue
                mark = tuple(x[lo] for x in marks[:-1])
                if mark != current:
                    current, held, thing = mark, [], None
                if marks[-1][lo] == 0:
                    held.append(batch.slice(lo, hi - lo))
                    continue
                if thing is None and held:
                    thing, held = build(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                for at in range(lo, hi, AT_ONCE) if thing is not None else ():
                    yield ask(thing, batch.slice(at, min(AT_ONCE, hi - at)))

    return run


class _Balls:
    """The balls of some blocks, by their length."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.block, self.dim, ball = rows.column("block").to_numpy(), rows.column("dim").to_numpy(), rows.column("ball")
        self.radius = ball.field("radius").to_numpy()
        self.least, self.most = (np.array(ball.field(c).to_pylist(), object) for c in ("least", "most"))
        self.of = {int(d): (at := np.flatnonzero(self.dim == d), np.array([ball.field("centre")[int(i)].as_py() for i in at], np.float64).reshape(len(at), -1)) for d in np.unique(self.dim)}

    def route(self, q: pa.RecordBatch, same: bool) -> pa.RecordBatch:
        """(node, block, dim, salt) where a block's ball and labels may hold rows for a window of the query."""
        node, dim, salt = (q.column(c).to_numpy() for c in ("node", "dim", "salt"))
        labels = np.array(q.column("label").to_pylist(), object)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for d in np.unique(dim):
            if int(d) not in self.of:
                continue
            own, (at, centres) = np.flatnonzero(dim == d), self.of[int(d)]
            v = _matrix(q.column("v").take(pa.array(own))).astype(np.float64)
            norm = np.sqrt((v * v).sum(1))[:, None]
            mid, wide = v @ centres.T, norm * self.radius[at]
            slack = 1e-9 * (1 + norm * (np.sqrt((centres**2).sum(1)) + self.radius[at]))
            low, high = (np.array([f(x) for x in q.column(c).take(pa.array(own)).to_pylist()], np.float64)[:, None] for c, f in (("lo", min), ("hi", max)))
            fits = (mid + wide + slack >= low) & (mid - wide - slack <= high)
            name = labels[own][:, None]
            fits &= ((name >= self.least[at]) & (name <= self.most[at])).astype(bool) if same else ~((name == self.least[at]) & (name == self.most[at])).astype(bool)
            i, j = np.nonzero(fits)
            out.append((own[i], at[j]))
        i, j = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.record_batch([pa.array(node[i]), pa.array(self.block[j]), pa.array(dim[i]), pa.array(salt[i])], names=["node", "block", "dim", "salt"])


def _built(rows: pa.RecordBatch) -> Tree:
    return Tree(_matrix(rows.column("v")), rows.column("id").to_numpy(), np.array(rows.column("label").to_pylist(), object))


def _searched(tree: Tree, q: pa.RecordBatch, k: int, same: bool) -> pa.RecordBatch:
    lo, hi = q.column("lo"), q.column("hi")
    of = np.repeat(np.arange(q.num_rows), np.diff(lo.offsets.to_numpy()))
    w = np.arange(len(of)) - np.searchsorted(of, of)
    at, ids, scores = tree.search(_matrix(q.column("v")), q.column("id").to_numpy(), np.array(q.column("label").to_pylist(), object), of, lo.flatten().to_numpy(), hi.flatten().to_numpy(), k, same)
    return pa.record_batch([q.column("node").take(pa.array(of[at])), pa.array(w[at].astype(np.int32)), pa.array(ids), pa.array(scores)], names=["node", "w", "id", "score"])
