"""The trie of conversation prefixes, and what storing each shared prefix once would save.

A node's owner is its smallest member. Members only fall away down a path, so what a conversation owns of its path is a suffix, and (owner,
depth) names a node. Every node below a node has one owner among its members, so sums over a subtree are sums over its members: what a
member's path holds from there on, without what the member owns of it. One group-by over (member, prefix) rows gives them all.
Owners are the minimum of a grouped aggregate, since a window over a prefix would hold all members of the root in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirlake.llm.common import running_sums, skew_join, work_table

KEY = ["n", "s1", "s2"]
#: Ids that are joined into one piece of text before they are hashed, and the hash of no ids.
PIECE, NONE = 1 << 16, hashlib.sha256(b"").hexdigest()


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, role, text): the turns of each conversation in their order, from 1.

    Turns stand in the order of turn (null first), role and text; a null role or text is empty; repeated rows are turns of their own.
    Rows without an id belong to no conversation and are left out. A conversation of any length spreads over sorted ranges.
    """
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    placed = running_sums(own.withColumn("one", F.lit(1).cast("bigint")), "conv_id", ["turn", "role", "text"], ["one"])
    return placed.select("conv_id", (F.col("one_before") + 1).alias("n"), "role", "text")


def occurrences(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, n, s1, s2, p1, p2, before, size): each prefix of each conversation, the 128 bits that name it and the prefix without its last turn, and the code points before and in the last turn."""
    terms = turns.select("conv_id", "n", F.xxhash64("n", "role", F.lit(1), "text").alias("t1"), F.xxhash64(F.lit(2), "text", "n", F.lit(3), "role").alias("t2"), F.length("text").cast("bigint").alias("size"))
    sums = running_sums(terms, "conv_id", ["n"], ["t1", "t2", "size"], upto=True)
    deep = sums.select("conv_id", "n", F.col("t1_upto").alias("s1"), F.col("t2_upto").alias("s2"), F.col("t1_before").alias("p1"), F.col("t2_before").alias("p2"), F.col("size_before").alias("before"), "size")
    zero = F.lit(0).cast("bigint")
    return deep.unionByName(conversations.select("conv_id", *(zero.alias(c) for c in (*KEY, "p1", "p2", "before", "size"))))


def trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each distinct prefix.

    `turns` has rows (conv_id, n, role, text) as `ranked` gives them; `conversations` lists the distinct ids (all of `turns`, where None), those
    without turns too: they are members of the root alone. A node is named by its smallest member and its depth. A leaf has no child; a leaf
    is in its own subtree. `saved_tokens` sums, over the subtree, one less than the node's members times the code points of its last text.
    `ends_sha256` hashes the ids of the members that end there, ascending and joined by commas. No conversations give no nodes.
    """
    ids = (turns if conversations is None else conversations).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    each = work_table(occurrences(turns, ids))
    ends = work_table(each.groupBy("conv_id").agg(F.max(F.struct(*KEY, (F.col("before") + F.col("size")).alias("total"))).alias("e")).select("conv_id", "e.*"))
    marks = each.select("conv_id", *KEY, "before", F.lit(1).alias("member"), F.lit(0).alias("ends")).unionByName(ends.select("conv_id", *KEY, F.lit(None).cast("bigint").alias("before"), F.lit(0).alias("member"), F.lit(1).alias("ends")))
    nodes = marks.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("member").alias("members"), F.sum("ends").alias("ends"), F.max("before").alias("before"))
    # of each owner: where its suffix begins, what stands before it, and whether its path ends in a leaf of its own
    owners = nodes.groupBy("conv_id").agg(F.min("n").alias("own_from"), F.min("before").alias("unowned"), F.max((F.col("members") == F.col("ends")).cast("int")).alias("leaf"))
    members = ends.join(owners, "conv_id", "left").select(
        "conv_id", F.col("n").alias("n_turns"), (F.col("n") + 1).alias("n_rows"), F.coalesce("own_from", F.col("n") + 1).alias("own_from"), F.coalesce("unowned", "total").alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    known = skew_join(each, work_table(members), ["conv_id"], "n_rows")
    child = (F.col("own_from") <= F.col("n") + 1) & (F.col("n") < F.col("n_turns"))
    found = known.groupBy(*KEY).agg(
        F.min(F.struct("conv_id", "own_from")).alias("owner"), F.count("*").alias("n_convs"), F.sum(child.cast("bigint")).alias("n_children"), F.sum("leaf").cast("bigint").alias("n_leaves"),
        F.sum(F.greatest(F.lit(0), F.col("unowned") - F.col("before"))).alias("saved_tokens"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    found = work_table(found.select("*", "owner.*").drop("owner"))
    # only the first node that a conversation owns hangs on another one's
    hangs = (F.col("n") > 0) & (F.col("n") == F.col("own_from"))
    side = work_table(found.where("n_children > 0").select(F.col("n").alias("pn"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children"))
    hung = skew_join(found.where(hangs).drop("n_children").withColumn("pn", F.col("n") - 1).join(found.select(*KEY, F.col("n_children").alias("own_children")), KEY), side, ["pn", "p1", "p2"], "n_children")
    names = ["conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    out = hung.withColumn("n_children", F.col("own_children")).select(*KEY, *names)
    out = out.unionByName(found.where(~hangs).withColumn("parent_conv_id", F.when(F.col("n") > 0, F.col("conv_id"))).select(*KEY, *names))
    out = out.join(_hashed(ends), KEY, "left")
    return out.select("conv_id", F.col("n").alias("depth"), *names[1:], F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"))


def _hashed(ends: DataFrame) -> DataFrame:
    """(n, s1, s2, ends_sha256): SHA-256 of the ids that end at a node. Sorted ranges join them into pieces first; a node's pieces then go through one hash in their order, none of them held."""
    fields = "n bigint, s1 bigint, s2 bigint"
    pieces = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces, f"{fields}, least bigint, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_digests, f"{fields}, ends_sha256 string")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of the rows of a batch that have one key and stand together."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
    lo = 0
    for hi in range(1, len(keys) + 1):
        if hi == len(keys) or keys[hi] != keys[lo] or hi - lo == PIECE:
            yield keys[lo], lo, hi
            lo = hi


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("conv_id")
        text = ids.cast(pa.string()).to_pylist()
        rows = [(*key, ids[lo].as_py(), ",".join(text[lo:hi])) for key, lo, hi in _runs(batch)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*KEY, "least", "piece"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest = None, None

    def put(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])

    for batch in batches:
        done: list[tuple] = []
        pieces = batch.column("piece")
        for key, lo, hi in _runs(batch):
            if key != current:
                if current is not None:
                    done.append((*current, digest.hexdigest()))
                current, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(pieces.slice(lo, hi - lo).to_pylist()).encode())
        yield put(done)
    if current is not None:
        yield put([(*current, digest.hexdigest())])


def rebuilt(turns: DataFrame, group: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): ranked turns where each conversation c begins with the first h turns of conversation c - c % `group`, with h = crc32(c) % `shared`, and goes on with its own after its first h.

    A base with fewer turns gives all, one that is absent none. A base's turns go to at most `group` conversations, `shared` - 1 to each.
    """
    turns = work_table(turns)
    n = turns.groupBy("conv_id").agg(F.max("n").alias("n_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("bigint")
    c = n.select("conv_id", "n_turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    c = work_table(c.join(n.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("base_turns")), "base", "left").withColumn("k", F.least("h", F.coalesce("base_turns", F.lit(0)))))
    own = skew_join(turns, c.select("conv_id", "n_turns", "h", "k"), ["conv_id"], "n_turns").where(F.col("n") > F.col("h"))
    own = own.select("conv_id", (F.col("n") - F.col("h") + F.col("k")).alias("n"), "role", "text")
    lent = turns.where(F.col("n") < shared).select(F.col("conv_id").alias("base"), "n", "role", "text").join(c.where("k > 0").select("base", "conv_id", "k"), "base").where("n <= k")
    return own.unionByName(lent.select("conv_id", "n", "role", "text")), c.select("conv_id")
