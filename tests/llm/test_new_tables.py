import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dirlake.llm import fingerprints as P
from dirlake.llm import hard_negatives as H
from dirlake.llm import prefix_trie as R


# --- hard negatives --------------------------------------------------------------------------------------------------------


def mined(rows, anchors, positives=5, negatives=3):
    """Every anchor against every row."""
    rows = sorted({(i, None if l is None else str(l), tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and None not in v}, key=repr)
    hold = lambda x: max(H.LEAST, min(H.MOST, x))
    out = []
    for a, l, v in rows:
        if a not in anchors:
            continue
        seen = [(hold(sum(x * y for x, y in zip(v, w))), i, m == l) for i, m, w in rows if i != a and len(w) == len(v)]
        best = sorted((-s, i) for s, i, same in seen if same)[:positives]
        for p, i in best:
            hard = sorted((-s, j) for s, j, same in seen if not same and -50 * p <= 100 * s <= -95 * p)[:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(hard)]
    return sorted(out)


def found(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, label string, v array<bigint>, id string, node int, ball int, block int").repartition(3)
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id").isin(*anchors), **more).collect())


def test_ball_trees_find_what_a_search_of_all_rows_finds(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aabc"), [rng.randint(-3, 9) for _ in range(4)]) for i in range(400)]
    rows += [(1000 + i, "a", [5, 5, 5, 5]) for i in range(60)] + [(2000 + i, "d", [1, 2]) for i in range(9)] + [(3000 + i, "e", []) for i in range(3)]
    rows += [(7, "a", [1, 2, 3, 4]), (None, "a", [1, 2, 3, 4]), (4000, None, [9, 9, 9, 9]), (4001, "b", None), (4002, "b", [1, None, 3, 4]), rows[0], rows[0], (4003, "b", [0, 0, 0, 0])]
    wide = [(*r, "x", 0, 0, 0) for r in rows]
    anchors = [0, 7, 50, 100, 1000, 1001, 2000, 3000, 4000, 4003, 9999]
    want = mined(rows, anchors)
    assert len(want) > 60 and len({r[0] for r in want}) > 5
    assert found(spark, wide, anchors) == want
    # many small blocks, other counts
    assert found(spark, wide, anchors, block=16) == want
    assert found(spark, wide, anchors, positives=2, negatives=1) == mined(rows, anchors, 2, 1)


def test_blocks_and_lists_are_met_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, str(i % 3), [rng.randint(0, 20) for _ in range(3)]) for i in range(300)]
    for name, value in (("BALLS", 2), ("QUERIES", 5), ("AT_ONCE", 3)):
        monkeypatch.setattr(H, name, value)
    anchors = list(range(0, 300, 9))
    assert found(spark, [(*r, "x", 0, 0, 0) for r in rows], anchors, block=40) == mined(rows, anchors)


def test_scores_beyond_doubles_are_exact_and_held_at_64_bits(spark):
    big = 1 << 40
    rows = [(0, "a", [big, 1, 0]), (1, "a", [big, 1, 3]), (2, "b", [big - (big >> 3), 7, 1]), (3, "b", [(big * 9) // 10, 5, 1]), (4, "a", [-big, 0, 1]), (5, "b", [1 << 62, 1, 1]), (6, "a", [1 << 62, 0, 0]), (7, "b", [0, 0, 0]), (8, "a", [0, 0, 0])]
    want = mined(rows, range(9))
    assert want and found(spark, [(*r, "x", 0, 0, 0) for r in rows], range(9)) == want


def test_trees_leave_out_most_leaves_of_clustered_rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 100
    x = np.rint(np.repeat(centres, 100, 0) + rng.normal(size=(4000, 8))).astype(np.int64)
    labels = np.array([str(k % 4) for k in range(40) for _ in range(100)], object)
    tree = H.Tree(x, np.arange(4000), labels)
    q = np.arange(0, 4000, 100)
    of, w = np.arange(len(q)), np.full(len(q), H.LEAST)
    at, ids, scores = tree.search(x[q], q, labels[q], of, w, np.full(len(q), H.MOST), 3, True)
    every = x[q] @ x.T
    for k in range(len(q)):
        own = [(-int(s), i) for i, s in enumerate(every[k]) if labels[i] == labels[q[k]] and i != q[k]]
        assert [(-int(s), int(i)) for s, i in zip(scores[at == k], ids[at == k])] == sorted(own)[:3]
    leaves = sum(c is None for c in tree.children)
    assert tree.scanned < len(q) * leaves / 3


def test_hard_negatives_of_odd_tables(spark):
    e = spark.createDataFrame([(0, [0.5, -0.001, float("nan")]), (1, [0.5, float("inf")]), (2, None), (3, [None, 1.0]), (4, [0.5, -0.001, 3e38]), (5, [])], "vec_id bigint, e array<float>")
    got = {r["vec_id"]: r["q"] for r in e.select("vec_id", H.quantised(F.col("e")).alias("q")).collect()}
    assert got[0] is got[1] is got[2] is got[3] is None and got[5] == [] and got[4] == [128, -1, (1 << 63) - 1]
    assert found(spark, [], [0]) == [] and found(spark, [(0, "a", [1], "x", 0, 0, 0)], [0]) == []


# --- prefix trie ------------------------------------------------------------------------------------------------------------


def nodes_of(paths):
    """(owner, depth): the contract's columns, by walking every prefix."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
        ends[p].append(c)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[:-1] == q for x in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
    return out


def trie_of(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows) and df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return got


def test_trie_of_all_shapes(spark):
    rng = random.Random(2)
    paths = {c: tuple((rng.choice("ua"), rng.choice(["", "x", "yé", "zzz"])) for _ in range(rng.randint(0, 4))) for c in rng.sample(range(-50, 500), 200)}
    paths[600] = tuple(("u", "x" * (k % 3)) for k in range(300))
    paths[601] = paths[600][:299]
    turns = [(c, n + 1, r, t) for c, p in paths.items() for n, (r, t) in enumerate(p)]
    df = spark.createDataFrame(turns, "conv_id bigint, n bigint, role string, text string").repartition(4)
    ids = spark.createDataFrame([(c,) for c in paths], "conv_id bigint")
    assert trie_of(R.trie(df, ids)) == nodes_of(paths)
    some = {c: p for c, p in paths.items() if p}
    assert trie_of(R.trie(df)) == nodes_of(some)
    assert R.trie(df.where("false")).count() == 0
    assert trie_of(R.trie(df.where("false"), ids.where("conv_id > 300 or conv_id = 601"))) == nodes_of({c: () for c in paths if c > 300})


def test_many_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 7)
    n = 3000
    second = F.when(F.col("id") % 1000 == 999, "other").otherwise("hi")
    each = spark.range(n).withColumnRenamed("id", "conv_id").withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))).withColumn("id", F.col("conv_id"))
    turns = each.select("conv_id", "n", F.when(F.col("n") == 1, "u").otherwise("a").alias("role"), F.when(F.col("n") == 1, "hello").otherwise(second).alias("text"))
    assert trie_of(R.trie(turns)) == nodes_of({c: (("u", "hello"), ("a", "other" if c % 1000 == 999 else "hi")) for c in range(n)})


def test_turns_are_ranked_and_rebuilt(spark, tmp_path):
    rng = random.Random(7)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice([None, "u", "a"]), rng.choice([None, "", "x", "yy"]), "extra", 5) for c in [0, 1, 2, 3, 5, 99, 100, 101, 150, 205, 207, 310] for _ in range(rng.randint(1, 9))]
    rows += [(None, 1, "u", "x", "extra", 5), rows[0], (0, 4, "u", "x", "e", 1), (0, 5, "a", "y", "e", 1)]
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    assert any(not p for p in rebuilt.values())
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n string, one int").repartition(3)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert trie_of(entry.queries()["op12_prefix_trie"](spark, str(tmp_path))) == nodes_of(rebuilt)
    df.where("false").write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    assert entry.queries()["op12_prefix_trie"](spark, str(tmp_path)).count() == 0


# --- fingerprints -----------------------------------------------------------------------------------------------------------


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    out = set()
    for i in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def bottom(hashes, k=P.K):
    return sorted(hashes)[:k]


def printed(sketch):
    return "".join(f"{h % (1 << 64):016x}" for h in sketch)


def likeness(a, b, k=P.K):
    both = bottom(set(a) | set(b), k)
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


TEXTS = ["", None, "   \n", "one", "one two three four", "a b c d e", "a b c d e f", "é ü ñ 漢字 x y z", "w " * 900, " ".join(f"w{k}" for k in range(3000)), " ".join(f"w{k}" for k in range(40)), "\t a\x0bb\x0cc\r\nd e ", " ".join(f"w{k}" for k in range(3000))]


def test_fingerprints_of_all_texts_and_their_edits(spark, tmp_path):
    rows = [(10 * k, t, "en", "s", 1, "clash", "clash") for k, t in enumerate(TEXTS)] + [(None, "no id a b c d", "en", "s", 1, "x", "y"), (20, "same id again and again", None, None, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, sketch string, key string").repartition(4)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["op13_fingerprints"](spark, str(tmp_path)).collect()
    want = []
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    docs = sorted(((-1 if i is None else i, signed(t or "") if t is not None else 42, i, t or "") for i, t, *_ in rows), reverse=True)
    docs = [(i, t) for _, _, i, t in docs]
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + after[:cut]
        a, b, c = (bottom(shingles(x)) for x in (t, e, after))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), printed(a), printed(b), likeness(a, b), likeness(a, c)))
    assert sorted(map(repr, (tuple(r)[:7] for r in got))) == sorted(map(repr, want))


def test_next_documents_over_many_blocks(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(5)
    got = {r["doc_id"]: r["next_text"] for r in P.with_next(df, block=13).collect()}
    ids = sorted(got, reverse=True)
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got == {i: text[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)} and len(got) == 1000
    assert P.with_next(df.where("false")).count() == 0
    (one,) = P.with_next(df.limit(1)).collect()
    assert one["text"] == one["next_text"]
    same = spark.range(50).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("equal").alias("text"))
    assert [r["next_text"] for r in P.with_next(same, block=7).collect()] == ["equal"] * 50


def test_sketches_of_parts_merge_and_estimate(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(20000)]
    a, b = " ".join(words[:9000]), " ".join(words[3000:15000])
    parts = [("a", " ".join(words[k : k + 1004])) for k in range(0, 9000 - 1004 + 1, 1000)] + [("a", " ".join(words[7000:9000])), ("b", b), ("b", b), ("c", ""), ("c", None), (None, "x y z")]
    rng.shuffle(parts)
    df = spark.createDataFrame([(k, t, 1) for k, t in parts], "key0 string, text string, h int").withColumn("s", P.sketch(F.col("text"))).repartition(3)
    got = {r["key0"]: r["sketch"] for r in P.merge_rows(df, "s", ["key0"]).collect()}
    assert got["a"] == bottom(shingles(a)) and got["b"] == bottom(shingles(b)) and got["c"] == [] and got[None] == bottom(shingles("x y z"))
    one = spark.createDataFrame([(a, b)], "a string, b string").select(P.sketch(F.col("a")).alias("a"), P.sketch(F.col("b")).alias("b"))
    r = one.select(P.resemblance(F.col("a"), F.col("b")), P.containment(F.col("a"), F.col("b")), P.distinct_shingles(F.col("a")), P.merge(F.col("a"), F.col("b")), P.parsed(P.printed(F.col("a"))), F.col("a")).first()
    x, y = shingles(a), shingles(b)
    error = 4 * 0.5 / math.sqrt(P.K)
    assert abs(r[0] - len(x & y) / len(x | y)) < error and abs(r[1] - len(x & y) / len(x)) < 2 * error and abs(r[2] / len(x) - 1) < 4 / math.sqrt(P.K)
    assert r[3] == bottom(x | y) and r[4] == r[5]
    assert P.merge_rows(df.where("false"), "s", ["key0"]).count() == 0


def test_fingerprints_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "mine")], "doc_id int, body string, sketch string")
    (r,) = P.fingerprints(df, "body").collect()
    assert r["doc_id"] == 1 and r["sketch"] == bottom(shingles("a b c d e f")) and r["fingerprint"] == printed(r["sketch"]) and r["n_shingles"] == 2.0
    plan = P.fingerprints(df, "body")._jdf.queryExecution().toString() + P.with_next(df.withColumnRenamed("body", "text"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "MapInPandas"))
