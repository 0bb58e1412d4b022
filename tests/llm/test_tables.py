"""Operators over other tables, the scan, the components, and the pipeline."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from dirlake.llm import chat, embed_neardup, packing, queries, url_rules
from dirlake.llm.common import running_sums, work_table
from dirlake.llm.graph import components
from tests.llm import test_documents as D
from tests.oracle import check, duck

SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@has_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    check(entry.queries()[name](spark, SF), duck(SF), entry.oracle_sql()[name])


def test_running_sums_over_a_hot_key(spark):
    rng = np.random.default_rng(1)
    data = [(("hot" if i % 3 else f"k{i % 7}"), int(x), int(y)) for i, (x, y) in enumerate(rng.integers(-100, 10**15, (900, 2)))]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.v_before for r in running_sums(df, "k", ["o"], ["v"], 9).collect()}
    sums: dict = {}
    for k, o, v in sorted(data):
        assert got[k, o] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v
    wrap = spark.createDataFrame([("a", 1, 2**62), ("a", 2, 2**62), ("a", 3, 5)], "k string, o bigint, v bigint")
    assert [r.v_before for r in running_sums(wrap, "k", ["o"], ["v"], 3).orderBy("o").collect()] == [0, 2**62, -(2**63)]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(31)) and got[301] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_chat_collapse(spark):
    hello, answer, more = ("user", "hello"), ("assistant", "hi <|im_end|> there"), ("user", "more")
    logs = {1: [hello], 2: [hello, answer], 3: [hello, answer, more], 4: [hello, answer, more], 5: [hello, more], 6: [("user", "other")], 7: [(None, None)], 8: [("user", f"t{i}") for i in range(150)], 9: [("user", f"t{i}") for i in range(100)]}
    rows = [(c, 10 * t, role, text, "x", "y") for c, turns in logs.items() for t, (role, text) in enumerate(turns)]
    rows += [(3, 0, "user", "hello", "x", "y"), (None, 0, "user", "lost", "x", "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n string, part string")
    got = chat.format_chats(df).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.n_turns, r.n_logged) for r in got] == [(3, 0, 3, 2), (5, 0, 2, 1), (6, 0, 1, 1), (7, 0, 1, 1), (8, 0, 150, 1), (8, 1, 150, 1), (8, 2, 150, 1)]
    assert got[0].text == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nhi <im_end> there<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and got[3].text.startswith("<|im_start|>unknown\n")
    assert "".join(r.text for r in got if r.conv_id == 8).count("<|im_start|>") == 150
    assert chat.format_chats(df.limit(0)).count() == 0
    named = chat.format_chats(df.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).withColumn("key", F.lit("k")).withColumn("one", F.lit(1))).orderBy("conv_id", "part").collect()
    assert [(r.conv_id, r.part, r.text) for r in named] == [(f"c{r.conv_id}", r.part, r.text) for r in got]


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.net/de/", "x://net/", "x://net", "http://notnet/", "http://a.example.com/de/?x#y", "http://b.org/fr/1", "http://b.org/de/1", "http://adult-x.example.com/1", "http://madult.com/1", "http://b.org/login", "http://b.org/login-x", "no scheme", "", None, "http://b.org/?a=://evil.net/", "http://b.org/a://c.net/"]
    df = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls + urls[:1])], "page_id bigint, url string, host string, target string")
    got = {r.own.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df).collect()}
    want = [("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("net", "/", "net/", "block"), ("net", "", None, "allow"), ("notnet", "/", None, "allow"), ("a.example.com", "/de/", "example.com/de/", "block"), ("b.org", "/fr/1", "org/fr/", "allow"), ("b.org", "/de/1", None, "allow"), ("adult-x.example.com", "/1", None, "block"), ("madult.com", "/1", None, "allow"), ("b.org", "/login", None, "block"), ("b.org", "/login-x", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.org", "/", None, "allow"), ("b.org", "/a://c.net/", None, "allow"), ("a.example.net", "/en/x", "example.net/en/", "allow")]
    assert [got[i] for i in range(len(want))] == want
    assert url_rules.judge(df.limit(0)).count() == 0
    assert sorted(map(str, url_rules.judge(df, most_broadcast=0).collect())) == sorted(map(str, url_rules.judge(df).collect()))
    open_rule = url_rules.rule_table(spark, [url_rules.Rule("any", "block", "*x*", False)])
    assert open_rule.select(url_rules.literals_of(F.col("pattern"))).first()[0] == []
    assert {r.own.page_id for r in url_rules.judge(df, open_rule).where("verdict = 'block'").collect()} >= {0, 8}
    clash = df.withColumn("_u", F.lit(1)).withColumn("u", F.lit(2)).withColumn("own", F.lit(3)).withColumn("best", F.lit(4)).withColumn("tokens", F.lit(5)).withColumn("verdict", F.lit(6))
    assert [got[r.own.page_id] for r in url_rules.judge(clash).collect() if (r.host, r.path, r.rule, r.verdict) != got[r.own.page_id] or (r.own._u, r.own.best, r.own.verdict) != (1, 4, 6)] == []


def test_url_rules_from_a_file(spark, tmp_path):
    rules = [("net/", "block", "||net/", "true"), ("a.b", "allow", "||a.b/x.y^", "true"), ("w", "block", "*~pi+ls~*", "false"), ("end", "block", "*/out^", "false")]
    (tmp_path / "r.tsv").write_text("! a comment\n" + "\n".join("\t".join(r) for r in rules) + "\nbad line\nx\tmaybe\t*y*\ttrue\n")
    table = url_rules.read_rules(spark, str(tmp_path / "r.tsv"))
    assert table.count() == 4
    urls = ["http://x.net/", "http://a.b/x.y?q", "http://a.b/xzy", "http://c.d/pi+ls", "http://c.d/api+ls", "http://c.d/out", "http://c.d/outer"]
    got = [r.verdict for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), table).orderBy("own.page_id").collect()]
    assert got == ["block", "allow", "allow", "block", "allow", "block", "allow"]


def test_url_rules_run_natively(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    plan = url_rules.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian"))


def brute(vectors):
    """n_links and component of each row by all pairs."""
    n = len(vectors)
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in vectors]
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]) and np.dot(np.float64(vectors[i][1]), np.float64(vectors[j][1])) / (np.linalg.norm(np.float64(vectors[i][1])) * np.linalg.norm(np.float64(vectors[j][1]))) >= 0.93] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((vectors[i][0], len(links[i]), min(vectors[j][0] for j in seen)))
    return sorted(out)


def test_embeddings_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        v = rng.normal(size=16) if k % 3 else rows[int(rng.integers(0, k))][1] + 0.35 * rng.normal(size=16) * (0.3 + rng.random()) if k > 30 else rng.normal(size=16)
        rows.append((k, np.float32(v), int(rng.integers(0, 3))))
    rows = [(i, [float(x) for x in v], lab) for i, v, lab in rows]
    rows += [(400, rows[0][1], rows[0][2]), (401, rows[0][1], rows[0][2]), (402, None, 1), (403, [0.0] * 16, 1), (404, [float("nan")] * 16, 1), (405, [None] * 16, 1), (406, rows[0][1], None), (407, [1.0, 2.0], 1), (408, [2.0, 4.0], 1), (409, [], 1), (410, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("n", F.lit(1))
    for leaf, block in ((512, 1024), (512, 32), (60, 1024), (1, 16)):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_neardup.near_links(df, leaf=leaf, block=block).collect())
        assert got == brute(rows)
    text = df.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("vec_id"), "embedding", F.concat(F.lit("l"), F.col("label").cast("string")).alias("label"))
    assert sorted((r.vec_id, r.n_links) for r in embed_neardup.near_links(text).collect()) == sorted((f"v{i}", n) for i, n, _ in brute(rows))
    assert embed_neardup.near_links(df.limit(0)).count() == 0


def test_pairs_at_the_least_cosine_meet():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1)[:, None]
    assert embed_neardup.plan(512)[1:] == (0, 1) and embed_neardup.plan(10**9)[1] == 3
    for n in (2_000, 9_000, 80_000, 7_000_000):
        directions, draws, tables = embed_neardup.plan(n)
        assert n * (embed_neardup.FARTHEST / (2 * directions)) ** draws <= 512
        a, b = (embed_neardup._cells(v.astype(np.float32), directions, draws, tables) for v in (x, y))
        met = (a[:, :, :, None] == b[:, :, None, :]).any((2, 3))
        assert met.any(1).all() and abs(met.mean() - embed_neardup.sharing(0.93, directions) ** draws) < 0.03


def test_calibrated_count():
    assert 10 < embed_neardup.least_count() < 24 and embed_neardup.least_count(miss=0.5) > embed_neardup.least_count(miss=1e-6)


@has_tables
def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    first = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = out.collect()
    assert got and {r.doc_id for r in got} <= first and len(corpus_pipeline.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Each stage against a plain version over the rows that the stage before it kept."""
    rng = np.random.default_rng(9)
    clean = [D.prose(i, 60 + i % 30) for i in range(45)]
    texts = clean + [clean[k] for k in (1, 1, 4)] + [clean[k] + " tail" for k in (7, 8)] + [f"{i} # | " + "$$ ** !! " * (8 + i % 7) + D.prose(i, 6) for i in range(30)]
    rows = [(i, t, "en", "abcd"[int(rng.integers(4))], len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "a", 0)]
    labels = [(i, int(i < 50)) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    train = [(texts[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    kept = [r for r, p in zip(rows, D.plain_quality(train, [r[1] for r in rows]), strict=True) if p >= 0.5]
    stages = dict(corpus_pipeline.STAGES)
    seen = lambda df: sorted(map(tuple, df.collect()), key=repr)
    docs = stages["quality classifier"](spark, docs, str(tmp_path))
    assert seen(docs) == sorted(kept, key=repr) and 40 <= len(kept) < len(rows)
    kept = [r for r, ok in zip(kept, D.plain_rules([(r[1], r[2]) for r in kept]), strict=True) if ok]
    docs = work_table(stages["quality rules"](spark, docs, str(tmp_path)))
    assert seen(docs) == sorted(kept, key=repr)
    least = D.classes([r[0] for r in kept], [r[1] for r in kept])
    kept = [r for r, c in zip(kept, least, strict=True) if r[0] == c]
    docs = work_table(stages["near-duplicates"](spark, docs, str(tmp_path)))
    assert seen(docs) == sorted(kept, key=repr) and len(kept) < len(least)
    keyed = sorted(kept, key=lambda r: (hashlib.md5(f"1:{r[0]}".encode()).hexdigest(), len(r[1].split())))
    sizes = {r[0]: len(r[1].split()) for r in kept}
    passes = D.plain_mix([(r[0], r[3], sizes[r[0]]) for r in keyed], 1024, by_pass=True)
    copies = Counter()
    for (i, _), n in passes.items():
        copies[i] += 2 * n >= sizes[i]
    docs = work_table(stages["mixing"](spark, docs, str(tmp_path)))
    assert Counter(r.doc_id for r in docs.collect()) == +copies
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.part == 0) == +copies
    deal = docs.select("doc_id", "source", F.xxhash64("text").alias("cluster"), F.xxhash64("doc_id", "text").alias("deal")).collect()
    order = sorted(deal, key=lambda r: (r.deal, r.source, sizes[r.doc_id]))
    plain = D.plain_pack([(sizes[r.doc_id], r.source, r.cluster) for r in order], packing.CAPACITY)
    bins = lambda placed: sorted(sorted(b) for b in placed.values())
    ours, theirs = {}, {}
    for r in packed:
        ours.setdefault(r.bin_id, []).append((r.start, r.doc_id, r.n_words))
    for k, _, n, b, start in plain:
        theirs.setdefault(b, []).append((start, order[k].doc_id, n))
    assert bins(ours) == bins(theirs)


def test_pipeline_on_odd_rows(spark, odd, nothing, tmp_path):
    spark.createDataFrame([(i, int(i < 25), 0) for i in (*range(12), 25, 32)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        docs.collect()
