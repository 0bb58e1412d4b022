"""Operators over documents: odd inputs have defined results, and results equal plain versions."""

import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dirlake.llm import bagminhash, langid, lattice_lm, mixing, packing, quality_qda, quality_rules
from dirlake.llm.textstats import Texts
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
has_vocabulary = pytest.mark.skipif(not os.path.exists(lattice_lm.VOCABULARY), reason="no vocabulary")


def rows(df):
    return [r.asDict() for r in df.collect()]


def base(text):
    words = WORD.findall(text or "")
    found = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if found[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_rules_base_counts(odd):
    got = quality_rules.judge(odd).select("own.doc_id", "own.text", "own.size", "q.*").collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def plain_classes(text):
    """Code points of each character class, one by one."""
    out = Counter()
    named = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\x0b\x0c\r", "newline": "\n", "stop": ".,;:", "quote": "'\"`", "dash": "-_", "shout": "!?", "symbol": "#*$%&<>", "pipe": "|", "bracket": "()[]{}"}
    for c in text or "":
        kind = next((k for k, chars in named.items() if c in chars), None)
        out[kind or ("control" if ord(c) < 32 or ord(c) == 127 else "other_ascii" if ord(c) < 128 else "latin" if c.encode()[0] < 0xD0 else "wide")] += 1
    return [out[c] for c in quality_rules.CLASSES]


def plain_common(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    out = Counter()
    for w in WORD.findall(lower):
        w = w[:-1] if len(w.encode()) > 1 and w[-1] in ",.;:" else w
        out[quality_rules.WORDS.index(w) if w in quality_rules.WORDS else len(quality_rules.WORDS)] += 1
    return [out[i] for i in range(quality_rules.N_WORD)]


def plain_distance(p, q):
    if not sum(p):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / (sum(q) or 1e-300) for x in q]
    return math.sqrt(max(0.0, sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q, strict=True) if a) / 2 + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q, strict=True) if b) / 2))


def plain_rules(docs):
    """Whether each (text, lang) is kept, by plain counts."""
    refs = {}
    for text, lang in docs:
        if lang is not None:
            old = refs.setdefault(lang, ([0] * quality_rules.N_CHAR, [0] * quality_rules.N_WORD))
            refs[lang] = tuple([a + b for a, b in zip(x, y, strict=True)] for x, y in zip(old, (plain_classes(text), plain_common(text)), strict=True))
    refs = {k: v for k, v in refs.items() if sum(v[1])}
    out = []
    for text, _ in docs:
        n, chars, *_, repeated = base(text)
        near = min(((plain_distance(plain_classes(text), r[0]), plain_distance(plain_common(text), r[1])) for _, r in sorted(refs.items())), key=sum, default=(0, 0))
        far = chars >= 250 and ((n >= 40 and near[0] > 0.21 and near[1] > 0.27) or near[0] > 0.35)
        out.append(not (n < 10 or 100 * repeated > 20 * n) and not far)
    return out


def test_rules_keep_what_plain_counts_keep(spark, odd):
    noise = ["%d # %s" % (i, "| $ % ** <> " * 30) + " ".join(f"{k}:{i}" for k in range(40)) for i in range(6)]
    made = [(r.doc_id, r.text, r.lang) for r in odd.collect()] + [(100 + i, t, "en") for i, t in enumerate(noise)] + [(200, "λόγος ἀρχή, θεός. " * 3 + " ".join(f"ω{i}" for i in range(90)), "el"), (201, "Der Hund; und die Katze: " + " ".join(f"ist{i}" for i in range(60)), "de")]
    got = quality_rules.judge(spark.createDataFrame(made, "doc_id bigint, text string, lang string")).select("own.text", "own.lang", "q.kept").collect()
    want = Counter(zip(((t, lang) for _, t, lang in made), plain_rules([(t, lang) for _, t, lang in made]), strict=True))
    assert Counter(((r.text, r.lang), r.kept) for r in got) == want and {r.kept for r in got} == {True, False}


def test_kept_rows_pass_one_python_worker(spark, odd):
    """Each Arrow function of a task has a worker of its own, and four of them in an executor of two cores broke its memory."""
    kept = quality_rules.keep_good(odd)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = quality_rules.judge(odd).where("q.kept").select("own.*")
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, want.collect())) and kept.count()


def test_rules_without_rows_or_references(odd, nothing):
    assert rows(quality_rules.judge(nothing)) == [] and quality_rules.keep_good(odd.where("lang is null")).columns == odd.columns
    assert quality_rules.fit_references(nothing) == {}


def test_rules_keep_a_reference_for_every_language(spark):
    rare = " ".join(["λόγος", "ἀρχή", "θεός"][i % 3] + f"ω{i}" for i in range(45))
    made = [(i, prose(i, 80), f"l{i:03d}") for i in range(203)] + [(999, rare, "zz")]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.judge(df).select("own.doc_id", "q.*").collect()}
    assert got[999].ref == "zz" and got[999].char_jsd == got[999].word_jsd == 0 and got[999].kept
    assert len(got) == 204 and all(math.isclose(got[i].char_jsd + got[i].word_jsd, 0, abs_tol=1e-9) for i in range(203))
    by_blocks = {r.doc_id: r for r in quality_rules.judge(df, most=70).select("own.doc_id", "q.*").collect()}
    assert by_blocks == got


def test_jensen_shannon():
    p = np.array([[1.0, 0], [1, 1], [0, 0]])
    d = quality_rules.jensen_shannon(p, np.array([1.0, 0]))
    # halves against one point: half of log2(4/3) and of a half of log2(2/3) and log2(2)
    assert d[0] == 0 and d[2] == 0 and abs(d[1] - math.sqrt(0.5 * math.log2(4 / 3) + 0.25 * math.log2(2 / 3) + 0.25)) < 1e-12


@has_tables
def test_rules_drop_symbols_and_keep_prose(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = quality_rules.judge(d).where("q.n_words >= 40 and not q.base_failed").groupBy("own.quality", "q.kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


def test_classifier_on_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, int(i != 32 and i != 25), 0) for i in (*range(12), 25, 32, 32)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = rows(quality_qda.classify(odd, labels).select("own.doc_id", "score", "predicted", "held_out"))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in rows(quality_qda.classify(odd, labels.limit(0)))} == {0.5}
    assert rows(quality_qda.classify(nothing, labels)) == []


def plain_features(text):
    words, chars = WORD.findall(text or ""), dict(zip(quality_rules.CLASSES, plain_classes(text), strict=True))
    n, total = len(words), sum(chars.values())
    share = {k: v / max(total, 1) for k, v in chars.items()}
    _, _, _, again, repeated = base(text)
    length = (total - chars["space"] - chars["newline"]) / max(n, 1)
    root = [share["lower"], share["upper"], share["digit"], share["stop"], share["shout"], share["symbol"], share["pipe"], share["bracket"] + share["quote"] + share["dash"], share["newline"], share["wide"] + share["latin"], again / (chars["newline"] + 1), repeated / max(n, 1)]
    return [math.log1p(n), math.log1p(length), *map(math.sqrt, root), math.log1p(len(set(words))) / math.log1p(max(n, 1)), -sum(v * math.log2(v) for v in share.values() if v)]


def plain_quality(train, texts, shrink=0.2, ridge=1e-4):
    """Probabilities of class 1 from (text, label) rows, with numpy's own covariances and densities."""
    x, y = np.array([plain_features(t) for t, _ in train]), np.array([q for _, q in train])
    cov = {k: np.cov(x[y == k].T, bias=True) for k in (0, 1)}
    pooled = sum(cov[k] * (y == k).mean() for k in (0, 1))
    target = 0.5 * pooled + 0.5 * np.diag(np.diag(pooled))
    out = []
    for t in texts:
        v, log = np.array(plain_features(t)), {}
        for k in (0, 1):
            c = (1 - shrink) * cov[k] + shrink * target + ridge * np.eye(len(v))
            d = v - x[y == k].mean(0)
            log[k] = -0.5 * (d @ np.linalg.solve(c, d) + np.linalg.slogdet(c)[1]) + math.log((y == k).mean())
        out.append(1 / (1 + math.exp(-max(-700, min(700, log[1] - log[0])))))
    return out


def quality_rows():
    texts = [prose(i, 30 + i) for i in range(24)] + [f"{i} # | " + "$$ ** !! " * (5 + i % 7) + prose(i, 6) for i in range(24)] + [None, "", "word", "é東 " * 20]
    return list(enumerate(texts)), [(i, int(i < 24)) for i in range(48)] + [(3, 1), (30, 5), (None, 1)]


def test_classifier_equals_plain_densities(spark):
    docs, labels = quality_rows()
    got = quality_qda.classify(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).select("own.doc_id", "score").collect()
    train = [(docs[i][1], q) for i, q in labels if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    want = plain_quality(train, [t for _, t in docs])
    assert all(math.isclose(r.score, want[r.doc_id], abs_tol=1e-6) for r in got) and len(got) == len(docs)


@has_tables
def test_classifier_held_out(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_qda.classify(d, y).where("held_out").select("own.doc_id", "score").join(y, "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.99


def bags(texts):
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    return out


def classes(ids, texts):
    b, up = bags(texts), list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if b[i] and 5 * sum((b[i] & b[j]).values()) >= 4 * sum((b[i] | b[j]).values()) > 0:
                up[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), math.inf), math.inf if i is None else i)
    return [least[root(k)] for k in range(len(texts))]


def near_texts():
    rng = np.random.default_rng(5)
    texts = []
    for g in range(8):
        words = [f"g{g}w{i}" for i in rng.integers(0, 400, 150)]
        for _ in range(12):
            own = list(words)
            for at in rng.choice(150, rng.integers(0, 5), replace=False):
                own[at] = f"edit{rng.integers(1 << 30)}" if rng.random() < 0.7 else f"common{at % 3}"
            texts.append(" ".join(own))
    texts += [" ".join(["a b c d e f"] * n) for n in (20, 24, 40, 41)] + ["one two", "one two", "one", "", None, "one two three"]
    return texts


def test_near_duplicates_equal_all_pairs(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes(range(len(texts)), texts)


def test_near_duplicates_on_odd_rows(odd, nothing):
    got = rows(bagminhash.near_duplicates(odd))
    assert len(got) == odd.count()
    assert {r["class_id"] for r in got if r["doc_id"] in (30, 31)} >= {30} and all(r["kept"] for r in got if r["doc_id"] in (20, 21, 22))
    one = bagminhash.keep_one(odd)
    assert one.columns == odd.columns and one.where("doc_id = 30").count() == 1 and one.where("doc_id = 31").count() == 0 and one.where("doc_id is null").count() == 2
    assert rows(bagminhash.near_duplicates(nothing)) == []


def test_stage_keeps_one_row_of_each_class_of_rows(spark, odd):
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, odd, SF).select("doc_id", "text").collect()]
    assert got.count((30, prose(30))) == 1 and got.count((30, prose(31))) == 1  # one id, two classes
    assert (3, prose(3)) in got and (None, prose(3)) not in got and (31, prose(30)) not in got
    assert {i for i, t in got if not base(t)[0]} == {20, 21, 22, None}
    shared = spark.createDataFrame([(3, prose(3)), (7, prose(3)), (7, prose(9)), (None, prose(12)), (None, prose(12))], "doc_id bigint, text string")
    got = corpus_pipeline.near_duplicates(spark, shared, SF).collect()
    assert sorted(r.text for r in got) == sorted([prose(3), prose(9), prose(12)]) and {r.doc_id for r in got} == {3, 7, None}


def test_kept_rows_are_picked_where_they_are(spark):
    """Whole rows are not shuffled to be picked, and the bitmaps hold what a join finds, at the ends of bytes and of bitmaps too."""
    numbers = [k + (p << 33) for p in (0, 1, 5) for k in (*range(20), 255, 256, 32766, 32767, 32768, 32769, 32770, 65536, 65537)]
    table = spark.createDataFrame([(n, f"t{n}", n % 5 == 0) for n in numbers], "row bigint, own string, free boolean").repartition(5)
    first = spark.createDataFrame([(n,) for n in numbers if n * 7 % 3 == 0] * 2 + [(10**12,)], "row bigint")
    want = sorted((n, f"t{n}") for n in numbers if n * 7 % 3 == 0 or n % 5 == 0)
    for most in (32 << 20, 0):
        got = bagminhash._picked(table, first.distinct(), F.col("free"), most)
        assert sorted((r.row, r.own) for r in got.collect()) == want and got.columns == table.columns
    assert sorted(r.row for r in bagminhash._picked(table, first.where("false"), F.col("free")).collect()) == [n for n in sorted(numbers) if n % 5 == 0]


def test_stage_shuffles_no_whole_rows_to_pick_them(spark, odd):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bagminhash.keep_rows(odd.select("doc_id", "text", "lang", "source", "n_chars"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and plan.count("own") and plan.count("hashpartitioning") == 1


def test_signatures_estimate_weighted_similarity():
    a = " ".join(["x y z u v w"] * 40)
    b = " ".join(["x y z u v w"] * 60)
    sig = np.concatenate([bagminhash.signatures(Texts.of(pa.array([f"{k} " + a, f"{k} " + b]))) for k in range(60)])
    x, y = bags([a, b])
    assert abs((sig[::2] == sig[1::2]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.04


def test_mix_shares_and_odd_rows(odd, nothing):
    got = rows(mixing.mix(odd, quantum=8))
    size = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        size[r["source"]] += r["size"]
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and 3 * size[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    for s in names:
        aim = 3 * size[s] if s in capped else level * weight[s]
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size[s]} and all(abs(r["target"] - aim) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - aim) <= 8
    key = lambda rs: sorted(map(repr, rs))
    assert key(got) == key(rows(mixing.mix(odd.repartition(5), quantum=8))) and rows(mixing.mix(nothing)) == []
    kept = mixing.mixed_rows(odd)
    assert kept.columns == odd.columns and kept.where("text is null").count() == 0


def test_mixed_rows_are_those_of_the_queue(spark, odd):
    # 40 rows without ids and 40 of one id in a source that is cut, next to sources that raise the total
    made = [(None if i % 2 else 5, " ".join(f"t{i}w{k}" for k in range(20 + i % 3)), "c") for i in range(80)]
    made += [(100 + i, prose(i), s) for i in range(20) for s in "ab"]
    taken, aim = mixing.mix(spark.createDataFrame(made, "doc_id bigint, text string, source string")).where("source = 'c'").selectExpr("sum(taken)", "max(target)").first()
    got = mixing.mixed_rows(spark.createDataFrame(made, "doc_id bigint, text string, source string")).where("source = 'c'").collect()
    assert abs(sum(len(r.text.split()) for r in got) - aim) <= 44 and abs(taken - aim) <= 22 and aim < 0.7 * sum(len(t.split()) for _, t, s in made if s == "c")
    for docs in (spark.createDataFrame(made, "doc_id bigint, text string, source string"), odd):
        sized, served = mixing.packets(docs.withColumn("t", docs.text), tag=["t"])
        taken = served.join(sized, "row").where("2 * taken >= size").collect()
        got = mixing.mixed_rows(docs).collect()
        assert Counter((r.doc_id, r.source, r.text) for r in got) == Counter((r.doc_id, r.source, r.t) for r in taken)
        # rows come out in the order of their finish
        times = {}
        for r in taken:
            times.setdefault((r.doc_id, r.source, r.t), []).append(r.finish)
        seen = [min(times[r.doc_id, r.source, r.text]) for r in got]
        first = {}
        for k, r in enumerate(got):
            first.setdefault((r.doc_id, r.source, r.text), (seen[k], k))
        assert [k for _, k in sorted(first.values())] == sorted(k for _, k in first.values())


def plain_mix(rows, quantum, by_pass=False):
    """Words taken of each id (and pass) by an exact queue over lists: rows (id, source, size) in queue order."""
    total, names = sum(r[2] for r in rows), sorted({r[1] for r in rows})
    size, weight = Counter(), {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    for _, s, n in rows:
        size[s] += n
    capped: set = set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and 3 * size[s] < level * weight[s]}
        if not more:
            break
        capped |= more
    queue, before = [], Counter()
    for k in range(3):
        for i, s, n in rows:
            for lo in range(0, n, quantum):
                words = min(quantum, n - lo)
                queue.append(((before[s] + lo + words) / (3 * size[s] if s in capped else level * weight[s]), i, k, words))
            before[s] += n
    taken, left = Counter(), total
    for _, i, k, words in sorted(queue):
        taken[(i, k) if by_pass else i] += min(words, left)
        left -= min(words, left)
    return taken


@pytest.mark.parametrize("quantum", [16, 1024])
def test_mix_is_the_queue_cut_at_the_budget(spark, quantum):
    made = [(i, " ".join(f"q{i}w{k}" for k in range(5 + i * 13 % 90)), "abcde"[i % 7 % 5]) for i in range(120)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id bigint, text string, source string"), quantum=quantum).collect()
    order = sorted((r.key, r.doc_id, r.source, r.size) for r in got)
    want = plain_mix([(i, s, n) for _, i, s, n in order], quantum)
    assert {r.doc_id: r.taken for r in got if r.taken} == +want


def test_packing_constraints(odd, nothing):
    got = rows(packing.pack(odd, capacity=128, block=8))
    words, bins = Counter(), {}
    for r in got:
        words[r["doc_id"]] += r["n_words"]
        bins.setdefault(r["bin_id"], []).append(r)
    want = Counter()
    for r in odd.collect():
        want[r.doc_id] += base(r.text)[0]
    assert words == +want
    for b in bins.values():
        assert sum(r["n_words"] for r in b) <= 128 and len({r["source"] for r in b}) == len(b) == len({r["cluster"] for r in b})
        at = 0
        for r in sorted(b, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_words"]
    assert rows(packing.pack(nothing)) == []


def test_packing_counts_words_once(odd):
    """A count in a filter and in a column took two Python workers in each task."""
    assert packing.pack(odd)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def plain_pack(rows, capacity):
    """(row, part, words, bin, start) by looking at every open bin: rows (size, source, cluster)."""
    bins, out, counts = [], [], Counter(c for _, _, c in rows)
    touched = 0
    for k in sorted(range(len(rows)), key=lambda k: -(rows[k][0] % capacity or capacity)):
        size, source, cluster = rows[k]
        parts = [capacity] * (size // capacity) + ([size % capacity] if size % capacity else [])
        for part, n in enumerate(parts):
            # among bins of one residual, the one that came to it first
            fits = [(b["left"], b["at"], i) for i, b in enumerate(bins) if b["left"] >= n and source not in b["sources"] and (counts[cluster] < 2 or cluster is None or cluster not in b["clusters"])]
            i = min(fits)[2] if fits else len(bins)
            if i == len(bins):
                bins.append({"left": capacity, "sources": set(), "clusters": set(), "at": 0})
            b = bins[i]
            out.append((k, part, n, i, capacity - b["left"]))
            touched += 1
            b.update(left=b["left"] - n, at=touched)
            b["sources"].add(source)
            b["clusters"].add(cluster)
    return out


def test_packing_equals_a_plain_search():
    rng = np.random.default_rng(8)
    for _ in range(20):
        rows = [(int(rng.integers(1, 150)), "abcdefgh"[rng.integers(8)], None if rng.random() < 0.1 else int(rng.integers(0, 40))) for _ in range(120)]
        assert packing.pack_block([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], 64) == plain_pack(rows, 64)


def test_packing_by_a_named_cluster(spark):
    made = [(f"d{i}", prose(i, 20), "abcdef"[i % 6], i // 3) for i in range(60)] + [("none", prose(99, 20), "a", None)]
    got = packing.pack(spark.createDataFrame(made, "doc_id string, text string, source string, class int"), capacity=100, cluster="class").collect()
    own, bins = {d: c for d, _, _, c in made}, {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(own[r.doc_id])
    assert len(got) == 61 and all(len(set(b) - {None}) == len([c for c in b if c is not None]) for b in bins.values())


def test_packing_takes_the_tightest_bin():
    bins = packing.Bins(10)
    assert [bins.place(6, 1, 0), bins.place(7, 2, 0), bins.place(3, 4, 0), bins.place(3, 4, 0), bins.place(1, 1, 0)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]


def test_language_gradient():
    rng = np.random.default_rng(0)
    raw, y = rng.integers(97, 101, (6, 5)).astype(np.uint8), rng.integers(0, 2, 6)
    net = langid.train(raw, np.array([0, 1, 0, 1, 0, 1]), ["a", "b"], steps=1)
    for group in (net.inputs, net.recurrent):
        for k, own in enumerate(group):
            group[k] = [x.astype(float) for x in own]
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)

    def loss():
        states = np.zeros((2, 5, 6, langid.UNITS))
        for way, order in enumerate((range(5), range(4, -1, -1))):
            h = np.zeros((6, langid.UNITS))
            for t in order:
                z, r = (langid._squash(net.inputs[way][k][raw.T[t]] + h @ net.recurrent[way][k]) for k in (0, 1))
                new = langid._squash(net.inputs[way][2][raw.T[t]] + (0.5 + 0.5 * r) * (h @ net.recurrent[way][2]))
                h = new + (0.5 + 0.5 * z) * (h - new)
                states[way, t] = h
        logits = np.concatenate(states, 2) @ net.out + net.bias
        logp = logits - np.log(np.exp(logits).sum(2, keepdims=True))
        return -logp[:, np.arange(6), y].mean()

    for p, g in zip(net.parameters, langid._gradients(net, raw.T, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-3 * max(1e-2, abs(g[at]))


@has_tables
def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).where("held_out and own.lang is not null").selectExpr("avg(cast(lang = own.lang as int))", "min(score)", "max(score)").first()
    assert got[0] > 0.98 and 0 <= got[1] and got[2] <= 1


def test_language_on_odd_rows(odd, nothing):
    got = rows(langid.identify(odd).select("own.doc_id", "own.text", "own.lang", "own.score", F.col("lang").alias("found"), F.col("score").alias("sure")))
    assert len(got) == odd.count() and all(0 <= r["sure"] <= 1 and r["score"] == "score" for r in got)
    assert all((r["found"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) for r in got)
    assert rows(langid.identify(odd.limit(0))) == [] and rows(langid.identify(nothing)) == []
    assert {r["lang"] for r in rows(langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).select("lang"))} == {"und"}


def test_every_language_is_learned(spark):
    # two rows of one language beside 900 of others, a third of all rows one copy, and rows that say nothing
    made = [(i, prose(i % 40), "en" if i % 2 else "fr") for i in range(600)] + [(None, prose(1), "en")] * 300 + [(2000 + i, "12 34 !", "en") for i in range(50)]
    made += [(5003, "жук λόγος ждал", "ru"), (5004, "жук ждал долго", "ru"), (5005, None, "xx"), (5006, "", "xx")]
    net = langid.fit(spark.createDataFrame(made, "doc_id bigint, text string, lang string"), sample=20)
    assert net.langs == ["en", "fr", "ru"]


def plain_network(net, data):
    """Mean probabilities of one text, a byte and a unit at a time."""
    soft = lambda x: x / (1 + abs(x))
    data = bytes(langid._FOLD[b] for b in data)
    total = np.zeros(len(net.langs))
    for lo in range(0, len(data), langid.SPAN):
        # a last window is padded with blanks, which are read but not counted
        part = data[lo : lo + langid.SPAN].ljust(langid.SPAN)
        states = [[None] * len(part) for _ in "fb"]
        for way, order in enumerate((range(len(part)), range(len(part) - 1, -1, -1))):
            h = [0.0] * langid.UNITS
            for t in order:
                dot = lambda k, u: sum(h[v] * float(net.recurrent[way][k][v, u]) for v in range(langid.UNITS))  # noqa: B023, E731
                table = lambda k, u: float(net.inputs[way][k][part[t], u])  # noqa: B023, E731
                new = []
                for u in range(langid.UNITS):
                    z, r = (0.5 + 0.5 * soft(table(k, u) + dot(k, u)) for k in (0, 1))
                    c = soft(table(2, u) + r * dot(2, u))
                    new.append(c + z * (h[u] - c))
                h = new
                states[way][t] = h
        for t in range(min(len(part), len(data) - lo)):
            x = np.array([*states[0][t], *states[1][t]]) @ net.out.astype(float) + net.bias
            p = np.exp(x - x.max())
            total += p / p.sum()
    return total / max(len(data), 1)


def test_language_probabilities_equal_a_plain_network():
    rng = np.random.default_rng(1)
    net = langid.train(rng.integers(97, 123, (12, 48)).astype(np.uint8), np.arange(12) % 3, ["a", "b", "c"], steps=5)
    texts = ["hello World", "x", "añb " * 60, ""]
    got = langid._pooled(pa.array(texts), net)
    assert all(np.allclose(got[k], plain_network(net, t.encode()), atol=1e-4) for k, t in enumerate(texts))


def toy():
    p = {b" ": 0.1, b"a": 0.2, b"b": 0.2, b"ab": 0.2, b" a": 0.15, b" ab": 0.1, b"ba": 0.05}
    return lattice_lm.Pieces(list(p), np.log(list(p.values())))


def plain_marginal(word, pieces):
    text, p = b" " + word, dict(zip(pieces.names, np.exp(pieces.logp), strict=True))
    alpha = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        alpha[j] = sum(alpha[i] * p.get(text[i:j], 0) for i in range(j))
    return math.log(alpha[-1])


def test_lattice_forward_and_expectations():
    words = [b"a", b"ab", b"abba", b"bab", b"aab"]
    got = lattice_lm.log_marginals(words, toy())
    assert np.allclose(got, [plain_marginal(w, toy()) for w in words])
    counts = lattice_lm.expected_pieces(words, np.ones(5), toy())
    assert np.isclose(sum(n * len(p) for n, p in zip(counts, toy().names, strict=True)), sum(len(w) + 1 for w in words))


def test_long_words_are_scored_like_short_ones(monkeypatch):
    rng = np.random.default_rng(6)
    words = [rng.choice(np.frombuffer(b"ab", np.uint8), n).tobytes() for n in (1, 7, 60, 300)]
    counts = np.array([3, 1, 2, 5])
    short = lattice_lm.log_marginals(words, toy()), lattice_lm.expected_pieces(words, counts, toy())
    monkeypatch.setattr(lattice_lm, "LONG", 0)
    assert np.allclose(short[0], lattice_lm.log_marginals(words, toy())) and np.allclose(short[1], lattice_lm.expected_pieces(words, counts, toy()))


def test_fit_equals_a_plain_expectation_maximisation(spark):
    words = [(b"ab", 4), (b"ba", 2), (b"abab", 1), (b"x", 0)]
    got = lattice_lm.fit(spark.createDataFrame([(bytearray(w), c) for w, c in words], "word binary, c bigint"), 3, toy(), rounds=2, prior=10.0)
    p = dict(zip(toy().names, np.exp(toy().logp), strict=True))
    first = dict(p)

    def segmentations(text):
        if not text:
            yield ()
        for k in range(1, len(text) + 1):
            if text[:k] in p:
                yield from ((text[:k], *rest) for rest in segmentations(text[k:]))

    for _ in range(2):
        n = {k: 10.0 * first[k] for k in p}
        for w, c in words:
            each = [(s, math.prod(p[x] for x in s)) for s in segmentations(b" " + w)]
            total = sum(q for _, q in each)
            for s, q in each:
                for x in s:
                    n[x] += c * q / total
        size = sum(n.values()) + 4
        p = {k: v / size for k, v in n.items()}
    assert np.allclose(np.exp(got.logp), [p[k] for k in got.names]) and math.isclose(math.exp(got.end), 4 / size)


@has_vocabulary
@pytest.mark.parametrize("head", [5, 100_000])
def test_lattice_scores(odd, nothing, head):
    got = rows(lattice_lm.score(odd, head=head, rounds=1))
    source = odd.select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, ends = Counter(), 0
    for r in source:
        if not held(r.doc_id):
            ends += 1
            c.update((r.text or "").encode().lower().split())
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for r in source:
        words = (r.text or "").encode().lower().split()
        want.append((str(r.doc_id), held(r.doc_id), len(words) + 1, sum(c[w] > 0 for w in words) + 1, n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1)), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert rows(lattice_lm.score(nothing)) == []


@has_vocabulary
def test_lattice_score_is_the_sum_of_its_words(spark):
    df = spark.createDataFrame([(i, prose(i)) for i in range(6)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in rows(lattice_lm.score(df, rounds=0, head=3))}
    pieces = lattice_lm.load()
    for i in range(6):
        words = prose(i).encode().split()
        assert math.isclose(got[i], (lattice_lm.log_marginals(words, pieces).sum() + pieces.end) / math.log(10), rel_tol=1e-9)
