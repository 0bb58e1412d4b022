import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dirlake.functions import lexer4512 as X
from dirlake.operators import compat as C

WORDS = st.sampled_from(["(", ")", "$", "'a b'", "'it\\27s'", "'x", "NAME", "DESC", "SUP", "name", "OBSOLETE", "1.2", "cn", "é", " ", "  ", "\t", "X-Y", "\\'"])


def scan(text):
    """One character at a time: (kind, first, last) of each token."""
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if c in " \t\n\r\x0b\x0c":
            k += 1
        elif c in "()$":
            out.append((c, k, k + 1))
            k += 1
        elif c == "'" and (k == 0 or text[k - 1] != "\\"):
            end = k + 1
            while end < len(text) and not (text[end] == "'" and text[end - 1] != "\\"):
                end += 1
            end = min(end + 1, len(text))
            out.append(("q", k, end))
            k = end
        else:
            end = k
            while end < len(text) and text[end] not in " \t\n\r\x0b\x0c()$" and not (text[end] == "'" and text[end - 1] != "\\" or text[end] == "'" and end == 0):
                end += 1
            out.append(("w", k, end))
            k = end
    return out


def fields(text):
    """The fields by a plain walk over the tokens."""
    tokens = scan(text)
    base = 1 if any(t[0] == "(" for t in tokens) else 0
    depth, out, oid, first, before, shut = 0, [], None, True, None, False
    for kind, lo, hi in tokens:
        word = text[lo:hi]
        depth += (kind == "(") - (kind == ")")
        if kind == ")" and depth <= base - 1:
            shut = True
        if shut:
            continue
        level = depth == base and kind in "wq"
        low = kind == "w" and word.upper() != word
        key = level and kind == "w" and (word.upper() in X.ORDER or word.upper().startswith("X-")) and not (low and before == "valued")
        if level and first:
            oid, first = (None if key else word), False
        if key:
            out.append([word.upper(), [], lo, hi])
        elif out and (depth > base or depth == base and kind != "("):
            out[-1][3] = hi
            if kind == "w":
                out[-1][1].append(word)
            elif kind == "q":
                own = word[1:-1] if len(word) > 1 and word.endswith("'") and word[-2] != "\\" else word[1:]
                out[-1][1].append(own.replace("\\27", "'").replace("\\'", "'").replace("\\5c", "\\").replace("\\5C", "\\"))
        before = "valued" if key and word.upper() not in X.FLAGS else None
    return oid, [tuple([f[0], f[1], f[2], f[3]]) for f in out]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(WORDS, max_size=14).map(" ".join) | st.lists(WORDS, max_size=14).map("".join) | st.none(), max_size=5))
def test_whole_columns_are_read_as_single_texts_are(texts):
    got = X._lexed(pa.array(texts, pa.string())).to_pylist()
    for text, x in zip(texts, got, strict=True):
        if text is None:
            assert x is None
        else:
            assert (x["oid"], [(f["name"], f["values"], f["first"], f["last"]) for f in x["fields"]]) == fields(text), text
    # a slice of a column is read from its own beginning
    assert X._lexed(pa.array(["( 1 DESC 'x", *texts], pa.string()).slice(1)).to_pylist() == got


def test_any_field_is_replaced_added_or_removed(spark):
    rng = random.Random(5)
    parts = {"NAME": "NAME ( 'a'  'b' )", "DESC": "DESC 'some (text) \\27q\\27 é'", "OBSOLETE": "OBSOLETE", "SUP": "SUP name", "SYNTAX": "SYNTAX 1.3{64}", "USAGE": "USAGE\tdSAOperation", "MAY": "MAY ( a$b )", "X-ORIGIN": "X-ORIGIN 'r'"}
    rows = []
    for k in range(60):
        names = rng.sample(list(parts), rng.randint(0, len(parts)))
        gaps = [" " * rng.randint(1, 3) for _ in names]
        rows.append((k, "( 1.2" + "".join(g + parts[n] for g, n in zip(gaps, names)) + " )", names, gaps))
    df = spark.createDataFrame([(k, t) for k, t, _, _ in rows], "k int, t string")
    for name in parts:
        out = {r["k"]: (r["new"], r["gone"], r["same"]) for r in df.select("k", X.with_changes(F.col("t"), [(name, F.lit("@"))]).alias("new"), X.with_changes(F.col("t"), [(name, F.lit(None))]).alias("gone"), X.with_changes(F.col("t"), [("MUST", F.lit(None))]).alias("same")).collect()}
        for k, t, names, gaps in rows:
            new, gone, same = out[k]
            own = [g + parts[n] for g, n in zip(gaps, names)]
            assert same == t
            if name in names:
                at = names.index(name)
                assert new == "( 1.2" + "".join(own[:at]) + gaps[at] + "@" + "".join(own[at + 1 :]) + " )"
                assert gone == "( 1.2" + "".join(own[:at] + own[at + 1 :]) + " )"
            else:
                # behind the last field that comes before it in the usual order
                order = {**{w: i for i, w in enumerate(X.ORDER)}, "X-ORIGIN": 99}
                at = max((i + 1 for i, n in enumerate(names) if order[n] < order[name]), default=0)
                assert new == "( 1.2" + "".join(own[:at]) + " @" + "".join(own[at:]) + " )" and gone == t


def test_restoring_twice_changes_nothing(spark):
    rows = [("( 1.2  NAME 'A' )", "( 1.3 NAME 'a' DESC 'B  c' )"), ("x", "( 1.2 )"), ("( 1.2 )", "x"), ("", ""), (None, "( 1 )"), ("( 1 )", None), ("( NAME 'a' )", "( 1.2 NAME 'a' )")]
    df = spark.createDataFrame(rows, "old string, new string")
    once = df.withColumn("out", C.restored(F.col("new"), C.formatting(F.col("old"))))
    twice = once.withColumn("again", C.restored(F.col("out"), C.formatting(F.col("old")))).collect()
    assert [r["out"] for r in twice][:1] == ["( 1.3  NAME 'a' DESC 'B  c' )"] and twice[4]["out"] == "( 1 )" and twice[5]["out"] is None
    assert all(r["again"] == r["out"] for r in twice)
