import contextlib
import io

from dirlake.functions import tables
from dirlake.sources import ldif


def shown(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_lateral_calls_are_planned_as_functions_over_whole_columns(spark):
    tables.register(spark)
    spark.createDataFrame([(1, "dn: cn=a\ncn: a", 'acl "a"; allow (read) ip="1";')], "k int, text string, aci string").createOrReplaceTempView("texts_and_acis_of_a_test")
    for call in ("parse_ldif(t.text)", "parse_acl(t.aci)"):
        plan = shown(spark.sql(f"SELECT t.k, e.* FROM texts_and_acis_of_a_test t, LATERAL {call} e"))
        # a call a row takes milliseconds, and a join on the argument brings equal ones together
        assert "BatchEvalPythonUDTF" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_texts_are_cut_as_parse_text_cuts_them(spark):
    tables.register(spark)
    texts = ["VERSION: 1\ndn: cn=a\n\n \t\n  dn: cn=b\r\n x\r\n\r\n\n\n\x0b\n\ndn: cn=c", "version: 1", "\n\n\ndn: cn=d\n\n", "# only a remark\n\nversion: 2\n\ndn: cn='e'\\n\n\tq"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    df.createOrReplaceTempView("odd_texts_of_a_test")
    got = spark.sql("SELECT k, e.* FROM odd_texts_of_a_test, LATERAL parse_ldif(text) e")
    want = ldif.parse_text(df).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert [f.dataType for f in got.schema if f.name != "record_no"] == [f.dataType for f in want.schema if f.name != "record_no"]


def test_clauses_of_many_instructions(spark):
    tables.register(spark)
    rows = [(1, 'acl "a"; allow (read) ip="1"; deny (write) (x;'), (2, None), (3, "none"), (4, 'acl "a"; allow (read) ip="1"; deny (write) (x;'), (5, 'deny( , ALL ) not ip="2" ;')]
    spark.createDataFrame(rows, "k int, aci string").coalesce(1).createOrReplaceTempView("many_acis_of_a_test")
    got = spark.sql("SELECT k, a.name, a.kind, a.permissions, a.rule, size(a.steps) AS n, a.error FROM many_acis_of_a_test LEFT JOIN LATERAL parse_acl(aci) a ON true").collect()
    both = [("a", "allow", ["read"], 'ip="1"', 1, None), ("a", "deny", ["write"], "(x", None, "unreadable at 1: x")]
    want = [(k, *c) for k in (1, 4) for c in both] + [(5, None, "deny", ["all"], 'not ip="2"', 2, None)] + [(k, None, None, None, None, None, None) for k in (2, 3)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
