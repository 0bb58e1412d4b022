"""URL filters: pattern rules indexed by their rarest literal token. DataFrame functions only.

A pattern is matched against the host (A-Z lower-cased), path and query of a URL. `||` at its start stands for the start
of the host or of a part of it after a dot, `*` for any characters, `^` for a separator (anything but letters,
digits, `_`, `-`, `.` and `%`, or the end), `~` for a word edge (no ASCII letter or digit next to it); all else is literal.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirlake.llm.common import packed

#: Bytes of an index that goes to every task; a larger one is joined by a shuffle. Both ways give the same rows.
MOST_BROADCAST = 32 << 20
#: The columns of a rule table.
SCHEMA = "name string, verdict string, pattern string, ranked boolean"
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """`name` is reported where `ranked` is true: of those that match, the longest name wins. The others only give a verdict, block before allow."""

    name: str
    verdict: str
    pattern: str
    ranked: bool


HOST_RULES = [Rule("net/", "block", "||net/", True), Rule("example.net/en/", "allow", "||example.net/en/", True), Rule("example.com/de/", "block", "||example.com/de/", True), Rule("org/fr/", "allow", "||org/fr/", True)]
WORD_RULES = [Rule(w, "block", p, False) for w, p in {"adult": "||*~adult~*/", "pills": "||*~pills~*/", "casino": "||*~casino~*/", "login": "*/login^", "cart": "*/cart^", "session": "*~sessionid=", "track": "*~click~*~redirect="}.items()]
RULES = HOST_RULES + WORD_RULES


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for a null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for a null or without `://`."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _target(url: Column) -> Column:
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, "://[^/?#]*([^#]*)", 1), F.lit("")))


def regex_of(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    anchored = pattern.startswith("||")
    rest = F.when(anchored, F.substring(pattern, F.lit(3), F.length(pattern))).otherwise(pattern)
    host = F.when(rest.startswith("*"), F.lit("^[^/?#]*")).otherwise(F.lit("^(?:[^/?#]*\\.)?"))
    tail = F.when(anchored & rest.startswith("*"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
    # literals are escaped first; the marks' own expressions hold none of the other marks unescaped
    out = F.regexp_replace(tail, r"([^a-zA-Z0-9/=*^~])", r"\\$1")
    out = F.replace(out, F.lit("^"), F.lit("\x01"))
    out = F.replace(out, F.lit("*"), F.lit("[\\s\\S]*"))
    out = F.replace(out, F.lit("~"), F.lit("(?:(?<![a-zA-Z0-9])|(?![a-zA-Z0-9]))"))
    out = F.replace(out, F.lit("\x01"), F.lit("(?:[^a-zA-Z0-9_.%-]|$)"))
    return F.concat(F.when(anchored, host).otherwise(F.lit("^")), out)


def literals_of(pattern: Column) -> Column:
    """The pattern's letter and digit runs that are whole tokens of any URL it matches: no `*` or open end next to them."""
    own = F.concat(F.when(pattern.startswith("||"), F.lit(".")).otherwise(F.lit("*")), F.regexp_replace(pattern, r"^\|*", ""), F.lit("*"))
    found = F.regexp_extract_all(own, F.lit(r"(?<![a-zA-Z0-9*])([a-zA-Z0-9]+)(?![a-zA-Z0-9*])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda t: F.translate(t, _UPPER, _SMALL))))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A few rules as a table of SCHEMA."""
    made = [F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.ranked).alias("ranked")) for r in rules]
    return spark.range(1).select(F.explode(F.array(*made)).alias("r")).select("r.*")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule list of any length as a table of SCHEMA: files of tab-separated lines name, verdict, pattern, ranked; lines that start with `!` are comments, and lines without a verdict of allow or block, or without a pattern, are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("!"))
    part = F.split("value", "\t")
    table = lines.select(F.get(part, F.lit(0)).alias("name"), F.get(part, F.lit(1)).alias("verdict"), F.get(part, F.lit(2)).alias("pattern"), (F.coalesce(F.get(part, F.lit(3)), F.lit("")) == "true").alias("ranked"))
    return table.where(F.col("verdict").isin("allow", "block") & (F.length("pattern") > 0))


def tokens_of(target: Column) -> Column:
    """The distinct letter and digit runs, and the empty token that rules without literals go by."""
    return F.array_append(F.array_distinct(F.regexp_extract_all(F.translate(target, _UPPER, _SMALL), F.lit("[a-z0-9]+"), F.lit(0))), F.lit(""))


def rule_index(urls: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """(token, name, verdict, regex, ranked): each rule under that of its literals which the fewest URLs hold."""
    known = literals_of(F.col("pattern"))
    table = rules.select("name", "verdict", "ranked", regex_of(F.col("pattern")).alias("regex"), F.when(F.size(known) > 0, known).otherwise(F.array(F.lit(""))).alias("tokens")).distinct()
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    seen = urls.select(F.explode("tokens").alias("token")).join(_hinted(wanted, small), "token", "left_semi").groupBy("token").count()
    each = table.select("*", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = each.groupBy("name", "verdict", "regex", "ranked").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("least"))
    return rarest.select(F.col("least.token").alias("token"), "name", "verdict", "regex", "ranked")


def _hinted(table: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(table) if small else table


def judge(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(own, host, path, rule, verdict), one row for each row of `pages`: its columns as a struct and the verdict on its URL.

    Each distinct URL is cut into tokens once, its tokens fetch the rules indexed under them, and only those run their
    regular expressions. `rule` is the longest ranked rule that matches, ties by name, and gives the verdict. Without one, any
    matching unranked rule blocks (or, without a blocking one, allows) and all other URLs, null and empty ones too, are allowed.
    Repeated rows are judged alike, and repeated rules count once. `rules` is a table of SCHEMA, RULES where None; it goes to every task where its patterns'
    bytes, times a bound for what the index adds to them, are `most_broadcast` or less.
    """
    rules = rule_table(pages.sparkSession, RULES) if rules is None else rules
    # a regular expression has at most 46 bytes for a pattern's byte; the other columns are in the sum
    size = rules.agg(F.sum(46 * F.coalesce(F.octet_length("pattern"), F.lit(0)) + F.coalesce(F.octet_length("name"), F.lit(0)) + 128)).first()[0] or 0
    small = size <= most_broadcast
    rows = pages.select(packed(pages).alias("own"), F.col(url).alias("u"))
    urls = rows.select("u").where("u is not null").distinct().withColumn("target", _target(F.col("u"))).withColumn("tokens", tokens_of(F.col("target")))
    index = rule_index(urls, rules, small)
    hits = urls.select("u", "target", F.explode("tokens").alias("token")).join(_hinted(index, small), "token").where(F.expr("target rlike regex"))
    best = hits.groupBy("u").agg(
        F.max(F.when(F.col("ranked"), F.struct(F.length("name").alias("l"), "name", "verdict"))).alias("best"),
        F.max(F.when(~F.col("ranked"), F.col("verdict"))).alias("other"),
    )
    out = rows.join(best, "u", "left")
    return out.select("own", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), F.col("best.name").alias("rule"), F.coalesce("best.verdict", "other", F.lit("allow")).alias("verdict"))
