"""Bind rules of access control instructions: nested expressions as postfix arrays that a column evaluates, and macros filled in from an entry's name."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from dirlake.functions.dn import norm_dn, split_dn

#: A step is a term (`op` is null: key, whether it is negated by `!=`, its alternatives) or an operator that takes what stands before it.
STEPS = "array<struct<op: string, key: string, negated: boolean, values: array<string>>>"
PARSED = f"struct<steps: {STEPS}, error: string>"
_TOKEN = re.compile(r'\s*(?:(\(|\))|(and|or|not)\b|([A-Za-z]\w*)\s*(!?=)\s*"([^"]*)")', re.I)
_RANK = {"or": 1, "and": 2, "not": 3}
_STEP = pa.struct([("op", pa.string()), ("key", pa.string()), ("negated", pa.bool_()), ("values", pa.list_(pa.string()))])


def postfix(text: str) -> tuple[list[dict] | None, str | None]:
    """(steps, error) of one bind rule: `not` binds closest, then `and`, then `or`; alternatives in a term stand between double bars."""
    out: list[dict] = []
    waiting: list[str] = []
    value_next, at = True, 0
    text = text.rstrip()

    def put(word: str) -> None:
        out.append({"op": word, "key": None, "negated": False, "values": []})

    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None, f"unreadable at {at}: {text[at : at + 20].strip()}"
        bracket, word, key, sign, values = m.groups()
        word = word and word.lower()
        if bool(bracket == "(" or word == "not" or key) != value_next:
            return None, f"unexpected at {m.start() + len(m[0]) - len(m[0].lstrip())}: {m[0].strip()[:20]}"
        if key:
            out.append({"op": None, "key": key.lower(), "negated": sign == "!=", "values": [re.sub(r"(?i)^ldaps?:///", "", v.strip()) for v in values.split("||")]})
            value_next = False
        elif bracket == "(" or word == "not":
            waiting.append(bracket or word)
        elif bracket == ")":
            while waiting and waiting[-1] != "(":
                put(waiting.pop())
            if not waiting:
                return None, f"bracket without opening at {m.end() - 1}"
            waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                put(waiting.pop())
            waiting.append(word)
            value_next = True
        at = m.end()
    if "(" in waiting:
        return None, "bracket is not closed"
    if value_next:
        return None, "ends early" if text.strip() else "empty"
    for word in reversed(waiting):
        put(word)
    return out, None


def parse(rule: Column) -> Column:
    """PARSED of each bind rule; each text that repeats in a batch is parsed once. A null gives a null, an unreadable rule an error and no steps."""

    @F.arrow_udf(PARSED)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rules in batches:
            coded = rules.dictionary_encode()
            done = [postfix(x) for x in coded.dictionary.to_pylist()]
            both = pa.StructArray.from_arrays([pa.array([s for s, _ in done], pa.list_(_STEP)), pa.array([e for _, e in done], pa.string())], ["steps", "error"])
            yield both.take(coded.indices) if len(done) else pa.array([None] * len(rules), both.type)

    return parsed(rule)


def holds(steps: Column, hits: Column) -> Column:
    """Whether an expression holds when its terms at the positions `hits` do; null without steps. A term with `!=` holds where it is no hit."""
    term = lambda s, i: F.array_contains(hits, i) != s["negated"]
    indexed = F.transform(steps, lambda s, i: F.struct(s["op"].alias("op"), term(s, i).alias("truth")))

    def step(stack: Column, s: Column) -> Column:
        n = F.size(stack)
        top, below = F.get(stack, n - 1), F.get(stack, n - 2)
        one, two = F.slice(stack, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0)))
        pushed = F.when(s["op"].isNull(), F.concat(stack, F.array(s["truth"]))).when(s["op"] == "not", F.concat(one, F.array(~top)))
        return pushed.when(s["op"] == "and", F.concat(two, F.array(top & below))).otherwise(F.concat(two, F.array(top | below)))

    return F.get(F.aggregate(indexed, F.array().cast("array<boolean>"), step), F.lit(0))


# --- macros --------------------------------------------------------------------------------------------------------------

MACRO = "($dn)"


def captured(target: Column, entry: Column) -> Column:
    """What stands for `($dn)` when a target with that macro matches an entry's name, both in lower-case normal form; null where it does not match or has no macro.

    The name has to end as the target does behind the macro; before it, the target's other part may stand anywhere at the beginning of a component, its last place counts.
    """
    before, after = F.substring_index(target, MACRO, 1), F.substring_index(target, MACRO, -1)
    rest = F.substr(entry, F.lit(1), F.length(entry) - F.length(after))
    own = F.when(before == "", rest).when(F.contains(F.concat(F.lit(","), rest), F.concat(F.lit(","), before)), F.call_function("substring_index", F.concat(F.lit(","), rest), F.concat(F.lit(","), before), F.lit(-1)))
    return F.when(F.contains(target, F.lit(MACRO)) & F.endswith(entry, after) & (own != ""), own)


def filled(value: Column, dn: Column) -> Column:
    """The names that a value with macros stands for: `($dn)` is all that the target captured, `[$dn]` that and each of its ends. Without a capture, a value with macros stands for none."""
    parts = F.split(dn, ",")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ","))
    many = F.transform(F.coalesce(ends, F.array().cast("array<string>")), lambda e: F.replace(value, F.lit("[$dn]"), e))
    one = F.when(dn.isNotNull(), F.array(F.replace(value, F.lit(MACRO), dn))).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(value, F.lit("[$dn]")), many).when(F.contains(value, F.lit(MACRO)), one).otherwise(F.array(value))


def key_of(name: Column) -> Column:
    """The form in which names are compared: normal form in lower case, or the text in lower case where it is no name."""
    return F.lower(F.coalesce(norm_dn(name), name))


def pattern_of(target: Column) -> Column:
    """A target in the form of `key_of`, with the components that are macros or wildcards kept in their place; null for a null."""
    parts = F.transform(split_dn(target), lambda p: F.when(F.contains(p, F.lit("=")), F.coalesce(norm_dn(p), p)).otherwise(p))
    return F.lower(F.array_join(parts, ","))


def expanded(steps: Column, dn: Column) -> Column:
    """Steps with the macros of their alternatives filled in."""
    return F.transform(steps, lambda s: F.struct(s["op"].alias("op"), s["key"].alias("key"), s["negated"].alias("negated"), F.flatten(F.transform(s["values"], lambda v: filled(v, dn))).alias("values")))


