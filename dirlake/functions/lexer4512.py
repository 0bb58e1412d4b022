"""Schema definitions with the place of each field, so that one field can change while every other byte stays.

A scanner goes over the bytes of a whole Arrow column at once: which bytes stand in quotes, which are blanks, brackets, dollar signs or words follows from
running sums, and tokens are where that changes. Fields, values and places come out as arrays; reading, writing and splicing are column expressions over them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keywords of attribute types and object classes in their written order, and those that have no value.
ORDER = ("NAME", "DESC", "OBSOLETE", "SUP", "EQUALITY", "ORDERING", "SUBSTR", "SYNTAX", "SINGLE-VALUE", "COLLECTIVE", "NO-USER-MODIFICATION", "USAGE", "ABSTRACT", "STRUCTURAL", "AUXILIARY", "MUST", "MAY")
FLAGS = ("OBSOLETE", "SINGLE-VALUE", "COLLECTIVE", "NO-USER-MODIFICATION", "ABSTRACT", "STRUCTURAL", "AUXILIARY")
KINDS = ("ABSTRACT", "STRUCTURAL", "AUXILIARY")

LEXED = "struct<head: string, oid: string, fields: array<struct<name: string, values: array<string>, first: int, last: int>>, words: array<string>, error: string>"
_BLANK, _WORD, _QUOTED, _OPEN, _CLOSE, _DOLLAR = range(6)
_CLASS = np.full(256, _WORD, np.int8)
_CLASS[list(b" \t\n\r\x0b\x0c")] = _BLANK
_CLASS[list(b"()$")] = (_OPEN, _CLOSE, _DOLLAR)


def lex(definition: Column) -> Column:
    """LEXED of each definition; null for a null.

    `head` is what stands before the bracket, `oid` the first word in it that is no keyword, `words` all words outside quotes. A field is a keyword outside inner brackets and what
    follows it up to the next one: its name in capitals, its values without quotes, brackets and dollar signs, and the places of its first character and of the one behind its last,
    counted from 0. A quote behind a backslash does not close; \\27 and \\5C stand for a quote and a backslash. Text without brackets is read as if it had them. `error` tells of quotes and brackets that are not closed.
    """

    @F.arrow_udf(LEXED)
    def lexed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _lexed(texts)

    return lexed.asNondeterministic()(definition)


def _slices(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The bytes between places as strings."""
    size = hi - lo
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)
    return pa.StringArray.from_buffers(len(lo), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[at].tobytes()))


def _running(x: np.ndarray, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at each text; `starts` are places in x, `of` the text of each place."""
    sums = np.cumsum(x)
    before = np.concatenate([[0], sums])[starts]
    return sums - before[of]


def _nested(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32()), values)


def _lexed(texts: pa.Array) -> pa.Array:
    n = len(texts)
    plain = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = plain.buffers()
    ends = np.frombuffer(offsets, np.int32)[plain.offset : plain.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    doc = np.repeat(np.arange(n), np.diff(ends))
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    first = first[:-1]
    slash = np.concatenate([[False], raw[:-1] == 92])[: len(raw)] & ~first
    quote = (raw == 39) & ~slash
    odd = _running(quote, ends[:-1], doc) % 2 == 1
    opens = quote & odd
    kind = np.where(odd | quote, _QUOTED, _CLASS[raw])
    # a token begins where the class changes, at each bracket and dollar sign, and at each quote that opens
    begins = first | opens | (kind >= _OPEN)
    begins[1:] |= kind[1:] != kind[:-1]
    lo = np.flatnonzero(begins)
    hi = np.append(lo[1:], len(raw))
    lo, hi = lo[kind[lo] != _BLANK], hi[kind[lo] != _BLANK]
    what, of = kind[lo], doc[lo]
    heads = np.searchsorted(of, np.arange(n))
    depth = _running((what == _OPEN).astype(np.int64) - (what == _CLOSE), heads, of)
    bracketed = np.bincount(of[what == _OPEN], minlength=n) > 0
    base = bracketed[of].astype(np.int64)
    # words at the level of the fields, and whether the definition's own bracket has been closed before them
    level = (depth == base) & ((what == _WORD) | (what == _QUOTED))
    shut = _running((what == _CLOSE) & (depth <= base - 1), heads, of) > 0
    level &= ~shut
    words = _slices(raw, lo, hi)
    upper = pc.utf8_upper(words)
    known = pc.or_(pc.is_in(upper, pa.array(ORDER)), pc.starts_with(upper, "X-")).to_numpy(zero_copy_only=False).astype(bool)
    key = level & known & (what == _WORD)
    # a word in small letters right behind a keyword that has a value is that value: `SUP name`
    small = pc.not_equal(upper, words).to_numpy(zero_copy_only=False).astype(bool)
    valued = pc.invert(pc.is_in(upper, pa.array(FLAGS))).to_numpy(zero_copy_only=False).astype(bool)
    for k in np.flatnonzero(key & small):
        if k and of[k - 1] == of[k] and key[k - 1] and valued[k - 1]:
            key[k] = False

    # the OID: the first word of the level, unless it is a keyword
    rank = _running(level.astype(np.int64), heads, of)
    oid_at = np.full(n, -1)
    own = np.flatnonzero(level & (rank == 1) & ~key)
    oid_at[of[own]] = own
    # fields: everything from a keyword to the next one
    field = np.cumsum(key) - 1
    inside = (_running(key.astype(np.int64), heads, of) > 0) & ~shut & ((depth > base) | ((depth == base) & (what != _OPEN)) | (what == _CLOSE) & (depth == base))
    keys = np.flatnonzero(key)
    last = hi[keys].copy()
    np.maximum.at(last, field[inside], hi[inside])
    value = np.flatnonzero(inside & ~key & ((what == _WORD) | (what == _QUOTED)))
    closed = (what[value] == _QUOTED) & quote[hi[value] - 1] & (hi[value] - lo[value] > 1)
    quoted = what[value] == _QUOTED
    values = _slices(raw, lo[value] + quoted, hi[value] - closed)
    values = pc.if_else(pa.array(quoted), pc.replace_substring_regex(pc.replace_substring(pc.replace_substring(values, "\\27", "'"), "\\'", "'"), r"\\5[cC]", r"\\"), values)
    # places in characters
    char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    place = lambda x, row: pa.array((char[x] - char[ends[row]]).astype(np.int32))
    fields = pa.StructArray.from_arrays([upper.take(pa.array(keys)), _nested(field[value], len(keys), values), place(lo[keys], of[keys]), place(last, of[keys])], ["name", "values", "first", "last"])

    opening = np.full(n, -1)
    at = np.flatnonzero(what == _OPEN)[::-1]
    opening[of[at]] = lo[at]
    head = _slices(raw, ends[:-1], np.where(opening >= 0, opening, ends[:-1]))
    oid = words.take(pa.array(oid_at, mask=oid_at < 0))
    bare = np.flatnonzero(what == _WORD)
    left = np.zeros(n, np.int64)
    np.add.at(left, of, (what == _OPEN).astype(np.int64) - (what == _CLOSE))
    open_quote = np.bincount(doc[quote], minlength=n) % 2 == 1
    error = pa.array(np.where(open_quote, "open quote", np.where(left > 0, "open bracket", np.where(left < 0, "bracket without opening", None))), pa.string())
    return pa.StructArray.from_arrays([head, oid, _nested(of[keys], n, fields), _nested(of[bare], n, words.take(pa.array(bare))), error], ["head", "oid", "fields", "words", "error"], mask=pc.is_null(texts))


# --- reading and writing -------------------------------------------------------------------------------------------------


def _values(lexed: Column, name: str) -> Column:
    return F.get(F.filter(lexed["fields"], lambda f: f["name"] == name), F.lit(0))["values"]


def parsed(lexed: Column) -> Column:
    """All fields of a lexed definition: (oid, names, desc, obsolete, sup, equality, ordering, substr, syntax, length, single_value, collective, no_user_modification, usage, kind, must, may, extensions). Lists that are not there are empty, other fields null, flags false."""
    some = lambda name: F.coalesce(_values(lexed, name), F.array().cast("array<string>"))
    one = lambda name: F.get(_values(lexed, name), F.lit(0))
    flag = lambda name: F.exists(lexed["fields"], lambda f: f["name"] == name)
    kind = F.get(F.filter(F.transform(lexed["fields"], lambda f: f["name"]), lambda x: x.isin(*KINDS)), F.lit(0))
    more = F.transform(F.filter(lexed["fields"], lambda f: F.startswith(f["name"], F.lit("X-"))), lambda f: F.struct(f["name"].alias("name"), f["values"].alias("values")))
    syntax = F.regexp_replace(one("SYNTAX"), r"^'|'$", "")
    return F.struct(
        lexed["oid"].alias("oid"), some("NAME").alias("names"), one("DESC").alias("desc"), flag("OBSOLETE").alias("obsolete"), some("SUP").alias("sup"), one("EQUALITY").alias("equality"), one("ORDERING").alias("ordering"), one("SUBSTR").alias("substr"),
        F.substring_index(syntax, "{", 1).alias("syntax"), F.regexp_extract(syntax, r"\{(\d+)\}", 1).try_cast("int").alias("length"), flag("SINGLE-VALUE").alias("single_value"), flag("COLLECTIVE").alias("collective"),
        flag("NO-USER-MODIFICATION").alias("no_user_modification"), one("USAGE").alias("usage"), kind.alias("kind"), some("MUST").alias("must"), some("MAY").alias("may"), more.alias("extensions"),
    )


def quoted(value: Column) -> Column:
    """A value in quotes, its own quotes and backslashes escaped."""
    return F.concat(F.lit("'"), F.replace(F.replace(value, F.lit("\\"), F.lit("\\5C")), F.lit("'"), F.lit("\\27")), F.lit("'"))


def field_texts(p: Column, length: bool = True) -> list[tuple[str, Column]]:
    """(keyword, text) of each field of a parsed definition in the written order, a null where it has none; extensions stand under `X-`, all in one text."""
    listed = lambda word, c, sep, q: F.when(F.size(c) == 1, F.concat(F.lit(word + " "), q(c[0]))).when(F.size(c) > 1, F.concat(F.lit(word + " ( "), F.array_join(F.transform(c, q), sep), F.lit(" )")))
    word = lambda name, c: F.concat(F.lit(name + " "), c)
    flag = lambda name, c: F.when(c, F.lit(name))
    same = lambda c: c
    syntax = F.concat(p["syntax"], F.coalesce(F.concat(F.lit("{"), p["length"].cast("string"), F.lit("}")), F.lit(""))) if length else p["syntax"]
    more = F.transform(p["extensions"], lambda x: F.concat(x["name"], F.when(F.size(x["values"]) > 1, F.concat(F.lit(" ( "), F.array_join(F.transform(x["values"], quoted), " "), F.lit(" )"))).when(F.size(x["values"]) == 1, F.concat(F.lit(" "), quoted(x["values"][0]))).otherwise("")))
    return [
        ("NAME", listed("NAME", p["names"], " ", quoted)), ("DESC", word("DESC", quoted(p["desc"]))), ("OBSOLETE", flag("OBSOLETE", p["obsolete"])), ("SUP", listed("SUP", p["sup"], " $ ", same)),
        ("EQUALITY", word("EQUALITY", p["equality"])), ("ORDERING", word("ORDERING", p["ordering"])), ("SUBSTR", word("SUBSTR", p["substr"])), ("SYNTAX", word("SYNTAX", syntax)),
        ("SINGLE-VALUE", flag("SINGLE-VALUE", p["single_value"])), ("COLLECTIVE", flag("COLLECTIVE", p["collective"])), ("NO-USER-MODIFICATION", flag("NO-USER-MODIFICATION", p["no_user_modification"])), ("USAGE", word("USAGE", p["usage"])),
        ("KIND", p["kind"]), ("MUST", listed("MUST", p["must"], " $ ", same)), ("MAY", listed("MAY", p["may"], " $ ", same)), ("X-", F.when(F.size(more) > 0, F.array_join(more, " "))),
    ]


def write(p: Column) -> Column:
    """The text of a parsed definition with all its fields."""
    return F.concat(F.lit("( "), F.concat_ws(" ", p["oid"], *(t for _, t in field_texts(p))), F.lit(" )"))


# --- splicing ------------------------------------------------------------------------------------------------------------


def splice(definition: Column, lexed: Column, changes: Column) -> Column:
    """The definition with some fields changed and every other character as it was.

    `changes` is an array of (name, text): the whole new text of a field, null to remove it and the blanks before it. A field that is not there is put behind the
    last one that comes before it in the usual order, or else behind the OID or opening bracket. Of changes that repeat a name, the first counts; a definition without changes is itself.
    """
    known = F.transform(lexed["fields"], lambda f: f["name"])
    where = lambda name: F.when(F.startswith(name, F.lit("X-")), len(ORDER) + 1).otherwise(F.array_position(F.array(*map(F.lit, ORDER)), name))
    change_of = lambda name: F.get(F.filter(changes, lambda c: c["name"] == name), F.lit(0))
    bare = F.array_max(F.array(F.length(lexed["head"]) + F.when(F.contains(definition, F.lit("(")), 1).otherwise(0), _behind_oid(definition, lexed)))
    new = F.filter(changes, lambda c: c["text"].isNotNull() & ~F.array_contains(known, c["name"]))
    new = F.array_sort(F.transform(new, lambda c: F.struct(where(c["name"]).alias("order"), c["name"].alias("name"), c["text"].alias("text"))))
    # pieces to put in: (first, last, order, text), those that are replaced and those that are new
    put = F.filter(F.transform(lexed["fields"], lambda f: F.struct(f["first"].alias("first"), f["last"].alias("last"), F.lit(0).alias("order"), F.struct(F.size(F.filter(changes, lambda c: c["name"] == f["name"])).alias("n"), change_of(f["name"])["text"].alias("text")).alias("c"))), lambda x: x["c"]["n"] > 0)
    put = F.transform(put, lambda x: F.struct(F.when(x["c"]["text"].isNull(), F.length(F.rtrim(F.substr(definition, F.lit(1), x["first"])))).otherwise(x["first"]).alias("first"), x["last"].alias("last"), x["order"].alias("order"), F.coalesce(x["c"]["text"], F.lit("")).alias("text")))
    after = lambda order: F.coalesce(F.array_max(F.transform(F.filter(lexed["fields"], lambda f: where(f["name"]) < order), lambda f: f["last"])), bare)
    put = F.concat(put, F.transform(new, lambda c: F.struct(after(c["order"]).alias("first"), after(c["order"]).alias("last"), c["order"].cast("int").alias("order"), F.concat(F.lit(" "), c["text"]).alias("text"))))
    put = F.array_sort(put)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))
    done = F.aggregate(put, begin, lambda acc, x: F.struct(x["last"].alias("at"), F.concat(acc["text"], F.substr(definition, acc["at"] + 1, x["first"] - acc["at"]), x["text"]).alias("text")))
    return F.when(F.size(put) == 0, definition).otherwise(F.concat(done["text"], F.substr(definition, done["at"] + 1)))


def _behind_oid(definition: Column, lexed: Column) -> Column:
    """The place behind the OID, which is the first text in the bracket; null without one."""
    rest = F.substr(definition, F.length(lexed["head"]) + 2)
    return F.when(lexed["oid"].isNotNull(), F.length(lexed["head"]) + 1 + F.length(rest) - F.length(F.ltrim(rest)) + F.length(lexed["oid"]))


def differences(new: Column, old: Column) -> Column:
    """The changes that make the fields of one lexed definition those of another, for `splice`: fields count by their values, however they are written. `new` is (definition, lexed)."""
    text, lexed = new["definition"], new["lexed"]
    was = lambda name: F.get(F.filter(old["fields"], lambda f: f["name"] == name), F.lit(0))
    changed = F.filter(lexed["fields"], lambda f: ~F.coalesce(was(f["name"])["values"] == f["values"], F.lit(False)))
    put = F.transform(changed, lambda f: F.struct(f["name"].alias("name"), F.substr(text, f["first"] + 1, f["last"] - f["first"]).alias("text")))
    names = F.transform(lexed["fields"], lambda f: f["name"])
    gone = F.transform(F.filter(old["fields"], lambda f: ~F.array_contains(names, f["name"])), lambda f: F.struct(f["name"].alias("name"), F.lit(None).cast("string").alias("text")))
    return F.concat(put, gone)


def with_changes(definition: Column, changes: Sequence[tuple[str, Column]]) -> Column:
    """A definition with the texts of some fields, by keyword: `("DESC", F.lit("DESC 'new'"))`; a null text removes the field."""
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), text.cast("string").alias("text")) for name, text in changes))
    own = F.struct(definition.alias("text"), lex(definition).alias("lexed"))
    # once for each row, whatever refers to it
    return F.get(F.transform(F.array(own), lambda x: splice(x["text"], x["lexed"], pairs)), F.lit(0))
