"""LDIF records cut into entries, and entries written as records: whole Arrow columns at a time.

All lines of a batch are one flat array; what a line is comes from vectorised kernels, and offsets put the pieces back into their
records. Python loops only over what is rare: encoded values, controls, and lines that are too long.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from dirlake.functions import text as T
from dirlake.functions.dn import COMPONENT
from dirlake.model import ATTRS, CONTROLS, OPS

#: Fixed values.
CHANGES = ("add", "delete", "modify", "moddn", "modrdn")
VERBS = ("add", "delete", "replace", "increment")
RENAME = ("newrdn", "deleteoldrdn", "newsuperior")
_BLANKS = " \t\n\r\x0b\x0c"
#: A name without escapes whose components are all `type=value`.
_PLAIN = r"^[ \t\n\r\x0b\x0c]*[a-zA-Z][a-zA-Z0-9-]*=[^,\\]*(?:,[ \t\n\r\x0b\x0c]*[a-zA-Z][a-zA-Z0-9-]*=[^,\\]*)*\z"
_PART, _SHAPE = re.compile(r"(?:\\.|[^,\\]|\\$)+", re.S), re.compile(COMPONENT, re.S)

ENTRY = f"struct<dn: string, changetype: string, record_kind: string, attrs: {ATTRS}, newrdn: string, newsuperior: string, deleteoldrdn: boolean, controls: {CONTROLS}, change_ops: {OPS}, comments: array<string>, error: string>"
_VALUE = pa.struct([("value", pa.string()), ("origin", pa.string()), ("raw", pa.string())])


def cut(record: Column) -> Column:
    """The entry of each unfolded record as a struct; see `dirlake.sources.ldif.parse`."""

    @F.arrow_udf(ENTRY)
    def entries(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _entries(texts)

    # what follows would otherwise be pushed below it and cut each record again
    return entries.asNondeterministic()(record)


def _decoded(payload: str) -> str:
    try:
        return base64.b64decode(payload, validate=True).decode("utf-8", "replace")
    except ValueError:
        return payload


def dn_error(dn: str | None) -> str | None:
    """What is wrong with an entry's name: none, or a component that is not `type=value`."""
    if not dn:
        return "no dn"
    parts = filter(None, (p.strip(_BLANKS) for p in _PART.findall(dn)))
    return None if all(map(_SHAPE.match, parts)) else f"invalid dn: {dn}"


def _dn_errors(dn: pa.Array) -> pa.Array:
    """`dn_error` of each name, one by one only for those that are not plain."""
    out = np.full(len(dn), None, object)
    odd = np.flatnonzero(~pc.fill_null(pc.match_substring_regex(dn, _PLAIN), False).to_numpy(zero_copy_only=False))
    out[odd] = [dn_error(x) for x in dn.take(pa.array(odd)).to_pylist()]
    return pa.array(out, pa.string())


class _Items:
    """The `name: value` lines of a batch of records, in order: rec, line (their places), name, low, value, whole (untrimmed), origin, raw."""

    def __init__(self, flat: pa.Array, rec: np.ndarray, at: np.ndarray) -> None:
        self.rec, self.line = rec[at], at
        halves = pc.split_pattern(flat.take(pa.array(at)), ":", max_splits=1).flatten()
        even = pa.array(np.arange(0, len(halves), 2))
        self.name = pc.utf8_trim(halves.take(even), _BLANKS)
        self.low = pc.utf8_lower(self.name).to_numpy(zero_copy_only=False)
        rest = pc.utf8_ltrim(halves.take(pa.array(np.arange(1, len(halves), 2))), _BLANKS)
        mark = pc.utf8_slice_codeunits(rest, 0, 1).to_numpy(zero_copy_only=False)
        payload = pc.utf8_trim(pc.utf8_slice_codeunits(rest, 1), _BLANKS)
        coded, linked = mark == ":", mark == "<"
        plain = pc.utf8_trim(rest, _BLANKS)
        whole = pc.if_else(pa.array(linked), payload, plain)
        where = np.flatnonzero(coded)
        if len(where):
            texts = [_decoded(p) for p in payload.take(pa.array(where)).to_pylist()]
            whole = pc.replace_with_mask(whole, pa.array(coded), pa.array(texts, pa.string()))
        self.whole = whole
        self.value = pc.utf8_trim(whole, _BLANKS)
        file = pc.starts_with(pc.utf8_lower(payload), "file://").to_numpy(zero_copy_only=False)
        self.origin = pa.array(np.array(["plain", "base64", "url", "file"], object)[np.where(coded, 1, np.where(linked, 2 + file, 0))], pa.string())
        self.raw = pc.if_else(pa.array(coded | linked), payload, pa.scalar(None, pa.string()))

    def last(self, name: str, n: int) -> np.ndarray:
        """For each record the place of its last item of that name, -1 without one."""
        out = np.full(n, -1)
        at = np.flatnonzero(self.low == name)
        np.maximum.at(out, self.rec[at], at)
        return out

    def values(self, at: np.ndarray, whole: bool = False) -> pa.Array:
        rows = pa.array(at)
        return pa.StructArray.from_arrays([(self.whole if whole else self.value).take(rows), self.origin.take(rows), self.raw.take(rows)], fields=list(_VALUE))


def _nested(owner: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """A list for each of `n` owners of the values that stand in their order."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _picked(values: pa.Array, at: np.ndarray) -> pa.Array:
    """The values at places, null for -1."""
    return values.take(pa.array(at, pa.int64(), mask=at < 0))


def _attributes(items: _Items, names: pa.Array, at: np.ndarray, n: int) -> pa.ListArray:
    """Attributes in written order, values of one spelling together; `names` are the items' names, `at` the items that are values."""
    coded = names.take(pa.array(at)).dictionary_encode()
    key = items.rec[at] * np.int64(max(1, len(coded.dictionary))) + coded.indices.to_numpy()
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.argsort(first)] = np.arange(len(first))
    group = place[group]
    order = np.argsort(group, kind="stable")
    heads = at[np.sort(first)]
    lists = _nested(group, len(first), items.values(at[order]))
    return _nested(items.rec[heads], n, pa.StructArray.from_arrays([names.take(pa.array(heads)), lists], ["name", "values"]))


def _control(text: str) -> dict:
    """`oid [criticality] [: value | :: base64 | :< url]`."""
    head, colon, tail = text.partition(":")
    kind, _, critical = head.strip(_BLANKS).partition(" ")
    out = {"control_type": kind, "criticality": critical.strip(_BLANKS).lower() == "true" if critical.strip(_BLANKS) else None, "value": None, "value_origin": None, "raw_value": None}
    if not colon:
        return out
    mark, payload = tail[:1], tail[1:].strip(_BLANKS)
    if mark == ":":
        return out | {"value": _decoded(payload), "value_origin": "base64", "raw_value": payload}
    if mark == "<":
        return out | {"value": payload, "value_origin": "file" if payload.lower().startswith("file://") else "url", "raw_value": payload}
    return out | {"value": tail.strip(_BLANKS), "value_origin": "plain"}


def _entries(texts: pa.Array) -> pa.Array:
    n = len(texts)
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    flat, rec = lines.flatten(), np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy())
    flat = pc.utf8_rtrim(flat, _BLANKS)
    remark = pc.starts_with(flat, "#").to_numpy(zero_copy_only=False)
    dash = pc.equal(flat, "-").to_numpy(zero_copy_only=False)
    items = _Items(flat, rec, np.flatnonzero((pc.find_substring(flat, ":").to_numpy() >= 0) & ~remark))
    dn = _picked(items.value, items.last("dn", n))
    kind = pc.utf8_lower(_picked(items.value, items.last("changetype", n)))
    kind = pc.if_else(pc.is_in(kind, pa.array(CHANGES)), kind, pa.scalar(None, pa.string()))
    modify = pc.fill_null(pc.equal(kind, "modify"), False).to_numpy(zero_copy_only=False)
    rename = pc.fill_null(pc.is_in(kind, pa.array(["moddn", "modrdn"])), False).to_numpy(zero_copy_only=False)

    own = ~np.isin(items.low, ("dn", "changetype", "control")) & ~(rename[items.rec] & np.isin(items.low, RENAME))
    opens = modify[items.rec] & np.isin(items.low, VERBS)
    # each line's open operation: the last one that opens at or before it in its record, unless a dash stands between
    ops = np.flatnonzero(opens)
    mark = np.full(len(flat), -1)
    mark[items.line[ops]] = np.arange(len(ops))
    since = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(flat)), -1)) if len(flat) else mark
    ended = np.maximum.accumulate(np.where(dash, np.arange(len(flat)), -1)) if len(flat) else mark
    at = since[items.line]
    inside = own & ~opens & (at >= 0) & (at > ended[items.line])
    inside &= rec[np.maximum(at, 0)] == items.rec
    part = np.where(inside, mark[np.maximum(at, 0)], -1)
    names = items.name
    if inside.any():
        # a value inside an operation is one of the operation's attribute, whatever its own name
        names = pc.if_else(pa.array(inside), items.value.take(pa.array(np.append(ops, 0)[part])), names)
    attrs = _attributes(items, names, np.flatnonzero(own & ~opens), n)
    held = np.flatnonzero(inside)
    values = _nested(part[held], len(ops), items.values(held, whole=True))
    verbs = pa.array(items.low[ops], pa.string())
    change_ops = _nested(items.rec[ops], n, pa.StructArray.from_arrays([verbs, items.value.take(pa.array(ops)), values], ["op", "attr", "values"]))

    where = np.flatnonzero(items.low == "control")
    full = pc.utf8_ltrim(pc.utf8_slice_codeunits(pc.utf8_ltrim(flat.take(pa.array(items.line[where])), _BLANKS), len("control")), _BLANKS + ":") if len(where) else pa.array([], pa.string())
    shape = pa.struct([("control_type", pa.string()), ("criticality", pa.bool_()), ("value", pa.string()), ("value_origin", pa.string()), ("raw_value", pa.string())])
    controls = _nested(items.rec[where], n, pa.array([_control(x) for x in full.to_pylist()], shape))
    notes = np.flatnonzero(remark)
    comments = _nested(rec[notes], n, pc.utf8_trim(pc.utf8_slice_codeunits(flat.take(pa.array(notes)), 1), _BLANKS))

    only = pa.array(rename)
    newrdn, superior = (pc.if_else(only, _picked(items.value, items.last(x, n)), pa.scalar(None, pa.string())) for x in ("newrdn", "newsuperior"))
    old = pc.is_in(pc.utf8_lower(_picked(items.value, items.last("deleteoldrdn", n))), pa.array(["1", "true", "yes"]))
    old = pc.if_else(pa.array(rename & (items.last("deleteoldrdn", n) >= 0)), old, pa.scalar(None, pa.bool_()))
    error = _dn_errors(dn)
    record_kind = pc.if_else(pc.is_null(kind), "content", "change")
    return pa.StructArray.from_arrays(
        [dn, kind, record_kind, attrs, newrdn, superior, old, controls, change_ops, comments, error],
        ["dn", "changetype", "record_kind", "attrs", "newrdn", "newsuperior", "deleteoldrdn", "controls", "change_ops", "comments", "error"],
    )


# --- writing -----------------------------------------------------------------------------------------------------------


def text_of(entry: Column, width: int) -> Column:
    """The LDIF text of each entry, a struct of the fields of ENTRY but `record_kind` and `error`; see `dirlake.sources.ldif.written`."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for entries in batches:
            yield _texts(entries, width)

    return texts.asNondeterministic()(entry)


_KINDS = {
    "attrs": pa.list_(pa.struct([("name", pa.string()), ("values", pa.list_(_VALUE))])),
    "controls": pa.list_(pa.struct([("control_type", pa.string()), ("criticality", pa.bool_()), ("value", pa.string()), ("value_origin", pa.string()), ("raw_value", pa.string())])),
    "change_ops": pa.list_(pa.struct([("op", pa.string()), ("attr", pa.string()), ("values", pa.list_(_VALUE))])),
    "comments": pa.list_(pa.string()), "deleteoldrdn": pa.bool_(),
}


def texts(fields: dict[str, pa.Array | None], n: int, width: int) -> pa.Array:
    """The LDIF texts of `n` entries given by their columns; one that is None counts as null everywhere."""
    own = {c: pa.nulls(n, _KINDS.get(c, pa.string())) if x is None else x for c, x in fields.items()}
    return _texts(pa.StructArray.from_arrays(list(own.values()), list(own)), width)


def _join(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "", null_handling="emit_null")


def _encoded(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else base64.b64encode(v.encode()).decode() for v in values.to_pylist()], pa.string())


def value_lines(names: pa.Array, values: pa.Array) -> pa.Array:
    """A line for each name and value struct. A base64, URL or file value with its raw payload is written with that; else text that is not safe, and any value of a binary attribute, is encoded."""
    value, origin, raw = (values.field(k) for k in range(3))
    value = pc.fill_null(value, "")
    kept = pc.is_valid(raw).to_numpy(zero_copy_only=False)
    origin = pc.fill_null(origin, "plain")
    coded = kept & pc.equal(origin, "base64").to_numpy(zero_copy_only=False)
    linked = pc.is_in(origin, pa.array(["url", "file"])).to_numpy(zero_copy_only=False)
    bare = pc.utf8_lower(pc.replace_substring_regex(names, ";.*$", ""))
    unsafe = pc.or_(pc.match_substring_regex(value, T.UNSAFE), pc.is_in(bare, pa.array(T.BINARY))).to_numpy(zero_copy_only=False)
    unsafe |= pc.equal(origin, "base64").to_numpy(zero_copy_only=False)
    unsafe &= ~coded & ~linked
    mark = pa.array(np.array([": ", ":: ", ":< "], object)[np.where(coded | unsafe, 1, np.where(linked, 2, 0))], pa.string())
    payload = pc.if_else(pa.array(coded | (linked & kept)), raw, value)
    where = np.flatnonzero(unsafe)
    if len(where):
        payload = pc.replace_with_mask(payload, pa.array(unsafe), _encoded(value.take(pa.array(where))))
    empty = pc.equal(payload, "")
    return _join(names, pc.if_else(empty, pc.utf8_rtrim(mark, " "), mark), payload)


def _dn_lines(name: str, dn: pa.Array) -> pa.Array:
    plain = pa.StructArray.from_arrays([dn, pa.array(["plain"] * len(dn), pa.string()), pa.nulls(len(dn), pa.string())], fields=list(_VALUE))
    return value_lines(pa.array([name] * len(dn), pa.string()), plain)


def _control_line(c: dict) -> str:
    out = f"control: {c['control_type']}" + ("" if c["criticality"] is None else f" {str(c['criticality']).lower()}")
    value, origin, raw = c["value"], c["value_origin"], c["raw_value"]
    if value is None:
        return out
    if origin == "base64" or (origin in (None, "plain") and T.is_unsafe(value)):
        return f"{out}:: {raw or base64.b64encode(value.encode()).decode()}"
    return f"{out}:{'< ' if origin in ('url', 'file') else ' '}{raw or value}"


def _owners(lists: pa.ListArray) -> np.ndarray:
    """The row of each of the values of a list column, by `flatten`."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())


class _Lines:
    """Lines gathered in any order, with their record and three ranks inside it."""

    def __init__(self) -> None:
        self.texts: list[pa.Array] = []
        self.ranks: list[np.ndarray] = []

    def add(self, rec: np.ndarray, section: int, texts: pa.Array, rank: np.ndarray | None = None, sub: int | np.ndarray = 0) -> None:
        rank = np.arange(len(rec)) if rank is None else rank
        self.texts.append(texts)
        self.ranks.append(np.column_stack([rec, np.full(len(rec), section), rank, np.broadcast_to(sub, len(rec)), np.arange(len(rec))]).astype(np.int64))

    def records(self, n: int, width: int) -> pa.Array:
        flat, ranks = pa.concat_arrays(self.texts), np.concatenate(self.ranks)
        order = np.lexsort(ranks.T[::-1])
        flat = _folded(flat.take(pa.array(order)), width)
        return pc.binary_join(_nested(ranks[order, 0], n, flat), "\n")


def _folded(lines: pa.Array, width: int) -> pa.Array:
    long = pc.greater(pc.binary_length(lines), width)
    whole = pc.match_substring_regex(lines, f"(?i)^(?:{'|'.join(T.UNFOLDED)}):")
    todo = pc.and_(long, pc.invert(whole))
    where = np.flatnonzero(todo.to_numpy(zero_copy_only=False))
    if not len(where):
        return lines
    return pc.replace_with_mask(lines, todo, pa.array([T.fold_text(x, width) for x in lines.take(pa.array(where)).to_pylist()], pa.string()))


def _texts(e: pa.StructArray, width: int) -> pa.Array:
    n = len(e)
    field = {f.name: e.field(k) for k, f in enumerate(e.type)}
    kind = field["changetype"]
    is_kind = lambda *names: pc.fill_null(pc.is_in(kind, pa.array(names)), False).to_numpy(zero_copy_only=False)
    out = _Lines()
    everyone = np.arange(n)
    comments = field["comments"]
    out.add(_owners(comments), 0, _join("# ", pc.fill_null(comments.flatten(), "")))
    out.add(everyone, 1, pc.fill_null(_dn_lines("dn", field["dn"]), "dn:"))
    controls = field["controls"]
    out.add(_owners(controls), 2, pa.array([_control_line(c) for c in controls.flatten().to_pylist()], pa.string()))
    changed = np.flatnonzero(pc.is_valid(kind).to_numpy(zero_copy_only=False))
    out.add(changed, 3, _join("changetype: ", kind.take(pa.array(changed))))

    attrs = field["attrs"]
    each = attrs.flatten()
    names, lists = each.field(0), each.field(1)
    row = _owners(attrs)
    at = _owners(lists)
    shown = ~is_kind("modify", "delete", "modrdn", "moddn")[row[at]]
    lines = value_lines(names.take(pa.array(at)), lists.flatten())
    out.add(row[at][shown], 4, lines.filter(pa.array(shown)), at[shown])

    ops = field["change_ops"]
    each = ops.flatten()
    verb, attr, values = (each.field(k) for k in range(3))
    row = _owners(ops)
    at = _owners(values)
    shown, inner = is_kind("modify")[row], is_kind("modify")[row[at]]
    place = np.arange(len(row))
    out.add(row[shown], 4, _join(verb, ": ", attr).filter(pa.array(shown)), place[shown], 0)
    out.add(row[at][inner], 4, value_lines(attr.take(pa.array(at)), values.flatten()).filter(pa.array(inner)), at[inner], 1)
    out.add(row[shown], 4, pa.array(["-"] * int(shown.sum()), pa.string()), place[shown], 2)

    moved = is_kind("modrdn", "moddn")
    for rank, (name, value) in enumerate((("newrdn", field["newrdn"]), ("deleteoldrdn", pc.if_else(field["deleteoldrdn"], "1", "0")), ("newsuperior", field["newsuperior"]))):
        have = np.flatnonzero(moved & pc.is_valid(value).to_numpy(zero_copy_only=False))
        out.add(have, 4, _dn_lines(name, value.take(pa.array(have))), np.full(len(have), rank))
    return out.records(n, width)
