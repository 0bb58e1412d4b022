"""LDIF as a Spark data source: `spark.read.format("ldif")` and `df.write.format("ldif")`.

Files of any size are read by byte ranges. A range owns the records behind the empty lines that end inside it, so it looks for its first
empty line and reads past its end to the next one: every byte is read once, whichever line end a file has, and no record is cut or read twice.
Tasks write to a folder of their job; commit moves what successful tasks report, abort removes the folder.
"""

from __future__ import annotations

import codecs
import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from dirlake.functions import records as R
from dirlake.functions import text as T
from dirlake.model import ATTRS, CONTROLS, OPS

#: Bytes of a range, and of one read.
RANGE, CHUNK = 32 << 20, 4 << 20
#: Records that are parsed at a time.
BATCH = 4096
SCHEMA = f"struct<source: string, record_no: bigint, {R.ENTRY.removeprefix('struct<')}"
#: What a writer takes, by name; other columns are not written.
WRITTEN = {"dn": "string", "changetype": "string", "attrs": ATTRS, "newrdn": "string", "newsuperior": "string", "deleteoldrdn": "boolean", "controls": CONTROLS, "change_ops": OPS, "comments": "array<string>"}
_EMPTY_LINE = re.compile(rb"\n(?=(\r?\n))")
_BLANK_LINES = re.compile(rb"(?:[ \t\r]*\n)+")
_WILD = re.compile(r"[*?\[]")


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    if not getattr(spark, "_dirlake_ldif", False):
        spark.dataSource.register(LdifSource)
        spark._dirlake_ldif = True


def place(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before such a path in a name). The path of a local file is taken as it is, blanks and percent signs too."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if not scheme or scheme[1] == "file":
        return pafs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:(//(?=/))?", "", path)), "file://"
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else f"{scheme[1]}://"


def reaches(path: str) -> bool:
    """Whether this source knows the path's kind of store; others can only be read by Spark's own readers."""
    try:
        place(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _hidden(path: str, top: str) -> bool:
    return any(part[:1] in ("_", ".") for part in path[len(top) :].split("/"))


def files(system: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """A file itself, all files below a folder but hidden ones, or those that a pattern matches part by part. A name that is there is no pattern."""
    found = system.get_file_info(path)
    if found.type == pafs.FileType.File:
        return [found]
    if found.type == pafs.FileType.Directory:
        below = system.get_file_info(pafs.FileSelector(path, recursive=True))
        return sorted((x for x in below if x.type == pafs.FileType.File and not _hidden(x.path, path)), key=lambda x: x.path)
    head, *rest = path.split("/")
    tops = [head]
    for k, part in enumerate(rest):
        if not _WILD.search(part):
            tops = [f"{t}/{part}" for t in tops]
            continue
        inside = [x for t in tops for x in system.get_file_info(pafs.FileSelector(t or "/", allow_not_found=True)) if fnmatch.fnmatchcase(x.base_name, part)]
        tops = [x.path for x in inside if k == len(rest) - 1 or x.type == pafs.FileType.Directory]
    if tops == [path]:
        raise FileNotFoundError(path)
    return [f for x in system.get_file_info(sorted(tops)) if x.type != pafs.FileType.NotFound for f in files(system, x.path)]


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _splits(encoding: str) -> bool:
    """Whether a line end is one byte of its own in this encoding, so that a file may be read from its middle."""
    return "\n".encode(encoding) == b"\n"


class _Utf8:
    """A stream of another encoding as UTF-8 bytes."""

    def __init__(self, stream, encoding: str) -> None:  # noqa: ANN001
        self.stream, self.decoder = stream, codecs.getincrementaldecoder(encoding)("replace")

    def read(self, n: int) -> bytes:
        while raw := self.stream.read(n):
            if got := self.decoder.decode(raw):
                return got.encode()
        return self.decoder.decode(b"", True).encode()


def blocks(stream, start: int, end: int, first: bytes = b"") -> Iterator[tuple[int, bytes]]:  # noqa: ANN001
    """(offset, bytes) of each record that the range from `start` to `end` owns. The stream stands at `start`; `first` is what stands right before it, two bytes at most."""
    data, base, last, scan = first, start - len(first), 0 if start == 0 else -1, 0
    more = True
    while more:
        chunk = stream.read(CHUNK)
        more = bool(chunk)
        data += chunk
        for m in _EMPTY_LINE.finditer(data, scan):
            closes = base + m.end(1)
            if closes <= start:
                continue
            if last >= 0 and m.start() > last:
                yield _begun(base + last, data[last : m.start()])
            if closes > end:
                return
            last = m.end(1)
        # what may be the beginning of an empty line is looked at again, the line end right before the open record too
        scan, least = len(data), max(last - 1, 0)
        while scan > least and data[scan - 1 : scan] in (b"\n", b"\r"):
            scan -= 1
        cut = least if last >= 0 else scan
        data, base, scan, last = data[cut:], base + cut, scan - cut, last - cut if last >= 0 else -1
    if last >= 0 and data[last:].strip():
        yield _begun(base + last, data[last:])


def _begun(at: int, raw: bytes) -> tuple[int, bytes]:
    """A record without the lines of blanks before it."""
    blank = _BLANK_LINES.match(raw)
    return (at + blank.end(), raw[blank.end() :]) if blank else (at, raw)


def entries(found: list[tuple[int, bytes]], source: str, encoding: str) -> pa.RecordBatch | None:
    """Parsed records, those left out that hold nothing but blanks or a version line."""
    texts = pa.array([raw.decode(encoding, "replace") for _, raw in found], pa.string())
    texts = pc.replace_substring_regex(pc.replace_substring(texts, "\r\n", "\n"), r"\n[ \t]", "")
    texts = pc.utf8_trim(pc.replace_substring_regex(texts, r"(?i)^version:[^\n]*(?:\n+|$)", ""), "\r\n")
    full = pc.not_equal(pc.utf8_trim_whitespace(texts), "")
    texts, at = texts.filter(full), pa.array([k for k, _ in found], pa.int64()).filter(full)
    if not len(texts):
        return None
    parsed = R._entries(texts)
    return pa.record_batch([pa.array([source] * len(texts), pa.string()), at, *parsed.flatten()], names=["source", "record_no", *(f.name for f in parsed.type)])


class LdifReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.encoding, self.range = options["path"], options.get("encoding", "UTF-8"), int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        out = []
        system, inner, _ = place(self.path)
        found = files(system, inner)
        if not found:
            raise FileNotFoundError(self.path)
        for f in found:
            whole = _compressed(f.path) or not _splits(self.encoding)
            step = max(1, f.size if whole else self.range)
            out += [Range(f.path, lo, 1 << 62 if whole else lo + step) for lo in range(0, max(1, f.size), step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _, before = place(self.path)
        source = before + partition.path
        encoding = self.encoding
        if _compressed(partition.path) or not _splits(encoding):
            stream = system.open_input_stream(partition.path, compression="detect")
            if not _splits(encoding):
                stream, encoding = _Utf8(stream, encoding), "UTF-8"
            own = blocks(stream, 0, partition.end)
        else:
            stream = system.open_input_file(partition.path)
            back = min(2, partition.start)
            stream.seek(partition.start - back)
            own = blocks(stream, partition.start, partition.end, stream.read(back) if back else b"")
        held: list[tuple[int, bytes]] = []
        for at, raw in own:
            held.append((at, raw.removeprefix(codecs.BOM_UTF8) if at == 0 else raw))
            if len(held) == BATCH:
                if (batch := entries(held, source, encoding)) is not None:
                    yield batch
                held = []
        if held and (batch := entries(held, source, encoding)) is not None:
            yield batch


def _compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst", ".lz4"))


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: the file in its job's folder, and how much."""

    file: str | None
    entries: int
    bytes: int


class LdifWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.width, self.overwrite = options["path"], int(options.get("width", T.WIDTH)), overwrite
        flag = lambda name: options.get(name, "false").lower() == "true"
        self.end, self.version, self.comments = b"\r\n" if flag("crlf") else b"\n", flag("version"), flag("comments")
        for f in schema.fields:
            kind = WRITTEN.get(f.name)
            if kind is not None and f.dataType.simpleString() != kind.replace(" ", ""):
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()}, but has to be {kind}")
        if "dn" not in schema.names:
            raise ValueError("there is no column dn")
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        system, top, _ = place(self.path)
        return system, top, f"{top}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, folder = self._folder()
        name, out, n, size = f"{folder}/part-{uuid.uuid4().hex}.ldif", None, 0, 0
        for batch in iterator:
            if not batch.num_rows:
                continue
            fields = {c: batch.column(c) if c in batch.schema.names and (c != "comments" or self.comments) else None for c in WRITTEN}
            raw = "".join(x + "\n\n" for x in R.texts(fields, batch.num_rows, self.width).to_pylist()).encode()
            if out is None:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(name)
                raw = b"version: 1\n\n" + raw if self.version else raw
            raw = raw.replace(b"\n", self.end) if self.end != b"\n" else raw
            out.write(raw)
            n, size = n + batch.num_rows, size + len(raw)
        if out is not None:
            out.close()
        return Written(name if out is not None else None, n, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, top, folder = self._folder()
        system.create_dir(top, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(top)):
                if f.path != folder and f.type == pafs.FileType.File:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.file is not None:
                system.move(m.file, f"{top}/{m.file.rpartition('/')[2]}")
        self._drop(system, folder)
        system.open_output_stream(f"{top}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        system, _, folder = self._folder()
        self._drop(system, folder)

    def _drop(self, system: pafs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type == pafs.FileType.Directory:
            system.delete_dir(folder)


class LdifSource(DataSource):
    """`spark.read.format("ldif").load(path)`: the entries of a file, folder or pattern; `spark.read.format("ldif")` needs `register` first.

    Columns are `source`, `record_no` (the byte where the record begins, in order within a file) and those of `dirlake.sources.ldif.parse`.
    Options: `encoding`; `rangebytes`, the bytes of a range. A file in an encoding whose line end is more than a byte, and a compressed one, is one range.

    `df.write.format("ldif").mode("append" or "overwrite").save(path)` writes entries. Options: `width` of a line, `crlf`, `version` and `comments` (true or false).
    """

    @classmethod
    def name(cls) -> str:
        return "ldif"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LdifReader:
        return LdifReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> LdifWriter:
        return LdifWriter(self.options, schema, overwrite)
