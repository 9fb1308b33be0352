"""FASTA and FASTQ as a Spark data source: ``spark.read.format("sequences").load(path)`` and ``df.write.format("sequences").save(path)``.

Reading: a file is cut into byte ranges of ``split_bytes``, each a task. A record belongs to the range that
holds the line end before it (the first one to the first range), so a range finds its records without
looking back, and reads beyond its end only to finish its last one. Files of gzip blocks (BGZF: members that
state their own size) are cut the same way between blocks; other gzip files have no place to start at and are
one task. A range is read in pieces; the memory of a task is that of a batch and of its longest record.

Rows are (file, part, at, header, seq, qual): part is the first byte of the range in the file, at the place of the record
in the range's uncompressed bytes, so (file, part, at) is the order of the file. qual is null in FASTA. FASTA
records are joined over their lines; FASTQ records have four lines. CR before a line end is no part of a line, blank
lines between records are skipped, a last FASTQ record without a quality line has a null one, one without a sequence
is none. Text before the first FASTA record is skipped; a FASTQ record that does not begin with ``@`` is an error. Empty
files and folders give no rows. A folder's files whose names begin with ``_`` or ``.`` are not read.

Writing: rows need header and seq, and for FASTQ qual; nulls are empty, other columns are left. Each task writes under ``_temporary``, and its file moves to the
folder when all have ended, in the order of the partitions; what a lost task or a repeated attempt has left goes with
``_temporary``, so no record is there twice.

Options: path; format (``fasta`` or ``fastq``; unless given, what a file begins with; fasta in writing); split_bytes (64 MB).
Paths are local or what ``pyarrow.fs`` opens by address.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandloom.runtime import ship_package

NAME = "sequences"
SCHEMA = "file string, part long, at long, header string, seq string, qual string"
SPLIT_BYTES = 64 << 20
_READ = 1 << 20
_BATCH_ROWS, _BATCH_BYTES = 8192, 8 << 20
#: The largest block of a file of gzip blocks (its size is stated in 16 bits).
_BLOCK = 1 << 16


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


def _block_size(head: bytes) -> int | None:
    """Bytes of the gzip block that ``head`` begins with, if it states them."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


@dataclass
class Range(InputPartition):
    """Bytes start to end of a file; ``packing`` is plain, blocks or gzip."""

    file: str
    start: int
    end: int
    packing: str


class _Bytes:
    """Uncompressed bytes of a range and what follows it. ``limit`` is the place where the range ends, once that is known."""

    def __init__(self, part: Range):
        self.part, self.limit = part, float("inf")
        self._fs, self._path = _open(part.file)

    def chunks(self) -> Iterator[bytes]:
        with self._fs.open_input_file(self._path) as f:
            yield from getattr(self, f"_{self.part.packing}")(f)

    def _plain(self, f) -> Iterator[bytes]:
        self.limit = self.part.end - self.part.start
        f.seek(self.part.start)
        while chunk := f.read(_READ):
            yield chunk

    def _gzip(self, f) -> Iterator[bytes]:
        unpack = zlib.decompressobj(31)
        while chunk := f.read(_READ):
            while chunk:
                yield unpack.decompress(chunk)
                chunk = unpack.unused_data
                if chunk:
                    unpack = zlib.decompressobj(31)
        if not unpack.eof and self.part.end:
            raise ValueError(f"{self.part.file} ends inside of a gzip member")

    def _blocks(self, f) -> Iterator[bytes]:
        at, done = self._first_block(f), 0
        while True:
            if at >= self.part.end:
                self.limit = min(self.limit, done)
                if not done:
                    return
            f.seek(at)
            head = f.read(_BLOCK)
            if not head:
                return
            size = _block_size(head)
            if size is None or size > len(head):
                raise ValueError(f"{self.part.file} has no whole gzip block at byte {at}")
            chunk = zlib.decompress(head[:size], 31)
            yield chunk
            at, done = at + size, done + len(chunk)

    def _first_block(self, f) -> int:
        """The first block at the range's start or behind it; a chance likeness is told by what follows it."""
        f.seek(self.part.start)
        window = f.read(2 * _BLOCK)
        at = window.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            size = _block_size(window[at : at + _BLOCK])
            if size is not None and (at + size == len(window) or _block_size(window[at + size : at + size + 64]) is not None):
                try:
                    zlib.decompress(window[at : at + size], 31)
                except zlib.error:
                    pass
                else:
                    return self.part.start + at
            at = window.find(b"\x1f\x8b\x08\x04", at + 1)
        return self.part.end


def _lines(source: _Bytes) -> Iterator[tuple[int, bytes]]:
    """(place, line) of each line that starts in a range and of those behind it; only the file's first range has one at 0."""
    skip, at, rest = source.part.start > 0, 0, []
    for chunk in source.chunks():
        first, *more = chunk.split(b"\n")
        rest.append(first)
        for piece in more:
            line = b"".join(rest)
            if not skip:
                yield at, line.removesuffix(b"\r")
            skip, at, rest = False, at + len(line) + 1, [piece]
    line = b"".join(rest)
    if line and not skip:
        yield at, line.removesuffix(b"\r")


def _fasta(lines: Iterator[tuple[int, bytes]], source: _Bytes) -> Iterator[tuple[int, bytes, bytes, None]]:
    at, header, parts = 0, None, []
    for start, line in lines:
        if line.startswith(b">"):
            if header is not None:
                yield at, header, b"".join(parts), None
            if start > source.limit:
                return
            at, header, parts = start, line[1:], []
        elif header is None and start > source.limit:
            return
        elif header is not None:
            parts.append(line)
    if header is not None:
        yield at, header, b"".join(parts), None


def _fastq(lines: Iterator[tuple[int, bytes]], source: _Bytes) -> Iterator[tuple[int, bytes, bytes, bytes | None]]:
    """A header is a line with ``@`` whose next but one has ``+``: behind a quality line the next but one is a sequence."""
    held: list[tuple[int, bytes]] = []
    found = source.part.start == 0
    for start, line in lines:
        if not held and start > source.limit:
            return
        if not held and found and not line:
            continue
        held.append((start, line))
        if not found and len(held) == 3:
            found = held[0][1].startswith(b"@") and line.startswith(b"+")
            if not found:
                held.pop(0)
                if held[0][0] > source.limit:
                    return
        if found and not held[0][1].startswith(b"@"):
            raise ValueError(f"{source.part.file} has a record without @ behind byte {source.part.start}")
        if found and len(held) == 4:
            yield held[0][0], held[0][1][1:], held[1][1], line
            held = []
    if found and len(held) >= 2:
        yield held[0][0], held[0][1][1:], held[1][1], None


class SequenceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.format = options.get("format")
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))
        if self.format not in (None, "fasta", "fastq"):
            raise ValueError("format is fasta or fastq")

    def _files(self) -> list[tuple[str, int]]:
        """Paths, as they are opened again, and sizes."""
        fs, path = _open(self.path)
        lead = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else self.path.split(path)[0]
        info = fs.get_file_info(path)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        inner = lambda f: [] if info.is_file else f.path[len(path) :].strip("/").split("/")
        return sorted((lead + f.path, f.size) for f in found if f.is_file and not any(x[:1] in ("_", ".") for x in inner(f)))

    def partitions(self) -> list[Range]:
        out = []
        for file, size in self._files():
            fs, path = _open(file)
            with fs.open_input_file(path) as f:
                head = f.read(64)
            packing = "plain" if head[:2] != b"\x1f\x8b" else "gzip" if _block_size(head) is None else "blocks"
            step = size if packing == "gzip" else self.split
            out += [Range(file, a, min(size, a + step), packing) for a in range(0, size, max(1, step))]
        return out or [Range("", 0, 0, "plain")]

    def _format(self, part: Range) -> str:
        if self.format:
            return self.format
        for chunk in _Bytes(Range(part.file, 0, part.end, part.packing)).chunks():
            if text := chunk.lstrip():
                return "fastq" if text.startswith(b"@") else "fasta"
        return "fasta"

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        source = _Bytes(partition)
        records = (_fastq if self._format(partition) == "fastq" else _fasta)(_lines(source), source)
        rows: list[tuple] = []
        size = 0
        text = lambda x: None if x is None else x.decode("utf-8", "replace")

        def batch() -> pa.RecordBatch:
            at, header, seq, qual = ([r[i] for r in rows] for i in range(4))
            columns = [pa.array([partition.file] * len(rows), pa.string()), pa.array([partition.start] * len(rows), pa.int64()), pa.array(at, pa.int64())]
            columns += [pa.array(list(map(text, c)), pa.string()) for c in (header, seq, qual)]
            return pa.RecordBatch.from_arrays(columns, ["file", "part", "at", "header", "seq", "qual"])

        for row in records:
            rows.append(row)
            size += sum(len(x) for x in row[1:] if x)
            if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str


class SequenceWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.format = options.get("format", "fasta")
        if self.format not in ("fasta", "fastq"):
            raise ValueError("format is fasta or fastq")
        need = ["header", "seq", *(["qual"] if self.format == "fastq" else [])]
        if missing := [c for c in need if c not in columns]:
            raise ValueError(f"{self.format} needs the columns {', '.join(missing)}")
        self.places = [columns.index(c) for c in need]
        self.work = f"_temporary-{uuid.uuid4().hex}"
        fs, path = _open(self.path)
        if not overwrite and fs.get_file_info(path).type != pa.fs.FileType.NotFound and fs.get_file_info(pa.fs.FileSelector(path)):
            raise FileExistsError(self.path)

    def write(self, iterator) -> Written:
        fs, path = _open(self.path)
        part = TaskContext.get().partitionId()
        file = f"{path}/{self.work}/{part:05d}-{uuid.uuid4().hex}"
        fs.create_dir(f"{path}/{self.work}", recursive=True)
        shape = ">{}\n{}\n" if self.format == "fasta" else "@{}\n{}\n+\n{}\n"
        with fs.open_output_stream(file) as out:
            for row in iterator:
                out.write(shape.format(*("" if row[i] is None else row[i] for i in self.places)).encode())
        return Written(part, file)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        fs.create_dir(path, recursive=True)
        if self.overwrite:
            for old in fs.get_file_info(pa.fs.FileSelector(path)):
                if old.is_file:
                    fs.delete_file(old.path)
        for m in filter(None, messages):
            fs.move(m.file, f"{path}/part-{m.partition:05d}.{self.format}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = _open(self.path)
        if fs.get_file_info(f"{path}/{self.work}").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/{self.work}")


class SequenceSource(DataSource):
    """The data source ``sequences``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SequenceReader:
        return SequenceReader(self.options)

    def writer(self, schema, overwrite: bool) -> SequenceWriter:
        return SequenceWriter(self.options, list(schema.names), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``sequences`` known to a session and its executors."""
    ship_package(spark)
    spark.dataSource.register(SequenceSource)
