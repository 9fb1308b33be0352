"""Exact counts of hashes over all documents, without a row per hash.

Documents are dealt to batches of a few megabytes by a hash of their row. Repeats of one
row share a batch, so they are put together before they are dealt: of all repeats in one Arrow batch of
the input one row travels, with their number. Each
batch sends its distinct hashes, sorted and delta-coded, cut by their leading
bits into buckets; a bucket adds up the counts of all batches and answers each
batch with one byte per hash (or with the repeated hashes themselves). A hash that
is in every document costs one entry per batch, so frequent hashes do not
gather in one place, and batches and buckets both grow in number, not in size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from strandloom.llm.textblocks import U64, pieces, release

BATCH_BYTES = 3 << 20
BUCKET_HASHES = 1_000_000


def pack(values: np.ndarray) -> bytes:
    """A sorted or small-valued unsigned array as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        if len(ids.unique()) == len(ids):
            yield pa.record_batch([*batch.columns, pa.array(np.ones(len(ids), dtype=np.int64))], names=[*batch.schema.names, "copies"])
            continue
        names = batch.schema.names
        table = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")])
        yield from table.select([*names, "count_all"]).rename_columns([*names, "copies"]).to_batches()


def twice(group: pa.Table) -> pa.Table:
    """A batch's rows, each once, and those once more that stand for several: what is repeated counts two, however its rows were put together."""
    names = [c for c in group.column_names if c not in ("copies", "batch")]
    rows = group.group_by([*names, "batch"], use_threads=False).aggregate([("copies", "sum")])
    again = rows.filter(pc.greater(rows.column("copies_sum"), 1))
    return pa.concat_tables([rows, again]) if again.num_rows else rows


def each(df: DataFrame) -> DataFrame:
    """``df`` with a row for each of its ``copies``."""
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("_copy", "copies")


def batched(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """``columns`` and text of ``docs`` with copies and a batch number; and the bytes of all texts.

    A row stands for as many equal rows as ``copies`` says. How repeats are put together depends on how
    they arrive, so a row may still be there several times; all of them are in one batch.
    """
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-int(total) // BATCH_BYTES))
    rows = docs.select(*columns, "text")
    rows = rows.mapInArrow(_put_together, StructType([*rows.schema.fields, StructField("copies", LongType())]))
    return rows.withColumn("batch", F.pmod(F.xxhash64(*columns, "text"), F.lit(n)).cast("int")), int(total)


def bucket_bits(n_hashes: int) -> int:
    """Leading bits that make buckets of about BUCKET_HASHES."""
    return max(0, int(np.ceil(np.log2(max(1, n_hashes) / BUCKET_HASHES))))


def distinct(hashes: np.ndarray, bits: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, where each hash is among them, counts). Unless exact, 32 bits within a bucket are kept."""
    values = hashes if exact else hashes >> U64(32 - bits)
    return np.unique(values, return_inverse=True, return_counts=True)


def send(batch: int, values: np.ndarray, counts: np.ndarray, bits: int, exact: bool) -> pa.RecordBatch:
    """One row for each bucket that has values of this batch."""
    bucket = (values >> U64(64 - bits) if exact else values >> U64(32)).astype(np.int64) if bits else np.zeros(len(values), dtype=np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows: dict[str, list] = {"bucket": [], "batch": [], "n": [], "vals": [], "counts": []}
    for a, b in zip(edges[:-1], edges[1:]):
        part = values[a:b] if exact else values[a:b].astype(np.uint32)
        rows["bucket"].append(int(bucket[a]))
        rows["batch"].append(batch)
        rows["n"].append(int(b - a))
        rows["vals"].append(pack(np.diff(part, prepend=part[:1] * 0)))
        rows["counts"].append(pack(counts[a:b].astype(np.uint32)))
    return pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=list(rows))


SENT = "bucket int, batch int, n int, vals binary, counts binary"
ANSWER = "batch int, bucket int, n int, answer binary"


def level(counts: np.ndarray) -> np.ndarray:
    """0 for a count of one, else a byte that never falls as the count grows."""
    return np.where(counts < 2, 0, np.minimum(255, 1 + 4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def answers(sent: DataFrame, exact: bool) -> DataFrame:
    """For each batch and bucket: if exact the repeated values, else the level of every value in order."""

    def add_up(group: pa.Table) -> pa.Table:
        n = group.column("n").to_pylist()
        kind = "<u8" if exact else "<u4"
        parts = [np.cumsum(unpack(v, k, kind), dtype=kind) for v, k in zip(group.column("vals").to_pylist(), n)]
        counts = np.concatenate([unpack(v, k, "<u4") for v, k in zip(group.column("counts").to_pylist(), n)]).astype(np.int64)
        release()
        values, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, weights=counts, minlength=len(values)).astype(np.int64)[where]
        ends = np.cumsum(n)
        out, sizes = [], []
        for part, a, b in zip(parts, ends - n, ends):
            if exact:
                again = part[total[a:b] > 1]
                out.append(pack(np.diff(again, prepend=again[:1] * 0)))
                sizes.append(len(again))
            else:
                out.append(pa.compress(level(total[a:b]).tobytes(), codec="zstd", asbytes=True))
                sizes.append(int(b - a))
        return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"), "n": pa.array(sizes, pa.int32()), "answer": pa.array(out, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(add_up, ANSWER)


def read_levels(answer: pa.Table) -> np.ndarray:
    """Levels of a batch's distinct values, in order."""
    rows = sorted(zip(answer.column("bucket").to_pylist(), answer.column("n").to_pylist(), answer.column("answer").to_pylist()))
    return np.concatenate([np.zeros(0, dtype=np.uint8), *(np.frombuffer(pa.decompress(a, n, codec="zstd", asbytes=True), dtype=np.uint8) for _, n, a in rows)])


def read_values(answer: pa.Table) -> np.ndarray:
    """A batch's repeated values, sorted."""
    rows = sorted(zip(answer.column("bucket").to_pylist(), answer.column("n").to_pylist(), answer.column("answer").to_pylist()))
    return np.concatenate([np.zeros(0, dtype=U64), *(np.cumsum(unpack(a, n, "<u8"), dtype="<u8") for _, n, a in rows if n)])


def send_hashes(docs: DataFrame, hashes_of: Callable[[pa.Table], np.ndarray], bits: int, exact: bool = False) -> DataFrame:
    """Each batch's distinct hashes with their counts; ``hashes_of`` gives all hashes of rows. A repeated row counts two."""

    def run(group: pa.Table) -> pa.Table:
        values, _, counts = distinct(hashes_of(twice(group)), bits, exact)
        release()
        return pa.Table.from_batches([send(group.column("batch")[0].as_py(), values, counts, bits, exact)])

    return docs.groupBy("batch").applyInArrow(run, SENT)


def slices(table: pa.Table, column: str) -> Iterator[pa.RecordBatch]:
    for batch in table.combine_chunks().to_batches():
        yield from pieces(batch, column)
