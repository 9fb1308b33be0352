"""Ranked lexical search on a bit-sliced impact index.

Documents are dealt to blocks of some megabytes of text. For each term a block knows which of its
documents hold it, and the impact of the term in each of them: a whole number, weight of the term times
saturated frequency. Impacts are stored in slices: slice b has bit b of all impacts. A query takes the
slices of its terms, spreads them over the block's documents as bitmaps, adds them all up with
bitwise sum and carry (three rows of bitmaps to two at a time, one ripple at the end), and finds the best
documents by going down the slices of the sum from the most significant: a slice either
splits the candidates or takes its holders in whole. So scores are exact and no document is scored alone.
Each block answers with its best ``k`` documents of each query, and a window over these gives the ranks.

Index: ``build_index`` counts the terms of all texts and then turns each text into its block in one pass without a
shuffle. An impact is the saturated frequency of a term in a document; the weight of the term depends on the number
of documents that hold it, which the index gives for the terms of a query before they are searched, and is multiplied in when
a term's slices are spread. A row is a block; its terms are dealt by hash to ``PARTS`` columns, so a query reads only the columns of its
terms. Every row and term is indexed. Queries are sent to the blocks in sets of bounded size.

Terms are runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased. A null text has no terms; a query
without terms, or with none that occurs, has no result. Equal scores go by ascending doc_id, null last;
repeated rows are documents of their own. Queries are told apart by (item_id, text), and repeats of one are answered once. An empty table gives no
rows. Columns other than the key and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandloom.llm.spans import byte_class, chunks, find_runs, name_spans, span_strings
from strandloom.llm.textblocks import LOWER, pieces, release, text_buffer
from strandloom.runtime import checkpoint, ship_package

#: Bytes of text in a block, columns that its terms are dealt to, bytes of query texts that are sent at once.
BLOCK_BYTES, PARTS, QUERY_BYTES = 8 << 20, 16, 16 << 20
# The weights of length and frequency, in hundredths and thousandths.
_LENGTH, _SCALE = 90, 1_000_000_000
_TERM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_PART = "struct<terms:array<string>,starts:binary,docs:binary,planes:binary,n_planes:int>"


def terms_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(code of each term occurrence, the distinct terms, the text of each occurrence)."""
    raw, off = text_buffer(column)
    buf = LOWER[raw]
    starts, ends = find_runs(buf, off, _TERM)
    code, kept = name_spans(buf, starts, ends, np.zeros(len(starts), dtype=np.int64))
    return code, span_strings(buf, starts[kept], ends[kept]), np.searchsorted(off, starts, side="right") - 1


def part_of(term: str) -> int:
    return hashlib.blake2b(term.encode(), digest_size=1).digest()[0] % PARTS


def _zip(values: np.ndarray, kind: str) -> bytes:
    return pa.compress(np.ascontiguousarray(values.astype(kind)).tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


@dataclass
class Index:
    """blocks: doc_id (sorted), p0 to p15; N documents with a term, L terms with repeats."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def _slices(impact: np.ndarray) -> np.ndarray:
    """Bit b of all values, packed, for each bit b that is used."""
    n = max(1, int(impact.max(initial=0)).bit_length())
    return np.stack([np.packbits((impact >> b & 1).astype(np.uint8), bitorder="little") for b in range(n)])


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, off = text_buffer(part.column(0))
                starts, _ = find_runs(raw, off, _TERM)
                some = np.diff(np.searchsorted(starts, off)) > 0
                yield pa.record_batch({"docs": pa.array([int(some.sum())], pa.int64()), "terms": pa.array([len(starts)], pa.int64())})

    found = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return int(found["docs"] or 0), int(found["terms"] or 0)


def build_index(docs: DataFrame, key: str = "doc_id") -> Index:
    """The index of all rows of ``docs`` (key, text)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_docs, n_terms = _sizes(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", BLOCK_BYTES):
            order = pc.sort_indices(chunk.column(0), null_placement="at_end")
            ids = chunk.column(0).take(order)
            code, terms, row = terms_of(chunk.column(1).take(order))
            part = np.array([part_of(t) for t in terms.to_pylist()], dtype=np.int64)
            order = np.argsort(part, kind="stable")
            new = np.empty_like(order)
            new[order] = np.arange(len(order))  # terms of one part are neighbours
            terms, size = terms.take(pa.array(order)), np.int64(max(1, len(ids)))
            posting, tf = np.unique(new[code] * size + row, return_counts=True)
            lengths = np.bincount(row, minlength=len(ids))
            doc, df = posting % size, np.bincount(posting // size, minlength=len(terms))
            m = 100 - _LENGTH + _LENGTH * lengths * n_docs // max(1, n_terms)
            impact = _SCALE * tf // (1000 * tf + 8 * m[doc])
            first, starts = np.searchsorted(part[order], np.arange(PARTS + 1)), np.concatenate([[0], np.cumsum(df)])
            out = {"doc_id": _list(ids)}
            for p in range(PARTS):
                a, b = first[p], first[p + 1]
                i, j = starts[a], starts[b]
                planes = _slices(impact[i:j])
                value = [_list(terms.slice(a, b - a)), *(pa.array([x], pa.binary()) for x in (_zip(starts[a : b + 1] - i, "<u4"), _zip(doc[i:j], "<u4"), _zip(planes, "u1"))), pa.array([len(planes)], pa.int32())]
                out[f"p{p}"] = pa.StructArray.from_arrays(value, names=["terms", "starts", "docs", "planes", "n_planes"])
            del posting, tf, doc, impact, code, row
            release()
            yield pa.record_batch(out)

    schema = f"doc_id array<{dict(rows.dtypes)['doc_id']}>, " + ", ".join(f"p{p} {_PART}" for p in range(PARTS))
    return Index(checkpoint(rows.mapInArrow(run, schema)), n_docs, n_terms)


def bitmaps(part: dict[str, pa.Scalar], weights: dict[str, int], n_docs: int) -> dict[str, np.ndarray]:
    """Weighted slices of those of the terms of ``weights`` that a part of a block has, as bitmaps over the block's documents (64 to a word)."""
    found = np.asarray(pc.index_in(part["terms"].values, pa.array(list(weights), pa.string())).fill_null(-1))
    wanted = np.flatnonzero(found >= 0)
    if not len(wanted):
        return {}
    known = list(weights.items())
    starts = _unzip(part["starts"].as_py(), len(found) + 1, "<u4").astype(np.int64)
    total, n = int(starts[-1]), part["n_planes"].as_py()
    docs, planes = _unzip(part["docs"].as_py(), total, "<u4"), _unzip(part["planes"].as_py(), n * ((total + 7) // 8), "u1").reshape(n, -1)
    width, out = -(-n_docs // 64) * 64, {}
    place = np.arange(n, dtype=np.int64)[:, None]
    for i in wanted.tolist():
        term, w = known[found[i]]
        a, b = int(starts[i]), int(starts[i + 1])
        bits = np.unpackbits(planes[:, a >> 3 : (b + 7) >> 3], axis=1, bitorder="little")[:, a & 7 : (a & 7) + b - a]
        impact = w * (bits.astype(np.int64) << place).sum(axis=0)
        high = max(1, int(impact.max()).bit_length())
        wide = np.zeros((high, width), dtype=np.uint8)
        wide[:, docs[a:b]] = impact >> np.arange(high)[:, None] & 1
        out[term] = np.packbits(wide, axis=1, bitorder="little").view("<u8")
    return out


def add_up(planes: list[np.ndarray]) -> np.ndarray:
    """The sum of sliced numbers as slices: carries are saved while adding and rippled up once."""
    height = max(len(p) for p in planes) + len(planes).bit_length() + 1
    total, carry = np.zeros((2, height, planes[0].shape[1]), dtype="<u8")
    for p in planes:
        more = np.zeros_like(total)
        more[: len(p)] = p
        odd = total ^ carry
        up = (total & carry) | (more & odd)
        total = odd ^ more
        carry = np.zeros_like(total)
        carry[1:] = up[:-1]
    ripple = np.zeros_like(total[0])
    for b in range(height):
        odd = total[b] ^ carry[b]
        total[b], ripple = odd ^ ripple, (total[b] & carry[b]) | (ripple & odd)
    return total


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def best(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the ``k`` largest sliced numbers above 0, equal ones by place."""
    open_, sure = np.bitwise_or.reduce(total, axis=0), np.zeros_like(total[0])
    if _count(open_) > k:
        for plane in total[::-1]:
            both = open_ & plane
            n = _count(sure | both)
            if n > k:
                open_ = both
            else:
                sure, open_ = sure | both, open_ & ~plane
                if n == k:
                    break
        left = k - _count(sure)
        places = np.sort(np.concatenate([_places(sure), _places(open_)[:left]]))
    else:
        places = _places(open_)
    words, bits = places >> 6, (places & 63).astype(np.uint64)
    value = sum(((plane[words] >> bits & np.uint64(1)).astype(np.int64) << b for b, plane in enumerate(total)), np.zeros(len(places), dtype=np.int64))
    return places, value


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best documents of each row of ``items`` (item_id, text)."""
    items = checkpoint(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    sets = max(1, -(-int(size) // QUERY_BYTES))
    schema: StructType = items.select("item_id").schema
    out = None
    for s in range(sets):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == s) if sets > 1 else items
        found = _search_set(index, own.collect(), k, schema[0].dataType.simpleString())
        out = found if out is None else out.unionByName(found)
    return out


def term_weights(index: Index, words: list[str]) -> dict[str, int]:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of those of the (boundedly many) ``words`` that occur."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for column in batch.columns:
                for part in column:
                    starts = _unzip(part["starts"].as_py(), len(part["terms"]) + 1, "<u4").astype(np.int64)
                    found = np.asarray(pc.index_in(part["terms"].values, shared.value).fill_null(-1))
                    at = np.flatnonzero(found >= 0)
                    yield pa.record_batch({"word": pa.array(found[at], pa.int32()), "df": pa.array(np.diff(starts)[at], pa.int64())})

    used = sorted({part_of(w) for w in words})
    if not used:
        return {}
    slim = index.blocks.select(*(F.struct(F.col(f"p{p}.terms").alias("terms"), F.col(f"p{p}.starts").alias("starts")).alias(f"p{p}") for p in used))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2).cast("double") / (2 * F.sum("df") + 1).cast("double"))).cast("long")
    return {words[r["word"]]: r["w"] for r in slim.mapInArrow(run, "word int, df long").groupBy("word").agg(weight.alias("w")).collect()}


def _search_set(index: Index, items: list, k: int, kind: str) -> DataFrame:
    """``search`` for a bounded set of queries."""
    spark = index.blocks.sparkSession
    code, terms, row = terms_of(pa.array([r["text"] for r in items], pa.string()))
    words = terms.to_pylist()
    pairs = sorted(set(zip(row.tolist(), code.tolist())))
    queries: dict[int, list[str]] = {}
    for r, c in pairs:
        queries.setdefault(r, []).append(words[c])
    used = sorted({part_of(w) for w in words})
    weights = term_weights(index, words)
    shared = spark.sparkContext.broadcast((queries, weights))
    doc = index.blocks.select("doc_id").schema[0].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values
                maps: dict[str, np.ndarray] = {}
                for column in batch.columns[1:]:
                    maps |= bitmaps(column[i], weight, len(ids))
                query, at, score = [], [], []
                for q, own in asked.items():
                    planes = [maps[t] for t in own if t in maps]
                    if planes:
                        places, values = best(add_up(planes), k)
                        query.append(np.full(len(places), q))
                        at.append(places)
                        score.append(values)
                release()
                cat = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts])
                yield pa.record_batch({"query": pa.array(cat(query), pa.int64()), "doc_id": ids.take(pa.array(cat(at))), "score": pa.array(cat(score), pa.int64())})

    rows = index.blocks.select("doc_id", *(f"p{p}" for p in used)).mapInArrow(run, f"query long, doc_id {doc}, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, items[q]["item_id"]) for q in queries], f"query long, item_id {kind}")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
