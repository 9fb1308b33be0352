"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased runs of ASCII letters and non-ASCII bytes, and their
prefixes of 4, 5 and 6 bytes, hashed into ``2**BITS`` buckets; a text is the set
of its terms. The machine adds to the linear weights a product of factors for
each pair of terms, so an insult beside a group mention counts for more (or
less) than the two alone.

It is fitted on the driver on about ``max_rows`` labelled rows and ``max_bytes`` of
their text at most (a hash of doc_id chooses them). Every bucket that occurs in
``support`` of these rows has a weight and factors, whatever its classes: a term that is
neutral alone may count in a pair. Scoring reads whole texts; a null or empty text has no
terms and the score of the bias alone. A null doc_id is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.textblocks import LOWER, U64, mix, pieces, span_hashes, text_buffer
from strandloom.runtime import checkpoint, ship_package

BITS, PREFIXES = 18, (4, 5, 6)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every term, with repeats."""
    buf, off = text_buffer(column)
    buf = LOWER[buf]
    n = len(buf)
    solid = _LETTER[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, starts, side="right") - 1
    docs, hashes = [doc], [span_hashes(buf, starts, ends)]
    for size in PREFIXES:
        long = ends - starts > size
        s = starts[long]
        docs.append(doc[long])
        hashes.append(mix(span_hashes(buf, s, s + size) + U64(size)))
    return np.concatenate(docs), (np.concatenate(hashes) >> U64(64 - BITS)).astype(np.int64)


@dataclass
class Machine:
    slot: np.ndarray  # slot of each bucket, -1 for weight zero
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        doc, bucket = terms(column)
        slot = self.slot[bucket]
        pairs = np.unique(doc[slot >= 0] * max(1, len(self.weight)) + slot[slot >= 0])
        doc, slot = np.divmod(pairs, max(1, len(self.weight)))
        return 1 / (1 + np.exp(-np.clip(self._raw(doc, slot, len(column)), -30, 30)))

    def _raw(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.weight[slot], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[slot, f]
            out += 0.5 * (np.bincount(doc, v, minlength=n) ** 2 - np.bincount(doc, v * v, minlength=n))
        return out


def fit_machine(sets: list[np.ndarray], labels: np.ndarray, factors: int = 4, support: int = 40, epochs: int = 10, rate: float = 0.5, decay: float = 1e-3, start: float = 1e-2, still: float = 0.3, sparse: float = 0.1, seed: int = 11) -> Machine:
    """Logistic loss over mini-batches; ``sets`` holds each row's distinct buckets.

    Weights follow the regularized leader, so those of terms that tell nothing stay zero
    (``sparse``). Factors join in the second half of the epochs, with AdaGrad steps that ``still``
    keeps small: they learn what the weights leave open. Only buckets in fewer than ``support`` rows are left out, and those in all rows, which tell nothing.
    """
    y = labels.astype(np.float64)
    pos, neg = max(y.sum(), 0), max((1 - y).sum(), 0)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bucket = np.concatenate([np.zeros(0, dtype=np.int64), *sets]).astype(np.int64)
    seen = np.bincount(bucket, minlength=1 << BITS)
    chosen = np.flatnonzero((seen >= min(support, max(1, len(sets) // 20))) & (seen < len(sets)))
    slot = np.full(1 << BITS, -1, dtype=np.int64)
    slot[chosen] = np.arange(len(chosen))
    bias = float(np.log((pos + 0.5) / (neg + 0.5)))
    rng = np.random.default_rng(seed)
    m = Machine(slot, bias, np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), factors)))
    rows = [slot[s][slot[s] >= 0] for s in sets]
    gb, gw, gv = start, np.full(len(chosen), start), np.full((len(chosen), factors), still)
    pull = np.zeros(len(chosen))
    epochs = max(epochs, 300 // max(1, -(-len(rows) // 256)))  # few rows are gone through more often
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            d = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            s = np.concatenate([np.zeros(0, dtype=np.int64), *(rows[i] for i in part)])
            err = (1 / (1 + np.exp(-np.clip(m._raw(d, s, len(part)), -30, 30))) - y[part]) / len(part)
            gb += err.sum() ** 2
            m.bias -= rate * err.sum() / np.sqrt(gb)
            if not len(s):
                continue
            used, back = np.unique(s, return_inverse=True)
            step = np.bincount(back, err[d])
            before = np.sqrt(gw[used])
            gw[used] += step**2
            after = np.sqrt(gw[used])
            pull[used] += step - (after - before) / rate * m.weight[used]
            z = pull[used]
            new_weight = np.where(np.abs(z) <= sparse, 0.0, (np.sign(z) * sparse - z) / (after / rate + decay))
            for f in range(factors if 2 * epoch >= epochs else 0):
                v = m.factor[s, f]
                total = np.bincount(d, v, minlength=len(part))
                step = np.bincount(back, err[d] * (total[d] - v)) + decay * m.factor[used, f]
                gv[used, f] += step**2
                m.factor[used, f] -= rate * step / np.sqrt(gv[used, f])
            m.weight[used] = new_weight
    return m


def labelled_terms(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_bytes: int = 64 << 20) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct buckets and label of about ``max_rows`` labelled rows with ``max_bytes`` of text at most.

    ``labels`` has doc_id and toxic; the chosen ids are broadcast, so that side has the
    bound ``max_rows`` (checked) and the texts are not shuffled. If their texts are too
    long together, fewer rows are chosen, and none that alone has a sixteenth of the bytes.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    share = min(1.0, 0.95 * max_rows / max(1, known.count()))
    fits = F.octet_length("text") <= max_bytes // 16
    for _ in range(2):
        chosen = checkpoint(known.where(place < int(share * 1_000_000)).limit(max_rows))
        rows = docs.select("doc_id", "text").where(F.coalesce(fits, F.lit(True))).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        if size <= max_bytes:
            break
        share *= 0.9 * max_bytes / size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, bucket = terms(part.column(1))
                pairs = np.unique(doc << BITS | bucket)
                edges = np.searchsorted(pairs >> BITS, np.arange(part.num_rows + 1))
                low = (pairs & (1 << BITS) - 1).astype(np.int32)
                sets = [low[a:b] for a, b in zip(edges[:-1], edges[1:])]
                yield pa.record_batch({"doc_id": part.column(0), "toxic": part.column(2), "terms": pa.array(sets, pa.list_(pa.int32()))})

    found = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, toxic int, terms array<int>").toArrow()
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    sets = [x.values.to_numpy() for x in found.column("terms").combine_chunks()] if found.num_rows else []
    labels_ = found.column("toxic").to_numpy()
    return [sets[i] for i in order], labels_[order]


def score_toxicity(docs: DataFrame, machine: Machine, key: str = "doc_id") -> DataFrame:
    """key, score (0 to 1) and predicted (score >= 0.5) of every row. The machine's size is fixed by its parameters.

    One row for each row of ``docs``, whatever its key, repeated rows included; equal texts have equal scores, null and empty ones that of a text
    without terms. No rows give no rows. Only ``key`` and ``text`` are read.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(key).alias("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                s = shared.value.score(part.column(1))
                yield pa.record_batch({"doc_id": part.column(0), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Machine:
    ship_package(docs.sparkSession)
    return fit_machine(*labelled_terms(docs, labels, max_rows))
