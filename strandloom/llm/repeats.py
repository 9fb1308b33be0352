"""Repeated passages by difference-cover anchors.

A window of ``window`` words is repeated when its word sequence also starts at
another place of any document. Positions of a document modulo ``PERIOD`` that lie
in ``COVER`` are anchors: for any two positions there is a shift below the period
that brings both into the cover, so two equal windows hold equal anchors at one
shift. Only anchors of ``window - PERIOD + 1`` words are hashed and counted first.
Windows around a repeated anchor are then extended to their full length and
counted exactly, and the words they cover are removed.

Words are runs outside space and 0x09-0x0D; null texts have none. Whole texts
are read; every row keeps its key, repeated and null keys included.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import hashcount as hc
from strandloom.llm.textblocks import U64, Words, mix, release, text_buffer
from strandloom.runtime import ship_package

# A perfect difference set; its differences give every residue of the period.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)


class Passages:
    """Word positions of some texts, with hashes of word runs of any length."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.words = Words(buf, off)
        self._ladder = [self.words.hashes]  # hashes of runs of 1, 2, 4, ... words
        self.first = np.repeat(self.words.word_off[:-1], self.words.counts)
        self.end = np.repeat(self.words.word_off[1:], self.words.counts)
        self.n = len(self.words.hashes)

    def runs(self, at: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each position, put together from runs of powers of two."""
        out, place = np.full(len(at), length, dtype=U64), at
        for k in range(length.bit_length()):
            if k == len(self._ladder):
                last, half = self._ladder[-1], 1 << (k - 1)
                self._ladder.append(mix(mix(last[: max(0, len(last) - half)]) + last[half:]))
            if length >> k & 1:
                out = mix(out ^ self._ladder[k][place])
                place = place + (1 << k)
        return out

    def anchors(self, length: int) -> np.ndarray:
        """Positions of the cover whose run lies in its text."""
        at = np.arange(self.n)
        return at[np.isin((at - self.first) % PERIOD, COVER) & (at + length <= self.end)]

    def windows(self, anchors: np.ndarray, window: int) -> np.ndarray:
        """Starts of the windows that hold one of these anchors."""
        steps = np.zeros(self.n + 1, dtype=np.int32)
        np.add.at(steps, np.maximum(anchors - PERIOD + 1, self.first[anchors]), 1)
        np.add.at(steps, anchors + 1, -1)
        at = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        return at[at + window <= self.end[at]]

    def covered(self, starts: np.ndarray, window: int) -> np.ndarray:
        """Whether each word lies in one of these windows."""
        steps = np.zeros(self.n + 1, dtype=np.int32)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + window, -1)
        return np.cumsum(steps[:-1]) > 0


def _passages(group: pa.Table) -> list[tuple[pa.RecordBatch, Passages]]:
    return [(part, Passages(*text_buffer(part.column("text")))) for part in hc.slices(group, "text")]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=U64), *parts])


def remove_repeats(docs: DataFrame, window: int = 35, key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and (with_text) the kept words joined by one space.

    One row for each row of ``docs``, whatever its key; no rows give no rows. A null text has no words. The windows of
    a repeated row start elsewhere too, so all its repeats lose them. Only ``key`` and ``text`` are read.
    """
    if window < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    ship_package(docs.sparkSession)
    length = window - PERIOD + 1
    rows, total = hc.batched(docs.select(F.col(key).alias("doc_id"), "text"), ["doc_id"])
    bits = hc.bucket_bits(total // 24)

    def anchor_hashes(group: pa.Table) -> np.ndarray:
        return _joined([p.runs(p.anchors(length), length) for _, p in _passages(group)])

    def window_hashes(group: pa.Table, answer: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.Table.from_batches([hc.send(0, *[np.zeros(0, dtype=U64)] * 2, bits, True)])
        found = _passages(hc.twice(group))
        at = [p.anchors(length) for _, p in found]
        _, where, _ = hc.distinct(_joined([p.runs(a, length) for (_, p), a in zip(found, at)]), bits, False)
        again = hc.read_levels(answer)[where] > 0
        edges = np.cumsum([0, *map(len, at)])
        hashes = _joined([p.runs(p.windows(a[again[i:j]], window), window) for (_, p), a, i, j in zip(found, at, edges[:-1], edges[1:])])
        values, _, counts = hc.distinct(hashes, bits, True)
        return pa.Table.from_batches([hc.send(group.column("batch")[0].as_py(), values, counts, bits, True)])

    def removed(group: pa.Table, answer: pa.Table) -> pa.Table:
        again = hc.read_values(answer) if answer.num_rows else np.zeros(0, dtype=U64)
        out: dict[str, list] = {"doc_id": [], "copies": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for part, p in _passages(group):
            at = np.flatnonzero(np.arange(p.n) + window <= p.end)
            starts = at[:0]
            if len(again) and len(at):
                h = p.runs(at, window)
                k = np.searchsorted(again, h)
                k[k == len(again)] = 0
                starts = at[again[k] == h]
            gone = p.covered(starts, window)
            data, off, word_off = p.words.buf.tobytes(), p.words.off.tolist(), p.words.word_off.tolist()
            for i in range(part.num_rows):
                words = data[off[i] : off[i + 1]].split()
                mask = gone[word_off[i] : word_off[i + 1]]
                n = int(mask.sum())
                kept = b" ".join(words if not n else compress(words, (~mask).tolist()))
                out["n_words"].append(len(words))
                out["n_removed"].append(n)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept_text"].append(kept.decode())
            out["doc_id"].append(part.column("doc_id"))
            out["copies"].append(part.column("copies"))
        release()
        table = {"doc_id": pa.chunked_array(out["doc_id"], type=group.schema.field("doc_id").type), "copies": pa.chunked_array(out["copies"], type=pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())}
        return pa.table(table | ({"kept_text": pa.array(out["kept_text"], pa.string())} if with_text else {}))

    by_batch = rows.groupBy("batch")
    anchors = hc.answers(hc.send_hashes(rows, anchor_hashes, bits), exact=False)
    windows = hc.answers(by_batch.cogroup(anchors.groupBy("batch")).applyInArrow(window_hashes, hc.SENT), exact=True)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, copies long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return hc.each(by_batch.cogroup(windows.groupBy("batch")).applyInArrow(removed, schema))
