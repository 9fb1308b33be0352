"""Language identification by interpolated Kneser-Ney character models.

Texts become letters (lower case) and single gaps between letter runs. For each
language a model of order ``ORDER`` is counted: the highest order from
occurrences, the lower ones from continuations (distinct preceding characters),
each discounted and interpolated with the next lower one down to a uniform
floor. The models of all languages share sorted arrays of n-gram hashes, one for
each order, with one interpolated probability for each language beside a hash;
an n-gram that is not there backs off by the weight of its context.

The language with the lowest cross-entropy per character wins. The score is a
softmax of the entropies whose temperature, like the entropy beyond which a text
is rejected, comes from sampled rows that the counts leave out.

Models are fitted on the driver on about ``rows_per_lang`` rows a language at
most (a hash of doc_id chooses them). Scoring reads whole texts. A null text, or
one without letters, is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bpe import char_classes
from strandloom.llm.textblocks import U64, mix, pieces, text_buffer
from strandloom.runtime import ship_package

ORDER = 4
_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """The lower-case letter of each code point, 0 for all that is no letter."""
    if not _symbols:
        table = np.where(char_classes() == 1, np.arange(0x110000, dtype=np.uint32), 0).astype(np.uint32)
        for c in np.flatnonzero(table):
            low = chr(c).lower()
            if len(low) == 1:
                table[c] = ord(low)
        _symbols.append(table)
    return _symbols[0]


class Characters:
    """Symbols of some texts, each text after ORDER - 1 gaps, and the positions that count."""

    def __init__(self, column: pa.Array):
        buf, off = text_buffer(column)
        code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        place = np.zeros(len(code) + 1, dtype=np.int64)
        np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), out=place[1:])
        head = np.searchsorted(place, off)
        raw = _symbol_table()[code]
        solid = raw != 0
        keep = solid.copy()
        keep[1:] |= solid[:-1]
        start = head[:-1][head[:-1] < len(code)]
        keep[start] = solid[start]
        total = np.zeros(len(code) + 1, dtype=np.int64)
        np.cumsum(keep, out=total[1:])
        first = total[head[:-1]]
        self.counts = np.diff(total[head])
        gap = ORDER - 1
        self.symbols = np.insert(raw[keep], np.repeat(first, gap), 0).astype(U64)
        doc = np.arange(len(first))
        self.at = np.arange(int(self.counts.sum())) + np.repeat((doc + 1) * gap, self.counts)
        self.doc = np.repeat(doc, self.counts)

    def grams(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hash of the n symbols that end at each position."""
        acc = np.full(len(at), n, dtype=U64)
        for k in range(n - 1, -1, -1):
            acc = (acc + self.symbols[at - k] + U64(1)) * U64(0x9E3779B97F4A7C15)
            acc ^= acc >> U64(31)
        return mix(acc)


@dataclass
class Models:
    langs: list[str]
    grams: list[np.ndarray]  # [order - 1]: sorted hashes
    probs: list[np.ndarray]  # interpolated probability, a column for each language
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    reject_above: float = np.inf

    def probability(self, c: Characters, at: np.ndarray, n: int = ORDER) -> np.ndarray:
        if n == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.langs)))
        hashes = c.grams(n, at)
        k = np.searchsorted(self.grams[n - 1], hashes)
        k[k == len(self.grams[n - 1])] = 0
        miss = np.flatnonzero(self.grams[n - 1][k] != hashes)
        out = self.probs[n - 1][k]
        if len(miss):
            where = at[miss]
            weight = np.ones((len(miss), len(self.langs)))
            if n == 1:
                weight[:] = self.backoff[0]
            else:
                h = c.grams(n - 1, where - 1)
                j = np.searchsorted(self.contexts[n - 1], h)
                j[j == len(self.contexts[n - 1])] = 0
                hit = self.contexts[n - 1][j] == h
                weight[hit] = self.backoff[n - 1][j[hit]]
            out[miss] = weight * self.probability(c, where, n - 1)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits per character under each language, number of characters) of each text."""
        c = Characters(column)
        sums = np.zeros((len(c.counts), len(self.langs)))
        for a in range(0, len(c.at), 1 << 19):
            bits = np.log2(self.probability(c, c.at[a : a + (1 << 19)]))
            doc = c.doc[a : a + (1 << 19)]
            edges = np.flatnonzero(np.diff(doc, prepend=-1))
            sums[doc[edges]] -= np.add.reduceat(bits, edges, axis=0)
        return sums / np.maximum(c.counts, 1)[:, None], c.counts


def _softmax(entropy: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-temperature * (entropy - entropy.min(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def fit_models(texts: dict[str, list[str]], discount: float = 0.75, held: int = 5) -> Models:
    """Models of the languages in ``texts``; every ``held``-th text calibrates."""
    langs = sorted(texts)
    n_lang = len(langs)
    raw: list[list[tuple]] = [[] for _ in range(ORDER)]
    for lang in langs:
        counted = [t for i, t in enumerate(texts[lang]) if i % held or len(texts[lang]) < held]
        c = Characters(pa.array(counted, pa.large_string()))
        hashes = [c.grams(n, c.at) for n in range(1, ORDER + 1)]
        context = [None] + [c.grams(n - 1, c.at - 1) for n in range(2, ORDER + 1)]
        count: np.ndarray | None = None
        for n in range(ORDER, 0, -1):
            keys, example = np.unique(hashes[n - 1], return_index=True)
            if n == ORDER:
                count = np.unique(hashes[n - 1], return_counts=True)[1].astype(np.float64)
            else:  # continuations: distinct n-grams of the next order that end so
                longer = np.unique(hashes[n], return_index=True)[1]
                count = np.bincount(np.searchsorted(keys, hashes[n - 1][longer]), minlength=len(keys)).astype(np.float64)
            own = context[n - 1][example] if n > 1 else np.zeros(len(keys), dtype=U64)
            heads, back = np.unique(own, return_inverse=True)
            total, kinds = np.bincount(back, count, minlength=len(heads)), np.bincount(back, minlength=len(heads))
            total = np.maximum(total, 1e-9)
            suffix = hashes[n - 2][example] if n > 1 else None
            raw[n - 1].append((keys, np.maximum(count - discount, 0) / total[back], own, suffix, heads, np.minimum(1.0, discount * kinds / total)))
    alphabet = max(2, len(np.unique(np.concatenate([x[0] for x in raw[0]]))) + 1)
    m = Models(langs, [], [], [], [], np.full(n_lang, 1.0 / alphabet))
    for n in range(1, ORDER + 1):
        heads = np.unique(np.concatenate([x[4] for x in raw[n - 1]]))
        backoff = np.ones((len(heads), n_lang))
        for k, x in enumerate(raw[n - 1]):
            backoff[np.searchsorted(heads, x[4]), k] = x[5]
        keys, example = np.unique(np.concatenate([x[0] for x in raw[n - 1]]), return_index=True)
        own = np.concatenate([x[2] for x in raw[n - 1]])[example]
        probs = backoff[np.searchsorted(heads, own)]
        if n == 1:
            probs = probs * m.floor
        else:
            suffix = np.concatenate([x[3] for x in raw[n - 1]])[example]
            probs = probs * m.probs[n - 2][np.searchsorted(m.grams[n - 2], suffix)]
        for k, x in enumerate(raw[n - 1]):
            probs[np.searchsorted(keys, x[0]), k] += x[1]
        m.grams.append(keys)
        m.probs.append(probs)
        m.contexts.append(heads)
        m.backoff.append(backoff if n > 1 else backoff[0])
    kept = [(k, t) for k, lang in enumerate(langs) for i, t in enumerate(texts[lang]) if i % held == 0]
    entropy, size = m.entropies(pa.array([t for _, t in kept], pa.large_string()))
    truth = np.array([k for k, _ in kept], dtype=np.int64)
    entropy, truth = entropy[size > 0], truth[size > 0]
    if len(truth):
        loss = lambda t: -np.log(np.maximum(_softmax(entropy, t)[np.arange(len(truth)), truth], 1e-12)).mean()
        m.temperature = float(min((2.0**e for e in np.arange(-2, 7, 0.5)), key=loss))
        m.reject_above = float(1.1 * np.quantile(entropy[np.arange(len(truth)), truth], 0.999))
    return m


def sample_texts(docs: DataFrame, rows_per_lang: int = 300, bytes_per_lang: int = 4 << 20, max_langs: int = 1000) -> dict[str, list[str]]:
    """About ``rows_per_lang`` whole texts and ``bytes_per_lang`` of each non-null lang at most, in doc_id order.

    A text that alone has an eighth of the bytes is not learned from. More than ``max_langs``
    values of lang are an error: that column holds no languages then.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") <= bytes_per_lang // 8)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).limit(max_langs + 1).collect()
    if not counts:
        raise ValueError("no labelled rows to learn languages from")
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} values of lang")
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(1_000_000 * min(1.0, rows_per_lang / r["n"], bytes_per_lang / max(1, r["bytes"])))))])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share[F.col("lang")])
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.select("doc_id", "lang", "text").collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["text"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def train_languages(docs: DataFrame, rows_per_lang: int = 300, needed: bool = True) -> Models:
    """Models of the languages of ``docs`` (doc_id, text, lang). Without labelled texts this is an error, or, if they are not ``needed``, there are models of no language, by which every text is ``und``."""
    ship_package(docs.sparkSession)
    if not needed and docs.where("lang IS NOT NULL AND text IS NOT NULL").isEmpty():
        return Models([], [], [], [], [], np.zeros(0))
    return fit_models(sample_texts(docs, rows_per_lang))


def identify_languages(docs: DataFrame, models: Models, key: str = "doc_id", reject: bool = True) -> DataFrame:
    """key, lang_pred, score, bits_per_char and rejected; with ``reject`` a rejected text is ``und``.

    The models hold the n-grams of a bounded sample, so their broadcast is bounded.
    One row for each row of ``docs``, whatever its key, repeated rows included; no rows give no rows. A null text and one
    without letters is ``und`` with score 0. Of languages with equal entropy the first by name is chosen. Only ``key`` and ``text`` are read.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rows = docs.select(F.col(key).alias("doc_id"), F.col("text"))
    if not models.langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), *(F.lit(0.0).alias(c) for c in ("score", "bits_per_char")), F.lit(False).alias("rejected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                entropy, size = m.entropies(part.column(1))
                best = entropy.argmin(axis=1)
                each = np.arange(len(best))
                some = size > 0
                low = entropy[each, best]
                far = low > m.reject_above
                named = some & ~(far & reject)
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "lang_pred": pa.array([m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), named.tolist())], pa.string()),
                        "score": pa.array(np.where(some, _softmax(entropy, m.temperature)[each, best], 0.0)),
                        "bits_per_char": pa.array(np.where(some, low, 0.0)),
                        "rejected": pa.array(some & far),
                    }
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, bits_per_char double, rejected boolean")
