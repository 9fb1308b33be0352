"""Quality rules as a short-circuit cascade.

Each rule rejects a document or passes it on. A document is kept when no rule
rejects it, so the order of the rules never changes the verdict, only the work.
Every rule's cost and selectivity are measured on a sample of about ``sample_rows``
documents, chosen by a hash of their text, and the rules are ordered by rejections
per unit of cost. Cost is counted work (bytes and words that the rule's features go
through), not seconds, so the order is the same in every run. The executors then run
the rules in that order: each sees only what the rules before it let through, and
features that are already there are filtered, not computed again.

Null and empty texts have no words and are rejected by ``few_words``. Words are
runs outside space and 0x09-0x0D; whole texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.textblocks import U64, Words, mix, pieces, release, text_buffer
from strandloom.runtime import ship_package

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True


class View:
    """Texts of some documents with features computed when first asked for; ``work`` counts what that took."""

    #: Features that are arrays over texts along their last axis: they survive a filter.
    BY_TEXT = ("n_words", "word_chars", "n_symbols", "n_upper", "n_alpha", "lines", "n_dup_lines", "n_repeat_words")

    def __init__(self, texts: pa.Array, cache: dict | None = None, work: list[int] | None = None):
        self.texts = texts
        self._cache: dict = cache if cache is not None else {}
        self.work = work if work is not None else [0]

    def get(self, name: str):
        if name not in self._cache:
            self._cache[name] = getattr(self, f"_{name}")()
        return self._cache[name]

    def __len__(self) -> int:
        return len(self.texts)

    def where(self, mask: np.ndarray) -> View:
        """The texts of ``mask``, with what is known of each."""
        if mask.all():
            return self
        known = {k: v[..., mask] for k, v in self._cache.items() if k in self.BY_TEXT}
        return View(self.texts.filter(pa.array(mask)), known, self.work)

    def _buffer(self):
        return text_buffer(self.texts)

    def _did(self, passes: int) -> None:
        self.work[0] += passes * len(self.get("buffer")[0])

    def _per_text(self, flags: np.ndarray) -> np.ndarray:
        off = self.get("buffer")[1]
        self._did(2)
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[off[1:]] - sums[off[:-1]]

    def _words(self) -> Words:
        self._did(4)
        return Words(*self.get("buffer"), hashes=False)

    def _hashed(self) -> Words:
        self._did(8)
        return Words(*self.get("buffer"))

    def _n_words(self) -> np.ndarray:
        return (self._cache.get("hashed") or self.get("words")).counts.astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        buf = self.get("buffer")[0]
        return self._per_text(((buf & 0xC0) != 0x80) & (buf > 0x20) | (buf < 0x20) & ((buf < 0x09) | (buf > 0x0D)))

    def _n_symbols(self) -> np.ndarray:
        return self._per_text(_SYMBOL[self.get("buffer")[0]])

    def _n_upper(self) -> np.ndarray:
        return self._per_text(_UPPER[self.get("buffer")[0]])

    def _n_alpha(self) -> np.ndarray:
        return self._per_text(_ALPHA[self.get("buffer")[0]])

    def _lines(self) -> np.ndarray:
        """Row 0: lines with a word; row 1: those equal to an earlier line."""
        buf, off = self.get("buffer")
        data = buf.tobytes()
        self._did(3)
        out = np.zeros((2, len(self)), dtype=np.int64)
        for i in range(len(self)):
            lines = [x for x in data[off[i] : off[i + 1]].split(b"\n") if x.strip()]
            out[:, i] = len(lines), len(lines) - len(set(lines))
        return out

    def _n_dup_lines(self) -> np.ndarray:
        return self.get("lines")[1]

    def _n_repeat_words(self) -> np.ndarray:
        words = self.get("hashed")
        self.work[0] += 40 * len(words.hashes)
        grams, valid = words.grams(3)
        keys = grams ^ mix(words.doc_of_word().astype(U64) + U64(1))
        at = np.flatnonzero(valid)
        ordered = np.sort(keys[at])
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        cover = np.zeros(len(grams) + 2, dtype=bool)
        if len(repeated):
            place = np.searchsorted(repeated, keys[at])
            place[place == len(repeated)] = 0
            hit = at[repeated[place] == keys[at]]
            for k in range(3):
                cover[hit + k] = True
        sums = np.zeros(len(grams) + 1, dtype=np.int64)
        np.cumsum(cover[: len(grams)], out=sums[1:])
        return sums[words.word_off[1:]] - sums[words.word_off[:-1]]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[View], np.ndarray]


def few_words(v: View) -> np.ndarray:
    return v.get("n_words") < 50


def repeated_words(v: View) -> np.ndarray:
    return 100 * v.get("n_repeat_words") > 50 * v.get("n_words")


def many_symbols(v: View) -> np.ndarray:
    return 10 * v.get("n_symbols") > v.get("n_words")


def shouting(v: View) -> np.ndarray:
    return 10 * v.get("n_upper") > 4 * v.get("n_alpha")


def duplicate_lines(v: View) -> np.ndarray:
    n, dup = v.get("lines")
    return 2 * dup > n


def odd_word_length(v: View) -> np.ndarray:
    chars, n = v.get("word_chars"), v.get("n_words")
    return (chars < 2 * n) | (chars > 15 * n)


RULES = (
    Rule("few_words", few_words),
    Rule("repeated_words", repeated_words),
    Rule("many_symbols", many_symbols),
    Rule("shouting", shouting),
    Rule("duplicate_lines", duplicate_lines),
    Rule("odd_word_length", odd_word_length),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> list[dict]:
    """Cost (work a row) and selectivity (share rejected) of each rule on a sample, best first.

    About ``sample_rows`` rows are measured where they lie, chosen by a hash of the text; only
    sums come to the driver. The sample guides the order alone.
    """
    ship_package(docs.sparkSession)
    texts = docs.select("text")
    share = min(1.0, sample_rows / max(1, texts.count()))
    chosen = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                found = []
                for rule in rules:
                    view = View(part.column(0))
                    found.append((int(rule.rejects(view).sum()), view.work[0]))
                yield pa.record_batch({"rule": pa.array([r.name for r in rules]), "n": pa.array([len(part)] * len(rules), pa.int64()), "rejected": pa.array([x for x, _ in found], pa.int64()), "work": pa.array([w for _, w in found], pa.int64())})

    sums = chosen.mapInArrow(run, "rule string, n long, rejected long, work long").groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("n", "rejected", "work")))
    seen = {r["rule"]: r for r in sums.collect()}
    found = []
    for rule in rules:
        n, rejected, work = (seen[rule.name][c] for c in ("n", "rejected", "work")) if rule.name in seen else (0, 0, 0)
        cost, selectivity = work / max(1, n), (rejected + 0.5) / (n + 1)
        found.append({"rule": rule.name, "cost": cost, "selectivity": selectivity, "gain": selectivity / max(cost, 1e-9)})
    return sorted(found, key=lambda x: (-x["gain"], x["rule"]))


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> tuple[Rule, ...]:
    """The rules by rejections per cost on a sample of ``docs``."""
    by_name = {r.name: r for r in rules}
    return tuple(by_name[x["rule"]] for x in estimate_rules(docs, rules, sample_rows))


def cascade(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    """Index of the first rule that rejects each text, -1 where none does."""
    verdict = np.full(len(view), -1, dtype=np.int32)
    alive = np.arange(len(view))
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(view)
        verdict[alive[bad]] = k
        alive, view = alive[~bad], view.where(~bad)
    return verdict


def quality_features(docs: DataFrame, rules: tuple[Rule, ...] | None = None, key: str = "doc_id") -> DataFrame:
    """key, the base counts, base_failed, kept and failed_rule of every row of ``docs``.

    Rows keep their key as it is: repeated and null keys give as many rows.
    """
    ship_package(docs.sparkSession)
    rules = rules or ordered_rules(docs)
    names = [r.name for r in rules]
    rows = docs.select(F.col(key).alias("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                view = View(part.column(1))
                view.get("hashed")
                base = {name: view.get(name) for name in BASE}
                failed = few_words(view) | repeated_words(view)
                verdict = cascade(view, rules)
                yield pa.record_batch(
                    {"doc_id": part.column(0)}
                    | {k: pa.array(v.astype(np.int64)) for k, v in base.items()}
                    | {"base_failed": pa.array(failed), "kept": pa.array(verdict < 0)}
                    | {"failed_rule": pa.array([None if v < 0 else names[v] for v in verdict.tolist()], type=pa.string())}
                )
        release()

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, failed_rule string"
    return rows.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with all their columns."""
    ship_package(docs.sparkSession)
    rules = rules or ordered_rules(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array(cascade(View(part.column(at)), rules) < 0))
        release()

    return docs.mapInArrow(run, docs.schema)
