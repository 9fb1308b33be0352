"""Personal data: generated candidates, boosted trees, calibrated thresholds. Spark expressions only.

Base spans follow fixed rules (e-mail, ip, card with Luhn, phone). Two generators
of high recall propose further, overlapping spans: ``number`` (groups of digits with
separators, seven characters or more) and ``secret`` (identifiers of sixteen characters
or more with a digit); neither has an upper length. Boosted trees score each
candidate from its format and the words before it. They are fitted on counts of
candidates by feature vector over all documents, so the fit needs one aggregation
of bounded size and no sample. Labels are weak: a number is positive if it overlaps
a valid base span (the sign that makes a phone number valid is no feature), a secret if a
word such as ``password`` stands before it (that word is no feature of secrets).
Thresholds are calibrated on other texts than the trees are fitted on (a hash of the text
deals them): for each generator the lowest score with a precision of ``precision`` on the
held-out labels, by the lower end of its confidence interval, selects redactions; without
one nothing is added. Base spans always stay.

The patterns are written so that their matching stays linear in the text: a failing
run of characters is left as a whole. Spans are compared by their ranks among the sorted
starts and ends of a text, so a text with n spans takes n log n. Positions are code points, ends exclusive. A
null text counts as empty. ``redact`` keeps all columns; the other functions replace
columns that have the names of their results.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
GENERATORS = ("number", "secret")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"[{_LOCAL}](?:(?<![{_LOCAL}][{_LOCAL}])|(?<=\G[{_LOCAL}]))[{_LOCAL}]*+@(?=[{_LABEL}]++\.[{_LABEL}])[{_LABEL}.]*?(?![{_LABEL}]|\.[{_LABEL}])",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![0-9]|[\x20-][0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![A-Za-z0-9_])\(?[0-9]++(?![A-Za-z_])(?:[\x20().-]++[0-9]++(?![A-Za-z_]))*+",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,}+",
}
_NEEDS = {"email": "@", "phone": "+"}
_SECRET_WORDS = r"(?i)(password|passwd|pwd|token|secret|api[_ -]?key|access[_ -]?key)[\x20\x22']*[=:]?[\x20\x22']*$"
_NUMBER_WORDS = r"(?i)(tel|telefon|phone|call|mobile|fax|card|visa|account|konto|ssn|iban)[.:#\x20]*\+?[0-9]{0,2}[\x20]?$"
_CHUNK = 64
#: Code points in a piece of a text; what stands at a place is cut from its pieces, not from the whole text.
_PIECE = 1024
#: One text in so many calibrates the thresholds and is not fitted on.
HELD = 3
FEATURES = ("number", "digits", "length", "parens", "hyphen", "dot", "space", "letters", "upper", "hex", "word")


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` with ``value`` evaluated once, however often and deep inside loops it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _before(sizes: Column) -> Column:
    """Sums of all elements before each one, in blocks, so that long arrays stay cheap."""
    plus = lambda x, y: x + y
    blocks = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(_CHUNK)), lambda a: F.aggregate(F.slice(s, a + 1, F.lit(_CHUNK)), F.lit(0), plus))
    starts = lambda k: F.transform(k, lambda _, i: F.aggregate(F.slice(k, F.lit(1), i), F.lit(0), plus))

    def inside(s: Column, t: Column) -> Column:
        block = lambda i: F.floor(i / _CHUNK).cast("int")
        return F.transform(s, lambda _, i: F.get(t, block(i)) + F.aggregate(F.slice(s, block(i) * _CHUNK + 1, i % _CHUNK), F.lit(0), plus))

    return _let(sizes, lambda s: _let(blocks(s), lambda k: _let(starts(k), lambda t: inside(s, t))))


def _steps(n: Column) -> Column:
    """Powers of two from the greatest within ``n`` down to one, none for an ``n`` of 0."""
    powers = F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    return F.filter(powers, lambda p: p <= n)


def _rank(ordered: Column, steps: Column, is_before: Callable[[Column], Column]) -> Column:
    """How many elements of a sorted array are before a value, by halving."""
    ahead = lambda at, step: F.coalesce(is_before(F.get(ordered, at + step - 1)), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))


def _starts_before(x: Column) -> Column:
    """Spans of a row of ``_ordered`` that start before ``x``."""
    return _rank(F.col("_starts"), F.col("_steps"), lambda v: v < x)


def _ends_by(x: Column) -> Column:
    """Spans of a row of ``_ordered`` that end at ``x`` or before. They started before it too, so the rest of those that did are still open."""
    return _rank(F.col("_ends"), F.col("_steps"), lambda v: v <= x)


_SIDES = ("_starts", "_ends", "_steps", "_pieces")


def _ordered(rows: DataFrame, spans: str, cut: Column) -> DataFrame:
    """Adds the sorted starts and ends of a column of spans, steps to search them, and, where ``cut`` holds, the pieces of body."""
    pieces = F.when(cut, F.regexp_extract_all("body", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)))
    sides = (F.sort_array(F.col(spans)["start"]), F.sort_array(F.col(spans)["end"]), _steps(F.size(spans)), pieces)
    return _fence(rows.withColumns(dict(zip(_SIDES, sides))))


def _cut(start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of body from its pieces, so that it takes as long as what is cut and not as what is before."""
    block = lambda i: F.floor(i / _PIECE).cast("int")
    near = F.array_join(F.slice("_pieces", block(start) + 1, block(F.greatest(end - 1, start)) - block(start) + 1), "")
    return F.substring(near, start % _PIECE + 1, end - start)


_SPANS = "array<struct<start:int,end:int,found:string>>"


def _fence(rows: DataFrame) -> DataFrame:
    """The same rows; the optimizer copies no expression from above into those below, which would repeat their work."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def _with_matches(rows: DataFrame, kind: str) -> DataFrame:
    """Adds ``kind``: (start, end, found) of every match, leftmost and not overlapping."""
    pattern = F.lit(PATTERNS[kind])
    may = F.contains(F.col("body"), F.lit(_NEEDS[kind])) if kind in _NEEDS else F.col("body").rlike("[0-9]")
    rows = rows.withColumn("_m", F.when(may, F.regexp_extract_all("body", pattern, F.lit(0))))
    rows = rows.withColumn("_g", F.when(F.size("_m") > 0, F.split("body", PATTERNS[kind], -1)))
    rows = rows.withColumn("_s", F.when(F.size("_m") > 0, _let(F.col("_g"), lambda g: F.transform("_m", lambda m, i: F.length(m) + F.length(F.get(g, i))))))
    rows = rows.withColumn("_b", F.when(F.size("_m") > 0, _before(F.col("_s"))))
    one = lambda g, n, at: F.transform("_m", lambda m, i: F.struct((F.get(at, i) + F.length(F.get(g, i))).alias("start"), (F.get(at, i) + F.get(n, i)).alias("end"), m.alias("found")))
    spans = _let(F.col("_g"), lambda g: _let(F.col("_s"), lambda n: _let(F.col("_b"), lambda at: one(g, n, at))))
    return _fence(rows.withColumn(kind, F.when(F.size("_m") > 0, spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))).drop("_m", "_g", "_s", "_b"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda x: x.rlike("^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        d = _digits(found)
        return F.when((F.length(d) >= 16) & (F.length(d) <= 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(8, 15)
    if kind == "number":
        return F.length(found) >= 7
    return F.lit(True)


def _valid_only(kind: str) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["found"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with body (text, null as empty) and an array column of valid spans for each base kind."""
    rows = docs.withColumn("body", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        rows = _with_matches(rows, kind)
        rows = rows.withColumn(kind, _valid_only(kind))
    return rows


def candidates(rows: DataFrame) -> DataFrame:
    """Adds ``proposed``: generated spans with features (small integers) and the weak label, to rows of ``base_spans``."""
    for kind in GENERATORS:
        rows = _with_matches(rows, kind).withColumn(kind, _valid_only(kind))
    rows = _ordered(rows.withColumn("_base", F.concat(*KINDS)), "_base", F.greatest(*map(F.size, GENERATORS)) > 0)

    def describe(kind: str):
        def one(s: Column) -> Column:
            x = s["found"]
            ahead = _cut(F.greatest(s["start"] - 24, F.lit(0)), s["start"])
            n = F.length(_digits(x))
            overlap = _starts_before(s["end"]) > _ends_by(s["start"])
            flag = lambda c: c.cast("int")
            keyed = ahead.rlike(_SECRET_WORDS if kind == "secret" else _NUMBER_WORDS)
            label = keyed if kind == "secret" else overlap
            feature = {
                "number": F.lit(int(kind == "number")),
                "digits": F.least(n, F.lit(24)),
                "length": F.least(F.floor(F.length(x) / 4).cast("int"), F.lit(16)),
                "parens": flag(F.contains(x, F.lit(")"))),
                "hyphen": flag(F.contains(x, F.lit("-"))),
                "dot": flag(F.contains(x, F.lit("."))),
                "space": flag(F.contains(x, F.lit(" "))),
                "letters": flag(x.rlike("[A-Za-z]")),
                "upper": flag(x.rlike("[A-Z]")),
                "hex": flag(x.rlike("^[0-9a-f]+$")),
                "word": F.lit(0) if kind == "secret" else flag(keyed),
            }
            return F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), flag(label).alias("label"), overlap.alias("base"), *(feature[f].alias(f) for f in FEATURES)
            )

        return F.transform(kind, one)

    return _fence(rows.withColumn("proposed", F.concat(*(describe(k) for k in GENERATORS))).drop("_base", *_SIDES, *GENERATORS))


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, below: (feature, cut, low, high), above: same)."""

    bias: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, x: dict[str, int]) -> float:
        out = self.bias
        for f, cut, *sides in self.trees:
            g, c, low, high = sides[x[f] > cut]
            out += high if x[g] > c else low
        return out

    def column(self, s: Column) -> Column:
        """The score of a span as an expression."""
        out = F.lit(self.bias)
        for f, cut, below, above in self.trees:
            leaf = lambda side: F.when(s[side[0]] > side[1], side[3]).otherwise(side[2])
            out = out + F.when(s[f] > cut, leaf(above)).otherwise(leaf(below))
        return out


def _best_split(rows: list[tuple], grads: list[tuple[float, float]]) -> tuple:
    """(gain, feature, cut, low value, high value) by Newton steps."""
    g_all, h_all = sum(g for g, _ in grads), sum(h for _, h in grads)
    best = (0.0, FEATURES[0], 1 << 30, -g_all / (h_all + 1), -g_all / (h_all + 1))
    for k, f in enumerate(FEATURES):
        sums: dict[int, list[float]] = {}
        for (x, _, _), (g, h) in zip(rows, grads):
            cell = sums.setdefault(x[k], [0.0, 0.0])
            cell[0] += g
            cell[1] += h
        g_low = h_low = 0.0
        for cut in sorted(sums)[:-1]:
            g_low, h_low = g_low + sums[cut][0], h_low + sums[cut][1]
            g_high, h_high = g_all - g_low, h_all - h_low
            gain = g_low**2 / (h_low + 1) + g_high**2 / (h_high + 1) - g_all**2 / (h_all + 1)
            if gain > best[0] + 1e-9:
                best = (gain, f, cut, -g_low / (h_low + 1), -g_high / (h_high + 1))
    return best


def fit_trees(counts: list[tuple[tuple[int, ...], int, int]], rounds: int = 20, rate: float = 0.3, precision: float = 0.95, held: list[tuple[tuple[int, ...], int, int]] | None = None) -> Trees:
    """Fit on (feature vector, candidates, positives), and set each generator's threshold on ``held`` (without it, on the same)."""
    rows = sorted(counts)
    n, p = sum(c for _, c, _ in rows), sum(q for _, _, q in rows)
    model = Trees(math.log((p + 0.5) / (n - p + 0.5)))
    scores = [model.bias] * len(rows)
    for _ in range(rounds if rows else 0):
        prob = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in scores]
        grads = [(c * q - pos, c * q * (1 - q)) for (_, c, pos), q in zip(rows, prob)]
        _, f, cut, _, _ = _best_split(rows, grads)
        k, sides = FEATURES.index(f), []
        for above in (False, True):
            part = [i for i, (x, _, _) in enumerate(rows) if (x[k] > cut) == above]
            _, g, c, low, high = _best_split([rows[i] for i in part], [grads[i] for i in part])
            sides.append((g, c, rate * low, rate * high))
        model.trees.append((f, cut, *sides))
        scores = [model.score(dict(zip(FEATURES, x))) for x, _, _ in rows]
    judged = [(model.score(dict(zip(FEATURES, x))), x, c, q) for x, c, q in (rows if held is None else sorted(held))]
    for kind in GENERATORS:
        own = sorted(((s, c, q) for s, x, c, q in judged if x[0] == (kind == "number")), reverse=True)
        by_score: dict[float, list[int]] = {}
        for s, c, q in own:  # a threshold takes all of one score or none
            cell = by_score.setdefault(s, [0, 0])
            cell[0] += c
            cell[1] += q
        total = good = 0
        for s, (c, q) in by_score.items():
            total, good = total + c, good + q
            if not total:
                continue
            share = good / total
            low = (share + 1.92 / total - 1.96 * math.sqrt(share * (1 - share) / total + 0.9604 / total**2)) / (1 + 3.8416 / total)
            if low >= precision:
                model.thresholds[kind] = s - 1e-9
    return model


def fit_pii(docs: DataFrame, precision: float = 0.95) -> Trees:
    """Trees and thresholds from candidate counts over all of ``docs``; the driver gets one row for each feature vector."""
    rows = docs.select("text", (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0).alias("held"))
    spans = candidates(base_spans(rows)).where(F.size("proposed") > 0).select("held", F.explode("proposed").alias("s"))
    counts = spans.groupBy("held", *(F.col(f"s.{f}").alias(f) for f in FEATURES)).agg(F.count(F.lit(1)).alias("n"), F.sum("s.label").alias("positive")).collect()
    fold = lambda held: [(tuple(r[f] for f in FEATURES), r["n"], r["positive"]) for r in counts if r["held"] == held]
    return fit_trees(fold(False), precision=precision, held=fold(True))


def find_pii(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with body, an array column for each base kind, and ``added``: spans the trees select beyond them."""
    rows = candidates(base_spans(docs))
    keep = lambda s: ~s["base"] & F.coalesce(
        F.when(s["kind"] == "number", model.column(s) >= F.lit(model.thresholds.get("number", math.inf))).otherwise(model.column(s) >= F.lit(model.thresholds.get("secret", math.inf))),
        F.lit(False),
    )
    return rows.withColumn("added", F.transform(F.filter("proposed", keep), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))).drop("proposed")


def span_list(kinds: tuple[str, ...] = KINDS, added: bool = False) -> Column:
    """All spans of a row of ``find_pii`` as (kind, start, end), by kind and then start."""


    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*map(named, kinds), *([F.array_sort("added")] if added else []))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """``docs`` with each span of text replaced by its kind in brackets; a null text stays null. Overlapping spans become one."""
    packed = docs.select("text", F.struct(*docs.columns).alias("_row"))
    spans = F.array_sort(F.transform(span_list(added=True), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = find_pii(packed, model).select("_row", "text", "body", spans.alias("_spans"))
    rows = _ordered(rows, "_spans", F.size("_spans") > 0)
    # A merged span opens at the first span of a start where all earlier ones have ended, and closes at an end that nothing open goes beyond.
    opens = F.filter("_spans", lambda s, i: (F.coalesce(F.get("_starts", i - 1), F.lit(-1)) != s["start"]) & (_starts_before(s["start"]) == _ends_by(s["start"])))
    closes = F.array_distinct(F.filter("_ends", lambda x: _starts_before(x) == _ends_by(x)))
    rows = _fence(rows.withColumns({"_opens": opens, "_closes": closes}))
    piece = lambda s, i: F.concat(_cut(F.coalesce(F.get("_closes", i - 1), F.lit(0)), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
    whole = F.concat(F.array_join(F.transform("_opens", piece), ""), _cut(F.element_at("_closes", -1), F.length("body")))
    redacted = F.when(F.size("_spans") > 0, whole).otherwise(F.col("text"))
    return _fence(rows.select("_row", redacted.alias("_text"))).select(*(F.col("_text").alias("text") if c == "text" else F.col(f"_row.{c}") for c in docs.columns))
