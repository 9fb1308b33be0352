"""Column functions on sequences. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """Upper case, without white space."""
    return F.upper(F.regexp_replace(_col(x), r"\s", ""))


def is_valid(x: Column | str) -> Column:
    """Only A, C, G, T, and at least one of them."""
    return _col(x).rlike("^[ACGT]+$")


def complement(x: Column | str) -> Column:
    """A-T and C-G swapped; other letters (the end mark too) stay."""
    return F.translate(_col(x), "ACGT", "TGCA")


def reverse_complement(x: Column | str) -> Column:
    return F.reverse(complement(x))


def canonical(x: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement."""
    return F.least(_col(x), reverse_complement(x))


def lex_rank(x: Column | str) -> Column:
    """Rank of a k-mer among all of its length, from 1 (k up to 31)."""
    return F.conv(F.translate(_col(x), BASES, "0123"), 4, 10).cast("long") + 1


def unrank(x: Column | str, k: int) -> Column:
    """The k-mer of a rank."""
    return F.translate(F.lpad(F.conv((_col(x) - 1).cast("string"), 10, 4), k, "0"), "0123", BASES)


def code_reverse_complement(x: Column | str, k: int) -> Column:
    """Reverse complement of a two-bit code (rank from 0)."""
    return lex_rank(reverse_complement(unrank(_col(x) + 1, k))) - 1


def canonical_number(k: Column | str) -> Column:
    """How many canonical k-mers there are."""
    k = _col(k)
    return F.when(k % 2 == 1, F.pow(F.lit(4.0), k) / 2).otherwise((F.pow(F.lit(4.0), k) + F.pow(F.lit(2.0), k)) / 2).cast("long")


def trim_n(x: Column | str) -> Column:
    """Without N or n at either end."""
    return F.regexp_replace(_col(x), "^[Nn]+|[Nn]+$", "")


def mask_low_quality(seq: Column | str, qual: Column | str, least: int, offset: int = 33) -> Column:
    """N for each base whose quality is below ``least``."""
    bases, marks = F.split(_col(seq), ""), F.split(_col(qual), "")
    return F.array_join(F.zip_with(bases, marks, lambda b, q: F.when(F.ascii(q) - offset < least, F.lit("N")).otherwise(b)), "")


def segments(x: Column | str, least: int) -> Column:
    """Runs of A, C, G, T of at least ``least`` bases."""
    return F.filter(F.split(_col(x), "[^ACGT]+"), lambda s: F.length(s) >= F.lit(max(1, least)))


def cut_even_palindrome(x: Column | str) -> Column:
    """Without the first base where the sequence equals its reverse complement."""
    x = _col(x)
    return F.when(x == reverse_complement(x), F.substring(x, 2, 1 << 30)).otherwise(x)


def base_codes(x: Column | str) -> Column:
    """$ACGTN as 0 to 5, case ignored; any other letter as 5."""
    return F.translate(F.regexp_replace(F.upper(_col(x)), "[^$ACGTN]", "N"), "$ACGTN", "012345")


def normalise(v: Column | str) -> Column:
    """A vector over its sum; null where the sum is zero."""
    v = _col(v)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(total != 0, F.transform(v, lambda x: x / total))


def first_letters(x: Column | str) -> Column:
    """The leading letters of a line: one sequence a line."""
    return F.regexp_extract(_col(x), "^[A-Za-z]*", 0)


def to_binary(x: Column | str, width: int) -> Column:
    """A whole number as ``width`` binary digits."""
    return F.lpad(F.bin(_col(x)), width, "0")


def from_binary(x: Column | str) -> Column:
    """The number of a string of binary digits."""
    return F.conv(_col(x), 2, 10).cast("long")


def packed(x: Column | str, words: int = 4) -> Column:
    """Up to 32 bases a word in ``words`` longs, two bits a base (A 0, C 1, G 2, T 3), the last base lowest. A longer sequence is an error."""
    fits = F.when(F.length(_col(x)) <= 32 * words, _col(x)).when(_col(x).isNotNull(), F.raise_error(F.lit(f"more than {32 * words} bases do not fit in {words} words")))
    x = fits
    digits = F.lpad(F.translate(_col(x), BASES, "0123"), 32 * words, "0")
    return F.array(*(F.conv(F.substring(digits, F.lit(32 * w + 1), F.lit(32)), 4, -10).cast("long") for w in range(words)))


def packed_shift(x: Column | str, bases: int | Column) -> Column:
    """A packed sequence moved up by ``bases``, or down where negative; bases that leave are lost. A column of bases is 0 or more."""
    x = _col(x)
    if isinstance(bases, Column):
        words, over = F.floor(bases / 32).cast("int"), (2 * (bases % 32)).cast("int")
        word = lambda i: F.coalesce(F.get(x, i), F.lit(0).cast("long"))
        low = lambda i: F.when(over > 0, F.call_function("shiftrightunsigned", word(i), 64 - over)).otherwise(F.lit(0).cast("long"))
        return F.transform(x, lambda _, i: F.call_function("shiftleft", word(i + words), over).bitwiseOR(low(i + words + 1)))
    far, bits = divmod(2 * abs(bases), 64)
    at = lambda i: F.coalesce(F.when(i >= 0, F.get(x, i)), F.lit(0).cast("long"))
    if bases >= 0:
        return F.transform(x, lambda _, i: F.shiftleft(at(i + far), bits).bitwiseOR(F.shiftrightunsigned(at(i + far + 1), 64 - bits) if bits else F.lit(0).cast("long")))
    return F.transform(x, lambda _, i: F.shiftrightunsigned(at(i - far), bits).bitwiseOR(F.shiftleft(at(i - far - 1), 64 - bits) if bits else F.lit(0).cast("long")))


def packed_and(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a.bitwiseAND(b))


def packed_or(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a.bitwiseOR(b))


def packed_xor(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(_col(x), _col(y), lambda a, b: a.bitwiseXOR(b))


def packed_less(x: Column | str, y: Column | str) -> Column:
    """Whether a packed sequence is smaller, as a number without sign."""
    flip = lambda v: F.transform(_col(v), lambda a: a.bitwiseXOR(F.lit(-(1 << 63))))
    return flip(x) < flip(y)


def nonzero_bases(x: Column | str) -> Column:
    """How many bases of a packed sequence are not A; of an exclusive-or: how many differ."""
    low = F.lit(0x5555555555555555)
    return F.aggregate(F.transform(_col(x), lambda a: F.bit_count(a.bitwiseOR(F.shiftrightunsigned(a, 1)).bitwiseAND(low))), F.lit(0), lambda s, n: s + n)
