"""Perceptual hashes over coefficient blocks, as Column expressions: symmetries, bits, bands, distances."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANTS = 8


def variant_hash(block: str, variant: int, side=8) -> Column:
    """One hash of at most 64 bits of a side x side block: bit i tells whether coefficient i + 1 is above the
    median of all but the first. Bit 2 of variant swaps rows and columns, then bit 0 turns the sign of odd
    columns and bit 1 that of odd rows: the block of the turned or mirrored picture."""
    n = side * side
    place = f"(i % {side}) * {side} + i div {side}" if variant & 4 else "i"
    sign = " * ".join(["1"] + [f"if({x} % 2 = 1, -1, 1)" for bit, x in ((1, f"(i % {side})"), (2, f"(i div {side})")) if variant & bit])
    moved = f"transform(sequence(1, {n - 1}), i -> {block}[{place}] * ({sign}))"
    middle = f"sort_array(m)[{(n - 2) // 2}]"
    bits = f"aggregate(zip_with(m, sequence(0, {n - 2}), (x, k) -> if(x > {middle.replace('sort_array(m)', 's')}, shiftleft(1L, k), 0L)), 0L, (a, x) -> a | x)"
    return F.expr(f"element_at(transform(array({moved}), m -> element_at(transform(array(sort_array(m)), s -> {bits}), 1)), 1)")


def bands(word, width=16, total=64) -> Column:
    """Array of the bands of a hash word, lowest bits first."""
    word = F.col(word) if isinstance(word, str) else word
    return F.array(*[F.shiftrightunsigned(word, k).bitwiseAND(F.lit((1 << width) - 1)).cast("int") for k in range(0, total, width)])


def hamming(a, b) -> Column:
    """Differing bits of two words, or of two arrays of four words."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hamming_words(a, b, n=4) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return reduce(lambda x, y: x + y, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(n)]).cast("int")


def hamming_any(variants, other, n=4) -> Column:
    """Least distance of any variant (array of words, or of arrays of words) to the other's hash."""
    other = F.col(other) if isinstance(other, str) else other
    one = (lambda v: hamming_words(v, other, n)) if n > 1 else (lambda v: hamming(v, other))
    return F.array_min(F.transform(variants, one))


def ring_weighted(rings) -> Column:
    """Colour signature with the two colour axes of each ring four times as heavy."""
    return F.transform(rings, lambda x, i: x * F.when((i % 4).isin(1, 2), F.lit(4.0)).otherwise(F.lit(1.0)))


def ring_distance(a, b) -> Column:
    """Root of the mean squared difference of two weighted signatures; infinite for one that is empty or
    of another length."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)), F.sqrt(total / F.size(a))).otherwise(F.lit(float("inf")))
