"""Functions of strings over a small alphabet and of ordered arrays of such strings. All are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Each base, then its complement, in both cases; N stands for itself.
BASES, COMPLEMENTS = "ACGTacgtNn", "TGCAtgcaNn"


def reverse_complement(s: Column) -> Column:
    """Complement each base, leave other characters, and reverse."""
    return F.reverse(F.translate(s, BASES, COMPLEMENTS))


def normalize_dna(s: Column) -> Column:
    """Upper case A, C, G and T; every other character is N. The length stays (lower case is mapped before, so no character grows)."""
    return F.regexp_replace(F.translate(s, "acgt", "ACGT"), "[^ACGT]", "N")


def reverse_complement_array(arr: Column) -> Column:
    return F.transform(F.reverse(arr), reverse_complement)


def is_flipped(direction: Column) -> Column:
    """Only a lone minus sign, blanks around it aside, flips."""
    return F.coalesce(F.trim(direction) == "-", F.lit(False))


def orient(arr: Column, direction: Column) -> Column:
    return F.when(is_flipped(direction), reverse_complement_array(arr)).otherwise(arr)


def contains_run(outer: Column, inner: Column, outer2: Column, inner2: Column) -> Column:
    """inner is a contiguous part of outer and, at the same place, inner2 equals as many elements of outer2 as inner has."""
    k, n = F.size(inner), F.size(outer)
    # sequence(1, 0) would count down: guard it.
    starts = F.when((k > 0) & (n >= k), F.sequence(F.lit(1), n - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: (F.slice(outer, i, k) == inner) & (F.slice(outer2, i, k) == inner2))


def regions_of(regions: Column, kind: str, exact_case: bool = False) -> Column:
    """Sequences of the regions of a type, in order."""
    same = (lambda r: r["Type"] == kind) if exact_case else (lambda r: F.lower(r["Type"]) == kind.lower())
    return F.transform(F.filter(regions, same), lambda r: r["Sequence"])


def last_region(regions: Column, kind: str) -> Column:
    """Sequence of the last region of a type, empty if there is none."""
    return F.coalesce(F.try_element_at(regions_of(regions, kind), F.lit(-1)), F.lit(""))


def gc_fraction(s: Column) -> Column:
    """Share of upper-case G and C; 0 for the empty string."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(s, "[^GC]", "")).cast("double"), F.length(s)), F.lit(0.0))


def total_length(*arrays: Column) -> Column:
    """Characters in all elements of all arrays."""
    one = lambda a: F.aggregate(F.transform(a, F.length), F.lit(0).cast("long"), lambda x, y: x + y)
    return reduce(lambda a, b: a + b, map(one, arrays))


def round_half_even(x: Column, digits: int) -> Column:
    """Scale, round half to even, unscale."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def smooth_label(y: Column, epsilon: float) -> Column:
    return y * (1 - epsilon) + epsilon / 2


def deletion_fraction(fraction: Column, deleted: Column, source_count: Column) -> Column:
    """The stated fraction if positive, else deleted over source; null where neither is known."""
    return F.when(fraction > 0, fraction).when(source_count > 0, deleted.cast("double") / source_count)
