"""Array columns: sequences, chunks, zips, running sums, Hamming matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(values: Column) -> Column:
    """Neighbouring equal items as one."""
    return F.filter(values, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(values, i - 1)))


def run_lengths(values: Column) -> Column:
    """Lengths of the runs of neighbouring equal items."""
    starts = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == 0) | ~F.get(values, i).eqNullSafe(F.get(values, i - 1)))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(values)))
    return F.when(F.size(values) > 0, F.zip_with(starts, ends, lambda a, b: b - a)).otherwise(F.expr("cast(array() as array<int>)"))


def running_sum(values: Column) -> Column:
    """Sums of the items up to each one."""
    empty = F.expr("cast(array() as array<double>)")
    return F.aggregate(values, empty, _append)


def _append(acc: Column, x: Column) -> Column:
    last = F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0.0))
    return F.concat(acc, F.array(last + x.cast("double")))


def chunks(values: Column, size: int) -> Column:
    """The items in pieces of a size, the last one shorter."""
    cut = F.transform(F.sequence(F.lit(0), F.size(values) - 1, F.lit(size)), lambda i: F.slice(values, i + 1, size))
    return F.when(F.size(values) > 0, cut)


def zip_to(a: Column, b: Column, length: Column, fill: Column) -> Column:
    """struct(a, b) up to a length; what is missing is filled."""
    at = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(F.coalesce(F.get(a, i), fill).alias("a"), F.coalesce(F.get(b, i), fill).alias("b")))
    return F.when(length > 0, at)


def middle_index(n: Column) -> Column:
    """The middle position of n, the lower one of two."""
    return F.ceil(n / 2) - 1


def mismatches(a: Column, b: Column) -> Column:
    """Positions at which arrays of one length differ."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))


def hamming_matches(values: Column, pattern: Column, most: int = 0) -> Column:
    """struct(start, window, wrong) for every window of the pattern's length with at most so many mismatches, overlapping ones too."""
    starts = F.sequence(F.lit(0), F.size(values) - F.size(pattern))
    windows = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(values, i + 1, F.size(pattern)).alias("window")))
    judged = F.transform(windows, lambda w: F.struct(w["start"].alias("start"), w["window"].alias("window"), mismatches(pattern, w["window"]).alias("wrong")))
    return F.when((F.size(values) >= F.size(pattern)) & (F.size(pattern) > 0), F.filter(judged, lambda w: F.size(w["wrong"]) <= most))


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def squared_error(a: Column, b: Column) -> Column:
    """Mean squared difference of the items."""
    return F.try_divide(F.pow(euclidean_distance(a, b), 2), F.size(a))


def collapse_constant(items: Column) -> Column:
    """The array, or its one element alone if all its elements are alike (null counts as a value); an empty array stays."""
    first = F.get(items, F.lit(0))
    alike = F.forall(items, lambda x: x.eqNullSafe(first))
    return F.when(alike, F.slice(items, 1, 1)).otherwise(items)
