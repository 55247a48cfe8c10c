"""Image and pair features, as Column expressions.

Values that are single precision by contract are computed in double precision
and cast where they are kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order is a contract with the classifier.
FEATURES = ("d_ahash", "d_dhash", "d_phash", "dim_ratio", "aspect_delta", "size_ratio", "hist_distance", "brightness_delta", "contrast_delta", "d_dhash_oriented")
BINS = 64


def _float(c: Column) -> Column:
    return c.cast("float")


def histogram(r: Column, g: Column, b: Column, n: int) -> Column:
    """Shares of pixels by colour, four levels to a channel: 64 bins of FLOAT."""
    bins = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.shiftright(F.element_at(r, i), 6) * 16 + F.shiftright(F.element_at(g, i), 6) * 4 + F.shiftright(F.element_at(b, i), 6))
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: _float(F.size(F.filter(bins, lambda x: x == k)) / F.lit(n)))


def luma(r: Column, g: Column, b: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(r, i) * 0.299 + F.element_at(g, i) * 0.587 + F.element_at(b, i) * 0.114)


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def contrast_of(values: Column) -> Column:
    """The population's standard deviation."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v) / F.size(values)
    return F.sqrt(F.greatest(F.lit(0.0), squares - F.pow(mean_of(values), 2)))


def hist_distance(a: Column, b: Column) -> Column:
    """1 less the shared area of two histograms, between 0 and 1."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0).cast("float"), lambda s, v: (s + v).cast("float"))
    return _float(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - shared.cast("double"))))


def _ratio(a: Column, b: Column) -> Column:
    x, y = F.greatest(F.lit(1).cast("long"), a.cast("long")), F.greatest(F.lit(1).cast("long"), b.cast("long"))
    return _float(F.least(x, y) / F.greatest(x, y))


def dim_ratio(wa: Column, ha: Column, wb: Column, hb: Column) -> Column:
    return _ratio(wa.cast("long") * ha.cast("long"), wb.cast("long") * hb.cast("long"))


def size_ratio(a: Column, b: Column) -> Column:
    return _ratio(a, b)


def aspect_delta(wa: Column, ha: Column, wb: Column, hb: Column) -> Column:
    aspect = lambda w, h: F.greatest(F.lit(1e-6), w.cast("double") / F.greatest(F.lit(1), h).cast("double"))
    return _float(F.abs(F.log(aspect(wa, ha) / aspect(wb, hb))))


def brightness_delta(a: Column, b: Column) -> Column:
    return _float(F.abs(a.cast("double") - b.cast("double")) / 255)


def contrast_delta(a: Column, b: Column) -> Column:
    return _float(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(a.cast("double") - b.cast("double")) / 128)))
