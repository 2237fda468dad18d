"""Sets, hashes and geometry: overlaps, Hamming distance of 64-bit hashes, centres and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all values; 0 where either array is null or empty."""
    empty = (F.coalesce(F.size(a), F.lit(0)) <= 0) | (F.coalesce(F.size(b), F.lit(0)) <= 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def top_values(values: Column, n: int) -> Column:
    """The first n different values in order."""
    return F.slice(F.array_sort(F.array_distinct(values)), 1, n)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hexadecimal digits, half by half, as 64 bits unsigned fit no long."""

    def half(x: Column, at: int) -> Column:
        return F.conv(F.substring(x, at, 8), 16, 10).cast("long")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def document_hash(page_hashes: Column) -> Column:
    """SHA-256 over the pages' hashes, in order."""
    return F.sha2(F.array_join(page_hashes, ""), 256)


def sorted_json(m: Column) -> Column:
    """A map as JSON with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def centre(at: Column, size: Column, whole: Column) -> Column:
    """A box's centre as a share of the page."""
    return (at + size / 2) / F.greatest(whole, F.lit(1))


def region_of(y: Column, h: Column, page_h: Column) -> Column:
    """header, body, summary_band or footer, by the centre's height on the page."""
    c = centre(y, h, page_h)
    return F.when(c < 0.2, "header").when(c > 0.8, "footer").when(c > 0.6, "summary_band").otherwise("body")


def expanded(region: Column, buffer_x: Column, buffer_y: Column) -> Column:
    """A region (x, y, width, height in shares) grown by buffers on every side, within the page."""
    x, y = F.greatest(region["x"] - buffer_x, F.lit(0.0)), F.greatest(region["y"] - buffer_y, F.lit(0.0))
    right, low = F.least(region["x"] + region["width"] + buffer_x, F.lit(1.0)), F.least(region["y"] + region["height"] + buffer_y, F.lit(1.0))
    return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("width"), (low - y).alias("height"))


def inside(cx: Column, cy: Column, region: Column) -> Column:
    """Whether a centre is in a region, its edges included."""
    return cx.between(region["x"], region["x"] + region["width"]) & cy.between(region["y"], region["y"] + region["height"])


def position_prior(kind: Column, cx: Column, cy: Column) -> Column:
    """A small bonus where a field of that kind usually stands."""
    return (
        F.when(kind.isin("invoice_number", "invoice_date", "due_date"), F.when((cy < 0.35) & (cx > 0.45), 0.08).when(cy < 0.35, 0.05).otherwise(-0.03))
        .when(kind.isin("total", "subtotal", "tax"), F.when((cy > 0.5) & (cx > 0.4), 0.08).when(cy > 0.5, 0.04).otherwise(-0.03))
        .otherwise(0.0)
    )
