"""Page expressions: text clean-up, which pages need recognition, and at what resolution to render them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import trimmed

SPARSE_WORDS, SPARSE_CHARACTERS, LEAST_COVERAGE = 4, 24, 0.25
DPI, LEAST_DPI, PAGE_PIXELS, SIDE_PIXELS = 200, 72, 25_000_000, 10_000


def page_text(text: Column) -> Column:
    """Lines without white space at their ends; blank lines go."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), trimmed)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def image_coverage(width: Column, height: Column, images: Column) -> Column:
    """The part of the page that its largest image (x0, x1, top, bottom) covers, 1 at most."""
    zero = F.lit(0.0)

    def area(i: Column) -> Column:
        across = F.least(width, F.greatest(i["x0"], i["x1"])) - F.greatest(zero, F.least(i["x0"], i["x1"]))
        down = F.least(height, F.greatest(i["top"], i["bottom"])) - F.greatest(zero, F.least(i["top"], i["bottom"]))
        return F.greatest(zero, across) * F.greatest(zero, down)

    largest = F.coalesce(F.array_max(F.transform(images, area)), zero)
    return F.least(F.lit(1.0), largest / F.greatest(width * height, F.lit(1.0)))


def needs_recognition(words: Column, characters: Column, coverage: Column) -> Column:
    """A page with hardly any text and a large image."""
    return ((words <= SPARSE_WORDS) | (characters <= SPARSE_CHARACTERS)) & (coverage >= LEAST_COVERAGE)


def render_dpi(width: Column, height: Column, rotation: Column, pixels_left: Column, dpi: int = DPI, least: int = LEAST_DPI) -> Column:
    """The highest whole resolution whose rounded-up image keeps within all caps; null if there is none.

    width and height are in points. Some hundred resolutions at most are tried, inside the expression.
    """
    turned = rotation % 180 != 0
    w, h = F.when(turned, height).otherwise(width).cast("double"), F.when(turned, width).otherwise(height).cast("double")
    cap = F.least(F.lit(PAGE_PIXELS).cast("long"), pixels_left.cast("long"))
    side = lambda x, d: F.greatest(F.lit(1).cast("long"), F.ceil(x * d / 72.0).cast("long"))
    fits = lambda d: (side(w, d) <= SIDE_PIXELS) & (side(h, d) <= SIDE_PIXELS) & (side(w, d) * side(h, d) <= cap)
    good = F.array_max(F.filter(F.sequence(F.lit(least), F.lit(dpi)), fits))
    return F.when((w > 0) & (h > 0) & (cap > 0), good)
