"""Rectangles of a page photo: cropping to the list, tiling of strips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .section import DEFAULT, Markers, absorbed_lines, is_crop_boundary, is_header


def half_up(c: Column) -> Column:
    """Rounded half towards plus infinity, to INT."""
    return F.floor(c + 0.5).cast("int")


def clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, least: tuple[int, int] = (80, 24)) -> Column:
    """A rectangle moved and cut to lie in the image, not smaller than ``least`` where the image allows."""
    w2 = F.least(F.greatest(w, F.lit(least[0])), width)
    h2 = F.least(F.greatest(h, F.lit(least[1])), height)
    x2 = F.greatest(F.lit(0), F.least(x, width - w2))
    y2 = F.greatest(F.lit(0), F.least(y, height - h2))
    return F.struct(half_up(x2).alias("x"), half_up(y2).alias("y"), half_up(w2).alias("width"), half_up(h2).alias("height"))


def scaled(rect: Column, factor: Column) -> Column:
    """A rectangle in the coordinates of an image scaled by ``factor``."""
    return F.struct(*[half_up(rect[k] * factor).alias(k) for k in ("x", "y", "width", "height")])


def list_crop(lines: Column, width: Column, height: Column, m: Markers = DEFAULT, most: int = 26) -> Column:
    """The rectangle round the ingredient list of ``lines``, structs of text, top, left, width and height.

    From the first line that belongs to the list, before the header where it wrapped there, down to the line before the next part of the
    label, ``most`` lines after the header at most; as wide as the image less 3 percent at either side, with 1.2 percent of the
    height above and below. Null without a header, and for a crop too small to read.
    """
    filled = F.filter(lines, lambda x: F.trim(x["text"]) != "")
    by_top = F.array_sort(F.transform(filled, lambda x: F.struct(x["top"].alias("top"), x["left"].alias("left"), x["text"].alias("text"), x["height"].alias("height"))))
    texts = F.transform(by_top, lambda x: x["text"])
    at = F.array_position(F.transform(texts, lambda x: is_header(x, m)), F.lit(True)).cast("int")
    rest = F.slice(by_top, at + 1, F.size(by_top))
    stop = F.array_position(F.transform(rest, lambda x: is_crop_boundary(x["text"], m)), F.lit(True)).cast("int")
    n = F.least(F.when(stop > 0, stop - 1).otherwise(F.size(rest)), F.lit(most))
    first, last = F.get(by_top, at - 1 - absorbed_lines(texts, at, m)), F.get(by_top, at - 1 + n)
    top, bottom = first["top"], last["top"] + last["height"]
    mx, my = half_up(width * 0.03), half_up(height * 0.012)
    y = F.greatest(F.lit(0), top - my)
    w, h = width - 2 * mx, F.least(height - y, bottom - top + 2 * my)
    return F.when((at > 0) & (bottom > top) & (w >= 80) & (h >= 24), clamped(mx, y, w, h, width, height))


def needs_tiles(width: Column, height: Column, chars: Column) -> Column:
    """A flat strip in which fewer characters were read than its width promises."""
    strip = (width / height >= 3) | (height < 240)
    return strip & (chars < F.greatest(F.lit(20), F.floor(width * 0.07 + 0.5)))


def tile_lefts(width: Column, tile: int = 800, overlap: int = 100) -> Column:
    """Left edges of overlapping tiles until one reaches the right edge."""
    step = tile - overlap
    last = F.greatest(F.lit(0), F.ceil((width - tile) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def tiles(width: Column, height: Column, tile: int = 800, overlap: int = 100) -> Column:
    """The tiles of a strip, from left to right."""
    return F.transform(tile_lefts(width, tile, overlap), lambda x: F.struct(x.cast("int").alias("x"), F.lit(0).alias("y"), F.least(F.lit(tile), width - x).cast("int").alias("width"), height.cast("int").alias("height")))
