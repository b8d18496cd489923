"""Grey images as pixel arrays: conversion, resizing, gradients and oriented histograms.

Everything is an expression over one row's array (higher-order functions), so
images need neither a shuffle nor Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def grey_rgb888(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def grey_rgb565(word: Column) -> Column:
    r, g, b = F.shiftright(word, 11).bitwiseAND(31), F.shiftright(word, 5).bitwiseAND(63), word.bitwiseAND(31)
    return grey_rgb888(F.shiftleft(r, 3).bitwiseOR(F.shiftright(r, 2)), F.shiftleft(g, 2).bitwiseOR(F.shiftright(g, 4)), F.shiftleft(b, 3).bitwiseOR(F.shiftright(b, 2)))


def grey_yuv422(pixels: Column) -> Column:
    """Luma of interleaved Y, U, Y, V bytes."""
    return F.filter(pixels, lambda _, i: i % 2 == 0)


def pixel(image: Column, width: int, y: Column | int, x: Column | int) -> Column:
    at = (F.lit(y) if isinstance(y, int) else y) * width + (F.lit(x) if isinstance(x, int) else x) + 1
    return F.element_at(image, at.cast("int"))


def _grid(height: int, width: int, f) -> Column:
    """Array of f(y, x) in row order, unrolled: sizes are small and fixed."""
    return F.array(*[f(y, x) for y in range(height) for x in range(width)])


def _places(size: int, to: int) -> list[float]:
    return [i * size / to for i in range(to)]


def resize_nearest(image: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    return _grid(to_height, to_width, lambda y, x: pixel(image, width, y * height // to_height, x * width // to_width))


def resize_bilinear(image: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """Whole pixel values at places x * width / to_width, between the pixel there and the next one; cut, not rounded.

    What lies within 1e-6 of the next whole number counts as that number.
    """
    xs, ys = _places(width, to_width), _places(height, to_height)

    def at(y: int, x: int) -> Column:
        x0, y0 = min(int(xs[x]), width - 1), min(int(ys[y]), height - 1)
        x1, y1 = min(x0 + 1, width - 1), min(y0 + 1, height - 1)
        dx, dy = xs[x] - x0, ys[y] - y0
        p = lambda b, a: pixel(image, width, b, a).cast("double")
        mixed = p(y0, x0) * ((1 - dx) * (1 - dy)) + p(y0, x1) * (dx * (1 - dy)) + p(y1, x0) * ((1 - dx) * dy) + p(y1, x1) * (dx * dy)
        return F.least(F.greatest(F.floor(mixed + 1e-6), F.lit(0)), F.lit(255)).cast("int")

    return _grid(to_height, to_width, at)


def resize_area(image: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """Whole mean of the source pixels from the target's first place to where the next target begins, both included."""

    def at(y: int, x: int) -> Column:
        ys = range(y * height // to_height, min((y + 1) * height // to_height, height - 1) + 1)
        xs = range(x * width // to_width, min((x + 1) * width // to_width, width - 1) + 1)
        cells = [pixel(image, width, b, a).cast("long") for b in ys for a in xs]
        return F.floor(sum(cells[1:], cells[0]) / len(cells)).cast("int")

    return _grid(to_height, to_width, at)


RESIZE = {"nearest": resize_nearest, "bilinear": resize_bilinear, "area": resize_area}
#: Bytes of a pixel by format; fixed frame sizes of the camera configuration, (width, height).
BYTES = {"grayscale": 1, "rgb565": 2, "rgb888": 3, "yuv422": 2}
FRAMES = {"96x96": (96, 96), "qqvga": (160, 120), "qcif": (176, 144), "hqvga": (240, 176), "240x240": (240, 240), "qvga": (320, 240), "cif": (400, 296), "hvga": (480, 320), "vga": (640, 480), "svga": (800, 600), "xga": (1024, 768), "hd": (1280, 720), "sxga": (1280, 1024), "uxga": (1600, 1200)}


def to_grey(raw: Column, form: str) -> Column:
    """Grey pixels of interleaved bytes in one of the formats."""
    if form == "grayscale":
        return raw
    if form == "yuv422":
        return grey_yuv422(raw)
    n = BYTES[form]
    at = F.sequence(F.lit(0), (F.size(raw) / n).cast("int") - 1)
    byte = lambda i, k: F.element_at(raw, i * n + k + 1)
    if form == "rgb565":  # high byte first
        return F.transform(at, lambda i: grey_rgb565(byte(i, 0) * 256 + byte(i, 1)))
    return F.transform(at, lambda i: grey_rgb888(byte(i, 0), byte(i, 1), byte(i, 2)))


def check_config(width: int, height: int, form: str, to_width: int, to_height: int, method: str = "nearest", cell: int = 4, block: int = 2) -> dict[str, int]:
    """Sizes of the buffers that a pipeline needs; raises where the settings cannot work."""
    if form not in BYTES or method not in RESIZE:
        raise ValueError(f"unknown format {form!r} or method {method!r}")
    if min(width, height, to_width, to_height, cell, block) <= 0:
        raise ValueError("sizes must be positive")
    if to_width % cell or to_height % cell or to_width // cell < block or to_height // cell < block:
        raise ValueError("the resized image must hold whole cells, and a block of them at least")
    if form == "yuv422" and width % 2:
        raise ValueError("rows of YUV 4:2:2 have an even number of pixels")
    return {"input": width * height * BYTES[form], "grey": width * height, "output": to_width * to_height}


def pipeline(raw: Column, width: int, height: int, form: str, to_width: int, to_height: int, method: str = "nearest") -> Column:
    """Bytes of a frame to grey pixels of the wanted size; null where the number of bytes is wrong."""
    sizes = check_config(width, height, form, to_width, to_height, method, 1, 1)
    grey = _let(to_grey(raw, form), lambda g: g if (width, height) == (to_width, to_height) else RESIZE[method](g, width, height, to_width, to_height))
    return F.when(F.size(raw) == sizes["input"], grey)


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def gradients(image: Column, width: int, height: int) -> Column:
    """Array of (at, magnitude, angle in 0..2 pi) of every pixel off the border, by central differences."""
    inner = F.lit([y * width + x for y in range(1, height - 1) for x in range(1, width - 1)])

    def differences(p: Column) -> Column:
        side = lambda d: F.element_at(image, p + 1 + d).cast("double")
        return F.struct(p.alias("at"), (side(1) - side(-1)).alias("gx"), (side(width) - side(-width)).alias("gy"))

    def polar(g: Column) -> Column:
        angle = F.atan2(g["gy"], g["gx"])
        return F.struct(g["at"].alias("at"), F.sqrt(g["gx"] * g["gx"] + g["gy"] * g["gy"]).alias("magnitude"), F.when(angle < 0, angle + 2 * math.pi).otherwise(angle).alias("angle"))

    return F.transform(F.transform(inner, differences), polar)


def cell_histograms(image: Column, width: int, height: int, cell: int = 4, orientations: int = 4) -> Column:
    """Magnitudes by orientation in each cell: array of cells x orientations, row order."""
    across, down = width // cell, height // cell

    def place(g: Column) -> Column:
        y, x = F.floor(g["at"] / width / cell), F.floor(g["at"] % width / cell)
        o = F.least(F.floor(g["angle"] / (2 * math.pi / orientations)), F.lit(orientations - 1))
        inside = (y < down) & (x < across)
        return F.struct(F.when(inside, (y * across + x) * orientations + o).cast("int").alias("i"), g["magnitude"].alias("m"))

    zero = F.lit([0.0] * (across * down * orientations))
    placed = F.transform(gradients(image, width, height), place)
    return F.aggregate(placed, zero, lambda acc, g: F.transform(acc, lambda v, i: v + F.when(i == g["i"], g["m"]).otherwise(0.0)))


def blocks(cells: Column, across: int, down: int, orientations: int = 4, size: int = 2, stride: int = 1) -> Column:
    """Blocks of size x size cells, each scaled to unit length (plus 1e-6 below), laid end to end."""
    places = [
        [((by + y) * across + bx + x) * orientations + o + 1 for y in range(size) for x in range(size) for o in range(orientations)]
        for by in range(0, down - size + 1, stride)
        for bx in range(0, across - size + 1, stride)
    ]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-6
    unit = lambda v: _let(norm(v), lambda n: F.transform(v, lambda x: x / n))
    each = F.array(*[F.lit(p) for p in places])
    return _let(cells, lambda c: F.flatten(F.transform(each, lambda p: _let(F.transform(p, lambda k: F.element_at(c, k)), unit))))


def hog(image: Column, width: int, height: int, cell: int = 4, orientations: int = 4, size: int = 2, stride: int = 1) -> Column:
    return blocks(cell_histograms(image, width, height, cell, orientations), width // cell, height // cell, orientations, size, stride)
