"""Palettes for clusters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hsv_rgb(hue: Column, s: float, v: float) -> tuple[Column, Column, Column]:
    """Red, green and blue (0 to 255, rounded down) of a hue in [0, 1)."""
    h = hue * 6
    sextant = F.floor(h) % 6
    f = h - F.floor(h)
    p, q, t = F.lit(v * (1 - s)), v * (1 - s * f), v * (1 - s * (1 - f))
    value = F.lit(float(v))
    order = {"r": (value, q, p, p, t, value), "g": (t, value, value, q, p, p), "b": (p, p, t, value, value, q)}

    def of(channel: str) -> Column:
        out = order[channel][5]
        for i in range(4, -1, -1):
            out = F.when(sextant == i, order[channel][i]).otherwise(out)
        return F.floor(out * 255).cast("long")

    return of("r"), of("g"), of("b")
