"""Severe-blur gate on luma grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.constants import MIN_EDGE_ENERGY


def edge_energy(pixels: Column, width: Column, height: Column) -> Column:
    """RMS of the 4-neighbour Laplacian over interior pixels of a row-major array.

    Works inside one row, so a table of images needs no shuffle. 0 when a side is below 3.
    """
    interior = F.filter(
        F.sequence(F.lit(0), F.size(pixels) - 1),
        lambda k: (k % width > 0) & (k % width < width - 1) & (k >= width) & (k < width * (height - 1)),
    )

    def laplacian(k):
        around = F.get(pixels, k - 1) + F.get(pixels, k + 1) + F.get(pixels, k - width) + F.get(pixels, k + width)
        return (4 * F.get(pixels, k) - around).cast("double")

    total = F.aggregate(F.transform(interior, laplacian), F.lit(0.0), lambda s, x: s + x * x)
    small = (width < 3) | (height < 3)
    return F.when(small, F.lit(0.0)).otherwise(F.sqrt(total / F.size(interior)))


def blur_reason(energy: Column) -> Column:
    return F.when(energy < MIN_EDGE_ENERGY, "severely blurry or blank")
