"""Components of pixels, by way of their runs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import runs


def components(mask: DataFrame, connectivity: int = 8, tile: int = runs.TILE) -> DataFrame:
    """mask (image_id, .., y, x) -> with first: a struct (y, x) of its component's first pixel in raster order.

    Columns besides image_id, y and x are taken as part of what separates masks (such as a class or a mask key).
    """
    found = runs.decode(runs.components(runs.encode(mask), connectivity, tile))
    return found.select(*runs.keys(mask), "y", "x", "first")
