"""Image comparison: pixels that differ perceptibly, their share, and the band it falls in."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrill.operators.web import _mapped
from tallyrill.sources.images import decode_png, encode_png

# Fixed values of the published perceptual measure: the largest difference, squared and weighted,
# the weights of the three channels, and the channels' coefficients for red, green and blue.
LARGEST = 35215.0
WEIGHTS = (0.5053, 0.299, 0.1957)
YIQ = ((0.29889531, 0.58662247, 0.11448223), (0.59597799, -0.27417610, -0.32180189), (0.21147017, -0.52261711, 0.31114694))


def band(percent: Column) -> Column:
    """Of the rounded percentage."""
    return F.when(percent == 0, "identical").when(percent < 1, "minor").when(percent < 5, "moderate").otherwise("significant")


def percent(different: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(different / total * 100, 2)).otherwise(F.lit(0.0))


def _channels(px: np.ndarray) -> np.ndarray:
    """Brightness and colour channels of an image laid over white."""
    alpha = px[..., 3:4].astype(float) / 255
    return (255 + (px[..., :3].astype(float) - 255) * alpha) @ np.array(YIQ).T


def differing(a: np.ndarray, b: np.ndarray, threshold: float = 0.1) -> np.ndarray:
    """Where two images of one size differ by more than the threshold, as booleans; smooth edges count."""
    delta = (_channels(a) - _channels(b)) ** 2 @ np.array(WEIGHTS)
    return delta > LARGEST * threshold * threshold


def image_diff(pairs: DataFrame, id_col: str, first: str, second: str, threshold: float = 0.1, with_image: bool = False) -> DataFrame:
    """``id, width, height, total_pixels, different_pixels, percent, band`` (and the ``diff`` PNG) of pairs of PNGs.

    Images of different sizes are compared over the part that both have.
    """
    kind = pairs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for key, x, y in zip(batch[id_col], batch[first], batch[second], strict=True):
                a, b = decode_png(bytes(x)), decode_png(bytes(y))
                h, w = min(len(a), len(b)), min(a.shape[1], b.shape[1])
                out = differing(a[:h, :w], b[:h, :w], threshold)
                shown = np.where(out[..., None], np.array([255, 0, 0, 255]), np.array([255, 255, 255, 255])) if with_image else None
                rows.append((key, w, h, w * h, int(out.sum()), encode_png(shown) if with_image else None))
            yield pd.DataFrame(rows, columns=[id_col, "width", "height", "total_pixels", "different_pixels", "diff"])

    got = _mapped(pairs.select(id_col, first, second), run, f"{id_col} {kind}, width int, height int, total_pixels long, different_pixels long, diff binary")
    share = percent(F.col("different_pixels"), F.col("total_pixels"))
    got = got.withColumn("percent", share).withColumn("band", band(F.col("percent")))
    return got if with_image else got.drop("diff")


def channel_diff(pairs: DataFrame, id_col: str, first: str, second: str, tolerance: float) -> DataFrame:
    """The same figures for arrays of channel values: elements apart by more than the tolerance, over the shorter array.

    Arrays of floats are held against the tolerance as a float, so a difference that is the tolerance in their own precision is none.
    """
    kinds = {pairs.schema[c].dataType.elementType for c in (first, second)}
    most = F.lit(tolerance).cast("float" if kinds == {T.FloatType()} else "double")
    n = F.least(F.size(first), F.size(second))
    apart = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.abs(F.get(first, i) - F.get(second, i)) > most)
    counts = pairs.select(id_col, n.cast("long").alias("total_pixels"), F.when(n > 0, F.size(apart)).otherwise(0).cast("long").alias("different_pixels"))
    share = percent(F.col("different_pixels"), F.col("total_pixels"))
    return counts.withColumn("percent", share).withColumn("band", band(F.col("percent")))
