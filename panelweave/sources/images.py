"""Metrics of images: size, grey variance, edge density, channel means and deviations, and mask coverage.

Spark's image source decodes on the JVM; numpy measures a few images at a time in each task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = 24
METRICS = "path string, decodable boolean, width int, height int, grayscale_variance double, edge_density double, rgb_mean array<double>, rgb_std array<double>, nonzero_ratio double"


def rgb_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Rows of RGB from the source's BGR, BGRA or grey bytes."""
    held = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(held, 3, axis=2) if channels == 1 else held[:, :, 2::-1]


def grey_of(rgb: np.ndarray) -> np.ndarray:
    """Luma by the ITU-R 601 weights in 16-bit fixed point, rounded."""
    return ((rgb.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.int64)


def edge_density(grey: np.ndarray, threshold: int = EDGE) -> float:
    """Share of inner pixels whose contrast to the eight around them exceeds the threshold."""
    height, width = grey.shape
    if height <= 2 or width <= 2:
        return float((grey > threshold).mean())
    around = sum(grey[1 + y : height - 1 + y, 1 + x : width - 1 + x] for y in (-1, 0, 1) for x in (-1, 0, 1))
    return float((np.clip(9 * grey[1:-1, 1:-1] - around, 0, 255) > threshold).mean())


def _row(path: str, height: int, width: int, channels: int, data: bytes, threshold: int) -> tuple:
    if height < 0:
        return path, False, None, None, None, None, None, None, None
    rgb = rgb_of(height, width, channels, data)
    grey = grey_of(rgb)
    spread = lambda f: [round(float(x), 6) for x in f(rgb.reshape(-1, 3).astype(np.float64), axis=0)]
    return path, True, width, height, round(float(grey.var()), 6), round(edge_density(grey, threshold), 6), spread(np.mean), spread(np.std), round(float((grey > 0).mean()), 6)


def image_metrics(spark: SparkSession, path: str, threshold: int = EDGE) -> DataFrame:
    """One row an image file; those that cannot be decoded have null metrics."""

    def work(frames):
        for frame in frames:
            rows = [_row(*row, threshold) for row in frame.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METRICS.split(", ")])

    read = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return read.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(work, METRICS)


def mask_faults(masks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Masks whose measured share differs from the recorded one, whose size is not the page's, or that cover everything. masks: path, nonzero_ratio, width, height, ratio, page_width, page_height."""
    faults = F.array(F.when(F.abs(F.col("nonzero_ratio") - F.col("ratio")) > tolerance, "ratio_differs"), F.when((F.col("width") != F.col("page_width")) | (F.col("height") != F.col("page_height")), "size_differs"), F.when(F.col("nonzero_ratio") == 1.0, "mask_is_full"))
    return masks.select("path", F.explode(F.array_compact(faults)).alias("fault"))


def compared(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows for the preflight: pairs of (candidate, original) paths with their metrics and differences; pairs may have policy and ocr_ok."""
    side = lambda name: metrics.select(F.col("path").alias(name), F.struct(*(c for c in metrics.columns if c != "path")).alias(f"m_{name}"))
    both = pairs.join(side("candidate"), "candidate", "left").join(side("original"), "original", "left")
    a, b = F.col("m_candidate"), F.col("m_original")
    most = lambda f: F.round(F.array_max(F.zip_with(a[f], b[f], lambda x, y: F.abs(x - y))), 6)
    decoded = lambda m: F.coalesce(m["decodable"], F.lit(False))
    return both.select(
        *pairs.columns, decoded(a).alias("candidate_ok"), decoded(b).alias("original_ok"), ((a["width"] == b["width"]) & (a["height"] == b["height"])).alias("same_size"), a["grayscale_variance"].alias("variance"),
        F.round(F.abs(a["edge_density"] - b["edge_density"]), 6).alias("edge_delta"), most("rgb_mean").alias("mean_delta"), most("rgb_std").alias("std_delta"),
    )
