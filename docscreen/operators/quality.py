"""Image quality: pixel statistics by NumPy, rules by SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = "laplacian double, brightness double, contrast double, glare double, width int, height int"


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows of BGR (or gray) bytes as gray levels."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels >= 3:
        return np.rint(a[..., 0] * 0.114 + a[..., 1] * 0.587 + a[..., 2] * 0.299)
    return a[..., 0].astype(float)


def pixel_stats(data: bytes, height: int, width: int, channels: int) -> tuple[float, float, float, float]:
    """Laplacian variance, mean, deviation and percentage of near-white pixels of rows of BGR bytes."""
    g = gray(data, height, width, channels)
    edge = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    lap = edge[:-2, 1:-1] + edge[2:, 1:-1] + edge[1:-1, :-2] + edge[1:-1, 2:] - 4 * g
    return float(lap.var()), float(g.mean()), float(g.std()), float((g >= 245).mean() * 100)


def with_stats(images: DataFrame) -> DataFrame:
    """Rows of the ``image`` source with its path and pixel statistics; the only step that leaves the JVM."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, *pixel_stats(bytes(d), h, w, c), w, h) for o, h, w, c, d in zip(b.origin, b.height, b.width, b.nChannels, b["data"])]
            yield pd.DataFrame(rows, columns=["origin", "laplacian", "brightness", "contrast", "glare", "width", "height"])

    from ..sources.packaging import ship

    ship(images.sparkSession)
    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, f"origin string, {STATS}")


def blur_status(laplacian: Column) -> Column:
    return F.when(laplacian < 80, "BLURRY").when(laplacian < 200, "MODERATE").otherwise("SHARP")


def lighting_warning(brightness: Column, glare: Column) -> Column:
    washed = F.concat(F.lit("Image is washed out / glare detected ("), F.round(glare, 1).cast("string"), F.lit("% saturated)."))
    return F.when(brightness < 50, "Image is very dark / underexposed.").when((brightness > 220) | (glare > 15.0), washed)


def report(laplacian: Column, brightness: Column, contrast: Column, glare: Column, width: Column, height: Column) -> Column:
    """Quality record of the statistics."""
    blur, light = blur_status(laplacian), lighting_warning(brightness, glare)
    score = F.lit(100.0) - F.when(blur == "BLURRY", 35.0).when(blur == "MODERATE", 10.0).otherwise(0.0) - F.when(light.isNotNull(), 20.0).otherwise(0.0) - F.when((width >= 400) & (height >= 300), 0.0).otherwise(25.0)
    score = F.greatest(F.lit(10.0), F.least(F.lit(100.0), score))
    return F.struct(
        F.round(score, 2).alias("quality_score"),
        blur.alias("blur_status"),
        F.round(laplacian, 2).alias("laplacian_variance"),
        F.round(brightness, 2).alias("brightness"),
        F.round(contrast, 2).alias("contrast"),
        F.round(glare, 2).alias("glare_percentage"),
        F.concat_ws("x", width.cast("string"), height.cast("string")).alias("resolution"),
        (score >= 50.0).alias("is_acceptable"),
        F.array_compact(F.array(F.when(blur == "BLURRY", "Image is noticeably blurry; OCR accuracy may be reduced."), light)).alias("warnings"),
    )


def skew_angle(rect_angle: Column, n_points: Column) -> Column:
    """Correction angle of a least-area rectangle: normalized to (-45, 45], 0 for under half a degree, over 30 degrees or under 100 points."""
    angle = F.when(rect_angle < -45, -(rect_angle + 90)).when(rect_angle > 45, -(rect_angle - 90)).otherwise(-rect_angle)
    return F.when(n_points.isNull(), None).when((n_points < 100) | (F.abs(angle) < 0.5) | (F.abs(angle) > 30.0), 0.0).otherwise(F.round(angle, 2))
