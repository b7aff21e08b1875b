"""Skew of a page image: dark pixels by Otsu's threshold, the least-area rectangle around them, and rotation back.

The rectangle comes from the convex hull of the dark pixels by rotating calipers; the rule that turns its angle into a
correction is ``quality.skew_angle``, a column expression. Images go through a task one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.packaging import ship
from .quality import gray, skew_angle

RECTANGLE = "struct<angle:double,n_points:int>"
#: Weight of the outer taps of the cubic kernel; pixels that are resampled at once; rounds that thin out a hull's points.
CUBIC, STRIP, ROUNDS = -0.75, 1 << 15, 4
#: Once a block of this size was freed, glibc keeps smaller ones at hand; else each array of an image is paged in anew, which takes longer than its use.
KEPT = 1 << 24


def otsu(pixels: np.ndarray) -> int:
    """The level that parts the histogram into two classes with the greatest variance between them; the darker class includes it."""
    n = np.bincount(pixels.ravel().astype(np.uint8), minlength=256).astype(float)
    below, sums = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (sums / below - (sums[-1] - sums) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points (x, y) in order, each once."""
    points = points[np.lexsort((points[:, 1], points[:, 0]))]
    # Of the points with one x only the least and the greatest can be corners.
    step = np.flatnonzero(points[1:, 0] != points[:-1, 0])
    low, high = points[np.concatenate([[0], step + 1])], points[np.concatenate([step, [len(points) - 1]])][::-1]

    def chain(some: np.ndarray) -> list:
        # A point that isn't outside of its neighbours' line is no corner; a few rounds leave little to the loop.
        for _ in range(ROUNDS):
            d = np.diff(some, axis=0)
            turns = d[:-1, 0] * d[1:, 1] > d[:-1, 1] * d[1:, 0]
            if turns.all():
                break
            some = some[np.concatenate([[True], turns, [True]])]
        out: list = []
        for x, y in some.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out

    there, back = chain(low), chain(high)
    there += back[there[-1] == back[0] :]
    return np.array(there[:-1] if len(there) > 1 and there[-1] == there[0] else there, float)


def least_rectangle(points: np.ndarray) -> float:
    """Angle in degrees, from 0 to under 90, of the sides of the rectangle of least area around points (x, y)."""
    corners = hull(points)
    if len(corners) < 3:
        d = corners[-1] - corners[0]
        return float(np.degrees(np.arctan2(d[1], d[0])) % 90)
    sides = np.roll(corners, -1, axis=0) - corners
    along = sides / np.hypot(*sides.T)[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    area = np.ptp(along @ corners.T, axis=1) * np.ptp(across @ corners.T, axis=1)
    best = along[area.argmin()]
    return float(np.degrees(np.arctan2(best[1], best[0])) % 90)


def rectangle(pixels: np.ndarray) -> tuple[float, int]:
    """Angle of the least-area rectangle of the dark pixels, as (row, column) points, and their number. pixels: gray."""
    dark = pixels <= otsu(pixels)
    n = int(np.count_nonzero(dark))
    if not n:
        return 0.0, 0
    # Of each row only the first and last dark pixel can be a corner.
    rows = np.flatnonzero(dark.any(axis=1))
    first, last = dark[rows].argmax(axis=1), dark.shape[1] - 1 - dark[rows, ::-1].argmax(axis=1)
    return least_rectangle(np.stack([np.concatenate([rows, rows]), np.concatenate([first, last])], axis=1)), n


def rotate(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned counter-clockwise about its centre, of the same size: cubic resampling, the border's pixels beyond it."""
    height, width = pixels.shape[:2]
    inner = pixels.reshape(height, width, -1)
    image = np.empty((height + 6, width + 6, inner.shape[2]), np.uint8)
    image[3:-3, 3:-3], image[3:-3, :3], image[3:-3, -3:] = inner, inner[:, :1], inner[:, -1:]
    image[:3], image[-3:] = image[3], image[-4]
    # The weights add up to 1: where all 16 neighbours are equal, so is the result, and only the others are computed.
    high, low = image, image
    for axis in (0, 1):
        high, low = _four(np.maximum, high, axis), _four(np.minimum, low, axis)
    uneven = np.zeros(image.shape[:2], bool)
    uneven[:-3, :-3] = (high != low).any(axis=2)
    flat, across = image.reshape(-1, image.shape[2]), width + 6
    planes = np.ascontiguousarray(flat.T).astype(np.float32)
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    cx, cy = width // 2, height // 2
    out, x, rows = np.empty((height, width, image.shape[2]), np.uint8), np.arange(width) - cx, max(1, STRIP // width)
    for top in range(0, height, rows):
        y = np.arange(top, min(height, top + rows))[:, None] - cy
        at_x, at_y = c * x - s * y + cx, s * x + c * y + cy
        left, up = np.floor(at_x), np.floor(at_y)
        # The first of the 16 neighbours; beyond two pixels from the image all are the border's.
        at = (np.clip(up, -2, height) * across + np.clip(left, -2, width) + (2 * across + 2)).astype(np.intp)
        strip = flat[at]
        odd = np.flatnonzero(uneven.ravel()[at])
        first, wx, wy = at.ravel()[odd], _cubic((at_x - left).ravel()[odd]), _cubic((at_y - up).ravel()[odd])
        weights = [(wy[j] * wx[i]).astype(np.float32) for j in range(4) for i in range(4)]
        for k, plane in enumerate(planes):
            total = np.zeros(len(odd), np.float32)
            for n, weight in enumerate(weights):
                total += weight * plane[n // 4 * across + n % 4 :].take(first)
            strip.reshape(-1, len(planes))[odd, k] = np.clip(np.rint(total), 0, 255)
        out[top : top + rows] = strip
    return out.reshape(pixels.shape)


def _four(best: np.ufunc, image: np.ndarray, axis: int) -> np.ndarray:
    """The greatest or least of each four neighbours along an axis."""
    image = image.swapaxes(0, axis)
    two = best(image[:-1], image[1:])
    return best(two[:-2], two[2:]).swapaxes(0, axis)


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four neighbours of a place t past the second."""
    a = CUBIC
    w0, w1 = ((a * (t + 1) - 5 * a) * (t + 1) + 8 * a) * (t + 1) - 4 * a, ((a + 2) * t - (a + 3)) * t * t + 1
    u = 1 - t
    w2 = ((a + 2) * u - (a + 3)) * u * u + 1
    return [w0, w1, w2, 1 - w0 - w1 - w2]


def with_skew(images: DataFrame, image: str = "image", name: str = "skew", turned: str | None = None, pixels: bool = True) -> DataFrame:
    """images with a struct of the rectangle's angle and number of dark pixels (null for null), and the correction in degrees as ``<name>_angle``.

    turned: a column of degrees; the struct is that of the image turned back by it, as ``straighten`` does. pixels: whether the images go on.
    """
    ship(images.sparkSession)
    kept = [c for c in images.columns if pixels or c != image]

    def measure(i: dict | None, degrees: float | None) -> dict | None:
        if i is None:
            return None
        if degrees:
            i = _turned(i, degrees)
        shown = gray(i["data"], i["height"], i["width"], i["nChannels"]) if i["nChannels"] > 1 else np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"])
        return dict(zip(("angle", "n_points"), rectangle(shown)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(KEPT, np.uint8)
        for b in batches:
            pages = b.column(image)
            found = [measure(pages[k].as_py(), b.column(turned)[k].as_py() if turned else None) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found, pa.struct([("angle", pa.float64()), ("n_points", pa.int32())]))], [*kept, name])

    types = {f.name: f.dataType.simpleString() for f in images.schema.fields}
    found = images.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{name}` {RECTANGLE}"]))
    return found.withColumn(f"{name}_angle", skew_angle(F.col(name)["angle"], F.col(name)["n_points"]))


def _turned(i: dict, degrees: float) -> dict:
    return i | {"data": rotate(np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"]), degrees).tobytes()}


def straighten(images: DataFrame, image: str = "image", angle: str = "skew_angle") -> DataFrame:
    """images turned back by the angle, in the ``image`` struct; an angle of 0 or null leaves the image as it is."""
    ship(images.sparkSession)
    kept, at = images.columns, images.columns.index(image)
    types = {f.name: f.dataType.simpleString() for f in images.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(KEPT, np.uint8)
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                i, degrees = row.column(image)[0].as_py(), row.column(angle)[0].as_py()
                if i is not None and degrees:
                    row = row.set_column(at, image, pa.array([_turned(i, degrees)], row.schema.field(at).type))
                yield row

    return images.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept))
