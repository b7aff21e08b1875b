"""Face geometry, similarity, risk and liveness rules over boxes, vectors and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
DETECT_LEAST, PAD_DOCUMENT, PAD_LIVE = 0.6, 0.25, 0.15
CLOSED, LEAST_RUN = 0.22, 2
TIMEOUT_S, STABLE_FRAMES = 15.0, 90
RISK = {"match": 0, "no_match": 40, "error": 50, "no_face": 50, "no_camera": 45, "no_live": 50}


def prominent(boxes: DataFrame, least: float = DETECT_LEAST) -> DataFrame:
    """The largest box of each image among those of enough confidence, the first of equals. boxes: (image_id, pos, x, y, w, h, conf, …)."""
    best = F.max_by(F.struct(*boxes.columns), F.struct(F.col("w") * F.col("h"), -F.col("pos")))
    return boxes.where(F.col("conf") >= least).groupBy("image_id").agg(best.alias("b")).select("b.*")


def pad_box(x: Column, y: Column, w: Column, h: Column, img_w: Column, img_h: Column, ratio: float = PAD_DOCUMENT) -> Column:
    """Struct x1, y1, x2, y2 of a box widened by a ratio on each side (toward zero), within the image."""
    dx, dy = (w * F.lit(ratio)).cast("int"), (h * F.lit(ratio)).cast("int")
    zero = F.lit(0)
    return F.struct(F.greatest(zero, x - dx).alias("x1"), F.greatest(zero, y - dy).alias("y1"), F.least(img_w, x + w + dx).alias("x2"), F.least(img_h, y + h + dy).alias("y2"))


def has_area(box: Column) -> Column:
    return (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])


def first_backend(boxes: list[tuple[str, Column]], img_w: Column, img_h: Column) -> Column:
    """Struct (x, y, w, h, backend) of the first detector that gave a box; one without size is the whole image; without any the whole image too."""
    whole = lambda name: F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), img_w.alias("w"), img_h.alias("h"), F.lit(name).alias("backend"))
    out = F
    for name, b in boxes:
        sized = F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"), F.lit(name).alias("backend"))
        out = out.when(b.isNotNull(), F.when((b["w"] <= 0) | (b["h"] <= 0), whole(name)).otherwise(sized))
    return out.otherwise(whole("fallback_full_image"))


def large_enough(w: Column, h: Column, least: int = 60) -> Column:
    """Whether a cascade detector's box is of its least size."""
    return (w >= least) & (h >= least)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def match(a: Column, b: Column, threshold: float) -> Column:
    """Struct of similarity in percent, distance, whether they match (distance within the threshold), and risk; null vectors are an error."""
    d = cosine_distance(a, b)
    ok = d <= threshold
    return F.when(
        d.isNull(), F.struct(F.lit("ERROR").alias("status"), F.lit(False).alias("is_match"), F.lit(0.0).alias("similarity_percentage"), F.lit(None).cast("double").alias("cosine_distance"), F.lit(RISK["error"]).alias("risk_score"))
    ).otherwise(
        F.struct(
            F.lit("SUCCESS").alias("status"),
            ok.alias("is_match"),
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round((1 - d) * 100, 2))).alias("similarity_percentage"),
            F.round(d, 4).alias("cosine_distance"),
            F.when(ok, RISK["match"]).otherwise(RISK["no_match"]).alias("risk_score"),
        )
    )


def case_risk(extracted: Column, camera: Column, live: Column, matched: Column) -> Column:
    """Struct (status, risk_score) of a case: no document face, no capture, no live photo, then the match. camera: captured, null if none is used."""
    fail = lambda k: F.struct(F.lit("FAIL").alias("status"), F.lit(RISK[k]).alias("risk_score"))
    return (
        F.when(~extracted, fail("no_face"))
        .when(camera.isNotNull() & ~camera, fail("no_camera"))
        .when(camera.isNull() & ~live, fail("no_live"))
        .otherwise(F.struct(F.when(matched["is_match"], "SUCCESS").otherwise("FLAGGED").alias("status"), matched["risk_score"].alias("risk_score")))
    )


def eye_aspect_ratio(points: Column, img_w: Column, img_h: Column) -> Column:
    """Of six points (x, y as shares of the image), cut to whole pixels."""

    def length(i: int, j: int) -> Column:
        px = lambda k, axis, size: (points[k][axis] * size).cast("int")
        dx, dy = px(i, "x", img_w) - px(j, "x", img_w), px(i, "y", img_h) - px(j, "y", img_h)
        return F.sqrt((dx * dx + dy * dy).cast("double"))

    across = length(0, 3)
    return F.when(across == 0, 0.0).otherwise((length(1, 5) + length(2, 4)) / (2.0 * across))


def blinks(frames: DataFrame, closed: float = CLOSED, least: int = LEAST_RUN) -> DataFrame:
    """(session_id, ts) of each frame at which the eyes open after a run of at least ``least`` closed frames.

    frames: (session_id, ts, ear, has_face). Frames without a face are passed over; a run that never ends isn't counted.
    """
    w = Window.partitionBy("session_id").orderBy("ts")
    seen = frames.where("has_face").withColumn("shut", F.col("ear") < closed)
    # Open frames number the islands: closed frames between two of them share a number.
    island = seen.withColumn("island", F.coalesce(F.sum(F.when(F.col("shut"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum(F.when(F.col("shut"), 1).otherwise(0)).over(Window.partitionBy("session_id", "island"))
    return island.withColumn("run", run).where(~F.col("shut") & (F.col("run") >= least)).select("session_id", "ts")


def liveness(frames: DataFrame, closed: float = CLOSED, least: int = LEAST_RUN) -> DataFrame:
    """Per session: whether a blink was seen, and the first one's frame."""
    first = blinks(frames, closed, least).groupBy("session_id").agg(F.min("ts").alias("captured_at"))
    return frames.select("session_id").distinct().join(first, "session_id", "left").select("session_id", F.col("captured_at").isNotNull().alias("liveness_verified"), "captured_at")


def auto_capture(frames: DataFrame, timeout: float = TIMEOUT_S, stable: int = STABLE_FRAMES) -> DataFrame:
    """Per session how the capture loop ends. frames: (session_id, ts, key). Per frame: timeout, then keys (space takes, q cancels), then the counter."""
    w = Window.partitionBy("session_id").orderBy("ts")
    numbered = frames.withColumn("n", F.row_number().over(w)).withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    numbered = numbered.withColumn("elapsed", (F.col("micros") - F.first("micros").over(w)) / 1e6)
    end = F.when(F.col("elapsed") > timeout, "timeout").when(F.col("key") == " ", "key").when(F.col("key") == "q", "cancelled").when(F.col("n") > stable, "auto")
    ended = numbered.withColumn("end", end).where("end is not null").groupBy("session_id").agg(F.min_by(F.struct("end", "n", "ts"), "n").alias("e"))
    all_ = frames.select("session_id").distinct().join(ended, "session_id", "left")
    return all_.select("session_id", F.coalesce("e.end", F.lit("stream_end")).alias("ended_by"), F.coalesce(F.col("e.end").isin("key", "auto"), F.lit(False)).alias("captured"), F.col("e.n").alias("frame"))
