"""Slots for external models: what goes in, what comes out, and nothing if no model is plugged in.

A model takes a list of values at once. It is loaded once in each Python worker, however many tasks the worker
runs, and gets the values of an Arrow batch in lists of ``Model.batch``. If a list makes it fail, its values are tried one by one;
those that fail alone give null in the slot's column and the reason in a column beside it. Nothing else fails with them.

A resource profile (``pyspark.resource.ResourceProfile``) puts the stage on executors of its own, with
accelerators or more memory, where the cluster allocates executors dynamically.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.packaging import ship

#: Type of each slot's result; every one takes an image's bytes.
SLOTS = {
    "ocr": "array<string>",  # the text of each pass, see text.union_passes
    "zone_text": "string",  # a zone reader's raw text, see pipeline.with_zone_text
    "zone_record": "struct<type:string,number:string,surname:string,names:string,nationality:string,date_of_birth:string,sex:string,expiration_date:string,valid_score:double,valid_number:boolean,valid_date_of_birth:boolean,valid_expiration_date:boolean>",
    "faces": "array<struct<x:int,y:int,w:int,h:int,conf:double>>",
    "cascade_faces": "array<struct<x:int,y:int,w:int,h:int>>",
    "embedding": "array<float>",
    "preprocessed": "binary",
    "skew_rectangle": "struct<angle:double,n_points:int>",
}

#: Of this process: loaded models by name.
_LOADED: dict[str, Callable[[list], Sequence]] = {}


@dataclass(frozen=True)
class Model:
    """load() gives a function of a list of values that returns as many results; name tells models (and their versions) apart."""

    name: str
    load: Callable[[], Callable[[list], Sequence]]
    batch: int = 32

    def loaded(self) -> Callable[[list], Sequence]:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]


def each(name: str, one: Callable[[Any], Any]) -> Model:
    """A model that is a function of one value."""
    return Model(name, lambda: lambda values: [one(v) for v in values], 1)


def predict(model: Model, values: list, kind: pa.DataType) -> tuple[pa.Array, list[str | None]]:
    """Results and reasons of failure of values; null gives null without a reason."""
    results, reasons = [None] * len(values), [None] * len(values)
    given = [k for k, v in enumerate(values) if v is not None]

    def run(some: list[int]) -> None:
        out = list(function([values[k] for k in some]))
        if len(out) != len(some):
            raise ValueError(f"{model.name} gave {len(out)} results for {len(some)} values")
        pa.array(out, kind)  # a result of another type is a failure too
        for k, x in zip(some, out):
            results[k] = x

    try:
        function = model.loaded()
    except Exception as e:
        return pa.nulls(len(values), kind), [None if v is None else _reason(e) for v in values]
    for s in range(0, len(given), model.batch):
        part = given[s : s + model.batch]
        try:
            run(part)
        except Exception as whole:
            for k in part:
                try:
                    if len(part) == 1:
                        raise whole
                    run([k])
                except Exception as e:
                    reasons[k] = _reason(e)
    return pa.array(results, kind), reasons


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def fill(docs: DataFrame, slot: str, model: Model | None = None, content: str = "content", name: str | None = None, keep_content: bool = True, profile: ResourceProfile | None = None) -> DataFrame:
    """docs with the slot's column and ``<name>_error``; both null without a model. Works on streams too.

    keep_content: whether the input goes on; if not, its bytes don't come back from Python.
    """
    name, kind = name or slot, SLOTS[slot]
    error = f"{name}_error"
    kept = [c for c in docs.columns if c not in (name, error) and (keep_content or c != content)]
    if model is None:
        return docs.select(*kept, F.lit(None).cast(kind).alias(name), F.lit(None).cast("string").alias(error))
    spark = docs.sparkSession
    ship(spark)
    # The slot's Arrow type, as Spark itself has it.
    arrow = spark.createDataFrame([], f"x {kind}").toArrow().schema.field("x").type
    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c].simpleString()}" for c in kept), f"`{name}` {kind}", f"`{error}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            results, reasons = predict(model, b.column(content).to_pylist(), arrow)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), results, pa.array(reasons, pa.string())], [*kept, name, error])

    return docs.select(*dict.fromkeys([*kept, content])).mapInArrow(run, schema, profile=profile)


# --- images -------------------------------------------------------------------


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of rows of gray, BGR or BGRA pixels of eight bits."""
    height, width = pixels.shape[:2]
    pixels = pixels.reshape(height, width, -1)
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[pixels.shape[2]]
    rows = np.zeros((height, 1 + width * len(order)), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = pixels[:, :, order].reshape(height, -1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[len(order)], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def with_crop(images: DataFrame, box: str = "box", image: str = "image", name: str = "face_png") -> DataFrame:
    """images with the part of an ``image`` struct (see read_images) within the struct ``box`` (x1, y1, x2, y2) as a PNG file; null without area. The image's own pixels don't come back."""
    ship(images.sparkSession)
    kept = [c for c in images.columns if c not in (image, name)]
    types = {f.name: f.dataType.simpleString() for f in images.schema.fields}

    def cut(i: dict | None, b: dict | None) -> bytes | None:
        if i is None or b is None or None in b.values() or b["x2"] <= b["x1"] or b["y2"] <= b["y1"]:
            return None
        pixels = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])
        return png(pixels[b["y1"] : b["y2"], b["x1"] : b["x2"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a row at a time, as an image may be large
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), pa.array([cut(row.column(image)[0].as_py(), row.column(box)[0].as_py())], pa.binary())], [*kept, name])

    return images.select(*kept, image).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{name}` binary"]))
