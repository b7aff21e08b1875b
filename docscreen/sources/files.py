"""File sources: images, bytes, JSON and a landing directory as a stream."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import BATCH_EXTENSIONS, MAX_BYTES, UPLOAD_EXTENSIONS, validate_files
from .packaging import ship
from .shared import save, shared_path


def read_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = BATCH_EXTENSIONS, largest: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of a directory's files with these extensions, in any case. largest is pushed into the scan."""
    glob = "*{" + ",".join(sorted({e for x in extensions for e in (x, x.upper())})) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= largest) if largest is not None else files


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """The ``image`` struct (origin, height, width, nChannels, mode, BGR data) of each file."""
    return spark.read.format("image").option("dropInvalid", str(drop_invalid).lower()).load(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, strict: bool = False) -> DataFrame:
    """JSON objects: damaged ones are null rows, or with strict an error."""
    reader = spark.read.option("multiLine", "true").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(filename, field, value) of a JSON object of objects."""
    text = spark.read.option("wholetext", "true").text(path)
    files = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("filename", "fields"))
    return files.select("filename", F.explode("fields").alias("field", "value"))


def _bounded(read, largest: int = MAX_BYTES) -> DataFrame:
    """Files of any length; the content of those that are too large isn't read and null."""
    small, large = read().where(F.col("length") <= largest), read().where(F.col("length") > largest)
    return small.unionByName(large.select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content")))


def _store(path: str):
    """The file system of a path or URI, the path there, and what the URI has before it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:"), ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.partition("://")[0] + "://"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each directory, or the file itself: (path, modificationTime, length, directory, read_error). A directory that can't be listed is a row with a reason."""
    from pyarrow import fs

    for b in batches:
        for path in b.column(0).to_pylist():
            rows, error = [], None
            try:
                store, inner, before = _store(path)
                at = store.get_file_info(inner)
                found = store.get_file_info(fs.FileSelector(inner)) if at.type == fs.FileType.Directory else [at]
                rows = [(before + i.path, i.mtime if i.type == fs.FileType.File else None, i.size if i.type == fs.FileType.File else None, i.type == fs.FileType.Directory, None) for i in found]
            except Exception as e:
                rows, error = [], f"{type(e).__name__}: {e}"[:500]
            rows = rows if error is None else [(path, None, None, False, error)]
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000]), _LISTED.types)], schema=_LISTED)


_LISTED = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("directory", pa.bool_()), ("read_error", pa.string())])
LISTED = "path string, modificationTime timestamp, length long, directory boolean, read_error string"


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = BATCH_EXTENSIONS, depth: int = 100) -> DataFrame:
    """(path, modificationTime, length, read_error) of the files with these extensions below a directory, a file or a glob of either: empty ones too. Each directory is listed by a task; the driver
    only resolves the glob and counts the directories of each level."""
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    todo, levels = spark.createDataFrame([(p,) for p in _roots(spark, path)], "path string"), []
    for _ in range(depth):
        level = save(todo.repartition(cores).mapInArrow(_listed, LISTED), shared_path(spark, "listing"))
        levels.append(level)
        todo = level.where("directory").select("path")
        if todo.isEmpty():
            break
    found = reduce(DataFrame.unionAll, levels).where("not directory").drop("directory")
    return found.where(F.lower("path").rlike("(" + "|".join(re.escape(x) for x in extensions) + ")$") | F.col("read_error").isNotNull())


def _roots(spark: SparkSession, path: str) -> list[str]:
    """The paths that a glob matches, as the file system finds them; a path without one is itself, whether it exists or not."""
    if not re.search(r"[*?\[{]", path):
        return [path]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return [re.sub("^file:/+", "/", f.getPath().toString()) for f in found]


def open_files(listed: DataFrame, largest: int = MAX_BYTES, task_bytes: int = 128_000_000) -> DataFrame:
    """(path, modificationTime, length, content, read_error): each listed file read by a task. One that can't be read has a null content and the reason, one
    that has gone meanwhile a null length too; one that is too large isn't read."""
    spark = listed.sparkSession
    ship(spark)
    total = listed.agg(F.sum(F.least("length", F.lit(largest)))).first()[0] or 0
    columns = ["path", "modificationTime", "length", "read_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a file at a time: it may be large
                row, content = {c: b.column(c)[k].as_py() for c in columns}, None
                if row["length"] is not None and row["length"] <= largest:
                    try:
                        store, inner, _ = _store(row["path"])
                        with store.open_input_stream(inner) as f:
                            content = f.read()
                        row["length"] = len(content)
                    except FileNotFoundError as e:
                        row |= {"length": None, "read_error": f"FileNotFoundError: {e}"[:500]}
                    except Exception as e:
                        row["read_error"] = f"{type(e).__name__}: {e}"[:500]
                parts = [pa.array([x], t) for x, t in zip((row["path"], row["modificationTime"], row["length"], content, row["read_error"]), (pa.string(), _LISTED.types[1], pa.int64(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays(parts, ["path", "modificationTime", "length", "content", "read_error"])

    dealt = listed.select(*columns).repartition(max(spark.sparkContext.defaultParallelism, math.ceil(total / task_bytes)))
    return dealt.mapInArrow(run, "path string, modificationTime timestamp, length long, content binary, read_error string")


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] = BATCH_EXTENSIONS, strict: bool = False) -> DataFrame:
    """The files of a directory or glob, each with its own error, message and code (null if it is good), and why it couldn't be read: a file that is empty, unreadable or has gone
    since the listing is a row like any other. A path that doesn't exist is one row with ERR_FILE_NOT_FOUND. Needs a store that ``pyarrow.fs`` knows."""
    return validate_files(open_files(list_files(spark, path, extensions)), strict)


def landing_stream(spark: SparkSession, path: str, per_batch: int = 100) -> DataFrame:
    """New files of a directory as a stream of (path, modificationTime, length, content), to be validated; those that are too large have no content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _bounded(lambda: spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path))


def uploads(files: DataFrame, strict: bool = False) -> DataFrame:
    """Files of an upload service, which takes fewer formats than a scan."""
    return validate_files(files, strict, UPLOAD_EXTENSIONS)
