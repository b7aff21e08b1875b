"""JSON of any shape as VARIANT: numbers, lists and nested objects stay what they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key under which some records hold their fields.
INNER = "$.extracted_data"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob, matches anything."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, damaged): one row for each file. One that holds no JSON has a null value and its text in ``damaged``; a path that doesn't exist is one row with neither."""
    if not exists(spark, path):
        return spark.range(1).select(F.lit(path).alias("path"), F.try_parse_json(F.lit(None).cast("string")).alias("value"), F.lit(None).cast("string").alias("damaged"))
    text = spark.read.option("wholetext", "true").text(path)
    value = F.try_parse_json("value")
    return text.select(F.col("_metadata.file_path").alias("path"), value.alias("parsed"), "value").select("path", F.col("parsed").alias("value"), F.when(F.col("parsed").isNull(), F.col("value")).alias("damaged"))


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def record(v: Column) -> Column:
    """The object that holds a record's fields: its extracted_data if that is an object, else the record itself; null without an object."""
    inner = F.try_variant_get(v, INNER, "variant")
    return F.when(is_object(inner), inner).when(is_object(v), v)


def fields(rows: DataFrame, v: str) -> DataFrame:
    """rows with (key, field) for each field of the object in column v, a VARIANT as it was; rows without an object have none."""
    each = rows.sparkSession.tvf.variant_explode(F.col(v).outer()).toDF("pos", "key", "field")
    return rows.where(is_object(F.col(v))).lateralJoin(each).drop("pos")


def get(v: Column, name: str, kind: str = "string") -> Column:
    """A field as a type; null if it is absent or of another type."""
    return F.try_variant_get(record(v), f"$.{name}", kind)
