"""Table access by name (SRC-11) and the schema registry (UDF-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """SRC-11: full scan of one table; column pruning and filters are pushed
    into the Parquet reader by Catalyst when the caller selects / filters."""
    if name not in TEST_TABLES and name not in SCHEMAS:
        raise KeyError(name)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


# Relational model of the claim-matching store (§1.2): name -> (schema, natural key).
_ts = T.TimestampType()
SCHEMAS: dict[str, tuple[T.StructType, list[str]]] = {}


def register_table(name: str, schema: T.StructType, key: list[str]):
    """UDF-07: registry entry; unknown names raise KeyError on lookup."""
    SCHEMAS[name] = (schema, key)
    return schema


def table_schema(name: str) -> T.StructType:
    return SCHEMAS[name][0]


def natural_key(name: str) -> list[str]:
    return SCHEMAS[name][1]


register_table("label", T.StructType([
    T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType(), False),
    T.StructField("misc", T.StringType()), T.StructField("date", _ts, False)]), ["id"])
register_table("reference", T.StructType([
    T.StructField("url", T.StringType(), False), T.StructField("misc", T.StringType()),
    T.StructField("date", _ts)]), ["url"])
register_table("model", T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType(), False),
    T.StructField("human", T.BooleanType(), False), T.StructField("config", T.StringType(), False),
    T.StructField("desc", T.StringType()), T.StructField("date", _ts)]), ["id"])
register_table("source", T.StructType([
    T.StructField("type", T.StringType(), False), T.StructField("date", _ts)]), ["type"])
register_table("misinformation", T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("text", T.StringType(), False),
    T.StructField("url", T.StringType()), T.StructField("source", T.StringType(), False),
    T.StructField("reliability", T.DoubleType(), False), T.StructField("misc", T.StringType()),
    T.StructField("date", _ts)]), ["text"])
register_table("input", T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("text", T.StringType(), False),
    T.StructField("source_type", T.StringType(), False), T.StructField("source_id", T.StringType(), False),
    T.StructField("misc", T.StringType()), T.StructField("date", _ts)]), ["source_id"])
register_table("output", T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("input_id", T.LongType()),
    T.StructField("model_id", T.StringType()), T.StructField("misinfo_id", T.LongType()),
    T.StructField("label_id", T.IntegerType()), T.StructField("confidence", T.DoubleType(), False),
    T.StructField("misc", T.StringType()), T.StructField("date", _ts)]), ["id"])
register_table("article", T.StructType([
    T.StructField("category", T.StringType(), False), T.StructField("url", T.StringType(), False),
    T.StructField("title", T.StringType(), False), T.StructField("publishedAt", T.StringType(), False),
    T.StructField("addedAt", _ts, False)]), ["category", "url"])
