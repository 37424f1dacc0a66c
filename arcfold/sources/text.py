"""Graphs as text: one vertex (id [value]) or edge (src dst [value]) a line, split at single white-space characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Parser = str | Callable[[Column], Column]
#: Parsers by name: Spark types that a field is cast to; a field that does not parse raises.
SCALARS = {"integer": "int", "long": "bigint", "float": "float", "double": "double", "string": "string"}
#: (id, value) types of the ready-made importers.
PRESETS = {"long_long": ("long", "long"), "long_double": ("long", "double")}


def parse(field: Column, parser: Parser) -> Column:
    return field.cast(SCALARS.get(parser, parser)) if isinstance(parser, str) else parser(field)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s").alias("f"))


def read_vertices(spark: SparkSession, path: str, id_parser: Parser = "long", value_parser: Parser = "long") -> DataFrame:
    """(id, value); a missing value is null."""
    return _fields(spark, path).select(parse(F.get("f", F.lit(0)), id_parser).alias("id"), parse(F.get("f", F.lit(1)), value_parser).alias("value"))


def read_edges(spark: SparkSession, path: str, id_parser: Parser = "long", value_parser: Parser = "long") -> DataFrame:
    """(src, dst, value)"""
    f = [F.get("f", F.lit(i)) for i in range(3)]
    return _fields(spark, path).select(
        parse(f[0], id_parser).alias("src"), parse(f[1], id_parser).alias("dst"),
        parse(f[2], value_parser).alias("value"),
    )


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, value) of lines user item rating: ids are (type, id), users of type 0, items of type 1."""
    return typed_ratings(read_edges(spark, path, "long", "float").toDF("user", "item", "rating"))


def typed_ratings(ratings: DataFrame) -> DataFrame:
    end = lambda kind, c: F.struct(F.lit(kind).cast("tinyint").alias("type"), F.col(c).cast("long").alias("id"))
    return ratings.select(end(0, "user").alias("src"), end(1, "item").alias("dst"), F.col("rating").cast("float").alias("value"))


def show_rating_id(c: Column) -> Column:
    """(id, type), as such ids print."""
    return F.format_string("(%d, %d)", c["id"], c["type"])


def parse_rating_id(c: Column) -> Column:
    """The id that show_rating_id() printed."""
    part = lambda i: F.regexp_extract(c, r"\((-?\d+), (-?\d+)\)", i)
    return F.struct(part(2).cast("tinyint").alias("type"), part(1).cast("long").alias("id"))


def _line(*columns: str) -> Column:
    """Columns with blanks between; a null at the end leaves no blank."""
    return F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value")


def write_vertices(vertices: DataFrame, path: str) -> None:
    """Lines of id, a blank and value; the id alone where the value is null, which reads back as null."""
    vertices.select(_line("id", "value")).write.text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """Lines of src, dst and value."""
    edges.select(_line("src", "dst", "value")).write.text(path)


def preset(name: str) -> tuple[str, str]:
    """The (id, value) parsers of a ready-made importer."""
    if name not in PRESETS:
        raise ValueError(f"no importer {name}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]
