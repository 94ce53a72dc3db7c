"""Reading and writing tables: delimited text, JSON in three shapes, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabularium.operators.common import without_nan

#: Tried in this order where no encoding is given.
ENCODINGS = ("utf-8", "iso-8859-1")
REPLACEMENT = "�"


def read_table(spark: SparkSession, path: str, fmt: str | None = None, encoding: str | None = None) -> DataFrame:
    """A table from a file or folder; fmt: csv, tsv, json or parquet (by the path's ending if not given).

    Text has a header row. Without an encoding, UTF-8 is read, and latin-1 if that leaves characters that can't be decoded. JSON may be an
    array (or lines) of records, one object of column arrays, or an object with one list of records; nested objects become `a.b` columns.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "parquet":
        return without_nan(spark.read.parquet(path))
    if fmt == "json":
        return without_nan(_records(spark.read.option("multiLine", True).json(path)))
    if fmt not in ("csv", "tsv"):
        raise ValueError(f"unknown format: {fmt}")
    reader = spark.read.option("header", True).option("inferSchema", True).option("sep", "\t" if fmt == "tsv" else ",")
    for name in (encoding,) if encoding else ENCODINGS:
        df = reader.option("encoding", name).csv(path)
        text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        broken = F.lit(False)
        for c in text:
            broken = broken | F.coalesce(F.contains(F.col(f"`{c}`"), F.lit(REPLACEMENT)), F.lit(False))
        if encoding or name == ENCODINGS[-1] or not any(REPLACEMENT in c for c in df.columns) and (not text or df.where(broken).isEmpty()):
            break
    return without_nan(df.toDF(*(c.removeprefix("﻿") for c in df.columns)))


def _records(df: DataFrame) -> DataFrame:
    lists = [f for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    wrapped = [f for f in lists if isinstance(f.dataType.elementType, T.StructType)]
    if len(wrapped) == 1:
        df = df.select(F.explode(F.col(f"`{wrapped[0].name}`")).alias("r")).select("r.*")
    elif lists and len(lists) == len(df.columns):
        df = df.select(F.explode(F.arrays_zip(*(F.col(f"`{f.name}`") for f in lists))).alias("r")).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in lists))
    return flatten(df)


def flatten(df: DataFrame) -> DataFrame:
    """Fields of structs as columns `a.b`, at any depth."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}.{g}") for g in f.dataType.names]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a table (csv and tsv with a header), in place of what the path holds."""
    writer = df.write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        writer.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        writer.format(fmt).save(path)
