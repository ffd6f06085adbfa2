"""File sources and sinks: text scans with provenance, pinned scans, nested columns as text, manifests, fold stores, strict JSON."""

from __future__ import annotations

import hashlib
import json
import math
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A folder of CSV files with every field as text, nothing turned to NULL, plus source_file; a missing or surplus header fails when read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns], F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"))


def read_joined_csv(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """CSV files with inferred types and a join key '<file stem>:<id>'."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return df.withColumn("join_key", F.concat(stem, F.lit(":"), F.col(id_column).cast("string")))


def file_digest(path: str) -> str:
    """SHA-256 of a file."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


def read_pinned(spark: SparkSession, path: str, digest: str) -> DataFrame:
    """A Parquet file, refused if its SHA-256 is not the pinned one."""
    found = file_digest(path)
    if found != digest:
        raise ValueError(f"{path} has digest {found}, not {digest}")
    return spark.read.parquet(path)


def read_regime_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose leading '#' lines carry metadata; they are skipped here and read by regime_header."""
    return spark.read.option("header", True).option("comment", "#").option("inferSchema", True).csv(path)


def regime_header(path: str) -> dict[str, str]:
    """The 'key: value' comment lines at the head of a file."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            if not line.startswith("#"):
                break
            key, _, value = line[1:].partition(":")
            out[key.strip()] = value.strip()
    return out


def nested_as_text(df: DataFrame) -> DataFrame:
    """df with every array, map and struct column as JSON text, so that it can be written as CSV."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def text_as_nested(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse of nested_as_text for the nested columns of `schema`."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    kinds = {f.name: f.dataType for f in schema.fields}
    return df.select(*[F.from_json(c, kinds[c]).alias(c) if isinstance(kinds.get(c), nested) else F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in df.columns])


def write_nested_csv(df: DataFrame, path: str) -> None:
    """df as CSV with its nested columns as JSON text."""
    nested_as_text(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_nested_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_nested_csv wrote, in its former types."""
    return text_as_nested(spark.read.option("header", True).option("escape", '"').csv(path), schema)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under a folder, hashed by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_folds(df: DataFrame, path: str, design: str) -> None:
    """A fold table as Parquet, partitioned by its design."""
    df.write.mode("overwrite").partitionBy(design).parquet(path)


def read_folds(spark: SparkSession, path: str, design: str, name: str, digest: str | None = None, columns: tuple[str, ...] = ("row_id", "fold")) -> DataFrame:
    """One design of a fold store, by partition pruning; refused if its fingerprint is not the given one."""
    from quarrystone.operators.folds import fingerprint

    df = spark.read.parquet(path).where(F.col(design) == name)
    if digest is not None and fingerprint(df, list(columns)).first()["digest"] != digest:
        raise ValueError(f"the folds of {name} have changed")
    return df


def write_json_strict(value, path: str) -> None:
    """A small value as JSON by way of a temporary file; NaN and infinities become null."""

    def clean(v):
        if isinstance(v, float) and not math.isfinite(v):
            return None
        if isinstance(v, dict):
            return {str(k): clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, (list, tuple)) else v

    part = Path(path).with_suffix(".part")
    part.write_text(json.dumps(clean(value), allow_nan=False, indent=1, sort_keys=True), encoding="utf-8")
    os.replace(part, path)


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A report's table as Markdown; at most `limit` rows, which is the feature."""
    rows = df.limit(limit).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", r"\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])


def pending(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """What an incremental cache lacks: the different wanted keys that are not in it."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(cached.select(key), key, "left_anti")
