"""Scans by suffix, sinks, manifests, file indexes and source inspection."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES = ("images", "events", "comparisons")


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """parquet, jsonl (blank lines skipped), csv (all strings), else a JSON document."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read if schema is None or suffix == "parquet" else spark.read.schema(schema)
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix == "csv":
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return reader.option("multiLine", suffix != "jsonl").json(path)


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of float columns become null, as strict JSON needs."""
    floats = {f.name: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(floats) if floats else df


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    finite(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Nested cells are JSON; fields fixes the order and adds absent ones as empty."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells: list[Column] = []
    for name in fields or df.columns:
        cell = F.col(name) if name in df.columns else F.lit(None).cast("string")
        cells.append((F.to_json(cell) if name in df.columns and isinstance(df.schema[name].dataType, nested) else cell).alias(name))
    finite(df).select(cells).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def _store(path: str):
    """The file system and path of a URI, in any store that Spark reaches."""
    spark = SparkSession.active()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def atomic_text(path: str, text: str) -> None:
    """A small file beside the tables: written under another name, then renamed.

    A path with a scheme goes through Hadoop's file systems; without one it is a file of the
    driver, and synced before it is renamed.
    """
    if "://" in path:
        files, target = _store(path)
        part = target.suffix(".part")
        out = files.create(part, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        files.delete(target, False)
        if not files.rename(part, target):
            raise OSError(f"{path} could not be renamed into place")
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, path)


def strict(value):
    """A value without NaN, dates as ISO text and keys as strings."""
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [strict(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value.isoformat() if hasattr(value, "isoformat") else value


def write_json(path: str, value) -> None:
    atomic_text(path, json.dumps(strict(value), ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n")


def read_json(path: str):
    if "://" in path:
        files, target = _store(path)
        source = files.open(target)
        try:
            return json.loads(bytes(source.readAllBytes()).decode("utf-8"))
        finally:
            source.close()
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def digest(value) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(strict(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def save_manifest(root: str, tables: dict[str, DataFrame], audit: dict, provenance: dict) -> None:
    for name in ENTITIES:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{root}/{name}")
    write_json(f"{root}/dataset_audit.json", audit)
    write_json(f"{root}/provenance.json", provenance)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reaches has the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_manifest(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict, dict]:
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in ENTITIES if exists(spark, f"{root}/{n}")}
    return tables, read_json(f"{root}/dataset_audit.json"), read_json(f"{root}/provenance.json")


def union_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One table of a file per split, with the split's name as a column."""
    out = None
    for split, path in paths.items():
        part = read_rows(spark, path).withColumn("original_split", F.lit(split))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def uid_occurrences(rows: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Per uid of several columns: how often it occurs and the first row that has it.  Only these
    columns are read."""
    long = rows.select(row_id, *columns).unpivot([row_id], columns, "slot", "uid")
    return long.groupBy("uid").agg(F.count("*").alias("n"), F.min(row_id).alias("first_row"))


def artifact_index(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def inspect_source(df: DataFrame, sample: int = 2) -> dict:
    return dict(rows=df.count(), schema=json.loads(df.schema.json()), sample=[strict(r.asDict(True)) for r in df.limit(sample).collect()])


def telemetry_summary(df: DataFrame, device: str, utilization: str, memory: str) -> DataFrame:
    """Per device: rows, highest, mean and mean non-zero utilization, highest memory; rows
    whose cells carry no number are skipped."""
    number = lambda c: F.try_to_number(F.regexp_extract(F.trim(c), "^(-?[0-9]+)", 1), F.lit("S999999999")).cast("double")
    rows = df.select(F.trim(device).alias("device"), number(utilization).alias("u"), number(memory).alias("m")).where("u is not null and m is not null")
    return rows.groupBy("device").agg(
        F.count("*").alias("samples"),
        F.max("u").alias("max_utilization"),
        F.round(F.avg("u"), 6).alias("mean_utilization"),
        F.round(F.avg(F.when(F.col("u") > 0, F.col("u"))), 6).alias("active_mean_utilization"),
        F.max("m").alias("max_memory"),
    )
