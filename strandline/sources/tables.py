"""Sources and sinks: wide waveform CSV, unions, optional tables, summaries, JSON, fingerprints, tolerant writes."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file from its first line only (a byte-order mark is dropped)."""
    first = spark.read.text(path).limit(1).collect()
    return [c.strip().strip('"') for c in first[0][0].lstrip("﻿").split(",")] if first else []


def phase_columns(header: list[str], channel: str) -> list[str]:
    """Columns named channel_pNNNN in the order of their numbers."""
    found = [(int(m.group(1)), c) for c in header if (m := re.fullmatch(rf"{re.escape(channel)}_p(\d+)", c))]
    return [c for _, c in sorted(found)]


def wide_waveforms(spark: SparkSession, path: str, dataset: str, channels=("Fx", "Fy", "Fz"), low: float = 0.45, high: float = 0.63) -> DataFrame:
    """dataset, cycle_index, stage and one array of the sensitive phase for each channel.

    The schema is explicit (no inference pass) and only the slice's columns are selected, so the reader prunes the rest.
    """
    header = csv_header(spark, path)
    types = {"CycleIndex": T.IntegerType(), "Stage1to5": T.IntegerType()}
    schema = T.StructType([T.StructField(c, types.get(c, T.DoubleType())) for c in header])
    raw = spark.read.schema(schema).option("header", True).csv(path)
    out = [F.lit(dataset).alias("dataset"), F.col("CycleIndex").alias("cycle_index"), F.col("Stage1to5").alias("stage")]
    for channel in channels:
        phases = phase_columns(header, channel)
        n = len(phases)
        first, last = max(1, -int(-low * n // 1)), int(high * n)
        out.append(F.array(*phases[first - 1 : last]).alias(channel.lower()))
    return raw.select(*out)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "feature_name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def pivot_first(long: DataFrame, ids: list[str], names: list[str], name: str = "feature_name", value: str = "value") -> DataFrame:
    """Long to wide with a stated list of names, so that no pass is needed to find them."""
    return long.groupBy(*ids).pivot(name, names).agg(F.first(value))


def feature_metadata(names: list[str], spark: SparkSession) -> DataFrame:
    """feature_name, channel, feature_family by splitting names at the first underscore."""
    return spark.createDataFrame([(n, n.split("_", 1)[0], n.split("_", 1)[1] if "_" in n else "level") for n in names], "feature_name string, channel string, feature_family string")


def optional_csv(spark: SparkSession, path: str, schema: str, warnings: list[str] | None = None, required: bool = False) -> DataFrame:
    """A CSV table, or an empty one of the schema where the path is missing or empty."""
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except Exception as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        if warnings is not None:
            warnings.append(f"missing: {path}")
        return spark.createDataFrame([], schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_or_compute(spark: SparkSession, path: str, compute) -> DataFrame:
    """A stored table where it exists, else the plan that makes it."""
    return spark.read.parquet(path) if path_exists(spark, path) else compute()


def write_summary(df: DataFrame, path: str) -> None:
    """A small table as one CSV file; large results go to Parquet."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_tolerant(df: DataFrame, path: str, spark: SparkSession) -> str:
    """Write once: an existing table that is equal row by row is left as it is, a different one is an error."""
    if not path_exists(spark, path):
        df.write.parquet(path)
        return "written"
    old = spark.read.parquet(path)
    if set(old.columns) == set(df.columns) and df.select(old.columns).exceptAll(old).isEmpty() and old.exceptAll(df.select(old.columns)).isEmpty():
        return "equal"
    raise ValueError(f"{path} holds a different table")


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """A payload (model, config, diagnostics) as one JSON row that any executor can read."""
    spark.createDataFrame([(json.dumps(payload, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): an order-free digest of all rows, summed in tasks."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(h).cast("string").alias("digest"))


def markdown(df: DataFrame, rows: int = 20) -> str:
    """The first rows as a Markdown table."""
    got = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)])
