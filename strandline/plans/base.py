"""Adapters from the driver's tables to streams, windows, z scores and state scores, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators import metrics as M
from strandline.operators import streams as S
from strandline.sources.tables import melt

FEATURES = ["x_mean", "x_rms", "x_p2p"]
IDS = ["dataset", "window_index", "start_cycle", "end_cycle", "center_cycle", "stage", "baseline_window"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    """Six decimals, for results that are compared with SQL."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6).alias(name or c)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, cycle, x, n, stage: events of a type in time order, numbered hour by hour."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset"), "event_id", "ts", F.col("value").alias("x"))
    rows = S.number_rows(e, ["dataset"], F.date_trunc("DAY", "ts"), ["ts", "event_id"], total="n")
    return rows.withColumn("stage", S.equal_stages(F.col("cycle"), F.col("n"))).select("dataset", "event_id", "cycle", "x", "n", "stage")


def stream_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, cycle, rx, ry, rs of line items in shipping order, numbered month by month."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = S.number_rows(li.withColumnRenamed("l_returnflag", "dataset"), ["dataset"], F.date_trunc("MONTH", "l_shipdate"), order, total="n")
    rx, ry = A.ratio(F.col("l_extendedprice"), F.col("l_quantity")), A.ratio(F.col("l_tax"), F.col("l_discount"))
    return rows.select("dataset", "cycle", "n", rx.alias("rx"), ry.alias("ry"), A.resultant(rx, ry).alias("rs"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, vec_id and a 64-point wave in double precision."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("E"), (F.col("label") % 2).cast("string")).alias("dataset"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("wave"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return S.count_windows(stream_events(spark, sf_dir), {"x_mean": F.avg(x), "x_rms": F.sqrt(F.avg(x * x)), "x_p2p": F.max(x) - F.min(x)})


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return melt(windows(spark, sf_dir), IDS, FEATURES)


def z_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.robust_z(long_features(spark, sf_dir))


def z_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The z scores of all features side by side: the baselines of a stream are one row, joined by key."""
    rows = windows(spark, sf_dir)
    base = rows.where("baseline_window = 1").groupBy("dataset").agg(*[x for f in FEATURES for x in (M.med(f).alias(f"_m_{f}"), (M.med(f, 0.75) - M.med(f, 0.25)).alias(f"_i_{f}"))])
    z = {f"z_{f}": A.clip((F.col(f) - F.col(f"_m_{f}")) / (F.col(f"_i_{f}") + 1e-9), -12.0, 12.0) for f in FEATURES}
    return rows.join(base, "dataset").withColumns(z).select(*IDS, *z)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with z scores, the mean score (awr), a diagonal baseline distance (bd) and a 1-based position."""
    z = [F.col(f"z_{f}") for f in FEATURES]
    return z_wide(spark, sf_dir).withColumns({"awr": A.mean_present(z), "bd": F.sqrt(A.mean_present([c * c for c in z])), "_at": F.col("window_index") + 1})


#: The same views in SQL: ev, wi, lo, z, sc.
SQL = """
WITH ev AS (
  SELECT event_type AS dataset, event_id, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS cycle, count(*) OVER (PARTITION BY event_type) AS n FROM events
), st AS (SELECT *, CAST(least(5, 1 + floor(5 * (cycle - 1) / n)) AS INTEGER) AS stage FROM ev),
sp AS (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((cycle - 20) / 5)) AS BIGINT), CAST(floor((cycle - 1) / 5) AS BIGINT))) AS window_index FROM st),
wi AS (
  SELECT dataset, window_index, window_index * 5 + 1 AS start_cycle, window_index * 5 + 20 AS end_cycle, window_index * 5 + 10.5::DOUBLE AS center_cycle, max_by(stage, cycle) AS stage,
    CASE WHEN window_index * 5 + 20 <= 500 THEN 1 ELSE 0 END AS baseline_window, avg(x) AS x_mean, sqrt(avg(x * x)) AS x_rms, max(x) - min(x) AS x_p2p
  FROM sp GROUP BY dataset, window_index HAVING count(*) = 20
), lo AS (UNPIVOT wi ON x_mean, x_rms, x_p2p INTO NAME feature_name VALUE value),
ba AS (
  SELECT dataset, feature_name, median(value) AS median_base, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr_base FROM lo WHERE baseline_window = 1 GROUP BY ALL
), z AS (SELECT lo.*, median_base, iqr_base, greatest(-12, least(12, (value - median_base) / (iqr_base + 1e-9))) AS z_value FROM lo JOIN ba USING (dataset, feature_name)),
sc AS (
  SELECT dataset, window_index, start_cycle, end_cycle, center_cycle, stage, baseline_window, max(z_value) FILTER (feature_name = 'x_mean') AS z_x_mean, max(z_value) FILTER (feature_name = 'x_rms') AS z_x_rms,
    max(z_value) FILTER (feature_name = 'x_p2p') AS z_x_p2p, avg(z_value) AS awr, sqrt(avg(z_value * z_value)) AS bd
  FROM z GROUP BY ALL
)
"""

#: Line items as streams: ls.
SQL_LINES = """
WITH ls AS (
  SELECT l_returnflag AS dataset, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS cycle, count(*) OVER (PARTITION BY l_returnflag) AS n,
    CASE WHEN abs(l_quantity) >= 1e-9 THEN l_extendedprice / l_quantity END AS rx, CASE WHEN abs(l_discount) >= 1e-9 THEN l_tax / l_discount END AS ry FROM lineitem
)
"""
#: Waves: wv (64 points), sl (phase slice 29..40).
SQL_WAVES = """
WITH wv AS (SELECT 'E' || CAST(label % 2 AS VARCHAR) AS dataset, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS wave FROM embeddings),
sl AS (SELECT dataset, vec_id, wave[29:40] AS s FROM wv)
"""
