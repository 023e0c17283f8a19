"""Running sums over a whole stream in any order, without a window over the stream.

Rows are dealt to tasks by ranges of (key, order) and written with the number of their range. Inside a range a window
sums; before it go the sums of the key's earlier ranges, one row a range and key. Every range is of bounded size however
long a stream is, and what is dealt is written once, so sums and rows always speak of the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import Scratch


def running_totals(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], scratch: Scratch, totals: bool = False) -> DataFrame:
    """``df`` with inclusive running sums ``values`` of each key in ``order``; ``totals`` adds those of the whole key as ``<name>_all``.

    Rows must differ in (keys, order): equal ones have no defined order among them, and stay in one range.
    """
    named = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    ranged = named.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.settle(ranged, "ranges")
    sums = ranged.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    zero = F.lit(0)
    before = [F.coalesce(F.sum(f"_s_{n}").over(earlier), zero).alias(f"_b_{n}") for n in values]
    all_ = [F.sum(f"_s_{n}").over(whole).alias(f"{n}_all") for n in values] if totals else []
    carried = scratch.settle(sums.select(*keys, "_range", *before, *all_), "carried")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in values}).join(carried, [*keys, "_range"])
    ends = [f"{n}_all" for n in values] if totals else []
    return summed.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in values], *ends)
