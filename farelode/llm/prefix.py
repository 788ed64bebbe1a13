"""Distributed prefix sums within groups, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelode.tables import durable


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` (integers, no nulls) over the rows of the same group that come earlier.

    Rows are range-partitioned and sorted by (group, order), so a group of any size spans as many partitions as it needs;
    ``order`` should identify a row, or equal rows may swap their places between runs. The placed rows are written to the
    shared checkpoint folder, as the partition of a row must not change afterwards. One pass sums within partitions; the
    sums per (group, partition) - at most groups + partitions rows, the ranges being disjoint - give the offsets, which
    are joined back. Null groups are a group. Column names starting with ``_pre_`` are reserved.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = durable(df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).withColumn("_pre_part", F.spark_partition_id()))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: object = None
        carried = 0
        for batch in batches:
            if batch.empty:
                continue
            keys = batch[group].to_numpy(dtype=object)
            values = batch[value].to_numpy(dtype="int64")
            null = pd.isna(keys)
            new = np.r_[True, (keys[1:] != keys[:-1]) & ~(null[1:] & null[:-1])]
            if carried and (keys[0] == last or null[0] and pd.isna(last)):
                new[0] = False
            total = np.cumsum(values)
            earlier = total - values  # over the whole batch
            starts = np.flatnonzero(new)
            base = np.zeros(len(values), dtype="int64")
            if not new[0]:
                base[: starts[0] if len(starts) else None] = -carried
            for i, s in enumerate(starts):
                base[s : starts[i + 1] if i + 1 < len(starts) else None] = earlier[s]
            before = earlier - base
            last, carried = keys[-1], int(before[-1] + values[-1])
            yield batch.assign(_pre_local=before)

    summed = placed.mapInPandas(local, T.StructType([*placed.schema.fields, T.StructField("_pre_local", T.LongType())]))
    sums = placed.groupBy(group, "_pre_part").agg(F.sum(value).cast("bigint").alias("_pre_sum"))
    earlier_parts = Window.partitionBy(group).orderBy("_pre_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("_pre_group"), F.col("_pre_part").alias("_pre_at"), F.coalesce(F.sum("_pre_sum").over(earlier_parts), F.lit(0)).alias("_pre_offset"))
    joined = summed.join(offsets, F.col(group).eqNullSafe(F.col("_pre_group")) & (F.col("_pre_part") == F.col("_pre_at")))
    return joined.withColumn("before", F.col("_pre_local") + F.col("_pre_offset")).drop("_pre_group", "_pre_at", "_pre_offset", "_pre_local", "_pre_part")
