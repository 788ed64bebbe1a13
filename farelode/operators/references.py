"""References to records that do not exist.

References and parent keys are hash-partitioned alike and sorted by key, so that the sort-merge join passes once over
both streams (``MERGE`` hint; no side is broadcast or held in memory). The parents reach the merge as one validity
interval per key, folded before their shuffle: the first arrival opens it, a deletion of the newest row closes it.
Comparing a reference with that interval separates *missing*, *deleted* and *late*.

A key that a large part of all references share (one missing id, say) would make one merge task long. Such hot keys, and
only they, are spread over several tasks (``skew.spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelode.operators.skew import spread_join
from farelode.tables import clean_id

ORPHAN_COLUMNS = ("table_name", "row_no", "orphan_kind", "period")


def validity_intervals(parents: DataFrame, key: str, arrived: str = "ingested_at", deleted: str = "deleted_at", order: str = "row_no") -> DataFrame:
    """One row per parent key: ``valid_key``, ``valid_from`` (earliest arrival), ``closed`` (the newest row is deleted).

    Newest is by ``arrived``, then ``order``; a row without an arrival counts as the oldest. Rows with a null or blank
    key are no parents. Repeated rows change nothing. Only the four named columns are read; others may have any name.
    """
    rows = parents.select(
        clean_id(F.col(key)).alias("valid_key"),
        F.col(arrived).alias("arrived"),
        F.col(deleted).isNotNull().alias("gone"),
        F.struct(F.col(arrived), F.col(order)).alias("age"),
    ).where("valid_key IS NOT NULL")
    return rows.groupBy("valid_key").agg(F.min("arrived").alias("valid_from"), F.max_by("gone", "age").alias("closed"))


def reference_status(children: DataFrame, reference: str, at: str, intervals: DataFrame, hot_share: float | None = None) -> DataFrame:
    """``children`` with a column ``orphan_kind``: missing, deleted, late, or null where the reference holds or is blank.

    A reference without a time (``at`` null), or to a parent without one, is never late. Children of any columns are
    allowed; the added working columns start with ``_ref_`` and are dropped again. Rows are neither lost nor multiplied,
    as each key has one interval. ``hot_share``: of the references, from which on a key is spread; see ``spread_join``.
    """
    keyed = children.withColumn("_ref_key", clean_id(F.col(reference)))
    known = intervals.select(F.col("valid_key").alias("_ref_parent"), F.col("valid_from").alias("_ref_from"), F.col("closed").alias("_ref_closed"))
    joined = spread_join(keyed, known, "_ref_key", "_ref_parent", "left", hot_share=hot_share)
    kind = (
        F.when(F.col("_ref_key").isNull(), F.lit(None).cast("string"))
        .when(F.col("_ref_parent").isNull(), F.lit("missing"))
        .when(F.col("_ref_closed"), F.lit("deleted"))
        .when(F.col("_ref_from") > F.col(at), F.lit("late"))
    )
    return joined.withColumn("orphan_kind", kind).drop("_ref_key", "_ref_parent", "_ref_from", "_ref_closed")


def orphan_references(children: DataFrame, table_name: str, reference: str, at: str, parents: DataFrame, parent_key: str, row_id: str = "row_no") -> DataFrame:
    """The orphan references of one child table, as ``ORPHAN_COLUMNS``.

    Only the row id, the reference and the time are read of the children. ``period`` is the child's month as YYYY-MM and
    null where the child has no time. Null and blank references are no orphans; an empty parent table makes every
    reference missing; repeated child rows come out as often as they come in.
    """
    narrow = children.select(F.col(row_id).alias("row_no"), F.col(reference).alias("reference"), F.col(at).alias("at")).where(clean_id(F.col("reference")).isNotNull())
    found = reference_status(narrow, "reference", "at", validity_intervals(parents, parent_key))
    return found.where("orphan_kind IS NOT NULL").select(
        F.lit(table_name).alias("table_name"), "row_no", "orphan_kind", F.date_format("at", "yyyy-MM").alias("period")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, period and kind."""
    return orphans.groupBy("table_name", "period", "orphan_kind").agg(F.count(F.lit(1)).alias("orphans"))
