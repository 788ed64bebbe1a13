"""Accuracy of extracted fields against manual labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelode.schema import SCORED_FIELDS

FIELD_TYPES = dict(SCORED_FIELDS)
DEFAULT_FIELDS = tuple(FIELD_TYPES)


def drop_skipped(rows: DataFrame) -> DataFrame:
    """Without rows whose label status is skip, whatever its case."""
    return rows.where(F.coalesce(F.lower("label_status"), F.lit("")) != "skip")


def canonical(value: Column, kind: str) -> Column:
    """A value as text: equal texts are equal values. Numbers are rounded half-even to 6 places, lists keep their order."""
    if kind == "double":
        return F.bround(value, 6).cast("string")
    if kind.startswith("array"):
        return F.to_json(value)
    return value.cast("string")


def field_pairs(gold: DataFrame, predicted: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS) -> DataFrame:
    """``field, gold_value, predicted_value`` of all records on both sides; each side has one row per ``record_id``."""
    g = gold.select("record_id", *[canonical(F.col(f), FIELD_TYPES[f]).alias(f"g_{f}") for f in fields])
    p = predicted.select(F.col("record_id").alias("_p"), *[canonical(F.col(f), FIELD_TYPES[f]).alias(f"p_{f}") for f in fields])
    both = g.join(p, F.col("record_id") == F.col("_p"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"g_{f}").alias("gold_value"), F.col(f"p_{f}").alias("predicted_value")) for f in fields]))
    return both.select(pairs.alias("x")).select("x.*")


def field_accuracy(gold: DataFrame, predicted: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS) -> DataFrame:
    """Per field ``correct, total, missing_pred_value, accuracy``; fields that no gold record has count 0 with null accuracy.

    A null gold value is not counted, an empty list is. All counts are folded before the shuffle.
    """
    told = F.col("gold_value").isNotNull()
    counted = field_pairs(gold, predicted, fields).groupBy("field").agg(
        F.count_if(told & F.col("predicted_value").isNotNull() & (F.col("gold_value") == F.col("predicted_value"))).alias("correct"),
        F.count_if(told).alias("total"),
        F.count_if(told & F.col("predicted_value").isNull()).alias("missing_pred_value"),
    )
    names = gold.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    full = names.join(counted, "field", "left").select("field", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("correct", "total", "missing_pred_value")])
    return full.withColumn("accuracy", F.try_divide("correct", "total"))


def record_overlap(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: how many records are on the gold side, the predicted side, both, or only one."""
    g = gold.select("record_id").distinct().withColumn("_g", F.lit(True))
    p = predicted.select("record_id").distinct().withColumn("_p", F.lit(True))
    both = g.join(p, "record_id", "full_outer")
    in_gold, in_predicted = F.coalesce("_g", F.lit(False)), F.coalesce("_p", F.lit(False))
    return both.agg(
        F.count_if(in_gold).alias("gold_records"), F.count_if(in_predicted).alias("pred_records"), F.count_if(in_gold & in_predicted).alias("matched_records"),
        F.count_if(in_gold & ~in_predicted).alias("missing_predictions_for_gold_records"), F.count_if(~in_gold & in_predicted).alias("extra_prediction_records"),
    )


def evaluate(gold: DataFrame, predicted: DataFrame, fields: tuple[str, ...] = DEFAULT_FIELDS) -> dict:
    """The whole report, of one row per field and one of counts; an id missing on either side is an error."""
    for rows in (gold, predicted):
        if rows.where("record_id IS NULL OR trim(record_id) = ''").limit(1).count():
            raise ValueError("record_id is required")
    stats = {r["field"]: r.asDict() for r in field_accuracy(gold, predicted, fields).collect()}
    correct, total = (sum(s[k] for s in stats.values()) for k in ("correct", "total"))
    return record_overlap(gold, predicted).first().asDict() | {
        "fields": list(fields),
        "per_field_accuracy": {f: stats[f]["accuracy"] for f in fields},
        "field_stats": {f: {k: stats[f][k] for k in ("correct", "total", "missing_pred_value")} for f in fields},
        "overall_field_accuracy": correct / total if total else None,
    }


def compare(predicted: DataFrame, stores: list[tuple[str, DataFrame | None]], file_gold: DataFrame | None, fields: tuple[str, ...] = DEFAULT_FIELDS) -> dict:
    """The report against the first store that has any labels, else against the gold file.

    ``stores``: (backend, labels) in order of precedence. A store with only skipped labels blocks; a file only if it is
    absent or has no rows at all.
    """
    for backend, labels in stores:
        if labels is not None and labels.limit(1).count():
            gold = drop_skipped(labels)
            if not gold.limit(1).count():
                return {"status": "blocked", "reason": "manual_gold_empty", "manual_gold_backend": backend}
            return evaluate(gold, drop_skipped(predicted), fields) | {"status": "ok", "manual_gold_backend": backend}
    if file_gold is None or not file_gold.limit(1).count():
        return {"status": "blocked", "reason": "manual_gold_empty", "manual_gold_backend": "jsonl"}
    return evaluate(drop_skipped(file_gold), drop_skipped(predicted), fields) | {"status": "ok", "manual_gold_backend": "jsonl"}
