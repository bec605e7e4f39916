"""Analyst feedback: lookups, quality of the verdicts, and when to retrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CORRECTIONS = ("is_false_negative", "corrected_level", "corrected_type")


def with_feedback(anomalies: DataFrame, feedback: DataFrame, how: str = "left") -> DataFrame:
    """Anomalies with each of their feedback rows."""
    notes = feedback.select(
        F.col("anomaly_id").alias("id"),
        F.col("id").alias("feedback_id"),
        "is_false_positive",
        F.col("created_at").alias("feedback_at"),
        *[c for c in CORRECTIONS if c in feedback.columns],
    )
    return anomalies.join(notes, "id", how)


def feedback_quality(anomalies: DataFrame, feedback: DataFrame, *by: str) -> DataFrame:
    """Confirmed, false and missed alarms and the precision they imply, per group.

    `by` may name any column of the anomalies (`model_version`, say) or of the feedback. Missed
    alarms are counted where the feedback has `is_false_negative`; they are no alarms, so they don't
    count into the precision.
    """
    judged = with_feedback(anomalies, feedback, "inner")
    missed = F.coalesce("is_false_negative", F.lit(False)) if "is_false_negative" in judged.columns else F.lit(False)
    wrong, alarms = F.count_if(F.col("is_false_positive") & ~missed), F.count_if(~missed)
    return judged.groupBy(*by).agg(
        F.count("*").alias("judged"),
        wrong.alias("false_positives"),
        F.count_if(missed).alias("false_negatives"),
        F.when(alarms > 0, 1 - wrong / alarms).alias("precision"),
    )


def retrain_due(
    feedback: DataFrame, trained_at: Column, as_of: Column, every_hours: int = 24, min_new: int = 100
) -> DataFrame:
    """Whether the model is old enough, or enough feedback came in, to train again."""
    fresh = F.count_if(F.col("created_at") > trained_at)
    old = as_of >= trained_at + F.expr(f"INTERVAL {int(every_hours)} HOURS")
    return feedback.filter(F.col("created_at") <= as_of).agg(
        fresh.alias("new_feedback"), (old | (fresh >= min_new)).alias("due")
    )
