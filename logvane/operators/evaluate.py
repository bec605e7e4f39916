"""Splits, leakage checks and metrics; every curve is a running total over score ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.prefix import even_buckets, join_same, running_totals

# --- fixed values: shares of the split ---
SHARES = (("train", 0.6), ("validation", 0.2), ("test", 0.2))


def stratified_split(
    df: DataFrame, label: str = "label", row_id: str = "id", seed: int = 42
) -> DataFrame:
    """Add `split`: each label's rows, in the order of a seeded hash, cut 60/20/20.

    Positions come from running totals over ranges of the hash, so a label that holds
    nearly all rows is still ranked by many tasks.
    """
    order = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"-{seed}")))
    hashed = df.withColumns({"_hash": order, "_part": F.substring(order, 1, 3), "_one": F.lit(1)})
    ranked = running_totals(hashed, [label], "_part", ["_hash", row_id], {"_at": "_one"})
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    share = F.col("_at") / F.col("_size")
    names, edges = [n for n, _ in SHARES], [0.6, 0.8]
    split = F.when(share < edges[0], names[0]).when(share < edges[1], names[1]).otherwise(names[2])
    return (
        join_same(ranked, sizes, [label])
        .withColumn("split", split)
        .drop("_hash", "_part", "_one", "_at", "_size")
    )


def overlap(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """`pair, shared`: distinct rows that two parts have in common."""
    names = list(parts)
    counts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = parts[a].select(*columns).intersect(parts[b].select(*columns))
            counts.append(both.agg(F.lit(f"{a}-{b}").alias("pair"), F.count("*").alias("shared")))
    return reduce(DataFrame.unionByName, counts)


def assert_no_overlap(parts: dict[str, DataFrame], columns: list[str]) -> None:
    shared = overlap(parts, columns).filter("shared > 0").collect()
    if shared:
        raise ValueError(f"parts share rows: {[(r['pair'], r['shared']) for r in shared]}")


def stack_labelled(normal: DataFrame, anomalous: DataFrame) -> DataFrame:
    """Both sets with their label."""
    return normal.withColumn("label", F.lit(0)).unionByName(
        anomalous.withColumn("label", F.lit(1))
    )


def _label_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label (the smaller on a tie), its rows, the positives, all rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_n"), (-F.col(label)).alias("_l")))
    return counts.agg(
        best.alias("_b"),
        F.coalesce(F.sum(F.when(F.col(label) == 1, F.col("_n"))), F.lit(0)).alias("positives"),
        F.sum("_n").alias("total"),
    ).select((-F.col("_b._l")).alias("label"), F.col("_b._n").alias("rows"), "positives", "total")


def majority(df: DataFrame, label: str = "label") -> DataFrame:
    """The most frequent label (the smaller one on a tie) and the accuracy of saying it."""
    return _label_counts(df, label).select("label", (F.col("rows") / F.col("total")).alias("accuracy"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, predicted: Column, label: str = "label") -> DataFrame:
    """One row: the four counts and what follows from them; 0 where a ratio has no base."""
    truth = F.col(label) == 1
    counts = df.agg(
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(truth & predicted).alias("tp"),
    )
    tn, fp, fn, tp = [F.col(c) for c in ("tn", "fp", "fn", "tp")]
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "fpr": _ratio(fp, fp + tn),
            "fnr": _ratio(fn, fn + tp),
        }
    )


def _curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives at and above it."""
    counts = df.groupBy(F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n")
    )
    falling = even_buckets(counts.withColumn("_down", -F.col("_score")), "_down")
    return running_totals(falling, [], "_bucket", ["_down"], {"_tp0": "_p", "_fp0": "_n"})


def areas(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Both areas from one curve.

    `roc_auc` is the share of (positive, negative) pairs in the right order, ties counting half;
    `pr_auc` the area under precision over recall by trapezoids, from recall 0 at precision 1.
    """
    curve = _curve(df, score, label)
    won = F.sum(F.col("_n") * (F.col("_tp0") + F.col("_p") / 2))
    pairs = F.sum("_p").cast("double") * F.sum("_n")
    seen = F.col("_tp0") + F.col("_fp0")
    before = F.when(seen == 0, F.lit(1.0)).otherwise(_ratio(F.col("_tp0"), seen))
    after = _ratio(F.col("_tp0") + F.col("_p"), seen + F.col("_p") + F.col("_n"))
    area = F.sum(F.col("_p") * (before + after) / 2)
    return curve.agg(
        F.coalesce(F.try_divide(won.cast("double"), pairs), F.lit(0.0)).alias("roc_auc"),
        _ratio(area, F.sum("_p")).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return areas(df, score, label).select("roc_auc")


def pr_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return areas(df, score, label).select("pr_auc")


def report(
    df: DataFrame, threshold: float, name: str, score: str = "score", label: str = "label"
) -> DataFrame:
    """All metrics of one data set in one row."""
    base = confusion(df, F.col(score) >= threshold, label)
    both = areas(df, score, label).select(F.struct("roc_auc", "pr_auc")).scalar()
    return base.withColumns(
        {
            "dataset": F.lit(name),
            "n_samples": F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"),
            "roc_auc": both["roc_auc"],
            "pr_auc": both["pr_auc"],
        }
    )


def gain_over_majority(metrics: DataFrame, df: DataFrame, label: str = "label") -> DataFrame:
    """What the model adds to always saying the most frequent label."""
    found = _label_counts(df, label).select(F.struct("*")).scalar()
    positives, total = found["positives"], found["total"]
    base_f1 = F.when(found["label"] == 1, 2 * positives / (positives + total)).otherwise(F.lit(0.0))
    return metrics.select(
        (F.col("accuracy") - found["rows"] / total).alias("accuracy_gain"),
        (F.col("f1") - base_f1).alias("f1_gain"),
    )
