"""Running totals that no single task has to walk: inside buckets first, then over buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEFORE = (W.unboundedPreceding, -1)


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, so that rows without a key are kept."""
    others = [c for c in right.columns if c not in names]
    keyed = right.select(*[F.col(n).alias(f"_key_{n}") for n in names], *others)
    equal = [F.col(n).eqNullSafe(F.col(f"_key_{n}")) for n in names]
    both = left.join(keyed, reduce(lambda a, b: a & b, equal), how)
    return both.drop(*[f"_key_{n}" for n in names])


def running_totals(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], totals: dict[str, str]
) -> DataFrame:
    """Add `name`: sum of the column over all rows of the key ahead of this one.

    `bucket` cuts the order into pieces (every row of a lower bucket comes first); only one
    row per key and bucket takes part in the pass over the whole key.
    """
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(*BEFORE)
    across = W.partitionBy(*keys).orderBy(bucket).rowsBetween(*BEFORE)
    sums = df.groupBy(*keys, bucket).agg(
        *[F.sum(column).alias(f"_sum_{name}") for name, column in totals.items()]
    )
    carried = sums.select(
        *keys,
        bucket,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(across), F.lit(0)).alias(f"_carry_{name}")
            for name in totals
        ],
    )
    local = df.withColumns(
        {
            f"_in_{name}": F.coalesce(F.sum(column).over(inside), F.lit(0))
            for name, column in totals.items()
        }
    )
    joined = join_same(local, carried, [*keys, bucket])
    added = {name: F.col(f"_in_{name}") + F.col(f"_carry_{name}") for name in totals}
    helpers = [f"{p}_{name}" for p in ("_in", "_carry") for name in totals]
    return joined.withColumns(added).drop(*helpers)


def even_buckets(df: DataFrame, column: str, pieces: int = 256) -> DataFrame:
    """Add `_bucket`: which of `pieces` about equally filled ranges of `column` a row is in.

    The bounds come from a quantile sketch of fixed size, read as a scalar subquery.
    """
    steps = ", ".join(f"{i / pieces}D" for i in range(1, pieces))
    bounds = df.select(
        F.expr(f"percentile_approx(cast({column} AS double), array({steps}), 10000)")
    ).scalar()
    below = F.filter("_bounds", lambda b: b < F.col(column).cast("double"))
    placed = df.withColumn("_bounds", bounds)
    return placed.withColumn("_bucket", F.size(below)).drop("_bounds")


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32
) -> DataFrame:
    """The first `k` rows of each key; a hot key is first cut to `k` rows per salt."""
    hashed = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(salts)))
    part = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= k)
    whole = W.partitionBy(*keys).orderBy(*order)
    return (
        kept.withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )
