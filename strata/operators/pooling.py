"""Vector pooling per group (VEC2) as a vector aggregate.

``Summarizer`` keeps one weighted mean vector for each group and task, so a map task ships one row for
each group (and vector length), whatever the skew; no component becomes a row before the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F


def _means(df: DataFrame, key: str, vec_col: str, weight) -> DataFrame:
    """(key, _dim, _mean, _n): the weighted mean and total weight of a group's vectors of each length."""
    v = F.col(vec_col).cast("array<double>")
    # vectors of one length share a summary; those without weight add nothing
    x = df.select(key, v.alias("_v"), weight.cast("double").alias("_w")).where("_v is not null").withColumn("_dim", F.size("_v"))
    sums = (x.where("_w > 0").groupBy(key, "_dim").agg(
        Summarizer.mean(array_to_vector("_v"), F.col("_w")).alias("_m"), F.sum("_w").alias("_n"))
        .select(key, "_dim", vector_to_array("_m").alias("_mean"), "_n"))
    lengths = x.groupBy(F.col(key).alias("_key")).agg(F.max("_dim").alias("_dims"))
    return lengths.join(sums, lengths["_key"].eqNullSafe(sums[key]), "left").select(
        F.col("_key").alias(key), "_dims", "_mean", "_n")


def masked_mean(df: DataFrame, key: str, vec_col: str, mask_col: str) -> DataFrame:
    """(key, dim, value): sum(x*m)/sum(m) per key and component; NULL when sum(m) = 0. A component counts
    over the vectors that have it."""
    m = _means(df, key, vec_col, F.col(mask_col))
    # a few mean vectors for each key: one for each length
    padded = F.transform(F.sequence(F.lit(0), F.col("_dims") - 1), lambda i: F.get("_mean", i))
    every = m.select(key, "_n", F.posexplode(padded).alias("dim", "_x")).where("_x is not null or _n is null")
    agg = every.groupBy(key, "dim").agg(F.sum(F.col("_x") * F.col("_n")).alias("_s"), F.sum("_n").alias("_t"))
    return agg.select(key, F.col("dim").cast("bigint").alias("dim"), F.try_divide("_s", "_t").alias("value"))


def group_mean(df: DataFrame, key: str, vec_col: str, out_col: str = "embedding") -> DataFrame:
    """(key, out_col): the component-wise mean vector of each group (of vectors of one length)."""
    return _means(df, key, vec_col, F.lit(1.0)).select(key, F.col("_mean").alias(out_col))
