"""Training-set operators: dedup against the store, unions, label tiers,
batch outcomes and fold assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import MIN_TRAIN_SAMPLES, SEED_DESCRIPTIONS, TIER_RANGES
from .keyed_store import KeyedTable
from .store import ordinal_index, top_k_per_group


def keep_first_example(df: DataFrame, order_col: str = "ord") -> DataFrame:
    return top_k_per_group(df, ["hash"], [F.col(order_col).asc()], 1)


def new_training_examples(existing: DataFrame, batch: DataFrame, order_col: str = "ord") -> DataFrame:
    """Examples whose hash is not stored yet, first per hash in the batch."""
    return keep_first_example(batch, order_col).join(existing.select("hash"), "hash", "left_anti")


def new_examples_for(table: KeyedTable, batch: DataFrame, order_col: str = "ord") -> DataFrame:
    """``new_training_examples`` against a keyed training store."""
    first = keep_first_example(batch, order_col)
    return first.join(table.matching(first, table.key).hint("shuffle_hash"), table.key, "left_anti")


def union_training(seed: DataFrame, live: DataFrame, order_col: str = "ord") -> DataFrame:
    return keep_first_example(seed.unionByName(live), order_col)


def seeds(spark) -> DataFrame:
    return spark.createDataFrame(SEED_DESCRIPTIONS, "description string, tier string")


def tiers(spark) -> DataFrame:
    return spark.createDataFrame(TIER_RANGES, "tier string, lo double, hi double")


def score_to_tier(df: DataFrame, tier_table: DataFrame, score_col: str = "risk_score") -> DataFrame:
    """Range join score -> tier (inclusive bounds; scores between bands get
    none).  The tier table is the fixed five-row catalog, so broadcasting it
    is bounded."""
    t = F.broadcast(tier_table)
    return df.join(t, (F.col(score_col) >= t["lo"]) & (F.col(score_col) <= t["hi"]), "left")


def training_stats(examples: DataFrame) -> DataFrame:
    """Size of the store, whether it suffices for a fit, and the number of
    examples of each source (a few kinds of origin) as text."""
    mix = source_mix(examples).agg(F.array_join(F.array_sort(F.collect_list(
        F.concat_ws("=", "source", F.col("n").cast("string")))), ",").alias("m")).select("m").scalar()
    return examples.agg(F.count("*").alias("sample_count"),
                        F.count_distinct("hash").alias("distinct_hashes"),
                        (F.count("*") >= F.lit(MIN_TRAIN_SAMPLES)).alias("trainable")).withColumn("source_mix", mix)


def source_mix(examples: DataFrame) -> DataFrame:
    return examples.groupBy("source").agg(F.count("*").alias("n"))


def seed_outcome(labelled: DataFrame, existing: DataFrame) -> DataFrame:
    """seeded / failed / duplicate counts of one labelling batch: failed when
    code or score is missing, duplicate when the hash was stored before or
    repeats earlier in the batch."""
    ok = F.col("code").isNotNull() & F.col("risk_score").isNotNull()
    e = existing.select("hash").distinct().withColumn("_stored", F.lit(True))
    j = labelled.join(e, "hash", "left")
    first = top_k_per_group(j.where(ok), ["hash"], [F.col("ord").asc()], 1).select("ord").withColumn("_first", F.lit(True))
    j = j.join(first, "ord", "left")
    is_new = ok & F.col("_stored").isNull() & F.col("_first").isNotNull()
    return j.agg(F.count_if(is_new).cast("long").alias("seeded"),
                 F.count_if(~ok).cast("long").alias("failed"),
                 F.count_if(ok & ~is_new).cast("long").alias("duplicate"))


def kfold_k(n: int) -> int:
    return min(5, max(2, n // 4))


def kfold_assign(df: DataFrame, n=None, order_col: str = "ord") -> DataFrame:
    """Contiguous folds over the ``order_col`` position: k = min(5, max(2,
    n // 4)) and the first n mod k folds are one row larger (the split of an
    unshuffled k-fold).  ``n`` defaults to the row count as a scalar
    subquery, so nothing is computed on the driver."""
    n = df.select(F.count("*")).scalar() if n is None else (F.lit(n) if isinstance(n, int) else n)
    k = F.least(F.lit(5), F.greatest(F.lit(2), F.floor(n / 4)))
    base = F.floor(n / k)
    extra = n % k
    big = extra * (base + 1)
    r = F.col("_pos")
    fold = F.when(r < big, F.floor(r / (base + 1))) \
        .otherwise(extra + F.floor((r - big) / F.greatest(base, F.lit(1))))
    return ordinal_index(df, order_col, "_pos").withColumn("fold", fold.cast("long")).drop("_pos")
