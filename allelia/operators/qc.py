"""Per-variant quality control and standardising in relational form, from (variant_index, ..., sample_index, dosage) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dominance


def counts(genotypes: DataFrame) -> DataFrame:
    """variant_index, n_obs, count_AA, count_AB, count_BB, maf, add_sd: one aggregation, combined before the shuffle."""
    g = F.col("dosage").cast("double")
    n, total = F.count("dosage"), F.coalesce(F.sum(g), F.lit(0.0))
    freq = total / F.greatest(2 * n, F.lit(1))
    return genotypes.groupBy("variant_index").agg(
        n.alias("n_obs"), *(F.count_if(g == k).alias(f"count_{c}") for k, c in enumerate(("AA", "AB", "BB"))),
        F.least(freq, 1 - freq).alias("maf"), F.nullif(F.stddev_samp(g), F.lit(0.0)).alias("add_sd")
    )


def eligible(qc: DataFrame, least: int = 0) -> DataFrame:
    """Adds genotype_filter_pass: the dosage varies and every genotype occurs often enough. Failing variants stay."""
    enough = (F.least("count_AA", "count_AB", "count_BB") >= least) if least > 0 else F.lit(True)
    return qc.withColumn("genotype_filter_pass", F.col("add_sd").isNotNull() & enough)


def standardize(genotypes: DataFrame, of: str = "dosage") -> DataFrame:
    """Adds z: centred and scaled by the variant's SD; null where the call is missing, 0 where the variant doesn't vary."""
    x = dominance(F.col("dosage")) if of == "dominance" else F.col("dosage").cast("double")
    rows = genotypes.withColumn("_x", x)
    scale = rows.groupBy("variant_index").agg(F.avg("_x").alias("_m"), F.nullif(F.stddev_samp("_x"), F.lit(0.0)).alias("_s"))
    # one row per variant: joined back, which never gathers a variant's samples as a window would
    return rows.join(scale, "variant_index").withColumn(
        "z", F.when(F.col("_x").isNotNull(), F.coalesce((F.col("_x") - F.col("_m")) / F.col("_s"), F.lit(0.0)))
    ).drop("_x", "_m", "_s")
