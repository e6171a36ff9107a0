"""A genotyped cohort read off the provided tables: a sample per embedding, a variant per dimension, traits of customers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Variants of one chromosome.
PER_CHROM = 16
#: Components under the first are dosage 0, under the second 1, else 2.
CUTS = (-0.06, 0.06)
TRAITS = ["y_bal", "y_evt", "y_ord"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant_index, chrom, snp, pos, sample_index, dosage; about one call in a hundred is missing."""
    k, x = F.col("variant_index"), F.col("x").cast("double")
    calls = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_index"), F.posexplode("embedding").alias("variant_index", "x")
    )
    missing = (F.col("sample_index") * 31 + k * 17) % 97 == 0
    dosage = F.when(missing, None).when(x < CUTS[0], 0).when(x < CUTS[1], 1).otherwise(2)
    return calls.select(
        k.cast("long").alias("variant_index"), (1 + F.floor(k / PER_CHROM)).cast("string").alias("chrom"),
        F.concat(F.lit("v"), k.cast("string")).alias("snp"), ((k % PER_CHROM + 1) * 1000).cast("long").alias("pos"), "sample_index",
        dosage.alias("dosage")
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_index, iid, level (a categorical covariate)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_index"), F.col("vec_id").cast("string").alias("iid"), F.col("label").alias("level")
    )


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iid and the traits: a customer's balance, mean order price and mean event value, each null where there is none."""
    balance = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y_bal"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("y_ord"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("y_evt"))
    wide = balance.join(orders, "id", "full").join(events, "id", "full")
    return wide.select(F.col("id").cast("string").alias("iid"), *TRAITS)


def traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_index, trait, y of the cohort's samples, without nulls."""
    from ..operators import samples as ops

    return ops.observed(
        ops.melt(ops.align(samples(spark, sf_dir).select("sample_index", "iid"), phenotypes(spark, sf_dir)), TRAITS)
    ).select("sample_index", "trait", "y")
