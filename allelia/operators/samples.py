"""The samples' side: alignment, masks, groups of traits that share samples, encoded covariates. Relational forms, then matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_SAMPLES = 5


# --- relational ---


def align(fam: DataFrame, pheno: DataFrame) -> DataFrame:
    """The fileset's samples that have a phenotype row, with it; sample_index keeps the fileset's order."""
    return fam.join(pheno, "iid")


def unaligned(fam: DataFrame, pheno: DataFrame) -> DataFrame:
    """Phenotyped samples that the fileset lacks."""
    return pheno.join(fam, "iid", "left_anti")


def melt(pheno: DataFrame, traits: list[str]) -> DataFrame:
    """(sample_index, iid, trait, y) of every trait column."""
    return pheno.unpivot([c for c in ("sample_index", "iid") if c in pheno.columns], traits, "trait", "y")


def observed(long: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    """Rows whose trait is known and whose covariates all are."""
    kept = long.where(F.col("y").isNotNull() & ~F.isnan("y"))
    if covariates is None:
        return kept
    known = covariates.where(" AND ".join(f"`{c}` IS NOT NULL" for c in covariates.columns if c != "sample_index"))
    return kept.join(known.select("sample_index"), "sample_index", "left_semi")


def mask_groups(long: DataFrame) -> DataFrame:
    """traits, n: traits grouped by the set of samples that they are observed on, at least LEAST_SAMPLES.

    A set is told by its size and two sums of its members' hashes, which are combined before the shuffle. One row per
    trait and sample is taken for granted.
    """
    member = F.xxhash64("sample_index")
    masks = long.groupBy("trait").agg(
        F.count("*").alias("n"), F.sum(member.cast("decimal(38,0)")).alias("total"),
        F.bit_xor(F.xxhash64("sample_index", F.lit(1))).alias("mixed")
    ).where(F.col("n") >= LEAST_SAMPLES)
    return masks.groupBy("n", "total", "mixed").agg(F.sort_array(F.collect_list("trait")).alias("traits")).select("traits", "n")


def complete_cases(long: DataFrame, traits: int) -> DataFrame:
    """Samples observed on all of so many traits."""
    return long.groupBy("sample_index").agg(F.count("*").alias("n")).where(F.col("n") == traits).select("sample_index")


def binary(long: DataFrame) -> DataFrame:
    """Traits of exactly two distinct values, which the linear model refuses."""
    return long.groupBy("trait").agg(F.count_distinct("y").alias("values")).where("values = 2").select("trait")


def one_hot(df: DataFrame, column: str, levels: list | None = None) -> DataFrame:
    """Adds a 0/1 column per level but the first; null stays null, so that the sample is left out."""
    if levels is None:
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(1001).collect()]
        if len(levels) > 1000:
            raise ValueError(f"{column} has over 1000 levels")
    return df.select(
        "*", *(F.when(F.col(column).isNotNull(), (F.col(column) == x).cast("double")).alias(f"{column}_{x}") for x in levels[1:])
    )


def pivot(long: DataFrame, value: str, traits: list[str], key: str = "variant_index") -> DataFrame:
    """A row per key and a column per trait."""
    return long.groupBy(key).pivot("trait", traits).agg(F.first(value))


# --- matrices; samples and traits are few, variants never come here ---


def load_pheno(spark: SparkSession, pheno) -> pd.DataFrame:
    """A frame indexed by string iid from a frame, a DataFrame or a white-space-separated file with an iid, id or second column of ids."""
    if isinstance(pheno, pd.DataFrame):
        frame = pheno.copy()
    else:
        if isinstance(pheno, DataFrame):
            frame = pheno.toPandas()
        else:
            lines = [r[0].split() for r in spark.read.text(str(pheno)).collect() if r[0].strip()]
            frame = pd.DataFrame(lines[1:], columns=lines[0])
        lower = {str(c).lower(): c for c in reversed(list(frame.columns))}
        named = lower.get("iid", lower.get("id", frame.columns[min(1, frame.shape[1] - 1)]))
        frame = frame.set_index(named).drop(columns=[c for c in frame.columns if str(c).upper() == "FID" and c != named])
    frame.index = frame.index.astype(str)
    if frame.index.has_duplicates:
        raise ValueError("phenotype rows must have unique ids")
    return frame


def encode(covariates, ids: list[str], categorical: list[str] | None = None) -> np.ndarray | None:
    """Numbers first, then 0/1 columns of each categorical's levels but the first; a missing level is NaN, so its sample is left out."""
    if covariates is None:
        return None
    if not isinstance(covariates, pd.DataFrame):
        out = np.asarray(covariates, float)
        out = out[:, None] if out.ndim == 1 else out
        if len(out) != len(ids):
            raise ValueError("a covariate array needs one row per aligned sample")
        return out
    covariates = covariates.set_axis(covariates.index.astype(str), axis=0)
    absent = [i for i in ids if i not in covariates.index]
    if absent:
        raise KeyError(f"samples without covariates: {absent[:5]}")
    rows = covariates.loc[ids]
    kinds = {
        c: c in (categorical or ()) or not pd.api.types.is_numeric_dtype(rows[c]) or pd.api.types.is_bool_dtype(rows[c])
        for c in rows
    }
    parts = [pd.to_numeric(rows[c], errors="coerce").to_numpy(float)[:, None] for c in rows if not kinds[c]]
    for c in (c for c in rows if kinds[c]):
        text = rows[c].astype("string")
        parts += [
            np.where(text.isna(), np.nan, (text == x).fillna(False).astype(float))[:, None]
            for x in sorted(text.dropna().unique())[1:]
        ]
    return np.column_stack(parts) if parts else None


def numeric_traits(frame: pd.DataFrame, traits: list[str] | None) -> pd.DataFrame:
    """The traits as numbers, NaN if not; two-valued ones are refused."""
    traits = list(traits or frame.columns)
    absent = [t for t in traits if t not in frame.columns]
    if absent:
        raise ValueError(f"traits missing from the phenotypes: {absent}")
    out = frame[traits].apply(pd.to_numeric, errors="coerce").astype(float)
    for t in traits:
        if out[t].nunique() == 2:
            raise ValueError(f"{t} has two values; only quantitative traits are analysed")
    return out


def groups(Y: np.ndarray, covariates: np.ndarray | None, separate: bool = True) -> list[tuple[np.ndarray, list[int]]]:
    """Sample masks with the places of the traits that share each, in order of first trait."""
    known = np.isfinite(Y) & (np.isfinite(covariates).all(1)[:, None] if covariates is not None else True)
    if not separate:
        return [(known.all(1), list(range(Y.shape[1])))]
    out: dict[bytes, tuple[np.ndarray, list[int]]] = {}
    for j in range(Y.shape[1]):
        out.setdefault(known[:, j].tobytes(), (known[:, j], []))[1].append(j)
    return list(out.values())
