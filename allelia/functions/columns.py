"""Per-row genetics as Catalyst columns: encodings, scores' clip, degrees and classes of dominance."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where |d / a| passes from additive to partial, complete and over-dominance; the smallest probability.
DEFAULT_THRESHOLDS = (0.25, 0.75, 1.25)
SMALLEST_P = 2.2250738585072014e-308


def dominance(dosage: Column) -> Column:
    """1 for a heterozygote, 0 for a homozygote, null if missing."""
    return F.when(dosage.isNotNull(), (dosage == 1).cast("double"))


def neglog10(p: Column) -> Column:
    """-log10 p with p clipped to [smallest double, 1]; null stays null."""
    return F.when(p.isNotNull(), -F.log10(F.least(F.greatest(p, F.lit(SMALLEST_P)), F.lit(1.0))))


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def degree(a: Column, d: Column) -> Column:
    """|d / a|, null where a is 0 or either isn't finite."""
    return F.abs(finite(d) / F.nullif(finite(a), F.lit(0.0)))


def coarse_class(ratio: Column, thresholds: tuple[float, float, float] = DEFAULT_THRESHOLDS) -> Column:
    """A, PD, D or OD by half-open ranges of |d / a|; NA if it isn't known."""
    low, mid, high = thresholds
    known = finite(ratio)
    return F.when(
        known.isNull() | (known < 0), "NA"
    ).when(known < low, "A").when(known < mid, "PD").when(known < high, "D").otherwise("OD")


def stable(a: Column, d: Column, se: Column | None = None, z: float = 1.0) -> Column:
    """Whether a is told apart from 0: finite, not 0, and above z standard errors where these are given."""
    sure = finite(a).isNotNull() & finite(d).isNotNull() & (F.abs(a) > 0)
    return F.coalesce(sure & (F.abs(a) > z * finite(se)) if se is not None else sure, F.lit(False))


def signed_class(
    a: Column, d: Column, se: Column | None = None, thresholds: tuple[float, float, float] = DEFAULT_THRESHOLDS, z: float = 1.0
) -> Column:
    """The coarse class, UNSTABLE where a isn't told apart from 0, NA where a or d isn't known."""
    known = finite(a).isNotNull() & finite(d).isNotNull()
    return F.when(~known, "NA").when(~stable(a, d, se, z), "UNSTABLE").otherwise(coarse_class(degree(a, d), thresholds))


def inheritance_mode(
    a: Column, d: Column, se: Column | None = None, thresholds: tuple[float, float, float] = DEFAULT_THRESHOLDS, z: float = 1.0
) -> Column:
    """The mode in words: towards which homozygote the heterozygote lies, or beyond which."""
    c = signed_class(a, d, se, thresholds, z)
    side = F.when(d / a > 0, "A1").when(d / a < 0, "A0")
    return (
        F.when(c == "UNSTABLE", "additive_near_zero").when(c == "A", "additive")
        .when(c == "PD", F.concat(F.lit("partial_dominant_"), side)).when(c == "D", F.concat(F.lit("complete_dominant_"), side))
        .when((c == "OD") & (d > 0), "overdominant_high").when((c == "OD") & (d < 0), "underdominant_low").otherwise("NA")
    )


def path_safe(name: Column) -> Column:
    """A chromosome's name as part of a path."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_.\-]", "_")


def safe_name(name: str) -> str:
    """A name as part of a path, on the driver; one that had to be changed bears a digest, so that no two names share a path."""
    safe = re.sub(r"[^A-Za-z0-9_.\-]", "_", name)
    return safe if safe == name else f"{safe}-{hashlib.sha256(name.encode()).hexdigest()[:8]}"
