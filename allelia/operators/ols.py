"""Ordinary least squares scans in relational form: every test of a (variant, trait) from one row of sums.

Genotype rows join the samples' traits once; the sums combine before the shuffle, and nothing else is shuffled. Missing
calls count as the variant's mean, as in the kernel scan with an unrelated covariance and an intercept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
#: A determinant under so much of its product is rounding: the two predictors are one.
SINGULAR = 1e-12


def moments(genotypes: DataFrame, traits: DataFrame) -> DataFrame:
    """variant_index, trait and sums over the trait's samples. traits: sample_index, trait, y without nulls."""
    g, y = F.col("dosage").cast("double"), F.col("y")
    het = F.when(g == 1, 1.0).when(g.isNotNull(), 0.0)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    rows = genotypes.select("variant_index", "sample_index", "dosage").join(traits, "sample_index")
    return rows.groupBy("variant_index", "trait").agg(
        F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.count(g).alias("n_obs"), zero(g).alias("sg"),
        zero(g * g).alias("sgg"), zero(het).alias("sh"), zero(g * y).alias("sgy"), zero(het * y).alias("shy"),
        zero(F.when(g.isNotNull(), y)).alias("syo"), zero(F.when(g.isNotNull(), y * y)).alias("syyo")
    )


def _terms(m: DataFrame) -> DataFrame:
    sd = lambda s, ss: F.sqrt(
        F.when((F.col("n_obs") > 1) & (ss - s * s / F.col("n_obs") > 1e-12), (ss - s * s / F.col("n_obs")) / (F.col("n_obs") - 1))
    )
    n, sg, sh = F.col("n_obs"), F.col("sg"), F.col("sh")
    m = m.withColumns(
        {"add_sd": sd(sg, F.col("sgg")), "dom_sd": sd(sh, sh), "ypy": F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")}
    )
    return m.withColumns(
        {
            "ay": (F.col("sgy") - sg / n * F.col("syo")) / F.col("add_sd"),
            "dy": (F.col("shy") - sh / n * F.col("syo")) / F.col("dom_sd"), "aa": (n - 1).cast("double"),
            "ad": (sh - sg * sh / n) / (F.col("add_sd") * F.col("dom_sd"))
        }
    )


def _root(x: Column) -> Column:
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))  # greatest alone skips nulls


def marginal(m: DataFrame, which: str = "additive") -> DataFrame:
    """variant_index, trait, beta, beta_raw, se_raw, stat of one predictor, additive or dominance."""
    t = _terms(m)
    xy, sd = (F.col("ay"), F.col("add_sd")) if which == "additive" else (F.col("dy"), F.col("dom_sd"))
    ok = sd.isNotNull() & (F.col("aa") > EPS) & (F.col("n") > 2)
    beta = F.when(ok, xy / F.col("aa"))
    se = _root((F.col("ypy") - beta * xy) / ((F.col("n") - 2) * F.col("aa")))
    return t.select(
        "variant_index", "trait", beta.alias("beta"), (beta / sd).alias("beta_raw"), (se / sd).alias("se_raw"),
        (beta / F.nullif(se, F.lit(0.0))).alias("stat")
    )


def joint(m: DataFrame) -> DataFrame:
    """variant_index, trait, n, genotype_filter_pass and the additive and dominance effects fitted together, on the dosage scale."""
    t = _terms(m).withColumn("det", F.col("aa") * F.col("aa") - F.col("ad") * F.col("ad"))
    ok = F.coalesce((F.col("det") > EPS) & (F.col("det") > SINGULAR * F.col("aa") * F.col("aa")), F.lit(False)) & (F.col("n") > 3)
    t = t.withColumns({"ok": ok, "det": F.when(ok, F.col("det"))})
    t = t.withColumns(
        {
            "ba": (F.col("aa") * F.col("ay") - F.col("ad") * F.col("dy")) / F.col("det"),
            "bd": (F.col("aa") * F.col("dy") - F.col("ad") * F.col("ay")) / F.col("det")
        }
    )
    t = t.withColumn(
        "s2", F.greatest(F.col("ypy") - F.col("ba") * F.col("ay") - F.col("bd") * F.col("dy"), F.lit(0.0)) / (F.col("n") - 3)
    )
    t = t.withColumn("se", _root(F.col("s2") * F.col("aa") / F.col("det")))
    stat = lambda b: F.col(b) / F.nullif(F.col("se"), F.lit(0.0))
    return t.select(
        "variant_index", "trait", "n", F.col("ok").alias("genotype_filter_pass"),
        (F.col("ba") / F.col("add_sd")).alias("beta_add_joint_raw"), (F.col("se") / F.col("add_sd")).alias("se_add_joint_raw"),
        (F.col("bd") / F.col("dom_sd")).alias("beta_dom_joint_raw"), (F.col("se") / F.col("dom_sd")).alias("se_dom_joint_raw"),
        stat("ba").alias("stat_add_joint"), stat("bd").alias("stat_dom_joint"), (stat("bd") * stat("bd")).alias("f_avsad")
    )


def observed_only(m: DataFrame) -> DataFrame:
    """variant_index, trait, n_obs and additive tests on the samples with a call alone: nothing imputed, n_obs - 2 degrees of freedom.

    For traits that are whitened beforehand; f is the gain of a dominance term over its residual, on n_obs - 3.
    """
    t = _terms(m)
    yy = F.col("syyo") - F.col("syo") * F.col("syo") / F.col("n_obs")
    ok = F.col("add_sd").isNotNull() & (F.col("n_obs") > 2)
    beta = F.when(ok, F.col("ay") / F.col("aa"))
    rss = yy - beta * F.col("ay")
    se = _root(rss / ((F.col("n_obs") - 2) * F.col("aa")))
    det = F.col("aa") * F.col("aa") - F.col("ad") * F.col("ad")
    both = F.when((F.col("n_obs") > 3) & (det > SINGULAR * F.col("aa") * F.col("aa")), det)
    extra = F.pow(F.col("dy") - F.col("ad") * beta, F.lit(2.0)) * F.col("aa") / both
    f = extra / ((rss - extra) / (F.col("n_obs") - 3))
    return t.select(
        "variant_index", "trait", "n_obs", (beta / F.col("add_sd")).alias("beta_raw"), (se / F.col("add_sd")).alias("se_raw"),
        (beta / F.nullif(se, F.lit(0.0))).alias("stat"), f.alias("f")
    )


def demeaned(genotypes: DataFrame, traits: DataFrame, factor: DataFrame) -> DataFrame:
    """Additive tests with an intercept and one categorical covariate (sample_index, level): both sides less their level's mean.

    Dosages are first centred and mean-imputed over the trait's samples, as the kernel does.
    """
    rows = genotypes.select(
        "variant_index", "sample_index", F.col("dosage").cast("double").alias("g")
    ).join(traits, "sample_index").join(factor, "sample_index")
    mean = rows.groupBy("variant_index", "trait").agg(F.avg("g").alias("m"), F.nullif(F.stddev_samp("g"), F.lit(0.0)).alias("sd"))
    z = rows.join(mean, ["variant_index", "trait"]).withColumn("z", F.coalesce((F.col("g") - F.col("m")) / F.col("sd"), F.lit(0.0)))
    cells = z.groupBy("variant_index", "trait", "level").agg(
        F.count("*").alias("n"), F.max("sd").alias("sd"),
        *(
            F.sum(e).alias(k) for k,
            e in (
                ("z", F.col("z")), ("y", F.col("y")), ("zz", F.col("z") * F.col("z")), ("zy", F.col("z") * F.col("y")),
                ("yy", F.col("y") * F.col("y"))
            )
        )
    )
    inside = lambda a, b, ab: F.sum(F.col(ab) - F.col(a) * F.col(b) / F.col("n"))
    t = cells.groupBy("variant_index", "trait").agg(
        F.sum("n").alias("n"), F.count("*").alias("levels"), F.max("sd").alias("sd"), inside("z", "z", "zz").alias("zz"),
        inside("z", "y", "zy").alias("zy"), inside("y", "y", "yy").alias("yy")
    )
    df = F.col("n") - F.col("levels") - 1
    ok = F.col("sd").isNotNull() & (F.col("zz") > EPS) & (df > 0)
    beta = F.when(ok, F.col("zy") / F.col("zz"))
    se = _root((F.col("yy") - beta * F.col("zy")) / (df * F.col("zz")))
    return t.select(
        "variant_index", "trait", "n", (beta / F.col("sd")).alias("beta_raw"), (se / F.col("sd")).alias("se_raw"),
        (beta / F.nullif(se, F.lit(0.0))).alias("stat")
    )
