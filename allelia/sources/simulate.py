"""A family-structured cohort with additive, dominance and null traits, written as a PLINK fileset."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .plink import write_plink


def simulate(
    prefix: str, n_fam: int = 200, sibs: int = 4, n_chrom: int = 3, snps_per_chrom: int = 1000, Va: float = 0.25, Vd: float = 0.35,
    Ve: float = 0.40, n_causal_add: int = 60, n_causal_dom: int = 60, big_dom_effect: float = 6.0, seed: int = 0
) -> dict:  # noqa: N803
    """Independent loci, siblings of two random parents each; one locus of y_dom has a large overdominant effect.

    Returns the traits by sample id (y_add, y_dom, y_mix, y_null), the causal loci and the planted one.
    """
    rng = np.random.default_rng(seed)
    n, m = n_fam * sibs, n_chrom * snps_per_chrom
    maf = rng.uniform(0.15, 0.5, m)
    parents = rng.random((n_fam, 2, 2, m)) < maf  # family, parent, chromosome copy, locus
    families = np.repeat(np.arange(n_fam), sibs)
    loci = np.arange(m)
    dosage = sum(parents[families[:, None], p, rng.integers(0, 2, (n, m)), loci].astype(np.int8) for p in (0, 1)).astype(float)
    het = (dosage == 1).astype(float)

    def genetic(x: np.ndarray, at: np.ndarray, variance: float) -> np.ndarray:
        sd = x[:, at].std(0)
        part = ((x[:, at] - x[:, at].mean(0)) / np.where(sd > 0, sd, np.inf)) @ rng.normal(size=len(at))
        return part / part.std() * np.sqrt(variance)

    chosen = rng.permutation(m)
    add, dom = chosen[:n_causal_add], chosen[n_causal_add : n_causal_add + n_causal_dom]
    big = int(chosen[n_causal_add])
    ga, gd = genetic(dosage, add, Va), genetic(het, dom, Vd)
    noise = lambda v: rng.normal(size=n) * np.sqrt(v)
    iids = [f"ID{i:05d}" for i in range(n)]
    pheno = pd.DataFrame(
        {
            "y_add": ga + noise(1 - Va), "y_dom": gd + noise(1 - Vd) + big_dom_effect * (het[:, big] - het[:, big].mean()),
            "y_mix": ga + gd + noise(Ve), "y_null": noise(1.0)
        },
        index=iids
    )
    write_plink(
        prefix, dosage, iids, [str(c) for c in np.repeat(np.arange(1, n_chrom + 1), snps_per_chrom)],
        np.tile(np.arange(1, snps_per_chrom + 1) * 1000, n_chrom).tolist()
    )
    return {
        "pheno": pheno, "causal_add": add, "causal_dom": dom, "big_dom_snp": big, "big_dom_name": f"rs{big}", "n": n, "m": m,
        "maf": maf, "dosage": dosage
    }
