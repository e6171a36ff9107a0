"""Additive and dominance association analytics on Spark: sources, operators and whole runs."""

from importlib import import_module

__version__ = "0.1.0"

#: The public names and where they live; loaded when first used.
_PUBLIC = {
    "plans.gwas": ("run_gwas", "run_blup"),
    "plans.resources": ("ResourceConfig", "ExecutionPlan", "plan_execution"),
    "sources.plink": ("read_bed", "read_bim", "read_fam", "write_plink"),
    "sources.simulate": ("simulate",),
    "operators.grm": ("compute_grm", "compute_loco_grms", "iter_loco_grms", "loco_eigensystems"),
    "operators.mixed": ("profile_fits", "score_components", "multivariate_transform", "whiten", "covariance_matrix", "grammar_residual"),
    "operators.scan": ("scan", "classify"),
    "operators.blup": ("calculate_blups", "calculate_component_blups", "write_blups"),
    "functions.columns": ("DEFAULT_THRESHOLDS", "degree", "coarse_class", "signed_class", "inheritance_mode"),
}
_WHERE = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = [*_WHERE, "__version__"]


def __getattr__(name: str) -> object:
    if name in _WHERE:
        return getattr(import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
