"""PLINK filesets and simulated cohorts."""
