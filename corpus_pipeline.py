"""Documents to packed training sequences in five stages; see allelia.llm.pipeline, where they are defined."""

from allelia.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
