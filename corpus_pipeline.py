"""The corpus pipeline: its stages, its checking SQL and its run, as the text subpackage has them."""

from snapledger.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
