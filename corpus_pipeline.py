"""The cleaning pipeline over documents; its stages are in tarnlake.llm.pipeline."""

from tarnlake.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
