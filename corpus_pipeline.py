"""The pipeline over documents: STAGES in order, run(spark, sf_dir), and ORACLE_SQL; see rollcall/llm/pipeline.py."""

from rollcall.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
