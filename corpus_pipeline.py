"""From documents to token ids in five stages; keyloom/llm/pipeline.py has them."""

from __future__ import annotations

from keyloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
