"""From raw documents to a mixed, tokenized training corpus, in five stages; see ``lodestar.llm.pipeline``.

Part of the training-data subpackage, and of no use without it.
"""

from lodestar.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
