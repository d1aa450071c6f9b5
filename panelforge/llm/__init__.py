"""Operators for training-data corpora: cleaning, scoring, deduplication, mixing and formatting of texts.

Nothing outside this folder imports it.
"""

from panelforge.llm.base import ORACLES, QUERIES
from panelforge.llm import (  # noqa: F401  each module registers its query
    archives,
    chat,
    contamination,
    inner_products,
    language_model,
    lexical,
    licenses,
    mixing,
    near_duplicates,
    pages,
    repeats,
    spellings,
    toxicity,
)

__all__ = ["ORACLES", "QUERIES"]
