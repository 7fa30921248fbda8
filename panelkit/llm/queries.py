"""All queries of the training-data operators (imported for their registration)."""

from . import (alignment, collocations, decontaminate, exact_dedup, jaccard_join, line_quality, mixing, packing,  # noqa: F401
               revisits, secrets, substring_dedup, toxicity, url_rules)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
