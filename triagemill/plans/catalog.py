"""Imports every query module so that the registry is complete."""

from triagemill.plans import (  # noqa: F401
    audit_queries,
    duplicate_queries,
    evaluation_queries,
    label_queries,
    model_queries,
    source_queries,
    split_queries,
    text_queries,
)
from triagemill.plans.registry import ORACLE, QUERIES  # noqa: F401
