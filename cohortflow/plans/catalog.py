"""Imports every query module so that the registry is complete."""

from . import q_children, q_cohort, q_eval, q_functions, q_io, q_label, q_models, q_prep, q_profile, q_resample  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
