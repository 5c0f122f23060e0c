"""Imports every module that registers queries."""

from lawloom.plans import queries_coding, queries_core, queries_evidence, queries_forecast, queries_language  # noqa: F401
from lawloom.plans.registry import ORACLES, QUERIES  # noqa: F401
