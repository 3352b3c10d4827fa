"""Imports every module that registers queries."""

from sievework.plans import advice, cascades, evaluation, issues, payloads, relations, scalars, streams  # noqa: F401
