"""Registered queries: name to Spark function and to the equivalent SQL."""

from __future__ import annotations

from . import evaluation, evidence, features, gates, holdout, ledgers, models, raw, records_ledger, sessions, validation

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (features, evaluation, ledgers, models, validation, evidence, raw, records_ledger, sessions, gates, holdout):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
