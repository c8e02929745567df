"""The core's queries by name."""

from __future__ import annotations

from factloom.plans import quantities, reference

PARTS = (reference, quantities)


def queries() -> dict:
    return {k: v for part in PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict:
    return {k: v for part in PARTS if hasattr(part, "oracle_sql") for k, v in part.oracle_sql().items()}
