"""Queries over quantities in common units."""

from __future__ import annotations

from factloom.operators import units
from factloom.tables import table


def p6_found(spark, folder):
    return units.equal_statements(table(spark, folder, "facts"), table(spark, folder, "common_units"))


def p6_quantities(spark, folder):
    return units.quantities(table(spark, folder, "facts"), table(spark, folder, "common_units"))


def p6_classes(spark, folder):
    return units.equal_classes(table(spark, folder, "facts"), table(spark, folder, "common_units"))


def queries() -> dict:
    return {"p6_classes": p6_classes, "p6_found": p6_found, "p6_quantities": p6_quantities}
