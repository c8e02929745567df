"""Candidate facts: structural validation, duplicates, projection; runs of errors and call budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT_TYPES = ["numeric", "semantic", "temporal", "categorical"]
MODALITIES = ["ASSERTED", "HISTORICAL", "ESTIMATED", "FORECAST", "TARGET", "UNCERTAIN"]
PERIOD_TYPES = ["instant", "quarter", "half_year", "fiscal_year", "calendar_year", "range", "unknown"]


def reject_reason(c: dict[str, Column], length: Column) -> Column:
    """The first structural fault of a candidate, null if there is none."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    s, e = c["char_start"], c["char_end"]
    value = c["numeric_value"]
    return (
        F.when(blank(c["subject"]), "missing_subject").when(blank(c["predicate"]), "missing_predicate").when(blank(c["object"]), "missing_object").when(blank(c["quote"]), "missing_quote")
        .when(~F.coalesce(c["fact_type"].isin(FACT_TYPES), F.lit(False)), "invalid_fact_type")
        .when(c["modality"].isNotNull() & ~c["modality"].isin(MODALITIES), "invalid_modality")
        .when(c["period_type"].isNotNull() & ~c["period_type"].isin(PERIOD_TYPES), "invalid_period_type")
        .when(~F.coalesce((s >= 0) & (s < e) & (e <= length), F.lit(False)), "invalid_offsets")
        .when((c["fact_type"] == "numeric") & blank(c["value_raw"]) & value.isNull(), "numeric_missing_value")
        .when((c["fact_type"] == "numeric") & (F.isnan(value) | (F.abs(value) == float("inf"))), "numeric_unparseable")
    )


def validate(rows: DataFrame, columns: dict[str, str], chunk: str, order: str, length: Column) -> DataFrame:
    """``rows`` with ``reject_reason``; valid candidates that repeat an earlier one of their chunk are rejected too."""
    c = {k: F.col(v) for k, v in columns.items()}
    fold = lambda x: F.lower(F.trim(x))
    rows = rows.withColumn("_fault", reject_reason(c, length))
    same = Window.partitionBy(chunk, F.col("_fault").isNull(), fold(c["subject"]), fold(c["predicate"]), fold(c["object"]), c["char_start"], c["char_end"]).orderBy(order)
    again = F.col("_fault").isNull() & (F.row_number().over(same) > 1)
    return rows.withColumn("reject_reason", F.when(again, "duplicate_in_chunk").otherwise(F.col("_fault"))).drop("_fault")


def error_runs(events: DataFrame, owner: str, order: list[str], is_error: Column, limit: int = 5) -> DataFrame:
    """(owner, longest_run, aborted): the longest run of errors of every owner; a run ends with any row that is no error."""
    w = Window.partitionBy(owner).orderBy(*order)
    marked = events.select(owner, *order, is_error.alias("_bad"))
    island = marked.withColumn("_run", F.sum(F.when(F.col("_bad"), 0).otherwise(1)).over(w))
    runs = island.groupBy(owner, "_run").agg(F.count_if("_bad").alias("_n"))
    return runs.groupBy(owner).agg(F.max("_n").alias("longest_run"), (F.max("_n") >= limit).alias("aborted"))


def within_budget(chunks: DataFrame, owner: str, order: list[str], limit: int = 800) -> DataFrame:
    """The first ``limit`` chunks of every owner: the operator's feature is the limit."""
    return chunks.withColumn("call_no", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).where(F.col("call_no") <= limit)


def project(c: dict[str, Column]) -> dict[str, Column]:
    """Columns of a fact out of a valid candidate's."""
    modality = F.when(F.coalesce(c["modality"], F.lit("")) == "", "ASSERTED").when(F.lower(c["modality"]) == "projected", "FORECAST").otherwise(c["modality"])
    return {
        "predicate_norm": F.lower(F.trim(c["predicate"])),
        "value_text": F.when(c["fact_type"] != "numeric", c["object"]),
        "value_raw": F.coalesce(c["value_raw"], c["object"]),
        "scope": F.when(c["scope"].isNotNull(), F.create_map(F.lit("raw"), c["scope"])),
        "modality": modality,
    }
