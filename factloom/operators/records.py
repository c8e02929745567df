"""Records as they are stored: what a fact, an evidence row and a relationship must satisfy, states and failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.candidates import FACT_TYPES, MODALITIES

LIFECYCLE = ["RAW", "CANDIDATE", "GROUNDED", "NORMALIZED", "ELIGIBLE_FOR_REASONING", "QUARANTINED"]
FAILURE_TYPES = ["extraction_unparsed", "grounding_failed", "context_incomplete", "ocr_page", "normalization_failed", "entity_ambiguous", "relationship_uncertain", "run_error"]
FAILURE = ["document_id", "failure_type", "reason", "ref_table", "ref_id", "detail"]


def failures(rows: DataFrame, kind: str, reason: Column, ref_table: str | None = None, ref_id: Column | None = None, detail: Column | None = None) -> DataFrame:
    """Failure rows of one schema out of any table with a ``document_id``; ``detail`` is JSON."""
    none = F.lit(None)
    return rows.select(F.col("document_id").cast("long").alias("document_id"), F.lit(kind).alias("failure_type"), reason.cast("string").alias("reason"), F.lit(ref_table).cast("string").alias("ref_table"), (none if ref_id is None else ref_id).cast("long").alias("ref_id"), (none if detail is None else detail).cast("string").alias("detail"))


def all_failures(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def abort_record(runs: DataFrame, limit: int = 5) -> DataFrame:
    """One ``run_error`` failure for every document whose extraction was given up; ``runs``: document_id, longest_run, last_reason."""
    given_up = runs.where(F.col("longest_run") >= limit)
    return failures(given_up, "run_error", F.concat(F.lit("aborted after "), F.lit(limit), F.lit(" consecutive errors: "), F.coalesce("last_reason", F.lit("unknown"))), "source_files", F.col("document_id"), F.to_json(F.struct(F.col("longest_run").alias("errors"))))


def fact_faults(facts: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, fault): why a fact cannot be stored, null if it can."""
    known = files.select(F.col("id").alias("document_id"), F.lit(True).alias("_file"))
    page = pages.select("document_id", "page_index").distinct().withColumn("_page", F.lit(True))
    rows = facts.join(known, "document_id", "left").join(page, ["document_id", "page_index"], "left")
    c = F.col
    numeric = (c("fact_type") == "numeric") & c("value_raw").isNull() & c("numeric_value").isNull()
    base = F.col("numeric_value") * F.col("magnitude_factor") if "magnitude_factor" in facts.columns else None
    fault = F.when(c("_file").isNull(), "unknown_document").when(c("_page").isNull(), "page_not_in_document").when(~F.coalesce(c("fact_type").isin(FACT_TYPES), F.lit(False)), "invalid_fact_type").when(c("modality").isNotNull() & ~c("modality").isin(MODALITIES), "invalid_modality").when(numeric, "numeric_missing_value")
    if base is not None:
        off = ~c("is_percentage") & (F.abs(c("base_value") - base) > 1e-6 * F.greatest(F.abs(base), F.lit(1.0)))
        fault = fault.when(F.coalesce(off, F.lit(False)), "base_value_mismatch")
    return rows.select("id", fault.alias("fault"))


def with_search_text(facts: DataFrame) -> DataFrame:
    """Facts with the four texts that a phrase is looked for in as one column of padded words."""
    words = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"(?U)[\w]+"), F.lit(0)), " ")
    return facts.withColumn("search_text", F.concat(F.lit(" "), F.concat_ws(" \x01 ", *map(words, ("subject_raw", "predicate", "object_raw", "value_text" if "value_text" in facts.columns else "value_raw"))), F.lit(" ")))


def evidence_faults(evidence: DataFrame, facts: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, fault): why an evidence row cannot be stored, null if it can; of a fact's rows the one with the smallest id comes first."""
    of = facts.select(F.col("id").alias("fact_id"), F.col("document_id").alias("_fact_doc"))
    page = pages.where("document_id is not null and page_index is not null").groupBy("document_id", "page_index").agg(F.min_by(F.struct("id", F.length("text").alias("n")), "id").alias("_page"))
    chunk = chunks.select(F.col("id").alias("chunk_id"), F.col("document_id").alias("_chunk_doc"), F.col("page_index").alias("_chunk_page"), F.lit(True).alias("_chunk"))
    rows = evidence.select("id", "fact_id", "document_id", "page_index", "page_id", "chunk_id", "char_start", "char_end")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("fact_id").orderBy("id")))
    rows = rows.join(of, "fact_id", "left").join(page, ["document_id", "page_index"], "left").join(chunk, "chunk_id", "left")
    c = F.col
    s, e = c("char_start"), c("char_end")
    inside = F.when(s.isNull() & e.isNull(), True).otherwise(F.coalesce((s >= 0) & (s < e) & (e <= c("_page.n")), F.lit(False)))
    elsewhere = ~F.coalesce((c("_chunk_doc") == c("document_id")) & (c("_chunk_page") == c("page_index")), F.lit(False))
    fault = (
        F.when(c("_fact_doc").isNull(), "unknown_fact").when(c("_rank") > 1, "evidence_exists").when(c("_fact_doc") != c("document_id"), "evidence_document_mismatch")
        .when(c("_page").isNull(), "page_not_in_document").when(c("page_id") != c("_page.id"), "page_id_mismatch")
        .when(c("chunk_id").isNotNull() & c("_chunk").isNull(), "unknown_chunk").when(c("chunk_id").isNotNull() & elsewhere, "chunk_not_in_page").when(~inside, "invalid_offsets")
    )
    return rows.select("id", fault.alias("fault"))


def chains(facts: DataFrame, evidence: DataFrame, files: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fact_id, evidence_id, chunk_id, page_id, document_id) of every fact whose first evidence leads to a page and a file, by way of its chunk where it names one."""
    first = evidence.groupBy("fact_id").agg(F.min_by(F.struct("id", "document_id", "page_index", "chunk_id"), "id").alias("e")).select("fact_id", F.col("e.id").alias("evidence_id"), "e.document_id", "e.page_index", "e.chunk_id")
    page = pages.groupBy("document_id", "page_index").agg(F.min("id").alias("page_id"))
    chunk = chunks.select(F.col("id").alias("chunk_id"), "document_id", "page_index", F.lit(True).alias("_chunk"))
    rows = first.join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").join(page, ["document_id", "page_index"]).join(files.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    rows = rows.join(chunk, ["chunk_id", "document_id", "page_index"], "left").where("chunk_id is null or _chunk")
    return rows.select("fact_id", "evidence_id", "chunk_id", "page_id", "document_id")


def promote(facts: DataFrame, chain: DataFrame) -> DataFrame:
    """Facts with ``lifecycle_state`` and ``reasoning_eligible`` after promotion, and ``promotion_fault`` where one that is not quarantined cannot be promoted."""
    intact = chain.select(F.col("fact_id").alias("id"), F.lit(True).alias("_intact"))
    c = F.col
    fault = F.when(c("lifecycle_state") == "QUARANTINED", "fact_quarantined").when(c("_intact").isNull(), "evidence_required").when(~F.coalesce(c("evidence_status").isin("VERIFIED", "PARTIAL"), F.lit(False)), "evidence_unverified")
    rows = facts.join(intact, "id", "left").withColumn("promotion_fault", fault).drop("_intact")
    up = c("promotion_fault").isNull() & c("lifecycle_state").isin("NORMALIZED", "ELIGIBLE_FOR_REASONING")
    return rows.withColumns({"lifecycle_state": F.when(up, "ELIGIBLE_FOR_REASONING").otherwise(c("lifecycle_state")), "reasoning_eligible": up})


def move(facts: DataFrame, state: str) -> DataFrame:
    """Facts moved to a state that needs no proof."""
    if state not in LIFECYCLE:
        raise ValueError(f"invalid_lifecycle_state: {state}")
    if state in ("QUARANTINED", "ELIGIBLE_FOR_REASONING"):
        raise ValueError(f"{state} is reached through quarantine or promotion only")
    return facts.withColumn("lifecycle_state", F.lit(state))


def quarantine(facts: DataFrame, reasons: DataFrame) -> DataFrame:
    """Facts of which those named in ``reasons`` (id, reason) are quarantined; a blank reason is an error of the caller and leaves the fact as it is."""
    why = reasons.where("trim(coalesce(reason, '')) <> ''").groupBy("id").agg(F.min("reason").alias("_why"))
    rows, hit = facts.join(why, "id", "left"), F.col("_why").isNotNull()
    return rows.withColumns({"lifecycle_state": F.when(hit, "QUARANTINED").otherwise(F.col("lifecycle_state")), "reasoning_eligible": ~hit & F.col("reasoning_eligible"), "quarantine_reason": F.when(hit, F.col("_why")).otherwise(F.col("quarantine_reason"))}).drop("_why")


def relationship_faults(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (fact_a_id, fact_b_id, ...) with ends in order and ``fault``: a fact with itself, an unknown fact, one that is not eligible."""
    a, b = F.least("fact_a_id", "fact_b_id"), F.greatest("fact_a_id", "fact_b_id")
    rows = pairs.withColumns({"fact_a_id": a, "fact_b_id": b})
    for side in ("a", "b"):
        rows = rows.join(facts.select(F.col("id").alias(f"fact_{side}_id"), F.coalesce("reasoning_eligible", F.lit(False)).alias(f"_{side}")), f"fact_{side}_id", "left")
    fault = F.when(F.col("fact_a_id") == F.col("fact_b_id"), "self_relationship").when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown_fact").when(~(F.col("_a") & F.col("_b")), "not_reasoning_eligible")
    return rows.withColumn("fault", fault).drop("_a", "_b")
