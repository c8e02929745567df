"""Read views: filters, pages of rows, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIFECYCLE = ["RAW", "CANDIDATE", "GROUNDED", "NORMALIZED", "ELIGIBLE_FOR_REASONING", "QUARANTINED"]
CATEGORIES = ["CORROBORATES", "CONTRADICTS", "DIFFERENT_CONTEXT", "TEMPORAL_EVOLUTION", "UNCERTAIN"]
EVIDENCE = ["VERIFIED", "PARTIAL", "UNVERIFIED"]


def contains(column: Column, query: str) -> Column:
    """Substring as SQL LIKE has it: letter case aside, % and _ of the query are wildcards."""
    return column.ilike(f"%{query}%")


def phrase(columns: list[Column], query: str) -> Column:
    """Whether the words of ``query`` stand in one column next to each other, whatever is between them."""
    words = lambda c: F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)[\w]+"), F.lit(0)), " "), F.lit(" "))
    return reduce(lambda x, y: x | y, [F.contains(words(c), words(F.lit(query))) for c in columns])


def fact_filter(facts: DataFrame, *, document_id=None, entity_id=None, predicate=None, fact_type=None, lifecycle=None, evidence=None, modality=None, eligible=None, q=None) -> DataFrame:
    """All conditions given, joined by AND; values outside a closed vocabulary are not applied."""
    c, rules = F.col, []
    if document_id is not None:
        rules.append(c("document_id") == document_id)
    if entity_id is not None:
        rules.append(c("subject_entity_id") == entity_id)
    if predicate is not None:
        rules.append(contains(c("predicate"), predicate) | contains(c("predicate_norm"), predicate))
    for value, column, known in ((fact_type, "fact_type", ["numeric", "semantic", "temporal", "categorical"]), (lifecycle, "lifecycle_state", LIFECYCLE), (evidence, "evidence_status", EVIDENCE), (modality, "modality", None)):
        if value is not None and (known is None or value in known):
            rules.append(c(column) == value)
    if eligible is not None:
        rules.append(c("reasoning_eligible") == eligible)
    if q:
        rules.append(phrase([c("subject_raw"), c("predicate"), c("object_raw"), c("value_raw")], q))
    return facts.where(reduce(lambda x, y: x & y, rules)) if rules else facts


def page_of(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an ordered list: 1 to 200 rows from ``offset`` on."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, limit)))


def either_side(relationships: DataFrame, fact_ids: DataFrame) -> DataFrame:
    """Relationships of which at least one fact is in ``fact_ids`` (id)."""
    ends = relationships.select("id", F.explode(F.array("fact_a_id", "fact_b_id")).alias("fact"))
    hit = ends.join(fact_ids.select(F.col("id").alias("fact")), "fact", "left_semi").select("id").distinct()
    return relationships.join(hit, "id", "left_semi")


def relationship_filter(relationships: DataFrame, *, category=None, dimension=None, action=None, llm_used=None, least=None, fact_ids: DataFrame | None = None) -> DataFrame:
    """All conditions given, joined by AND; ``fact_ids`` (id): at least one end among them. An unknown category is an error."""
    if category is not None and category not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    c, rules = F.col, []
    for value, column in ((category, "category"), (dimension, "context_dimension"), (action, "validation_action"), (llm_used, "llm_used")):
        if value is not None:
            rules.append(c(column) == value)
    if least is not None:
        rules.append(c("confidence") >= least)
    rows = relationships.where(reduce(lambda x, y: x & y, rules)) if rules else relationships
    return rows if fact_ids is None else either_side(rows, fact_ids)


def entity_facts(facts: DataFrame, entities: DataFrame, query: str, aliases: DataFrame | None = None) -> DataFrame:
    """Facts of entities whose label, or one of whose ``aliases`` (entity_id, surface), holds ``query``."""
    hit = entities.where(contains(F.col("canonical_label"), query)).select(F.col("id").alias("subject_entity_id"))
    if aliases is not None:
        hit = hit.union(aliases.where(contains(F.col("surface"), query)).select("entity_id"))
    return facts.join(hit.distinct(), "subject_entity_id", "left_semi")


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)


def facts_out(facts: DataFrame, evidence: DataFrame, entities: DataFrame, files: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts shaped as nested rows with document, page label, first evidence, entity, figures, period and how they were made, in one pass."""
    shown = ["page_index", "quote", "char_start", "char_end", "verification_method", "fuzzy_score", "numeric_rederivation", "evidence_status", "notes"]
    first = evidence.groupBy("fact_id").agg(F.min_by(F.struct(*[_or_null(evidence, c) for c in shown]), "id").alias("evidence"))
    named = entities.select(F.col("id").alias("subject_entity_id"), F.struct("id", "canonical_label").alias("entity"))
    doc = files.select(F.col("id").alias("document_id"), F.struct(F.coalesce("title", "original_filename").alias("title"), "publisher", "disclosure_type", "publication_date", _or_null(files, "data_vintage")).alias("document"))
    label = pages.groupBy("document_id", "page_index").agg(F.min_by("printed_label", "id").alias("printed_label"))
    out = facts.withColumnRenamed("id", "fact_id").join(first, "fact_id", "left").join(named, "subject_entity_id", "left").join(doc, "document_id", "left").join(label, ["document_id", "page_index"], "left")
    numeric = F.struct("value_raw", "numeric_value", "magnitude", _or_null(facts, "magnitude_factor", "double"), "base_value", "currency", "is_percentage", _or_null(facts, "percentage_ratio", "double"), "unit_raw", _or_null(facts, "unit_norm"))
    period = F.struct(*[F.col(f"reporting_period_{k}").alias(k) for k in ("raw", "start", "end", "type")])
    repro = F.struct("extraction_model", _or_null(facts, "prompt_version"), _or_null(facts, "extraction_temperature", "double"))
    return out.select(
        F.col("fact_id").alias("id"), "document_id", "document", "page_index", "printed_label", "lifecycle_state", "reasoning_eligible", "subject_raw", "entity", "predicate", "predicate_norm", "object_raw", "fact_type",
        F.when(F.col("fact_type") == "numeric", numeric).alias("numeric"), period.alias("reporting_period"), "scope", F.coalesce("qualifiers", F.array().cast("array<string>")).alias("qualifiers"), "modality", "evidence_status", "evidence", repro.alias("repro"),
    )


# Labels that categories are shown by.
LABELS = {c: c.replace("_", " ").capitalize() for c in CATEGORIES}


def relationships_out(relationships: DataFrame, shaped: DataFrame) -> DataFrame:
    """Relationships with the label of their category and both facts as ``facts_out`` shapes them."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("category")), F.col("category"))
    rows = relationships.withColumn("category_label", label)
    for side in "ab":
        rows = rows.join(shaped.select(F.col("id").alias(f"fact_{side}_id"), F.struct("*").alias(f"fact_{side}")), f"fact_{side}_id", "left")
    return rows


def documents_out(files: DataFrame, pages: DataFrame, facts: DataFrame, relationships: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Every document with its counts: pages, facts by state, relationships by category, failures; all documents in one pass."""
    n = F.count("*")
    states = facts.groupBy("document_id").agg(n.alias("facts"), F.count_if(F.col("evidence_status") == "UNVERIFIED").alias("facts_unverified"), F.count_if(F.col("lifecycle_state") == "QUARANTINED").alias("facts_quarantined"), F.count_if(F.col("lifecycle_state") == "ELIGIBLE_FOR_REASONING").alias("eligible_facts"))
    ends = relationships.select("id", F.coalesce("category", F.lit("")).alias("category"), F.explode(F.array_distinct(F.array("fact_a_id", "fact_b_id"))).alias("fact"))
    touched = ends.join(facts.select(F.col("id").alias("fact"), "document_id"), "fact").select("document_id", "id", "category").distinct()
    kinds = touched.groupBy("document_id", "category").agg(n.alias("n")).groupBy("document_id").agg(F.sum("n").alias("relationships"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    out = files.withColumnRenamed("id", "document_id")
    parts = [pages.groupBy("document_id").agg(n.alias("pages")), states, kinds]
    if failures is not None:
        parts.append(failures.groupBy("document_id").agg(n.alias("failures")))
    for part in parts:
        out = out.join(part, "document_id", "left")
    counts = [c for part in parts for c in part.columns if c not in ("document_id", "by_category")]
    return out.na.fill(0, counts).withColumn("by_category", F.coalesce("by_category", F.create_map().cast("map<string,bigint>")))


def status_out(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(document_id, status, run): each document with its latest ``full`` run, else its latest; ``runs``: id, document_id, run_type, ..."""
    latest = runs.groupBy("document_id").agg(F.max_by(F.struct("*"), F.struct((F.col("run_type") == "full").alias("full"), "id")).alias("run"))
    return files.select(F.col("id").alias("document_id"), "status").join(latest, "document_id", "left")


def entities_out(entities: DataFrame, facts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Entities with the numbers of their aliases and facts."""
    out = entities.join(facts.where("subject_entity_id is not null").groupBy(F.col("subject_entity_id").alias("id")).agg(F.count("*").alias("fact_count")), "id", "left")
    if aliases is not None:
        out = out.join(aliases.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("alias_count")), "id", "left")
    else:
        out = out.withColumn("alias_count", F.lit(0).cast("long"))
    return out.na.fill(0, ["fact_count", "alias_count"])


def failures_out(failures: DataFrame, *, document_id=None, failure_type=None) -> tuple[DataFrame, DataFrame]:
    """(failures that match, their counts by type)."""
    rows = failures
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    if failure_type is not None:
        rows = rows.where(F.col("failure_type") == failure_type)
    return rows, rows.groupBy("failure_type").agg(F.count("*").alias("n"))


def with_referent(failures: DataFrame, shaped: DataFrame, relationships: DataFrame) -> DataFrame:
    """Failures with the fact or the relationship that they point at."""
    fact = shaped.select(F.lit("facts").alias("ref_table"), F.col("id").alias("ref_id"), F.struct("*").alias("fact"))
    relation = relationships.select(F.lit("relationships").alias("ref_table"), F.col("id").alias("ref_id"), F.struct("*").alias("relationship"))
    return failures.join(fact, ["ref_table", "ref_id"], "left").join(relation, ["ref_table", "ref_id"], "left")


def overview(files: DataFrame, facts: DataFrame, relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """(measure, n): totals of the corpus and its relationships by category."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")
    mix = relationships.groupBy(F.coalesce("category", F.lit("none")).alias("measure")).agg(F.count("*").alias("n"))
    return one(files, "documents").union(one(facts, "facts")).union(one(facts.where("reasoning_eligible"), "eligible facts")).union(one(entities, "entities")).union(one(relationships, "relationships")).union(mix)


def first_write(relationships: DataFrame) -> DataFrame:
    """The earliest row of every pair, ends in order, pairs of a fact with itself left out."""
    a, b = F.least("fact_a_id", "fact_b_id"), F.greatest("fact_a_id", "fact_b_id")
    rows = relationships.where("fact_a_id <> fact_b_id").select(a.alias("a"), b.alias("b"), "id", "category", "confidence")
    return rows.groupBy("a", "b").agg(F.min("id").alias("id"), F.min_by("category", "id").alias("category"), F.count("*").alias("n_rows"))
