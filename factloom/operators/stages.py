"""Stages of the fact pipeline as functions of tables, and the pipeline that composes them.

Nothing is updated in place: a stage takes tables and gives tables, with the rows it rejects as failures of one schema.
Extractors and confirmers are callables that are passed in; without them the stages that need one are left out or leave
their residual rows open.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import numbers, periods
from factloom.operators import candidates, grounding, records, resolve, retrieval, signals
from factloom.tables import cut

CANDIDATE = "subject string, predicate string, object string, fact_type string, raw_value_text string, parsed_value double, unit string, magnitude string, currency string, percentage boolean, ratio double, reporting_period string, period_type string, scope string, qualifiers array<string>, modality string, quote string, char_start int, char_end int"
REQUIRED = ["subject", "predicate", "object", "fact_type", "quote", "char_start", "char_end"]
FIELDS = [c.strip().split(" ")[0] for c in CANDIDATE.split(", ")]
CALL_ERRORS = ["api_error", "rate_limit", "timeout", "refusal", "client_exception"]
MAX_ITEMS = 100_000


def resolve_convention(files: DataFrame, pages: DataFrame, default: str = "apr-mar") -> DataFrame:
    """(document_id, convention, source) for every file: the stored convention, else the first statement in its pages, else ``default``.

    A statement of the fiscal year's end on any page comes before a looser one; the first of its kind decides, even if
    its month is none that a convention ends with.
    """
    words = pages.select("document_id", "page_index", periods.year_end_words(F.col("text")).alias("w"))
    first = lambda k: F.min_by(F.col(f"w.{k}"), F.when(F.col(f"w.{k}").isNotNull(), F.col("page_index")))
    found = words.groupBy("document_id").agg(F.coalesce(first("stated"), first("loose")).alias("month"))
    found = found.select(F.col("document_id").alias("id"), periods.convention_of(F.col("month")).alias("detected"))
    stored = F.when(F.col("fy_convention").isin(*periods.FY_START), F.col("fy_convention"))
    source = F.when(stored.isNotNull(), "override").when(F.col("detected").isNotNull(), "detected").otherwise("config_default")
    return files.select("id", "fy_convention").join(found, "id", "left").select(F.col("id").alias("document_id"), F.coalesce(stored, "detected", F.lit(default)).alias("convention"), source.alias("source"))


def document_header(files: DataFrame) -> DataFrame:
    """(document_id, header): what is known of a document, for an extractor."""
    known = lambda c: F.nullif(F.col(c), F.lit("unknown"))
    return files.select(F.col("id").alias("document_id"), F.concat_ws(" | ", "title", "publisher", known("disclosure_type"), F.col("publication_date").cast("string"), known("fy_convention")).alias("header"))


def parse_reply(reply: str | None) -> tuple[list[dict] | None, str | None]:
    """(candidates, error) of an extractor's reply: JSON of the one schema, where a name that it does not know is an error."""
    try:
        data = json.loads(reply or "")
    except ValueError:
        return None, "json_decode_error"
    if not isinstance(data, dict) or set(data) - {"facts"} or not isinstance(data.get("facts", []), list):
        return None, "schema_validation_error"
    kinds = {"parsed_value": (int, float), "ratio": (int, float), "percentage": (bool,), "qualifiers": (list,), "char_start": (int,), "char_end": (int,)}
    for x in data.get("facts", []):
        if not isinstance(x, dict) or set(x) - set(FIELDS) or any(x.get(k) is None for k in REQUIRED):
            return None, "schema_validation_error"
        if any(v is not None and not (isinstance(v, kinds.get(k, (str,))) and (k == "percentage" or not isinstance(v, bool))) for k, v in x.items()):
            return None, "schema_validation_error"
    return data.get("facts", []), None


@dataclass
class Extraction:
    """``raw``: one row a chunk with the reply as it came; facts and their evidence; ``rejected`` candidates; failures."""

    raw: DataFrame
    facts: DataFrame
    evidence: DataFrame
    rejected: DataFrame
    failures: DataFrame


def extract(chunks: DataFrame, files: DataFrame, extractor: Callable[[str, str], object], limit: int = 5, budget: int = 800, model: str = "passed in") -> Extraction:
    """Candidates of an ``extractor``: (text, header) -> reply (JSON text, a dict, or {"error_code": ...}).

    Every asked chunk has its reply stored, whatever came of it. A document's chunks behind ``limit`` errors of the
    extractor in a row are not taken. A fact's id is made of its chunk's and its place in the reply.
    """
    order = ["page_index", "seq", "id"]
    asked = candidates.within_budget(chunks.select("id", "document_id", "page_index", "seq", "char_offset", F.coalesce("header_prefix_len", F.lit(0)).alias("prefix"), "text"), "document_id", order, budget)
    asked = asked.join(document_header(files), "document_id", "left").where("coalesce(text, '') <> ''")

    def run(batches):
        for rows in batches:
            out = []
            for text, header in zip(rows["text"], rows["header"]):
                try:
                    said = extractor(text, header or "")
                    code = said.get("error_code") if isinstance(said, dict) else None
                    reply = said if isinstance(said, str) else json.dumps(said, ensure_ascii=False)
                except Exception as e:  # one broken call is one failed chunk
                    code, reply = "client_exception", repr(e)[:200]
                found, error = (None, code) if code else parse_reply(reply)
                out.append((reply, error, None if found is None else len(found), json.dumps({"facts": found or []}, ensure_ascii=False)))
            made = pd.DataFrame(out, columns=["reply", "error", "items", "clean"])
            yield pd.concat([rows[["id", "document_id", "page_index", "seq", "char_offset", "prefix"]].reset_index(drop=True), rows["text"].str.len().rename("size").reset_index(drop=True), made], axis=1)

    replies = cut(asked.mapInPandas(run, "id long, document_id long, page_index int, seq int, char_offset int, prefix int, size long, reply string, error string, items int, clean string"))
    failed = F.coalesce(F.col("error").isin(CALL_ERRORS), F.lit(False))
    of = Window.partitionBy("document_id").orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(of)
    runs = replies.withColumns({"failed": failed, "island": island})
    runs = runs.withColumn("run", F.sum(F.col("failed").cast("int")).over(Window.partitionBy("document_id", "island").orderBy(*order)))
    runs = cut(runs.withColumn("over", F.coalesce(F.max(F.col("run")).over(of.rowsBetween(Window.unboundedPreceding, -1)) >= limit, F.lit(False))).where("not over"))
    raw = runs.select(F.col("id").alias("chunk_id"), "document_id", "page_index", "reply", "error", F.col("items").alias("item_count"), F.lit(model).alias("model_name"))
    parsed = F.from_json("clean", f"struct<facts:array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ',')}>>>")["facts"]
    found = runs.where("error is null").select(F.col("id").alias("chunk_id"), "document_id", "page_index", "char_offset", "prefix", "size", F.posexplode(parsed).alias("place", "c")).select("chunk_id", "document_id", "page_index", "char_offset", "prefix", "size", "place", "c.*")
    names = {"subject": "subject", "predicate": "predicate", "object": "object", "quote": "quote", "fact_type": "fact_type", "modality": "modality", "period_type": "period_type", "char_start": "char_start", "char_end": "char_end", "value_raw": "raw_value_text", "numeric_value": "parsed_value"}
    # a model's "projected" is a modality of its own spelling
    spelt = F.when(F.coalesce("modality", F.lit("")) == "", None).when(F.lower("modality") == "projected", "FORECAST").otherwise(F.col("modality"))
    judged = cut(candidates.validate(found.withColumn("modality", spelt), names, "chunk_id", "place", F.col("size")))
    good = judged.where("reject_reason is null").withColumn("id", F.col("chunk_id") * MAX_ITEMS + F.col("place"))
    c = {k: F.col(v) for k, v in names.items()} | {"scope": F.col("scope")}
    made = candidates.project(c)
    none = F.lit(None)
    facts = good.select(
        "id", "document_id", "page_index", F.lit("CANDIDATE").alias("lifecycle_state"), none.cast("string").alias("quarantine_reason"), F.col("subject").alias("subject_raw"), none.cast("long").alias("subject_entity_id"), "predicate", made["predicate_norm"].alias("predicate_norm"), F.col("object").alias("object_raw"), "fact_type",
        made["value_text"].alias("value_text"), F.when(F.col("fact_type") == "numeric", made["value_raw"]).alias("value_raw"), F.col("parsed_value").alias("numeric_value"), "magnitude", none.cast("double").alias("magnitude_factor"), none.cast("double").alias("base_value"), "currency", F.coalesce("percentage", F.lit(False)).alias("is_percentage"), F.col("ratio").alias("percentage_ratio"), F.col("unit").alias("unit_raw"), none.cast("string").alias("unit_norm"),
        F.col("reporting_period").alias("reporting_period_raw"), none.cast("date").alias("reporting_period_start"), none.cast("date").alias("reporting_period_end"), F.col("period_type").alias("reporting_period_type"), made["scope"].alias("scope"), "qualifiers", made["modality"].alias("modality"), F.lit("UNVERIFIED").alias("evidence_status"), F.lit(False).alias("reasoning_eligible"), F.lit(model).alias("extraction_model"),
    )
    at = F.col("char_offset") - F.col("prefix")  # offsets of a reply count the repeated head line too
    evidence = good.select("id", F.col("id").alias("fact_id"), "document_id", "page_index", none.cast("long").alias("page_id"), "chunk_id", (at + F.col("char_start")).cast("int").alias("char_start"), (at + F.col("char_end")).cast("int").alias("char_end"), "quote")
    rejected = judged.where("reject_reason is not null").select("chunk_id", "document_id", "place", "reject_reason")
    ends = runs.groupBy("document_id").agg(F.max("run").alias("longest_run"), F.max_by("error", F.struct(*order)).alias("last_reason"))
    lost = [
        records.failures(runs.where("error is not null"), "extraction_unparsed", F.col("error"), "chunks", F.col("id")),
        records.failures(rejected, "extraction_unparsed", F.col("reject_reason"), "chunks", F.col("chunk_id")),
        records.abort_record(ends, limit),
    ]
    return Extraction(raw, facts, evidence, rejected, records.all_failures(lost))


def ground(facts: DataFrame, evidence: DataFrame, pages: DataFrame, chunks: DataFrame, threshold: float = 90.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, evidence, failures) after verification: verified candidates are GROUNDED, the others QUARANTINED with their reason."""
    first = evidence.join(evidence.groupBy("fact_id").agg(F.min("id").alias("id")), ["fact_id", "id"], "left_semi")
    judged = cut(grounding.verify(first, pages, chunks, facts, threshold))
    said = judged.select(F.col("fact_id").alias("id"), F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    ok = F.col("_status").isin("VERIFIED", "PARTIAL")
    state = F.when(~ok, "QUARANTINED").when(F.col("lifecycle_state").isin("RAW", "CANDIDATE", "QUARANTINED"), "GROUNDED").otherwise(F.col("lifecycle_state"))
    rows = facts.join(said, "id").withColumns({"lifecycle_state": state, "evidence_status": F.col("_status"), "quarantine_reason": F.when(~ok, F.col("_reason")), "reasoning_eligible": F.coalesce("reasoning_eligible", F.lit(False)) & ok})
    lost = records.failures(rows.where(~ok), "grounding_failed", F.col("_reason"), "facts", F.col("id"))
    seen = judged.where("id is not null").select("id", "status", "method", "rederivation", "fuzzy_score", F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    kept = first.drop("evidence_status", "verification_method", "numeric_rederivation", "fuzzy_score").join(seen, "id")
    kept = kept.withColumns({"char_start": F.coalesce("_s", "char_start"), "char_end": F.coalesce("_e", "char_end")}).withColumnsRenamed({"status": "evidence_status", "method": "verification_method", "rederivation": "numeric_rederivation"}).drop("_s", "_e")
    return rows.drop("_status", "_reason"), kept, lost


def normalize(facts: DataFrame, conventions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, failures): grounded facts with value, magnitude, currency, unit and period read from their texts.

    A stated number comes before the one in the text, which still gives magnitude and percentage. A numeric fact with
    neither stays GROUNDED. ``conventions``: document_id, convention.
    """
    rows = facts.join(conventions.select("document_id", "convention"), "document_id", "left")
    work, c = F.col("lifecycle_state").isin("GROUNDED", "NORMALIZED"), F.col
    n = numbers.parse_number(c("value_raw"))
    numeric = work & (c("fact_type") == "numeric")
    rows = rows.withColumns({"_value": n["value"], "_magnitude": n["magnitude"], "_factor": n["factor"], "_ratio": n["ratio"], "_pct": n["is_pct"], "_numeric": numeric, "_currency": numbers.parse_currency(F.concat_ws(" ", "value_raw", "unit_raw", "currency"))})
    lost = c("_numeric") & c("_value").isNull() & c("numeric_value").isNull()
    read = c("_numeric") & c("_value").isNotNull()
    own = F.coalesce("numeric_value", "_value")
    labels = rows.where(work & (F.coalesce("reporting_period_raw", F.lit("")) != "")).select("reporting_period_raw", "convention").distinct()
    parsed = labels.withColumn("_p", periods.parse_period(c("reporting_period_raw"), c("convention")))
    same = [rows["reporting_period_raw"] == parsed["reporting_period_raw"], rows["convention"].eqNullSafe(parsed["convention"])]
    rows = rows.join(parsed, same, "left").drop(parsed["reporting_period_raw"]).drop(parsed["convention"])
    has = work & c("_p").isNotNull()
    made = {
        "numeric_value": F.when(c("_numeric"), own).otherwise(c("numeric_value")),
        "magnitude": F.when(read, c("_magnitude")).otherwise(c("magnitude")),
        "magnitude_factor": F.when(read, c("_factor")),
        "is_percentage": F.when(read, c("_pct")).otherwise(c("is_percentage")),
        "base_value": F.when(read, F.when(c("_pct"), c("_ratio")).otherwise(own * F.coalesce("_factor", F.lit(1.0)))).otherwise(c("base_value")),
        "unit_norm": F.when(c("_numeric"), numbers.parse_unit(c("unit_raw"), F.coalesce("_currency", "currency"))),
        "currency": F.when(c("_numeric"), F.coalesce("_currency", "currency")).otherwise(c("currency")),
        **{f"reporting_period_{k}": F.when(has, c(f"_p.{k}")).otherwise(c(f"reporting_period_{k}")) for k in ("start", "end", "type")},
        "lifecycle_state": F.when((c("lifecycle_state") == "GROUNDED") & ~lost, "NORMALIZED").otherwise(c("lifecycle_state")),
        "_lost": lost,
    }
    rows = cut(rows.withColumns(made))
    failed = records.failures(rows.where("_lost"), "normalization_failed", F.lit("numeric_unparseable"), "facts", F.col("id"), F.to_json(F.struct("value_raw")))
    return rows.drop(*[x for x in rows.columns if x.startswith("_")], "convention"), failed


@dataclass
class Resolution:
    facts: DataFrame
    entities: DataFrame
    aliases: DataFrame
    failures: DataFrame


def resolve_subjects(facts: DataFrame, entities: DataFrame, chain: DataFrame, confirmer=None) -> Resolution:
    """Normalized facts with their entities, renamed entities merged, and those with an intact chain of evidence promoted."""
    work = facts.where("lifecycle_state in ('NORMALIZED', 'ELIGIBLE_FOR_REASONING')")
    done = cut(resolve.resolve(work, entities, confirmer=confirmer))
    known = entities.select("id", "canonical_label", "entity_type", resolve.text.normalize_name(F.col("canonical_label")).alias("normalization_key"), "resolution_method").unionByName(resolve.new_entities(work, done))
    linked = facts.join(done.select(F.col("fact_id").alias("id"), F.col("entity_id").alias("_entity")), "id", "left").withColumn("subject_entity_id", F.coalesce("_entity", "subject_entity_id")).drop("_entity")
    moved = cut(resolve.rename_map(linked, known))
    linked = records.promote(resolve.renames(linked, moved), chain).drop("promotion_fault")
    kept = known.join(moved.select(F.col("old_id").alias("id")), "id", "left_anti")
    names = resolve.aliases(work, done).join(moved.withColumnRenamed("old_id", "entity_id"), "entity_id", "left").withColumn("entity_id", F.coalesce("keep_id", "entity_id")).drop("keep_id")
    names = names.groupBy("entity_id", "surface").agg(F.min_by(F.struct("normalized", "match_method", "score", "source_fact_id"), "source_fact_id").alias("a")).select("entity_id", "surface", "a.*")
    open_ = done.where("reason is not null").join(work.select(F.col("id").alias("fact_id"), "document_id", "subject_raw"), "fact_id")
    open_ = open_.groupBy("document_id", "subject_raw", "reason").agg(F.min("fact_id").alias("fact_id"))
    return Resolution(cut(linked), kept, names, records.failures(open_, "entity_ambiguous", F.col("reason"), "facts", F.col("fact_id"), F.to_json(F.struct(F.col("subject_raw").alias("surface")))))


def relate(facts: DataFrame, files: DataFrame, known: DataFrame | None = None, confirmer=None, documents: DataFrame | None = None, p: signals.Thresholds = signals.Thresholds()) -> tuple[DataFrame, DataFrame]:
    """(relationships, failures): candidate pairs judged, without those that ``known`` (fact_a_id, fact_b_id) holds; uncertain ones are failures too."""
    pairs = retrieval.candidate_pairs(facts, p, documents)
    if known is not None:
        pairs = pairs.join(known.select(F.least("fact_a_id", "fact_b_id").alias("a"), F.greatest("fact_a_id", "fact_b_id").alias("b")), ["a", "b"], "left_anti")
    pairs, bad = signals.guard_pairs(pairs, facts)
    pairs = cut(pairs)
    judged = signals.reason(signals.signals(signals.with_pair(pairs.select("a", "b"), facts, files), p), confirmer, p).join(pairs, ["a", "b"])
    judged = cut(judged.withColumnsRenamed({"a": "fact_a_id", "b": "fact_b_id", "score": "retrieval_score", "methods": "retrieval_methods"}).withColumn("id", F.xxhash64("fact_a_id", "fact_b_id")))
    owner = facts.select(F.col("id").alias("fact_a_id"), "document_id")
    unsure = judged.where("category = 'UNCERTAIN'").join(owner, "fact_a_id")
    broken = bad.withColumnRenamed("a", "fact_a_id").join(owner, "fact_a_id")
    lost = records.failures(unsure, "relationship_uncertain", F.col("code"), "relationships", F.col("id"))
    return judged, lost.unionByName(records.failures(broken, "run_error", F.col("reason"), "facts", F.col("fact_a_id")))


@dataclass
class Run:
    """The tables after a run; ``extraction`` is None where facts were given."""

    facts: DataFrame
    evidence: DataFrame
    entities: DataFrame
    aliases: DataFrame
    relationships: DataFrame
    failures: DataFrame
    stages: dict = field(default_factory=dict)
    extraction: Extraction | None = None


def run(files: DataFrame, pages: DataFrame, chunks: DataFrame, entities: DataFrame, facts: DataFrame | None = None, evidence: DataFrame | None = None, extractor=None, entity_confirmer=None, relationship_confirmer=None, p: signals.Thresholds = signals.Thresholds()) -> Run:
    """Extract (or take the facts given), ground, normalize, resolve and relate.

    ``extractor`` and confirmers are optional: without an extractor ``facts`` and ``evidence`` must be given, and without
    a confirmer residual rows stay open.
    """
    found, lost = None, []
    if extractor is not None:
        found = extract(chunks, files, extractor)
        facts, evidence = cut(found.facts), cut(found.evidence)
        lost.append(found.failures)
    elif facts is None or evidence is None:
        raise ValueError("give an extractor, or facts and evidence")
    facts, evidence, failed = ground(facts, evidence, pages, chunks)
    facts, evidence = cut(facts), cut(evidence)
    lost.append(failed)
    facts, failed = normalize(facts, resolve_convention(files, pages))
    lost.append(failed)
    resolved = resolve_subjects(facts, entities, records.chains(facts, evidence, files, pages, chunks), entity_confirmer)
    lost.append(resolved.failures)
    relationships, failed = relate(resolved.facts, files, confirmer=relationship_confirmer, p=p)
    lost.append(failed)
    return Run(resolved.facts, evidence, resolved.entities, resolved.aliases, relationships, records.all_failures(lost), {"facts": stage_counts(resolved.facts)}, found)


def stage_counts(facts: DataFrame) -> DataFrame:
    """One row: facts by what the stages made of them."""
    n = lambda c, name: F.count_if(c).alias(name)
    c = F.col
    return facts.agg(F.count("*").alias("examined"), n(c("evidence_status") == "VERIFIED", "verified"), n(c("evidence_status") == "PARTIAL", "partial"), n(c("lifecycle_state") == "QUARANTINED", "quarantined"), n(c("base_value").isNotNull(), "with_base_value"), n(c("reporting_period_type") == "unknown", "unknown_period"), n(c("subject_entity_id").isNotNull(), "resolved"), n(c("reasoning_eligible"), "eligible"))


def sweep(facts: DataFrame, files: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """(config, category, n) and the number of relationships that reach ``confidence``, for every named set of thresholds; ``baseline`` is the default.

    Configs that differ in ``top_k``, ``candidate`` or in what only verdicts use share one search for partners; each
    pair is compared once, whatever the number of configs that it is a pair of.
    """
    named, groups, keys = {}, {}, {}
    for name, changes in configs.items():
        p = signals.Thresholds(**{k: v for k, v in changes.items() if k != "confidence"})
        group = (p.weight_predicate, p.weight_lexical, p.weight_entity, p.bucket_max, p.min_shared)
        bit = 1 << keys.setdefault((*group, p.top_k, p.candidate), len(keys))
        groups.setdefault(group, {})[bit] = p
        named[name] = (p, bit, changes.get("confidence", 0.5))
    found = None
    for ps in groups.values():
        widest = replace(next(iter(ps.values())), top_k=max(p.top_k for p in ps.values()), candidate=min(p.candidate for p in ps.values()))
        every = cut(retrieval.readings(facts, widest)[0])
        for bit, p in ps.items():
            pairs = retrieval.best(every, p).select("a", "b", F.lit(bit).cast("long").alias("of"))
            found = pairs if found is None else found.union(pairs)
    pairs, _ = signals.guard_pairs(found.groupBy("a", "b").agg(F.bit_or("of").alias("of")), facts)
    pairs = cut(pairs)
    unused = ["reasons", "base_value_abs_diff", "base_value_ratio", "publication_gap_days", "scope_relation", "modality_relation", "same_document", *[f"{c}_{side}" for c in ("subject_entity_id", "fact_type", "modality") for side in "ab"]]
    made = cut(signals.signals(signals.with_pair(pairs.select("a", "b"), facts, files)).drop(*unused).join(pairs, ["a", "b"]))
    out = None
    for name, (p, bit, least) in named.items():
        judged = signals.reason(made.where(F.col("of").bitwiseAND(F.lit(bit).cast("long")) > 0), None, p)
        rows = judged.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= least).alias("n_confident")).select(F.lit(name).alias("config"), "category", "n", "n_confident")
        out = rows if out is None else out.unionByName(rows)
    return out


SWEEP = {"baseline": {}, "top_k 5": {"top_k": 5}, "candidate 0.80": {"candidate": 0.80}, "predicate 0.85": {"predicate": 0.85}, "confidence 0.90": {"confidence": 0.90}, "equivalence 0.001": {"equivalence": 0.001}, "contradiction 0.50": {"contradiction": 0.50}}


def recommended(swept: DataFrame) -> DataFrame:
    """The config that settles most relationships, of equal ones the one that leaves fewest uncertain, then by name: one row (config, settled, uncertain)."""
    unsure = F.col("category") == "UNCERTAIN"
    rows = swept.groupBy("config").agg(F.sum(F.when(~unsure, F.col("n")).otherwise(0)).alias("settled"), F.sum(F.when(unsure, F.col("n")).otherwise(0)).alias("uncertain"))
    return rows.orderBy(F.desc("settled"), "uncertain", "config").limit(1)


def properties(relationships: DataFrame, facts: DataFrame, signal_rows: DataFrame, failures: DataFrame, p: signals.Thresholds = signals.Thresholds()) -> DataFrame:
    """(property, n_hits, holds) of the four cases that a corpus should show; ``signal_rows``: a, b, ...; ``relationships``: fact_a_id, fact_b_id, category, context_dimension, validation_action."""
    side = lambda s: facts.select(F.col("id").alias(f"fact_{s}_id"), F.struct("document_id", "predicate", "object_raw", "evidence_status", "modality").alias(s))
    rows = relationships.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id").join(signal_rows.withColumnsRenamed({"a": "_a", "b": "_b"}), (F.col("_a") == F.col("fact_a_id")) & (F.col("_b") == F.col("fact_b_id")))
    c = F.col
    grounded = c("a.evidence_status").isin("VERIFIED", "PARTIAL") & c("b.evidence_status").isin("VERIFIED", "PARTIAL")
    one = (c("category") == "CORROBORATES") & (c("a.document_id") != c("b.document_id")) & (c("a.object_raw") != c("b.object_raw")) & (c("a.predicate") != c("b.predicate")) & grounded & ((c("a.evidence_status") == "VERIFIED") | (c("b.evidence_status") == "VERIFIED")) & (c("delta") <= p.equivalence)
    strict = (c("category") == "CONTRADICTS") & (c("entity_relation") == "same") & (c("predicate_exact") | (c("predicate_similarity") >= p.predicate)) & c("unit_equivalent") & c("period_relation").isin("equal", "overlaps") & (F.size("scope_conflict") == 0) & c("modality_comparable") & (c("delta") > p.contradiction) & c("validation_action").isin("not_applicable", "accepted")
    context = c("category").isin("DIFFERENT_CONTEXT", "TEMPORAL_EVOLUTION") & (c("delta") > p.contradiction) & (F.trim(F.coalesce("context_dimension", F.lit(""))) != "") & (c("a.evidence_status") != "UNVERIFIED") & (c("b.evidence_status") != "UNVERIFIED")
    found = rows.agg(F.count_if(one).alias("corroboration_cross_document"), F.count_if(strict).alias("contradiction_strict_profile"), F.count_if(context).alias("context_reconciled_with_dimension"))
    out = found.select(F.inline(F.array(*[F.struct(F.lit(k).alias("property"), F.col(k).alias("n_hits"), (F.col(k) > 0).alias("holds")) for k in found.columns])))
    about = failures.where("ref_table = 'facts' and ref_id is not null").select(F.col("ref_id").alias("id")).distinct()
    leaked = about.join(facts.where("lifecycle_state <> 'QUARANTINED'").select("id"), "id", "left_semi").agg(F.count("*").alias("leaked"))
    ends = relationships.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id")).distinct()
    used = about.join(ends, "id", "left_semi").agg(F.count("*").alias("used"))
    kinds = failures.agg(F.count("*").alias("n"), F.count_if(c("failure_type").isin(records.FAILURE_TYPES) & (c("failure_type") != "run_error")).alias("typed"), F.count_if(F.trim(F.coalesce("reason", F.lit(""))) == "").alias("blank"))
    whole = kinds.join(leaked).join(used)  # three tables of one row
    surface = whole.select(F.lit("failure_surface_populated").alias("property"), c("n").alias("n_hits"), ((c("typed") > 0) & (c("blank") == 0) & (c("leaked") == 0) & (c("used") == 0)).alias("holds"))
    return out.unionByName(surface)
