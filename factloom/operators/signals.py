"""Comparison signals of fact pairs, verdicts, the guard over proposals, and confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fuzzy, text
from factloom.functions.periods import period_relation


@dataclass(frozen=True)
class Thresholds:
    """The tunables of retrieval and verdicts."""

    top_k: int = 15
    candidate: float = 0.55
    predicate: float = 0.60
    jaccard: float = 0.34
    weight_predicate: float = 0.3
    weight_lexical: float = 0.2
    weight_entity: float = 0.4
    bucket_max: int = 400
    min_shared: int = 2
    equivalence: float = 0.02
    contradiction: float = 0.15


CATEGORIES = ["CORROBORATES", "CONTRADICTS", "DIFFERENT_CONTEXT", "TEMPORAL_EVOLUTION", "UNCERTAIN"]
DISTINCT_PERIODS = ["adjacent", "disjoint", "same_year"]
FACT_FIELDS = ["id", "document_id", "subject_entity_id", "predicate", "predicate_norm", "object_raw", "fact_type", "value_raw", "base_value", "currency", "is_percentage", "unit_raw", "reporting_period_start", "reporting_period_end", "reporting_period_type", "scope", "modality", "evidence_status"]


def relation(a: Column, b: Column) -> Column:
    """missing, same or different of two texts, blanks and letter case aside."""
    x, y = (F.lower(F.trim(c.cast("string"))) for c in (a, b))
    return F.when(F.coalesce(x, F.lit("")) == "", "missing").when(F.coalesce(y, F.lit("")) == "", "missing").when(x == y, "same").otherwise("different")


def scope_relation(a: Column, b: Column) -> tuple[Column, Column]:
    """(relation, keys that conflict in order) of two scopes."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    fold = lambda c: F.lower(F.trim(c))
    conflict = F.array_sort(F.filter(shared, lambda k: fold(F.try_element_at(a, k)) != fold(F.try_element_at(b, k))))
    empty = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0)
    same = F.size(shared) == F.greatest(F.size(a), F.size(b))
    return (
        F.when(empty, "missing").when(F.size(conflict) > 0, "different").when(F.size(shared) == 0, "different").when(same, "same").otherwise("overlap"),
        F.when(empty, F.array().cast("array<string>")).otherwise(conflict),
    )


def numeric_signals(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Signals of two numeric facts (base, is_pct, unit, currency, fact_type)."""
    va, vb = a["base"], b["base"]
    comparable = (a["fact_type"] == "numeric") & (b["fact_type"] == "numeric") & va.isNotNull() & vb.isNotNull()
    diff, largest = F.abs(va - vb), F.greatest(F.abs(va), F.abs(vb))
    pct = F.coalesce(a["is_pct"], F.lit(False)) != F.coalesce(b["is_pct"], F.lit(False))
    unit, currency = relation(a["unit"], b["unit"]), relation(a["currency"], b["currency"])
    return {
        "numeric_comparable": comparable,
        "base_value_abs_diff": F.when(comparable, diff),
        "base_value_ratio": F.when(comparable, va / F.nullif(vb, F.lit(0.0))),
        "delta": F.when(comparable, F.when(largest == 0, F.lit(0.0)).otherwise(F.round(diff / F.nullif(largest, F.lit(0.0)), 6))),
        "sign_match": F.when(comparable, (va >= 0) == (vb >= 0)),
        "pct_vs_abs": pct,
        "unit_relation": unit,
        "currency_relation": currency,
        "unit_equivalent": ~pct & (unit != "different") & (currency != "different"),
    }


def with_pair(pairs: DataFrame, facts: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) joined to both facts as structs ``fa`` and ``fb``, with their documents' dates where given."""
    rows = facts.select("id", F.struct(*FACT_FIELDS).alias("f"))
    if documents is not None:  # joined to the facts, of which there are fewer than pairs
        has = lambda c: F.col(c) if c in documents.columns else F.lit(None)
        dates = documents.select(F.col("id").alias("doc"), F.coalesce(F.col("publication_date"), has("document_date").cast("date")).alias("published"), has("data_vintage").cast("string").alias("vintage"))
        rows = rows.join(dates, F.col("f.document_id") == F.col("doc"), "left")
    side = lambda s: rows.withColumnsRenamed({"id": s, **{c: f"{c}{s}" if c == "f" else f"{c}_{s}" for c in rows.columns if c != "id"}})
    return pairs.join(side("a"), "a").join(side("b"), "b")


def signals(pairs: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """The signals of pairs as ``with_pair`` gives them; similar predicates are compared once per distinct pair of texts."""
    pred = lambda s: text.predicate_text(F.col(f"{s}.predicate"), F.col(f"{s}.predicate_norm"))
    pairs = pairs.withColumns({"pa": F.lower(pred("fa")), "pb": F.lower(pred("fb"))})
    distinct = pairs.select("pa", "pb").distinct()
    left, right = text.content_tokens(F.col("pa")), text.content_tokens(F.col("pb"))
    union = F.size(F.array_union(left, right))
    compared = distinct.select("pa", "pb", ((F.col("pa") == F.col("pb")) & (F.col("pa") != "")).alias("predicate_exact"), F.round(fuzzy.set_ratio("pa", "pb") / 100, 4).alias("predicate_similarity"), F.when(union == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(left, right)) / F.nullif(union, F.lit(0)), 4)).alias("predicate_jaccard"))
    side = lambda s: {"base": F.col(f"{s}.base_value"), "is_pct": F.col(f"{s}.is_percentage"), "unit": F.col(f"{s}.unit_raw"), "currency": F.col(f"{s}.currency"), "fact_type": F.col(f"{s}.fact_type"), "start": F.col(f"{s}.reporting_period_start"), "end": F.col(f"{s}.reporting_period_end"), "type": F.col(f"{s}.reporting_period_type")}
    a, b = side("fa"), side("fb")
    scope, conflict = scope_relation(F.col("fa.scope"), F.col("fb.scope"))
    ea, eb = F.col("fa.subject_entity_id"), F.col("fb.subject_entity_id")
    comparable = ["ASSERTED", "HISTORICAL"]
    objects = (text.norm_object(F.col("fa.object_raw")) == text.norm_object(F.col("fb.object_raw"))) & (text.norm_object(F.col("fa.value_raw")) == text.norm_object(F.col("fb.value_raw")))
    made = {
        "entity_relation": F.when(ea.isNull() | eb.isNull(), "unresolved").when(ea == eb, "same").otherwise("different"),
        "period_relation": period_relation(a, b),
        "types_differ": a["fact_type"] != b["fact_type"],
        "both_numeric": (a["fact_type"] == "numeric") & (b["fact_type"] == "numeric"),
        **numeric_signals(a, b),
        "scope_relation": scope, "scope_conflict": conflict,
        "modality_same": F.col("fa.modality") == F.col("fb.modality"),
        "modality_comparable": F.col("fa.modality").isin(comparable) & F.col("fb.modality").isin(comparable),
        "objects_equal": objects,
        "partial": (F.col("fa.evidence_status") == "PARTIAL") | (F.col("fb.evidence_status") == "PARTIAL"),
    }
    if "published_a" in pairs.columns:
        made["publication_gap_days"] = F.abs(F.date_diff("published_a", "published_b"))
        made["vintage_differs"] = F.coalesce((F.col("vintage_a") != "") & (F.col("vintage_b") != "") & (F.col("vintage_a") != F.col("vintage_b")), F.lit(False))
    for side in "ab":
        f = lambda c: F.col(f"f{side}.{c}")  # noqa: B023, E731
        made |= {f"subject_entity_id_{side}": f("subject_entity_id"), f"fact_type_{side}": f("fact_type"), f"modality_{side}": f("modality")}
    made["same_document"] = F.col("fa.document_id") == F.col("fb.document_id")
    made["modality_relation"] = F.when(F.col("fa.modality") == F.col("fb.modality"), "same").otherwise("different")
    # only what is made of the facts is carried to where predicates are compared
    numeric = (a["fact_type"] == "numeric") | (b["fact_type"] == "numeric")
    pairs = pairs.select("a", "b", "pa", "pb", numeric.alias("_numeric"), *[v.alias(k) for k, v in made.items()]).join(compared, ["pa", "pb"])
    reasons = F.array_compact(F.array(
        F.when(F.col("entity_relation") == "unresolved", "one or both subjects are not resolved to an entity"),
        F.when(F.col("_numeric") & ~F.coalesce("numeric_comparable", F.lit(False)), "numeric comparison skipped (missing base_value or mixed fact types)"),
        F.when(F.col("period_relation") == "missing", "reporting period absent on at least one side"),
        F.when(F.col("scope_relation") == "missing", "scope not described on both sides"),
    ))
    return pairs.select("a", "b", "predicate_exact", "predicate_similarity", "predicate_jaccard", *made, reasons.alias("reasons"))


def verdict(p: Thresholds = Thresholds()) -> Column:
    """struct<category, dimension, code> of a row of signals; a null category awaits a confirmer."""
    c = F.col
    period, delta = c("period_relation"), c("delta")
    numeric, same_time = c("numeric_comparable"), c("period_relation").isin("equal", "overlaps")
    pred_ok = c("predicate_exact") | (c("predicate_similarity") >= p.predicate)
    equal, distinct = delta <= p.equivalence, period.isin(DISTINCT_PERIODS)
    rules = [
        (c("entity_relation") != "same", "UNCERTAIN", None, "entity_not_same"),
        (period == "unknown", "UNCERTAIN", None, "period_unknown"),
        (~pred_ok & (c("predicate_jaccard") < p.jaccard), "UNCERTAIN", None, "weak_predicate"),
        (c("types_differ") & ~numeric, "UNCERTAIN", None, "fact_type_mismatch"),
        (c("pct_vs_abs"), "UNCERTAIN", None, "percentage_vs_absolute"),
        (F.size("scope_conflict") > 0, "DIFFERENT_CONTEXT", F.concat(F.lit("scope:"), F.try_element_at("scope_conflict", F.lit(1))), "scope_conflict"),
        (~c("modality_comparable") & c("modality_same") & numeric & c("unit_equivalent") & equal & period.isin("equal", "contains"), "CORROBORATES", None, "same_modality_agree"),
        (~c("modality_comparable"), "DIFFERENT_CONTEXT", F.lit("modality"), "modality_mismatch"),
        (numeric & (c("currency_relation") == "different"), "DIFFERENT_CONTEXT", F.lit("currency"), "currency_differs"),
        (numeric & (c("unit_relation") == "different"), "DIFFERENT_CONTEXT", F.lit("units"), "unit_differs"),
        (numeric & distinct & ~equal, "TEMPORAL_EVOLUTION", F.lit("time"), "temporal_numeric"),
        (numeric & distinct, "UNCERTAIN", None, "equal_across_periods"),
        (numeric & (period == "contains") & ~equal, "DIFFERENT_CONTEXT", F.lit("period_type"), "period_type_differs"),
        (numeric & (period == "contains"), "UNCERTAIN", None, "contained_period"),
        (numeric & same_time & ~c("sign_match"), "UNCERTAIN", None, "sign_mismatch"),
        (numeric & same_time & equal, "CORROBORATES", None, "numeric_equivalent"),
        (numeric & same_time & (delta > p.contradiction), "CONTRADICTS", None, "numeric_conflict"),
        (numeric & same_time, "UNCERTAIN", None, "numeric_borderline"),
        (numeric, "UNCERTAIN", None, "period_missing"),
        (c("both_numeric"), "UNCERTAIN", None, "numeric_unparsed"),
        (distinct & ~c("objects_equal"), "TEMPORAL_EVOLUTION", F.lit("time"), "temporal_semantic"),
        (pred_ok & c("objects_equal") & period.isin("equal", "missing", "same_year", "contains", "overlaps"), "CORROBORATES", None, "identical_claim"),
    ]
    none = F.lit(None).cast("string")
    out = None
    for when, category, dimension, code in rules:
        made = F.struct(F.lit(category).alias("category"), (none if dimension is None else dimension).alias("dimension"), F.lit(code).alias("code"))
        out = F.when(F.coalesce(when, F.lit(False)), made) if out is None else out.when(F.coalesce(when, F.lit(False)), made)
    return out.otherwise(F.struct(none.alias("category"), none.alias("dimension"), F.lit("needs_semantic").alias("code")))


def confidence(category: Column, p: Thresholds = Thresholds(), proposed: Column | None = None) -> Column:
    delta = F.coalesce("delta", F.lit(0.0))
    base = (
        F.when(category == "UNCERTAIN", 0.25)
        .when((category == "CORROBORATES") & F.col("numeric_comparable"), 0.75 + 0.2 * (1 - F.least(F.lit(1.0), delta / p.equivalence)))
        .when((category == "CONTRADICTS") & F.col("numeric_comparable"), 0.7 + 0.25 * F.least(F.lit(1.0), (delta - p.contradiction) / p.contradiction))
        .otherwise(0.55 + 0.2 * F.col("predicate_similarity"))
    )
    if proposed is not None:
        base = F.when(proposed.isNotNull(), F.least(base, F.greatest(F.lit(0.3), proposed))).otherwise(base)
    return F.round(F.least(F.when(F.col("partial"), F.least(base, F.lit(0.6))).otherwise(base), F.lit(0.99)), 3)


def guard(proposal: Column, p: Thresholds = Thresholds()) -> Column:
    """struct<category, action>: a proposed category held against the signals."""
    c = F.col
    period, delta = c("period_relation"), F.coalesce(c("delta"), F.lit(0.0))
    numeric, conflict = c("numeric_comparable") & c("unit_equivalent"), F.size("scope_conflict") > 0
    claim = proposal.isin("CONTRADICTS", "CORROBORATES")
    made = lambda category, action: F.struct(category.alias("category"), F.lit(action).alias("action"))
    lit = F.lit
    return (
        F.when(c("entity_relation") != "same", made(lit("UNCERTAIN"), "downgraded"))
        .when((proposal == "CONTRADICTS") & numeric & (delta <= p.equivalence) & (period == "equal") & ~conflict & c("sign_match"), made(lit("CORROBORATES"), "overridden"))
        .when(claim & conflict, made(lit("DIFFERENT_CONTEXT"), "overridden"))
        .when((proposal == "CONTRADICTS") & period.isin(DISTINCT_PERIODS) & c("modality_comparable"), made(lit("TEMPORAL_EVOLUTION"), "overridden"))
        .when((proposal == "CONTRADICTS") & ~c("modality_comparable"), made(lit("DIFFERENT_CONTEXT"), "downgraded"))
        .when((proposal == "CORROBORATES") & c("numeric_comparable") & (delta > p.contradiction), made(lit("UNCERTAIN"), "downgraded"))
        .when(claim & period.isin("unknown", "missing"), made(lit("UNCERTAIN"), "downgraded"))
        .otherwise(made(proposal, "accepted"))
    )


def usable(proposal: Column, conf: Column, why: Column | None = None, error: Column | None = None) -> Column:
    """A proposed category if the proposal can be used, else null: a known category, a confidence of 0 to 1, a reason, no error."""
    name = F.upper(F.trim(proposal))
    ok = name.isin(CATEGORIES) & conf.between(0.0, 1.0)
    if why is not None:
        ok &= F.coalesce(F.trim(why), F.lit("")) != ""
    if error is not None:
        ok &= error.isNull()
    return F.when(ok, name)


def context_dimension(category: Column, given: Column, has_vintage: bool = True) -> Column:
    """What a pair differs in: as the verdict gave it, else read from the signals."""
    c = F.col
    vintage = F.coalesce(c("vintage_differs"), F.lit(False)) if has_vintage else F.lit(False)
    context = (
        F.when(F.size("scope_conflict") > 0, F.concat(F.lit("scope:"), F.try_element_at("scope_conflict", F.lit(1)))).when(~c("modality_comparable"), "modality")
        .when(vintage, "vintage").when(c("currency_relation") == "different", "currency").when(c("unit_relation") == "different", "units").otherwise("period")
    )
    return F.coalesce(given, F.when(category == "TEMPORAL_EVOLUTION", "time").when(category == "DIFFERENT_CONTEXT", context))


def packet(pairs: DataFrame, evidence: DataFrame, signal_rows: DataFrame) -> DataFrame:
    """(a, b, packet): both facts with their first quote and the signals, as one struct for a confirmer; ``pairs`` as ``with_pair`` gives them."""
    quotes = evidence.groupBy("fact_id").agg(F.min_by("quote", "id").alias("quote"))
    out = pairs
    for side in "ab":
        out = out.join(quotes.withColumnsRenamed({"fact_id": side, "quote": f"quote_{side}"}), side, "left")
    said = ["predicate", "object_raw", "value_raw", "base_value", "unit_raw", "currency", "reporting_period_type", "scope", "modality", "evidence_status"]
    fact = lambda s: F.struct(*[F.col(f"f{s}.{c}").alias(c) for c in said], F.col(f"quote_{s}").alias("evidence_quote"))
    signal = signal_rows.select("a", "b", F.struct(*[c for c in signal_rows.columns if c not in ("a", "b")]).alias("signals"))
    return out.join(signal, ["a", "b"]).select("a", "b", F.struct(fact("a").alias("fact_a"), fact("b").alias("fact_b"), "signals").alias("packet"))


def guard_pairs(pairs: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of eligible facts, rejected pairs with ``reason``): both facts exist, are eligible, and are not unverified."""
    state = facts.select("id", F.when((F.col("lifecycle_state") != "ELIGIBLE_FOR_REASONING") | ~F.coalesce("reasoning_eligible", F.lit(False)), "fact_not_eligible").when(F.col("evidence_status") == "UNVERIFIED", "fact_unverified").otherwise("").alias("fault"))
    side = lambda s: state.withColumnsRenamed({"id": s, "fault": f"fault_{s}"})
    judged = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    fault = F.coalesce(F.nullif(F.coalesce("fault_a", F.lit("unknown_fact")), F.lit("")), F.nullif(F.coalesce("fault_b", F.lit("unknown_fact")), F.lit("")))
    judged = judged.withColumn("reason", fault).drop("fault_a", "fault_b")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def reason(signal_rows: DataFrame, confirmer=None, p: Thresholds = Thresholds()) -> DataFrame:
    """Verdicts with confidence. ``confirmer``: DataFrame of residual pairs -> (a, b, proposal, llm_confidence); without one, or where its proposal cannot be used, they stay uncertain."""
    rows = signal_rows.withColumn("v", verdict(p))
    if confirmer is not None:
        said = confirmer(rows.where("v.category is null").drop("v")).select("a", "b", F.col("proposal").alias("said"), "llm_confidence")
        rows = rows.join(said, ["a", "b"], "left").withColumn("proposal", usable(F.col("said"), F.col("llm_confidence")))
        rows = rows.withColumn("llm_confidence", F.when(F.col("proposal").isNotNull(), F.col("llm_confidence")))
    else:
        rows = rows.withColumns({"proposal": F.lit(None).cast("string"), "llm_confidence": F.lit(None).cast("double")})
    held = F.when(F.col("proposal").isNotNull(), guard(F.col("proposal"), p))
    category = F.coalesce("v.category", held["category"], F.lit("UNCERTAIN"))
    rows = rows.withColumns({"category": category, "validation_action": F.coalesce(held["action"], F.lit("not_applicable"))})
    code = F.when(F.col("v.category").isNull() & F.col("proposal").isNull(), "uncertain_no_llm").otherwise(F.col("v.code"))
    dimension = context_dimension(F.col("category"), F.col("v.dimension"), "vintage_differs" in rows.columns)
    return rows.select("a", "b", "category", dimension.alias("context_dimension"), code.alias("code"), F.col("proposal").isNotNull().alias("llm_used"), "validation_action", confidence(F.col("category"), p, F.col("llm_confidence")).alias("confidence"))
