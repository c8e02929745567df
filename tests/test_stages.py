import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import records, signals, stages, views

FILES = "id long, title string, original_filename string, publisher string, disclosure_type string, publication_date date, fy_convention string, status string"
MARKED = {
    "Acme revenue was ₹8,142 crore in FY24.": {"predicate": "revenue from operations", "raw_value_text": "₹8,142 crore", "parsed_value": 8142.0, "currency": "INR", "magnitude": "crore", "reporting_period": "FY24"},
    "Acme revenue was ₹7,454 crore in FY24 on its own.": {"predicate": "revenue from operations", "raw_value_text": "₹7,454 crore", "parsed_value": 7454.0, "currency": "INR", "magnitude": "crore", "reporting_period": "FY24", "scope": "standalone"},
    "Acme revenue was ₹6,000 crore in FY23.": {"predicate": "revenue from operations", "raw_value_text": "₹6,000 crore", "parsed_value": 6000.0, "currency": "INR", "magnitude": "crore", "reporting_period": "FY23"},
    "Acme profit after tax was ₹500 crore in FY24.": {"predicate": "profit after tax", "raw_value_text": "₹500 crore", "parsed_value": 500.0, "currency": "INR", "magnitude": "crore", "reporting_period": "FY24"},
    "Acme profit after tax was ₹800 crore in FY24, it says elsewhere.": {"predicate": "profit after tax", "raw_value_text": "₹800 crore", "parsed_value": 800.0, "currency": "INR", "magnitude": "crore", "reporting_period": "FY24"},
    "Acme had many permanent employees.": {"predicate": "permanent employees", "raw_value_text": "9,999", "parsed_value": 9999.0, "quote": "Acme had 9,999 permanent employees."},
    "Acme Ltd had revenue of ₹81,420 million in FY24.": {"predicate": "revenue from operations", "raw_value_text": "₹81,420 million", "parsed_value": 81420.0, "currency": "INR", "magnitude": "million", "reporting_period": "FY24", "scope": "consolidated"},
}


def made_extractor():
    marked = dict(MARKED)  # a function of its own, that workers need no test module for

    def extractor(text, header):
        if text == "broken":
            return "{not json"
        if text == "extra":
            return {"facts": [], "surprise": 1}
        if text == "down":
            raise ValueError("no connection")
        if text not in marked:
            return {"facts": []}
        said = {"subject": "Acme Ltd" if "Ltd" in text else "Acme", "object": marked[text]["raw_value_text"], "fact_type": "numeric", "modality": "HISTORICAL", "quote": text, "char_start": 0, "char_end": len(text)} | marked[text]
        return json.dumps({"facts": [said, said, said | {"predicate": " "}]}, ensure_ascii=False)

    return extractor


def corpus(spark, texts):
    rows = [(n + 1, 1 if n < 6 else 2, n, t) for n, t in enumerate(texts)]
    pages = spark.createDataFrame([(n, d, k, None, t) for n, d, k, t in rows], "id long, document_id long, page_index int, printed_label string, text string")
    chunks = spark.createDataFrame([(100 + n, d, k, 0, 0, len(t), 0, t) for n, d, k, t in rows], "id long, document_id long, page_index int, seq int, char_offset int, char_end int, header_prefix_len int, text string")
    files = spark.createDataFrame([(1, "A", "a.pdf", None, "annual_report", None, "unknown", "done"), (2, None, "b.pdf", None, None, None, "apr-mar", "done")], FILES)
    entities = spark.createDataFrame([], "id long, canonical_label string, entity_type string, resolution_method string")
    return files, pages, chunks, entities


def test_pipeline_from_pages_to_relationships(spark):
    files, pages, chunks, entities = corpus(spark, [*MARKED, "broken", "extra"])
    done = stages.run(files, pages, chunks, entities, extractor=made_extractor())
    n = done.stages["facts"].collect()[0]
    assert (n.examined, n.verified, n.quarantined, n.with_base_value, n.resolved, n.eligible) == (7, 6, 1, 6, 6, 6)
    assert [r.canonical_label for r in done.entities.collect()] == ["Acme"] and {r.surface for r in done.aliases.collect()} == {"Acme", "Acme Ltd"}
    rel = {r.category: r for r in done.relationships.collect()}
    assert {"CORROBORATES", "CONTRADICTS", "DIFFERENT_CONTEXT", "TEMPORAL_EVOLUTION", "UNCERTAIN"} == set(rel)
    assert rel["DIFFERENT_CONTEXT"].context_dimension == "scope:raw" and rel["TEMPORAL_EVOLUTION"].context_dimension == "time"
    lost = {(r.failure_type, r.reason) for r in done.failures.collect()}
    assert {("grounding_failed", "numeric_token_mismatch"), ("extraction_unparsed", "json_decode_error"), ("extraction_unparsed", "schema_validation_error"), ("extraction_unparsed", "duplicate_in_chunk"), ("extraction_unparsed", "missing_predicate")} <= lost
    assert {r.reply for r in done.extraction.raw.where("error is not null").collect()} == {"{not json", json.dumps({"facts": [], "surprise": 1})}
    shaped = views.facts_out(done.facts, done.evidence, done.entities, files, pages).where("numeric.value_raw = '₹8,142 crore'").collect()[0]
    assert shaped.numeric.base_value == pytest.approx(8.142e10) and shaped.document.title == "A" and shaped.evidence.verification_method == "exact" and shaped.reporting_period.type == "fiscal_year"
    made = signals.signals(signals.with_pair(done.relationships.selectExpr("fact_a_id a", "fact_b_id b"), done.facts, files))
    held = {r.property: r.holds for r in stages.properties(done.relationships, done.facts, made, done.failures.where("failure_type = 'grounding_failed'")).collect()}
    assert held == {"corroboration_cross_document": False, "contradiction_strict_profile": True, "context_reconciled_with_dimension": True, "failure_surface_populated": True}
    packet = signals.packet(signals.with_pair(done.relationships.selectExpr("fact_a_id a", "fact_b_id b"), done.facts), done.evidence, made).first().packet
    assert packet.fact_a.evidence_quote in MARKED and packet.signals.entity_relation == "same"


def test_extraction_gives_up_after_errors_in_a_row(spark):
    files, pages, chunks, _ = corpus(spark, ["down", "down", next(iter(MARKED)), "down", "down"])
    found = stages.extract(chunks, files, made_extractor(), limit=3)
    assert found.raw.count() == 5 and found.facts.count() == 1
    found = stages.extract(chunks, files, made_extractor(), limit=2)
    assert found.raw.count() == 2 and found.facts.count() == 0
    assert [r.reason for r in found.failures.where("failure_type = 'run_error'").collect()] == ["aborted after 2 consecutive errors: client_exception"]


def test_replies():
    good = {"subject": "a", "predicate": "b", "object": "c", "fact_type": "semantic", "quote": "q", "char_start": 0, "char_end": 1}
    assert stages.parse_reply(json.dumps({"facts": [good]})) == ([good], None) and stages.parse_reply("{}") == ([], None)
    for bad in ({"facts": [good | {"more": 1}]}, {"facts": [good | {"char_start": "0"}]}, {"facts": [good | {"quote": None}]}, {"facts": {}}, [], {"facts": [good | {"percentage": 1}]}):
        assert stages.parse_reply(json.dumps(bad)) == (None, "schema_validation_error")
    assert stages.parse_reply(None) == (None, "json_decode_error")


def test_states_and_guards(spark):
    facts = spark.createDataFrame([(1, "NORMALIZED", False, None, "VERIFIED"), (2, "GROUNDED", False, None, "PARTIAL"), (3, "QUARANTINED", False, "x", "VERIFIED"), (4, "NORMALIZED", False, None, "UNVERIFIED")], "id long, lifecycle_state string, reasoning_eligible boolean, quarantine_reason string, evidence_status string")
    chain = spark.createDataFrame([(1,), (2,), (3,), (4,)], "fact_id long")
    got = {r.id: (r.lifecycle_state, r.reasoning_eligible, r.promotion_fault) for r in records.promote(facts, chain).collect()}
    assert got == {1: ("ELIGIBLE_FOR_REASONING", True, None), 2: ("GROUNDED", False, None), 3: ("QUARANTINED", False, "fact_quarantined"), 4: ("NORMALIZED", False, "evidence_unverified")}
    held = records.quarantine(facts, spark.createDataFrame([(1, "why"), (2, " ")], "id long, reason string"))
    assert {r.id: (r.lifecycle_state, r.quarantine_reason) for r in held.where("id < 3").collect()} == {1: ("QUARANTINED", "why"), 2: ("GROUNDED", None)}
    with pytest.raises(ValueError):
        records.move(facts, "QUARANTINED")
    with pytest.raises(ValueError):
        views.relationship_filter(facts, category="NONSENSE")
    said = spark.createDataFrame([("contradicts", 0.5), ("CONTRADICTS", 1.5), ("OTHER", 0.5), (None, None)], "p string, c double")
    assert [r[0] for r in said.select(signals.usable(F.col("p"), F.col("c"))).collect()] == ["CONTRADICTS", None, None, None]
