import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import fuzzy
from factloom.operators import candidates, grounding, resolve, retrieval, signals, stages, views
from factloom.sources import ingest
from factloom.streaming import incremental

FACT = "id long, document_id long, subject_entity_id long, subject_raw string, predicate string, predicate_norm string, object_raw string, fact_type string, value_raw string, base_value double, currency string, is_percentage boolean, unit_raw string, reporting_period_start date, reporting_period_end date, reporting_period_type string, scope map<string,string>, modality string, evidence_status string, lifecycle_state string"
FY = {23: (dt.date(2022, 4, 1), dt.date(2023, 4, 1)), 24: (dt.date(2023, 4, 1), dt.date(2024, 4, 1))}


def fact(n, doc, predicate, base, year=24, scope=None, entity=1, **more):
    row = {"id": n, "document_id": doc, "subject_entity_id": entity, "subject_raw": "Acme", "predicate": predicate, "predicate_norm": predicate, "object_raw": str(base), "fact_type": "numeric", "value_raw": str(base), "base_value": base, "currency": "INR", "is_percentage": False, "unit_raw": None, "reporting_period_start": FY[year][0], "reporting_period_end": FY[year][1], "reporting_period_type": "fiscal_year", "scope": scope, "modality": "HISTORICAL", "evidence_status": "VERIFIED", "lifecycle_state": "ELIGIBLE_FOR_REASONING"} | more
    return tuple(row[c.split(" ")[0]] for c in FACT.replace("map<string,string>", "map").split(", "))


def corpus(spark):
    both, alone = {"basis": "consolidated"}, {"basis": "standalone"}
    revenue = "revenue from operations"
    return spark.createDataFrame([fact(1, 1, revenue, 8.141538e10, scope=both), fact(2, 1, revenue, 7.454082e10, scope=alone), fact(3, 1, revenue, 6.0e10, 23, scope=both), fact(4, 1, "profit after tax", 5e9), fact(5, 1, "profit after tax", 8e9), fact(7, 2, "revenue from services", 8.142e10, scope=both)], FACT)


def test_golden_corpus(spark):
    facts = corpus(spark)
    pairs = retrieval.candidate_pairs(facts)
    assert pairs.count() == 15
    out = {(r.a, r.b): r for r in signals.reason(signals.signals(signals.with_pair(pairs.select("a", "b"), facts))).collect()}
    want = {(1, 7): ("CORROBORATES", 0.949), (4, 5): ("CONTRADICTS", 0.95), (1, 2): ("DIFFERENT_CONTEXT", 0.75), (2, 3): ("DIFFERENT_CONTEXT", 0.75), (2, 7): ("DIFFERENT_CONTEXT", 0.705), (1, 3): ("TEMPORAL_EVOLUTION", 0.75), (3, 7): ("TEMPORAL_EVOLUTION", 0.705)}
    for key, r in out.items():
        category, confidence = want.get(key, ("UNCERTAIN", 0.25))
        assert (r.category, r.confidence) == (category, pytest.approx(confidence, abs=1e-3)), key
    assert {r.code for k, r in out.items() if k not in want} == {"weak_predicate"}


def brute_pairs(rows, k, bucket):
    stop = {"from", "of", "the"}
    tokens = {x[0]: {t for t in " ".join(x[3:] + x[2:3]).lower().split() if t not in stop and len(t) > 1} for x in rows}
    held = {}
    for n, ts in tokens.items():
        for t in ts:
            held.setdefault(t, set()).add(n)
    pairs = []
    for x in rows:
        for y in rows:
            if x[0] < y[0]:
                same, exact = x[1] is not None and x[1] == y[1], x[2] == y[2] and x[2] != ""
                both = tokens[x[0]] & tokens[y[0]]
                lexical = any(len(held[t]) <= bucket for t in both)
                sim = fuzzy.token_set_ratio(x[2], y[2]) / 100 if x[2] and y[2] else 0.0
                score = round((0.4 * same + 0.3 * sim + 0.2 * min(1.0, len(both) / 3)) / 0.9, 6)
                if same or exact or (lexical and len(both) >= 2 and score >= 0.55):
                    methods = ["entity"] * same + (["predicate_exact"] if exact else ["predicate_similar"] if sim >= 0.6 else []) + ["lexical"] * lexical
                    pairs.append((-score, x[0], y[0], methods))
    seen, out = {}, {}
    for s, a, b, methods in sorted(pairs):
        if seen.get(a, 0) < k or seen.get(b, 0) < k:
            out[a, b] = (-s, methods)
        seen[a], seen[b] = seen.get(a, 0) + 1, seen.get(b, 0) + 1
    return out


@pytest.mark.parametrize(("seed", "bucket"), [(1, 400), (2, 12), (3, 5)])
def test_retrieval_equals_brute_force(spark, seed, bucket):
    rng = random.Random(seed)
    names = ["revenue from operations", "revenue from services", "profit after tax", "total revenue from operations net", ""]
    rows = [(n, rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice(names), rng.choice(["acme", "acme works", "other mills", ""]), " ".join(rng.sample(["crore", "mn", "10", "25", "70", "81", "93"], 2))) for n in range(1, 90)]
    df = spark.createDataFrame([fact(n, n % 3, p, 1.0, entity=e, subject_raw=s, object_raw=o) for n, e, p, s, o in rows], FACT)
    p = signals.Thresholds(top_k=4, bucket_max=bucket)
    got = retrieval.candidate_pairs(df, p).collect()
    want = brute_pairs(rows, 4, bucket)
    assert len(got) == len(want) and {(r.a, r.b): (r.score, r.methods) for r in got} == {k: (pytest.approx(s), m) for k, (s, m) in want.items()}
    one = retrieval.candidate_pairs(df, p, spark.createDataFrame([(1,)], "id long"))
    assert {(r.a, r.b) for r in one.collect()} == {k for k in want if 1 in (k[0] % 3, k[1] % 3)}


def joined_rows(spark, run):
    """(result of ``run``, the most rows that any join of its executions gave)."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, most = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList()
    for i in range(before, found.size()):
        graph, values = store.planGraph(found.apply(i).executionId()).allNodes(), store.executionMetrics(found.apply(i).executionId())
        for n in (graph.apply(k) for k in range(graph.size())):
            for m in (n.metrics().apply(k) for k in range(n.metrics().size())):
                if "Join" in n.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


@pytest.mark.parametrize("entity", [None, 1])
def test_no_hot_predicate_or_entity_meets_itself(spark, entity):
    rng = random.Random(7)
    words = [f"w{n}" for n in range(30)]
    rows = [(n, entity, "output", rng.choice(["acme", "other"]), " ".join(rng.sample(words, 4))) for n in range(1, 501)]
    df = spark.createDataFrame([fact(n, n % 3, p, 1.0, entity=e, subject_raw=s, object_raw=o) for n, e, p, s, o in rows], FACT)
    got, most = joined_rows(spark, lambda: retrieval.candidate_pairs(df, signals.Thresholds(top_k=4, bucket_max=10)).collect())
    want = brute_pairs(rows, 4, 10)
    assert {(r.a, r.b): (r.score, r.methods) for r in got} == {k: (pytest.approx(s), m) for k, (s, m) in want.items()}
    assert most < 100 * len(rows)


@pytest.mark.parametrize("weight", [0.2, 0.0])
def test_kinds_of_many_tokens_are_compared_one_by_one(spark, monkeypatch, weight):
    rng = random.Random(8)
    rows = [(n, rng.choice([1, 2, None]), rng.choice(["output", "net output", ""]), "acme", " ".join(rng.sample("abcdefghijkl", 3)).replace(" ", "x ") + "x" * rng.choice([1, 40])) for n in range(1, 90)]
    df = spark.createDataFrame([fact(n, n % 3, p, 1.0, entity=e, subject_raw=s, object_raw=o) for n, e, p, s, o in rows], FACT)
    p = signals.Thresholds(top_k=4, bucket_max=8, weight_lexical=weight)
    by_sets = {tuple(map(str, r)) for r in retrieval.candidate_pairs(df, p).collect()}
    monkeypatch.setattr(retrieval, "SUBSETS", 5)
    assert by_sets == {tuple(map(str, r)) for r in retrieval.candidate_pairs(df, p).collect()}
    if weight:
        assert len(by_sets) == len(brute_pairs(rows, 4, 8))


def test_sweep_searches_partners_once(spark, monkeypatch):
    rng = random.Random(9)
    names = ["revenue from operations", "revenue from services", "total revenue from operations net"]
    rows = [(n, rng.choice([1, 1, 2, None]), rng.choice(names), rng.choice(["acme", "acme works"]), " ".join(rng.sample(["crore", "mn", "10", "25", "70", "81"], 2))) for n in range(1, 60)]
    facts = spark.createDataFrame([fact(n, n % 3, p, rng.choice([1.0, 1.1, 2.0]), entity=e, subject_raw=s, object_raw=o) for n, e, p, s, o in rows], FACT)
    facts = facts.withColumn("reasoning_eligible", F.lit(True))
    files = spark.createDataFrame([(n, None) for n in range(3)], "id long, publication_date date")
    searches, real = [], retrieval.fact_rows
    monkeypatch.setattr(retrieval, "fact_rows", lambda facts: searches.append(1) or real(facts))
    configs = {"baseline": {"top_k": 4, "confidence": 0.5}, "few": {"top_k": 2}, "strict": {"top_k": 3, "candidate": 0.8}, "loose": {"top_k": 3, "candidate": 0.5}, "contradiction": {"top_k": 4, "contradiction": 0.6}}
    got = sorted(map(tuple, stages.sweep(facts, files, configs).collect()))
    assert len(searches) == 1
    configs["weight"] = {"top_k": 4, "weight_entity": 0.0}  # other partners than the baseline's
    got = sorted(map(tuple, stages.sweep(facts, files, configs).collect()))
    want = []
    for name, changes in configs.items():
        p = signals.Thresholds(**{k: v for k, v in changes.items() if k != "confidence"})
        pairs = signals.guard_pairs(retrieval.candidate_pairs(facts, p), facts)[0]
        judged = signals.reason(signals.signals(signals.with_pair(pairs.select("a", "b"), facts, files), p), None, p).collect()
        want += [(name, c, sum(r.category == c for r in judged), sum(r.category == c and r.confidence >= 0.5 for r in judged)) for c in {r.category for r in judged}]
    assert got == sorted(want)


def test_verdict_grid(spark):
    cases = [(0.0, "equal", "CORROBORATES"), (0.01, "equal", "CORROBORATES"), (0.05, "equal", "UNCERTAIN"), (0.3, "equal", "CONTRADICTS"), (0.3, "overlaps", "CONTRADICTS"), (0.3, "adjacent", "TEMPORAL_EVOLUTION"), (0.3, "disjoint", "TEMPORAL_EVOLUTION"), (0.3, "missing", "UNCERTAIN")]
    df = spark.createDataFrame(cases, "delta double, period_relation string, want string")
    fixed = {"entity_relation": "same", "predicate_exact": True, "predicate_similarity": 1.0, "predicate_jaccard": 1.0, "types_differ": False, "both_numeric": True, "numeric_comparable": True, "sign_match": True, "pct_vs_abs": False, "unit_relation": "missing", "currency_relation": "same", "unit_equivalent": True, "modality_same": True, "modality_comparable": True, "objects_equal": False}
    df = df.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"scope_conflict": F.array().cast("array<string>")})
    assert all(r.v.category == r.want for r in df.select("want", signals.verdict().alias("v")).collect())


def test_verification_ladder(spark):
    page = "Revenue was ₹8,142 crore in FY24. Costs fell. Costs fell. The board approved the plan on schedule."
    cases = {"₹8,142 crore": (12, 24, "exact"), "₹8,142  crore": (12, 24, "normalized_exact"), "Revenue was": (3, 9, "recovered_exact"), "Costs fell.": (0, 5, "ambiguous_quote_match"), "nothing": (0, 5, "quote_not_found"), "Revenue was ₹9,999 crore in FY24": (0, 5, "numeric_token_mismatch"), "The board aproved the plan on schedule": (0, 5, "fuzzy"), "A very different sentence altogether": (0, 5, "quote_not_found"), "": (0, 5, "quote_not_found"), None: (0, 5, "quote_not_found")}
    rows = [(n, n, 1, 1, 5, 0, q, s, e) for n, (q, (s, e, _)) in enumerate(cases.items())]
    rows[0] = (0, 0, None, 1, 5, 0, *rows[0][6:])  # found by document and page index
    evidence = spark.createDataFrame(rows + [(99, 99, 7, 1, 6, 0, "x", 0, 1)], "id long, fact_id long, page_id long, chunk_id long, document_id long, page_index int, quote string, char_start int, char_end int")
    pages = spark.createDataFrame([(1, 5, 0, page)], "id long, document_id long, page_index int, text string")
    chunks = spark.createDataFrame([(1, 0, len(page), 0, page)], "id long, char_offset int, char_end int, header_prefix_len int, text string")
    got = {r.id: r.reason or r.method for r in grounding.verify(evidence, pages, chunks).collect()}
    assert got == {n: w for n, (_, _, w) in enumerate(cases.values())} | {99: "source_unavailable"}
    number = lambda n, raw, value, **more: {"id": n, "fact_type": "numeric", "value_raw": raw, "numeric_value": value, "currency": None, "magnitude": None, "unit_raw": None, "is_percentage": False, "percentage_ratio": None} | more
    facts = [number(0, "₹8,142 crore", 8142.0, currency="INR", magnitude="crore"), number(1, "₹8,142 crore", 8143.0), number(2, "8,142", 8142.0), number(100, "1", 1.0), number(6, None, None) | {"fact_type": "semantic"}]
    facts = spark.createDataFrame([tuple(f.values()) for f in facts], "id long, fact_type string, value_raw string, numeric_value double, currency string, magnitude string, unit_raw string, is_percentage boolean, percentage_ratio double")
    checked = {r.fact_id: r for r in grounding.verify(evidence, pages, chunks, facts).collect()}
    assert {k: (checked[k].status, checked[k].rederivation, checked[k].reason) for k in (0, 1, 2, 100, 6)} == {0: ("VERIFIED", "success", None), 1: ("UNVERIFIED", "failed", "numeric_mismatch"), 2: ("UNVERIFIED", "failed", "numeric_mismatch"), 100: ("UNVERIFIED", "not_applicable", "unsupported_evidence"), 6: ("PARTIAL", "not_applicable", None)}


@pytest.mark.parametrize(("target", "overlap", "backoff"), [(40, 10, 8), (200, 40, 30)])
def test_chunk_spans(spark, target, overlap, backoff):
    rng = random.Random(3)
    texts = ["", "x" * 500, " " * 90, *("".join(rng.choice("abc é\n") for _ in range(rng.randrange(900))) for _ in range(20))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ingest.chunk_spans(F.col("t"), target, overlap, backoff).alias("s"))
    for t, spans in df.collect():
        want, at = [], 0
        while t:
            end = min(at + target, len(t))
            if end < len(t):
                end = next((e for e in range(end, end - backoff, -1) if t[e - 1] in " \n"), end)
            want.append((at, end))
            if end == len(t):
                break
            at = end - overlap
        assert [(s.start, s.stop) for s in spans] == want


def test_sources(spark):
    df = spark.createDataFrame([("a\nPage 7\n", 9), ("12\nsome words", 9), ("xiv", 9), ("9999\n7", 9), ("7\n9999", 9), ("no label", 9), ("", 9)], "t string, n int")
    assert [r[0] for r in df.select(ingest.printed_label(F.col("t"), F.col("n"))).collect()] == ["7", "12", "xiv", "7", None, None, None]
    names = spark.createDataFrame([("C:\\x\\r.pdf",), ("../..",), (None,), ("a/b\tc.pdf",)], "v string")
    assert [r[0] for r in names.select(ingest.display_name(F.col("v"))).collect()] == ["r.pdf", "upload.pdf", "upload.pdf", "bc.pdf"]
    copies = ingest.first_copies(spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, t string"), "id", "t")
    assert {r.id: (r.first_id, r.is_duplicate) for r in copies.collect()} == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False)}


def test_binary_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-one|two")
    (tmp_path / "b.pdf").write_bytes(b"plain")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-bad")

    def parser(body):
        if b"|" not in body:
            raise ValueError
        return [(t, 595.0, 842.0) for t in body[5:].decode().split("|")]

    rows = sorted((r.path[-5:], r.page_index, r.text, r.error) for r in ingest.binary_pages(spark, str(tmp_path), parser).collect())
    assert rows == [("a.pdf", 0, "one", None), ("a.pdf", 1, "two", None), ("b.pdf", None, None, "not_a_pdf"), ("c.pdf", None, None, "unreadable_pdf")]


def test_resolution(spark):
    facts = spark.createDataFrame([(1, 1, "Acme Corp.", None), (2, 1, "the Company", None), (3, 1, "Acme Limited", None), (4, 2, "Brand New Ltd", None), (5, 2, "Brand New", None), (6, 3, "Holdings Group", None), (7, 4, "Zenith Hydro Powers", None), (8, 4, "Tavra Consultancy", None), (9, 5, "the Company", None)], "id long, document_id long, subject_raw string, subject_entity_id long")
    entities = spark.createDataFrame([(10, "ACME Ltd"), (11, "Acme"), (12, "Zenith Hydro Power"), (13, "Tavra Consultancy Services")], "id long, canonical_label string")
    done = resolve.resolve(facts, entities)
    got = {r.fact_id: (r.entity_id, r.method or r.reason) for r in done.collect()}
    want = {1: (10, "deterministic"), 2: (10, "anaphora"), 3: (10, "deterministic"), 4: (-4, "new_entity"), 5: (-4, "new_entity"), 6: (None, "empty_key"), 7: (12, "similarity"), 8: (None, "similar_unconfirmed"), 9: (None, "anaphora_no_dominant_entity")}
    assert got == want
    asked = resolve.resolve(facts, entities, confirmer=lambda d: d.select("key", F.lit(True).alias("same"), F.lit(0.9).alias("confidence")))
    assert {r.fact_id: (r.entity_id, r.method or r.reason) for r in asked.collect()} == want | {8: (13, "llm")}
    assert {(r.entity_id, r.surface) for r in resolve.aliases(facts, done).collect()} == {(10, "Acme Corp."), (10, "the Company"), (10, "Acme Limited"), (-4, "Brand New Ltd"), (-4, "Brand New"), (12, "Zenith Hydro Powers")}
    assert [(r.id, r.canonical_label, r.normalization_key) for r in resolve.new_entities(facts, done).collect()] == [(-4, "Brand New Ltd", "brand new")]
    said = spark.createDataFrame([(1, 10, "formerly known as", None, "Zenith Hydro Power Ltd"), (2, 10, "revenue", None, "Acme")], "id long, subject_entity_id long, predicate string, predicate_norm string, object_raw string")
    assert [tuple(r) for r in resolve.rename_map(said, entities).collect()] == [(12, 10)]


def test_error_runs_budget_and_views(spark):
    events = spark.createDataFrame([(1, n, k) for n, k in enumerate("EEXEEEEEX")] + [(2, 0, "X")], "u long, t int, k string")
    got = {r.u: (r.longest_run, r.aborted) for r in candidates.error_runs(events, "u", ["t"], F.col("k") == "E").collect()}
    assert got == {1: (5, True), 2: (0, False)}
    assert candidates.within_budget(events, "u", ["t"], 3).count() == 4
    facts = corpus(spark)
    assert views.fact_filter(facts, q='profit "after', lifecycle="NONSENSE").count() == 2 and views.fact_filter(facts, q="Profit AFTER").count() == 2
    assert [r.id for r in views.page_of(facts, [F.desc("id")], limit=0, offset=-4).collect()] == [7]


def test_incremental_batches(spark, tmp_path):
    facts = corpus(spark)
    fresh, stored = facts.where("id = 7"), facts.where("id <> 7")
    pairs_of = lambda d: retrieval.candidate_pairs(d).select("a", "b")
    known = spark.createDataFrame([(1, 7)], "a long, b long")
    assert {tuple(r) for r in incremental.new_pairs(fresh, stored, pairs_of, known).collect()} == {(2, 7), (3, 7), (4, 7), (5, 7)}
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    facts.select("id", "predicate").repartition(2).write.parquet(source)
    query = incremental.run(spark, source, "id long, predicate string", target, str(tmp_path / "ck"), lambda b, _: b.groupBy("predicate").count())
    query.awaitTermination()
    assert spark.read.parquet(target).agg(F.sum("count")).collect()[0][0] == 6


def test_fuzzy_block_equals_brute_force_with_words_in_many_keys(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeiklmnorstu") for _ in range(rng.randrange(1, 10)))
    names = [f"{g} {word()}" for g in ['alexander'] * 420 + ['li', 'konstantin'] * 30] + [f"{word()} {word()} {rng.choice(['textiles', 'agro products'])}" for _ in range(450)]
    names += ["alexander tresthax", "alexander tresthxa", "zbc qdf textiles", "zbx qdx textiles", "textiles", "konstantinopel li", "konstantinopel wu", "li li wampandrurt", "aaaaaaa", "aaaaaaaa", "wampandrurt li"]
    typed = [k[:p] + rng.choice("xz ") + k[p + 1 :] for k in names for p in [rng.randrange(1, len(k))]]
    left, right = (sorted({" ".join(k.split()) for k in x}) for x in (typed[::2] + names[-11:], names))
    frames = [spark.createDataFrame([(k,) for k in x], "key string") for x in (left, right)]
    scored = {(a, b): (fuzzy.token_set_ratio(a, b), fuzzy.token_sort_ratio(a, b)) for a in left for b in right}
    got = [(r.key, r.match) for r in resolve.fuzzy_block(*frames).collect()]
    want = {k for k, (x, _) in scored.items() if x >= 88}
    assert len(got) == len(set(got)) and set(got) == want and ("alexander tresthax", "alexander tresthxa") in want
    merged = {(r.key, r.match) for r in resolve.fuzzy_block(*frames, merge=94.0).collect()}
    assert merged == {k for k, (x, y) in scored.items() if x >= 88 and y >= 94}
