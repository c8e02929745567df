import random

import pytest

from factloom.llm.names import Rule, link_names, similar_words
from factloom.llm.spelling import allowed, edits, parts, similarity

ENTITIES = [
    (1, "Tarstilkol Gramrawolm Pharmaceuticals Ltd"), (2, "Tarstilkol & Grenbrapisk Laboratories Pvt Ltd"), (3, "Robert Tresthax"), (4, "Alexandra Chisla"), (5, "Alexander Chisla"),
    (6, "Thegas Wedrenston Corp."), (7, "Tarstilkol Gramarwolm Pharma"), (8, "Samuel Dozouk"), (9, "Brasvon Flarquan Pharmaceuticals"), (12, "Stisemwaind Florbartrim Logistics"), (13, "Wumtipreilm Jamshe Logistics"), (14, "Wumtipreilm Sharzu Logistics"), (15, "Klohort Fequanfo Laboratories"), (16, "Klohort Laboratories Inc."), (10, None), (None, "Nobody Registered"), (11, ""), (3, "Robert Tresthax"),
]
FACTS = {
    "M/s TARSTILKOL GRAMRAWOLM PHARMA": {1, 7}, "Gramrawolm, Tarstilkol Pharmaceuticals Inc.": {1, 7}, "TarstilkolGramrawolm Pharm.": {1, 7}, "T. Gramrawolm Pharmaceuticals": {1, 7},
    "T.G. Pharmaceuticals Corp.": {1, 7}, "Tarstilkol Grenbrapisk": {2}, "Bobby Tresthax": {3}, "Tresthax, R.": {3}, "Mr. Robert Q. Tresthaxx": {3}, "Alexandra Chisla": {4}, "Alexander Chilsa": {5},
    "Stisemwaind Logistics plc": {12}, "Stisemwiand Logistics": {12}, "Stisemwaind Laboratories": set(), "Wumtipreilm Logistics": set(), "Klohort Laboratories": {15, 16}, "Fequanfo Laboratories": set(),
    "The gas Wedrenston": {6}, "the Company": set(), "our company": set(), "Robert Tresthaxstow": set(), "Thomas Tresthax": set(), "Brasvon Gramrawolm Pharmaceuticals": set(), "J. Tresthax": set(), "": set(), " ": set(), None: set(), "x" * 30_000: set(),
}


def filler():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ka", "mo", "ri", "ste", "lou", "pen"]) for _ in range(4)).capitalize()
    trades, given = ["Pharmaceuticals", "Laboratories", "Logistics"], ["Robert", "Samuel", "Thomas"]
    return [f"{word()} {word()} {rng.choice(trades)} Ltd" for _ in range(400)] + [f"{rng.choice(given)} {word()}" for _ in range(200)]


def test_links(spark):
    entities = spark.createDataFrame([(k, n, "x") for k, n in ENTITIES + [(1000 + i, n) for i, n in enumerate(filler())]], "id long, canonical_label string, core string")
    facts = spark.createDataFrame([(k, n, "x", 0) for k, n in enumerate(FACTS)] + [(0, next(iter(FACTS)), "x", 0)], "fact_id long, subject_raw string, core string, words int")
    got: dict = {k: set() for k in range(len(FACTS))}
    rows = link_names(facts, "fact_id", "subject_raw", entities, "id", "canonical_label").collect()
    for r in rows:
        got[r.fact_id].add(r.entity_id)
    wrong = {n: got[k] for k, (n, want) in enumerate(FACTS.items()) if got[k] != want}
    assert wrong == {} and len(rows) == sum(map(len, FACTS.values()))


def test_equal_names_without_a_rare_word(spark):
    # several parties fit "S.G. Pharmaceuticals", one of which is registered like that
    labels = ["Stolwen Gramrawolm Pharmaceuticals Ltd", "Sarquist Grenbrapisk Pharmaceuticals", "SG Pharmaceuticals Inc.", *filler()]
    entities = spark.createDataFrame(list(enumerate(labels)), "id long, canonical_label string")
    facts = spark.createDataFrame([(1, "SG Pharmaceuticals"), (2, "SG Laboratories"), (3, "S.G. Pharmaceuticals")], "fact_id long, subject_raw string")
    got = {(r.fact_id, r.entity_id) for r in link_names(facts, "fact_id", "subject_raw", entities, "id", "canonical_label").collect()}
    assert (1, 2) in got and {k for k, _ in got} == {1} and len(got) == 1


def test_names_of_short_words(spark):
    labels = ["ABB Limited", "SAP", "ITC Ltd", "L&T Ltd", "Jio", "Global Industries", *filler(), *(f"Global {x} Industries" for x in ("Asia", "Nova", "Polo", "Tera", "Zeta"))]
    entities = spark.createDataFrame(list(enumerate(labels)), "id long, canonical_label string")
    typed = {"ABB Ltd": 0, "SAP": 1, "ITC Limited": 2, "Itc": 2, "JIO pvt. ltd.": 4, "Industries, Global": 5, "IBM": None, "SAB": None}
    facts = spark.createDataFrame(list(enumerate(typed)), "fact_id long, subject_raw string")
    got = {(r.fact_id, r.entity_id) for r in link_names(facts, "fact_id", "subject_raw", entities, "id", "canonical_label").collect()}
    assert got == {(k, want) for k, want in enumerate(typed.values()) if want is not None}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, name string")
    some = spark.createDataFrame([(1, "Tarstilkol Gramrawolm")], "id long, name string")
    assert link_names(none, "id", "name", some, "id", "name").collect() == []
    assert link_names(some, "id", "name", none, "id", "name").collect() == []


def test_word_join_equals_brute_force_up_to_one_edit(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(4, 11))) for _ in range(250)]
    typed = []
    for w in words:
        k = rng.randrange(1, len(w) - 1)
        typed.append(rng.choice([w[:k] + "z" + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + "q" + w[k:], w[: k - 1] + w[k] + w[k - 1] + w[k + 1 :]]))
    left, right = (spark.createDataFrame([(w,) for w in x], "word string") for x in (typed, words))
    got = {tuple(r) for r in similar_words(left, right, Rule()).collect()}
    want = {(a, b) for a in set(typed) for b in set(words) if len(a) >= 4 and edits(a, b, 1) <= 1}
    assert len(want - got) <= 0.02 * len(want)  # a set similarity of 0.3 leaves out swaps in the shortest words


@pytest.mark.parametrize(("a", "b", "like"), [("robert tresthax", "bob tresthax", True), ("robert tresthax", "thomas tresthax", False), ("j tresthax", "robert tresthax", False), ("pharma", "pharmaceuticals", False)])
def test_similarity(a, b, like):
    df = {"robert": 90, "thomas": 90, "bob": 5, "tresthax": 4, "j": 30, "pharma": 50, "pharmaceuticals": 300}
    x, y = a.split(), b.split()
    assert (similarity(x, [df[w] for w in x], y, [df[w] for w in y], 10_000, 40)[0] >= Rule().accept) == like


def test_parts_and_edits():
    assert parts("M/s Acmé-Brasvon & Sons (Pvt) Ltd.") == ["acme", "brasvon", "sons"] and parts("The Group") == [] and parts(None) == []
    assert edits("abcd", "acbd", 2) == 1 and edits("abcd", "xyzw", 1) == 2 and [allowed(n) for n in (3, 4, 8)] == [0, 1, 2]
