import random

import numpy as np

from factloom.llm import scans
from factloom.llm.boost import Boosted
from factloom.llm.names import similar_words
from factloom.llm.scans import damage, mended_pages, page_number, read_scans

WORDS = "management committee statutory treasury regional council auditor procurement environmental remediation amalgamation provisioning distribution discontinued undertaking confirmation balances approved recorded discussed confirmed schedule inventories disclosure shareholders restructuring depreciation recommendation arbitration commissioning".split()
SCHEMA = "id long, document_id long, page_index int, text string, words string, word string"


def corpus():
    rng = random.Random(6)
    rows, want = [], {}

    def body(n=40):
        return [rng.choice(WORDS) for _ in range(n)] + ["long-term", "plan."]

    def lines(words):
        return "\n".join(" ".join(words[k : k + 8]) for k in range(0, len(words), 8))

    for doc in range(12):
        scanned = doc % 3 == 0
        for page in range(8):
            pid, kinds, words = doc * 100 + page, set(), body()
            if scanned:
                for _ in range(3):
                    k = rng.randrange(40)
                    words[k] = next(d for d in iter(lambda: damage(words[k], rng), None) if d != words[k])
                kinds.add("misread")
            text = lines(words)
            if scanned and page % 2:
                text += "\nThe provi-\nsioning of the long-\nterm plan."
                kinds.add("hyphen_break")
            if scanned and doc % 2 == 0:
                text = f"Annual Report of Somebody {2020 if page != 3 else '2O20'}\n{text}\n{page + 5 if doc else 'Page ' + str(page + 1) + ' of 8'}"
                kinds |= {"running_head", "page_number"}
            rows.append((pid, doc, page, text, "x", "y"))
            want[pid] = kinds
    rows += [(9001, 50, 0, None, "x", "y"), (9002, 50, 1, "", "x", "y"), (9003, None, None, "- 4 -\nSome words here\nand more.", "x", "y"), (9004, 50, 2, "committee " * 30_000, "x", "y"), rows[0]]
    want |= {9003: {"page_number"}}
    return rows, want


def test_noise_kinds_and_repair(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {}
    for r in read_scans(df).found.collect():
        assert r.noise_kind not in got.setdefault(r.page_id, set())
        got[r.page_id].add(r.noise_kind)
    assert {k: (got.get(k, set()), v) for k, v in want.items() if got.get(k, set()) != v} == {}
    assert set(got) <= set(want)
    texts = {r.page_id: r for r in mended_pages(df).collect()}
    assert texts[9001].text is None and texts[9002].text == "" and texts[9001].noise_kinds == []
    page = texts[1]
    assert "Annual Report" not in page.text and "Page 2" not in page.text and "provisioning of the long-term plan." in page.text
    known = {*WORDS, "long-term", "plan.", "The", "of", "the"}
    mended = [texts[k].text for k in want if "misread" in want[k]]
    words = [w for t in mended for w in t.split()]
    assert sum(w in known for w in words) > 0.97 * len(words)


def test_page_numbers():
    assert page_number("- l9 -") == [(19, True)] and page_number("Page 3 of 1O") == [(3, True)] and page_number("xliv") == [(44, False)] and page_number("[12]") == [(12, True)]
    assert page_number("9,113") == [] and page_number("25.7%") == [] and page_number("demand.") == [] and (1, False) in page_number("l")


def test_empty(spark):
    assert read_scans(spark.createDataFrame([], SCHEMA)).found.collect() == []


def test_heads_of_any_form(spark):
    heads = {1: "ACME TEXTILES CORP.", 2: "Brasvon Pharmaceuticals Ltd.", 3: "Interim report", 4: "Annual report | 2024", 5: "(draft)", 6: "AGM"}
    rng, rows = random.Random(8), []
    for doc, head in heads.items():
        for page in range(5):
            body = [" ".join(rng.choices(WORDS, k=6)) + f" {doc}{page}{k}." for k in range(3)]
            shown = head.replace("In", "ln") if page == 1 else head
            lines = [shown, *body] if doc % 2 else [*body, shown]
            rows.append((doc * 100 + page, doc, page, "\n".join(lines if page < 4 else body), "x", "y"))
    rows += [(900 + page, 9, page, "Nil", "x", "y") for page in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id for r in read_scans(df).found.where("noise_kind = 'running_head'").collect()}
    want = {doc * 100 + page for doc in heads for page in range(4)}
    assert got == want
    texts = {r.page_id: r.text for r in mended_pages(df).collect()}
    assert not any(head in texts[doc * 100] for doc, head in heads.items()) and texts[900] == "Nil"


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_words_and_grams_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows, want = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages"))  # a file has a size to plan by
    plans, cut = [], scans.cut
    monkeypatch.setattr(scans, "cut", lambda df: plans.append(planned(df)) or cut(df))
    found = scans.read_scans(spark.read.parquet(str(tmp_path / "pages"))).found.collect()
    assert {(r.page_id, r.noise_kind) for r in found} == {(k, kind) for k, kinds in want.items() for kind in kinds}
    joined = [p for p in plans if "explode(words" in p and "Join" in p]
    assert len(joined) == 1 and "BroadcastHashJoin" not in joined[0]
    words = spark.range(2000).selectExpr("concat('word', id) as word")
    assert "BroadcastHashJoin" not in planned(similar_words(words, words))


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.4)).astype(float)
    model = Boosted().fit(x[:600], y[:600])
    assert ((model.predict(x[600:]) > 0.5) == (y[600:] > 0.5)).mean() > 0.95
