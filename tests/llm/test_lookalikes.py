import unicodedata

from factloom.llm.lookalikes import one_form, quotes_on_pages

PAGE = "Zeiñkle Finance\nclosed FY24 with 5 m² of floor at ₹1,234. The quick ﬁeld report: Fezé́klen approved it."
CASES = {
    "written": ("closed FY24 with 5 m² of", True, True),
    "line_feed": ("Finance closed", True, True),
    "wide": ("ｃｌｏｓｅｄ FY２４ with", False, True),
    "cyrillic": ("Zеiñkle Finаnсe", False, True),
    "decomposed": (unicodedata.normalize("NFD", "Zeiñkle"), False, True),
    "invisible": ("clo​sed F­Y24", False, True),
    "space": ("closed FY24　with", False, True),
    "ligature": ("quick field", False, True),
    "mathematical": ("FY𝟤𝟦", False, True),
    "case": ("CLOSED FY24", False, False),
    "raised": ("FY2⁴ with", False, False),
    "plain_for_raised": ("5 m2 of", False, False),
    "accent": ("Zeinkle", False, False),
    "other_word": ("closed FY25", False, False),
    "empty": ("", False, False),
    "null": (None, False, False),
}


def test_quotes(spark):
    quotes = spark.createDataFrame([(k, 1, q, "x") for k, (q, _, _) in enumerate(CASES.values())] + [(90, 2, "text", "x"), (91, None, "text", "x"), (92, 3, "a", "x"), (92, 3, "a", "x"), (93, 4, "b", "x")], "id long, page_id long, quote string, map string")
    pages = spark.createDataFrame([(1, PAGE, 0), (3, "wordа " * 20_000 + "а", 0), (4, None, 0), (5, "", 0)], "id long, text string, page int")
    got = sorted((r.quote_id, r.as_written, r.looks_same) for r in quotes_on_pages(quotes, pages).collect())
    want = [(k, w, s) for k, (_, w, s) in enumerate(CASES.values())] + [(92, False, True), (92, False, True), (93, False, False)]
    assert got == want


def test_one_form(spark):
    rows = [(1, "ｃａｆé"), (2, "café ok"), (3, None), (4, ""), (5, unicodedata.normalize("NFD", "café")), (6, "a​ b"), (7, "plain\ntext")]
    got = dict(tuple(r) for r in one_form(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect())
    assert got == {1: "café", 2: "café ok", 3: None, 4: "", 5: "café", 6: "a b", 7: "plain text"}


def test_empty(spark):
    e = spark.createDataFrame([], "id long, page_id long, quote string")
    assert quotes_on_pages(e, spark.createDataFrame([], "id long, text string")).collect() == []
