import random

import pytest

from factloom.llm.tokens import VOCABULARY, encode

TEXTS = [
    None, "", " ", "\n\n \t", "<|endoftext|> it's", "a" * 5001, "ab" * 3000, "!!!!!!!!!!!!___", "é हिन्दी ﬁ​ ₹1,23,456.7",
    "".join(random.Random(1).choice("abcdefghij") for _ in range(20_000)), "word " * 30_000, "it's it's it's",
]


def test_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(VOCABULARY)
    lib.encode_special_tokens = True
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(1, "again", "x"), (1, "again", "x"), (None, "no key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    key = lambda x: (str(x[0]), x[1])
    got = sorted(((r.doc_id, list(r.ids)) for r in encode(df, "doc_id", "text").collect()), key=key)
    assert got == sorted(((k, lib.encode(t or "", add_special_tokens=False).ids) for k, t, _ in rows), key=key)
    sizes = sorted((str(r.doc_id), r.n_tokens) for r in encode(df, "doc_id", "text", sizes_only=True).collect())
    assert sizes == sorted((str(k), len(i)) for k, i in got)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []
