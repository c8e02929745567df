"""One form for texts that look the same (problem 3).

The words that hold other than ASCII characters are mapped character by character to the letters they look like; the
mapped words are grouped in SQL under the accent-sensitive Unicode collation, under which composed and decomposed
accents are equal and invisible characters do not count; the shortest, then smallest member speaks for its class and is
joined back to the words and put into the texts. Only distinct words pass through mapping and grouping, never texts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.tables import cut

# Letters of other scripts with the Latin letters that they are drawn like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaesijopcyxdqwhl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXovcj"
OTHER = "ɑɡıⅼⅽⅾⅿⅰⅴⅹʼʹ’‘‐‑"
OTHER_LATIN = "agilcdmivx''''--"
INVISIBLE = "​‌‍⁠﻿­᠎‎‏⁡⁢⁣⁤⁦⁧⁨⁩‪‫‬‭‮"


def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """One character for one, and one for several: a rule over Unicode's own decompositions, with the fixed values above."""
    one, many = {}, {}
    for code in [*range(0xA0, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        char = chr(code)
        kind = unicodedata.decomposition(char).split(" ")[0]
        if unicodedata.category(char) == "Zs":
            one[char] = " "
        elif kind in ("<wide>", "<narrow>", "<font>", "<compat>") and not unicodedata.category(char).startswith(("No", "M")):
            plain = unicodedata.normalize("NFKC", char)
            if plain.strip() and all(ord(x) < 0x250 for x in plain):
                (one if len(plain) == 1 else many)[char] = plain
    for theirs, latin in ((CYRILLIC, CYRILLIC_LATIN), (GREEK, GREEK_LATIN), (OTHER, OTHER_LATIN)):
        one.update(zip(theirs, latin, strict=True))
    one = {k: v for k, v in one.items() if k not in INVISIBLE}
    return one, {k: v for k, v in many.items() if k in "ﬀﬁﬂﬃﬄﬅﬆ"}


ONE, MANY = _tables()
UNUSUAL = r"[\x21-\x7e]*+[^\x00-\x7f][^ \n]*+"


def _mapped(word: Column) -> Column:
    out = F.translate(word, "".join(ONE) + INVISIBLE, "".join(ONE.values()))
    for char, plain in MANY.items():
        out = F.replace(out, F.lit(char), F.lit(plain))
    return out


@F.pandas_udf(T.StringType())
def _composed(words: pd.Series) -> pd.Series:
    return words.map(lambda w: unicodedata.normalize("NFC", w), na_action="ignore")


def flat(text: str | Column) -> Column:
    """The text with line feeds as blanks."""
    return F.translate(F.col(text) if isinstance(text, str) else text, "\n", " ")


def unusual_words(text: str | Column) -> Column:
    """The different words of a text, cut at blanks and line feeds, that hold more than ASCII; null if there are none."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(UNUSUAL), F.lit(0)))


def canonical_words(words: DataFrame) -> DataFrame:
    """(word, canon) for each word of a table (word) that its class writes differently; repeated and null words are allowed."""
    different = words.where("word is not null").distinct().withColumn("mapped", _mapped(F.col("word")))
    classes = words.sparkSession.sql(
        """select min_by(mapped, struct(char_length(mapped), mapped)) as canon, collect_set(mapped) as members
        from {different} group by mapped collate UNICODE""",
        different=different,
    )
    members = classes.select(_composed("canon").alias("canon"), F.explode("members").alias("mapped"))
    return different.join(members, "mapped").where("word <> canon").select("word", "canon")


def with_words(text: Column, map_: Column) -> Column:
    """``flat`` text with the words of ``map_`` replaced."""
    return F.when(map_.isNull(), text).otherwise(F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.coalesce(F.element_at(map_, w), w)), " "))


def quotes_on_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, as_written, looks_same) for every quote whose page exists.

    ``quotes``: id, page_id, quote; ``pages``: id, text. ``as_written``: the quote occurs on the page character for
    character, line feeds taken as blanks; ``looks_same``: it does once both are in one form. Null or empty quotes and
    pages are neither; repeated rows are judged one by one; other columns are not read. A page and its quotes meet once,
    keyed by page, together with the page's table of replaced words.
    """
    q = quotes.select(F.col("id").alias("quote_id"), "page_id", F.col("quote").alias("quote")).where("page_id is not null")
    p = pages.select(F.col("id").alias("page_id"), flat("text").alias("page")).where("page_id is not null")  # flat once a page, not once a quote
    words = cut(p.select("page_id", F.explode(unusual_words("page")).alias("word")).union(q.select("page_id", F.explode(unusual_words("quote")).alias("word"))).distinct())  # read once, not for each use
    canon = canonical_words(words.select("word"))
    maps = words.join(canon, "word").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "canon"))).alias("map"))
    both = q.join(p.join(maps, "page_id", "left"), "page_id")
    there = (F.length("quote") > 0) & (F.length("page") > 0)
    written = F.coalesce(there & F.contains(F.col("page"), flat("quote")), F.lit(False))
    both = both.withColumn("as_written", written)
    same = F.col("as_written") | F.coalesce(there & F.col("map").isNotNull() & F.contains(with_words(F.col("page"), F.col("map")), with_words(flat("quote"), F.col("map"))), F.lit(False))
    return both.select("quote_id", "as_written", same.alias("looks_same"))


def one_form(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): every text in its one form; null stays null. ``key`` must be unique; line feeds become blanks."""
    words = cut(texts.select(key, F.explode(unusual_words(text)).alias("word")).distinct())
    maps = words.join(canonical_words(words.select("word")), "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "canon"))).alias("_map"))
    return texts.select(key, F.col(text).alias("_text")).join(maps, key, "left").select(key, with_words(flat("_text"), F.col("_map")).alias("text"))
