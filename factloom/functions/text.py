"""Text and token functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of content tokens, legal suffixes, honorifics, anaphora, rename phrases, alias groups.
STOPWORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "per", "the", "to", "with", "s"]
LEGAL_SUFFIXES = ["limited", "ltd", "llp", "inc", "incorporated", "corp", "corporation", "company", "co", "plc", "pvt", "private", "gmbh", "sa", "nv", "ag", "pte", "llc", "lp", "group", "holdings", "holding", "sarl", "bv", "oyj"]
HONORIFICS = ["mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri", "hon", "sir", "mx"]
ANAPHORA = ["the company", "the group", "the issuer", "the bank", "the corporation", "the firm", "the registrant", "our company", "the parent", "the organisation", "the organization", "the entity"]
RENAME_PHRASES = ["formerly known as", "formerly", "former name", "changed its name", "changed name", "renamed", "incorporated as", "originally incorporated", "previously known as", "erstwhile", "name was changed"]
CURRENCY_ALIASES = {"inr": ["₹", "rs", "rs.", "inr"], "₹": ["₹", "rs", "rs.", "inr"], "rs": ["₹", "rs", "rs.", "inr"], "usd": ["$", "us$", "usd"], "$": ["$", "us$", "usd"], "eur": ["€", "eur"], "€": ["€", "eur"], "gbp": ["£", "gbp"], "£": ["£", "gbp"]}
MAGNITUDE_ALIASES = {"crore": ["crore", "crores", "cr"], "cr": ["cr", "crore", "crores"], "lakh": ["lakh", "lakhs", "lac"], "million": ["million", "mn", "mln"], "mn": ["mn", "million"], "billion": ["billion", "bn"], "bn": ["bn", "billion"], "thousand": ["thousand", "'000", "000s"], "bps": ["bps", "basis points", "basis point"]}

# What counts as a figure, a percentage, and a magnitude or unit word.
NUMBER = r"\d[\d,]*(?:\.\d+)?"
PERCENT = r"(?i)%|per\s?cent|percent"
MAGNITUDE_WORDS = r"(?i)\b(?:crores?|cr|lakhs?|lac|millions?|mn|mln|billions?|bn|thousand|bps|basis\s+points?|tonnes?|tons?|units?|days?|sq\.?\s?ft)\b"
SPACE = "[\\s   -     　﻿]+"
QUOTES_DASHES = ("‘’‚‛“”„‟‐‑‒–—―−", "''''\"\"\"\"-------")


def fold(text: Column) -> Column:
    """Quotes and dashes in their plain form, white space as one blank, trimmed; letter case and figures stay."""
    return F.trim(F.regexp_replace(F.translate(text, *QUOTES_DASHES), SPACE, " "))


def content_tokens(text: Column) -> Column:
    """The different lower-case letter-and-digit runs of at least two characters that are no stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS)))


def predicate_text(predicate: Column, predicate_norm: Column) -> Column:
    norm, raw = (F.trim(F.coalesce(c, F.lit(""))) for c in (predicate_norm, predicate))
    return F.when(norm != "", norm).otherwise(raw)


def salient_tokens(text: Column) -> Column:
    """Figures, currency marks, percent signs and magnitude or unit words, each once whatever its letter case."""
    out = F.concat(
        F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)),
        F.regexp_extract_all(text, F.lit("[₹$€£]"), F.lit(0)),
        F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(?:rs|inr|usd|eur|gbp)\b"), F.lit(0)), F.lower),
        F.when(text.rlike(PERCENT), F.array(F.lit("%"))).otherwise(F.array().cast("array<string>")),
        F.transform(F.regexp_extract_all(text, F.lit(MAGNITUDE_WORDS), F.lit(0)), F.lower),
    )
    return F.array_distinct(out)


def token_in_text(token: Column, text: Column) -> Column:
    """Whether a token stands in a text: percent in any form, figures with no digit beside them, anything else as a substring."""
    token = F.trim(token)
    bare, plain = F.regexp_replace(token, ",", ""), F.regexp_replace(text, ",", "")
    figure = F.concat(F.lit(r"(?<![\d.])\Q"), bare, F.lit(r"\E(?!\d)"))
    return F.when(F.trim(token) == "", True).when(token == "%", text.rlike(PERCENT)).when(token.rlike(r"\d"), F.regexp_like(plain, figure)).otherwise(F.contains(F.lower(text), F.lower(token)))


def alias_in_text(value: Column, text: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Whether one of a value's aliases stands in a text as a substring; a value without any, as ``token_in_text`` has it."""
    plain = token_in_text(value, text)
    if not aliases:
        return plain
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    forms = F.try_element_at(table, F.lower(F.trim(value)))
    return F.when(forms.isNull(), plain).otherwise(F.exists(forms, lambda a: F.contains(F.lower(text), a)))


def digits_of(text: Column) -> Column:
    """The one number in a text, negative if the whole text is in brackets or begins with a minus; null for none or several."""
    s = F.trim(F.translate(text, "−", "-"))
    found = F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0))
    n = F.when(F.size(found) == 1, F.regexp_replace(F.element_at(found, 1), ",", "").try_cast("double"))
    bare = F.ltrim(F.btrim(s, F.lit("()")))
    return F.when((s.startswith("(") & s.endswith(")")) | bare.startswith("-"), -n).otherwise(n)


def norm_object(text: Column) -> Column:
    return F.rtrim(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")), F.lit(".,;:"))


def normalize_name(raw: Column) -> Column:
    """A name's key: lower case, punctuation as blanks, trailing legal suffixes and leading honorifics dropped."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"(?U)[^\w\s&-]", " "), r"(?U)\s+", " ")), " ")
    kept = F.aggregate(F.reverse(words), F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.isin(LEGAL_SUFFIXES), acc).otherwise(F.array_append(acc, w)))
    named = F.aggregate(F.reverse(kept), F.array().cast("array<string>"), lambda acc, w: F.when((F.size(acc) == 0) & w.isin(HONORIFICS), acc).otherwise(F.array_append(acc, w)))
    return F.trim(F.array_join(named, " "))


def guess_type(raw: Column) -> Column:
    first = F.element_at(F.split(F.trim(F.lower(raw)), r"[.\s]"), 1)
    return F.when(first.isin(HONORIFICS), "person").otherwise("org")


def is_anaphora(raw: Column) -> Column:
    return F.rtrim(F.trim(F.regexp_replace(F.lower(raw), r"(?U)\s+", " ")), F.lit(".")).isin(ANAPHORA)


def is_rename(predicate: Column, predicate_norm: Column) -> Column:
    text = F.concat_ws(" ", F.lower(F.coalesce(predicate, F.lit(""))), F.lower(F.coalesce(predicate_norm, F.lit(""))))
    return reduce(lambda x, y: x | y, [F.contains(text, F.lit(p)) for p in RENAME_PHRASES])
