"""Verification of quotes against their source: a ladder whose first hit wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fuzzy, text


def sources(evidence: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence with its page text and the span it is checked against: its chunk, or the whole page where that is not valid.

    The page is the one of ``page_id``, else the one of document and page index.
    """
    known = pages.select(F.col("id").alias("page_id"), F.col("id").alias("_own"))
    placed = pages.where("document_id is not null and page_index is not null").groupBy("document_id", "page_index").agg(F.min("id").alias("_place"))
    out = evidence.join(known, "page_id", "left").join(placed, ["document_id", "page_index"], "left").withColumn("_page", F.coalesce("_own", "_place")).drop("_own", "_place")
    page = pages.select(F.col("id").alias("_page"), F.col("text").alias("page_text"))
    chunk = chunks.select(F.col("id").alias("chunk_id"), "char_offset", F.coalesce("char_end", F.col("char_offset") + F.length("text") - F.coalesce("header_prefix_len", F.lit(0))).alias("stop"))
    out = out.join(page, "_page", "left").drop("_page").join(chunk, "chunk_id", "left")
    n = F.length("page_text")
    valid = (F.col("char_offset") >= 0) & (F.col("char_offset") < F.col("stop")) & (F.col("stop") <= n)
    base = F.when(valid, F.col("char_offset")).otherwise(0)
    return out.withColumns({"base": base, "span": F.when(valid, F.substring("page_text", F.col("char_offset") + 1, F.col("stop") - F.col("char_offset"))).otherwise(F.col("page_text"))})


def _slice(start: Column, end: Column) -> Column:
    return F.substring("page_text", start + 1, end - start)


def ladder(rows: DataFrame, threshold: float = 90.0, least: int = 12, similarity: Column | None = None) -> DataFrame:
    """(id, status, method, reason, char_start, char_end) of evidence as ``sources`` gives it.

    Rows that reach the last rung without a ``similarity`` come out with status null and reason ``needs_fuzzy``.
    """
    s, e, quote = F.col("char_start"), F.col("char_end"), F.coalesce("quote", F.lit(""))
    valid = (s >= 0) & (s < e) & (e <= F.length("page_text"))
    piece = F.when(valid, _slice(s, e))
    at = F.expr("locate(coalesce(quote, ''), span)")
    again = F.expr("locate(coalesce(quote, ''), span, locate(coalesce(quote, ''), span) + 1)")
    folded_span, folded = text.fold(F.col("span")), text.fold(quote)
    missing = F.filter(text.salient_tokens(folded), lambda t: ~text.token_in_text(t, folded_span))
    hard = F.exists(missing, lambda t: t.rlike(r"\d|[₹$€£%]"))
    none = F.lit(None).cast("int")
    made = lambda status, method, why, a=none, b=none: F.struct(F.lit(status).alias("status"), F.lit(method).alias("method"), F.lit(why).alias("reason"), a.alias("char_start"), b.alias("char_end"))
    found = F.col("base") + at - 1
    out = (
        F.when(F.coalesce("page_text", F.lit("")) == "", made("UNVERIFIED", "unverified", "source_unavailable"))
        .when((quote != "") & (piece == quote), made("VERIFIED", "exact", None, s, e))
        .when((quote != "") & (text.fold(piece) == folded), made("VERIFIED", "normalized_exact", None, s, e))
        .when((quote != "") & (at > 0) & (again == 0), made("VERIFIED", "recovered_exact", None, found, found + F.length(quote)))
        .when((quote != "") & (at > 0), made("UNVERIFIED", "unverified", "ambiguous_quote_match"))
        .when(F.length(F.trim(quote)) < least, made("UNVERIFIED", "unverified", "quote_not_found"))
        .when(hard, made("UNVERIFIED", "unverified", "numeric_token_mismatch"))
        .when(F.size(missing) > 0, made("UNVERIFIED", "unverified", "quote_not_found"))
    )
    if similarity is None:
        out = out.otherwise(made(None, None, "needs_fuzzy"))
    else:
        out = out.when(similarity >= threshold, made("PARTIAL", "fuzzy", None)).otherwise(made("UNVERIFIED", "unverified", "quote_not_found"))
    return rows.withColumn("_v", out)


FACT_NUMBERS = ["fact_type", "value_raw", "numeric_value", "currency", "magnitude", "unit_raw", "is_percentage"]


def verify(evidence: DataFrame, pages: DataFrame, chunks: DataFrame, facts: DataFrame | None = None, threshold: float = 90.0) -> DataFrame:
    """(id, fact_id, status, method, rederivation, fuzzy_score, reason, char_start, char_end): the whole ladder; only rows that reach the fuzzy rung go through Python.

    With ``facts``, numeric facts are held against the span that their quote was found in (``numeric_mismatch``), and
    facts without evidence come out too, with a null id (``unsupported_evidence``).
    """
    rows = ladder(sources(evidence, pages, chunks), threshold)
    fields = ["id", "fact_id", "page_text", "span"]
    keep = lambda d, score: d.select(*fields, "_v.status", "_v.method", "_v.reason", F.col("_v.char_start").alias("char_start"), F.col("_v.char_end").alias("char_end"), score.alias("fuzzy_score"))
    done = keep(rows.where("_v.reason is null or _v.reason <> 'needs_fuzzy'"), F.lit(None).cast("double"))
    last = rows.where("_v.reason = 'needs_fuzzy'").withColumn("score", fuzzy.best_partial(threshold)(text.fold(F.col("quote")), text.fold(F.col("span"))))
    hit = F.col("score") >= threshold
    none = F.lit(None).cast("int")
    ranked = last.select(*fields, F.when(hit, "PARTIAL").otherwise("UNVERIFIED").alias("status"), F.when(hit, "fuzzy").otherwise("unverified").alias("method"), F.when(~hit, "quote_not_found").alias("reason"), none.alias("char_start"), none.alias("char_end"), F.col("score").alias("fuzzy_score"))
    out = done.unionByName(ranked)
    not_asked = F.lit("not_applicable")
    columns = ["id", "fact_id", "status", "method", "rederivation", "fuzzy_score", "reason", "char_start", "char_end"]
    if facts is None:
        return out.withColumn("rederivation", not_asked).select(*columns)
    ratio = F.col("percentage_ratio") if "percentage_ratio" in facts.columns else F.lit(None).cast("double")
    out = out.join(facts.select(F.col("id").alias("fact_id"), *FACT_NUMBERS, ratio.alias("percentage_ratio")), "fact_id", "left")
    found = F.coalesce(F.when(F.col("method") != "fuzzy", _slice(F.col("char_start"), F.col("char_end"))), F.col("span"))
    c = F.col
    agrees = numeric_consistent(c("value_raw"), c("numeric_value"), c("currency"), c("magnitude"), c("unit_raw"), found, c("is_percentage"), c("percentage_ratio"))
    asked = (c("fact_type") == "numeric") & c("status").isin("VERIFIED", "PARTIAL")
    out = out.withColumn("rederivation", F.when(F.coalesce(asked, F.lit(False)), F.when(agrees, "success").otherwise("failed")).otherwise(not_asked))
    failed = c("rederivation") == "failed"
    out = out.withColumns({"status": F.when(failed, "UNVERIFIED").otherwise(c("status")), "reason": F.when(failed, "numeric_mismatch").otherwise(c("reason")), "char_start": F.when(~failed, c("char_start")), "char_end": F.when(~failed, c("char_end"))})
    bare = facts.join(evidence.select(F.col("fact_id").alias("id")), "id", "left_anti").select(F.lit(None).cast("long").alias("id"), F.col("id").alias("fact_id"), F.lit("UNVERIFIED").alias("status"), F.lit("unverified").alias("method"), not_asked.alias("rederivation"), F.lit(None).cast("double").alias("fuzzy_score"), F.lit("unsupported_evidence").alias("reason"), none.alias("char_start"), none.alias("char_end"))
    return out.select(*columns).unionByName(bare)


def numeric_consistent(value_raw: Column, numeric_value: Column, currency: Column, magnitude: Column, unit: Column, span: Column, is_pct: Column | None = None, ratio: Column | None = None, tolerance: float = 1e-6) -> Column:
    """Whether a numeric fact agrees with the span that it was verified on."""
    flat = text.fold(span)
    tokens = F.exists(text.salient_tokens(value_raw), lambda t: ~text.token_in_text(t, flat))
    digits = text.digits_of(value_raw)
    off = digits.isNotNull() & numeric_value.isNotNull() & (F.abs(numeric_value - digits) > tolerance)
    absent = lambda v, aliases: (F.coalesce(v, F.lit("")) != "") & ~text.alias_in_text(v, flat, aliases)
    no = F.lit(False)
    bad = [tokens, off, absent(currency, text.CURRENCY_ALIASES), absent(magnitude, text.MAGNITUDE_ALIASES), absent(unit, None)]
    if ratio is not None:
        bad.append(is_pct & (F.abs(ratio - numeric_value) > tolerance) & (F.abs(ratio - numeric_value / 100) > tolerance))
    return ~reduce(lambda x, y: x | y, [F.coalesce(b, no) for b in bad])
