"""The queries of this subpackage by name, over the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import components, containers, lookalikes, names, pieces, scans, tokens, truncation
from factloom.tables import cut, table


def p1_found(spark, folder):
    facts = table(spark, folder, "facts").where("subject_entity_id is null").withColumnRenamed("id", "fact_id")
    return names.link_names(facts, "fact_id", "subject_raw", table(spark, folder, "entities"), "id", "canonical_label")


def p2_found(spark, folder):
    judged = pieces.faulty_chunks(table(spark, folder, "chunks"), table(spark, folder, "pages"))
    return judged.where("too_long or misses_boundary or wrong_overlap or stops_early").select("chunk_id")


def p2_pieces(spark, folder):
    return pieces.cut_pieces(table(spark, folder, "pages"), "id", "text").withColumnRenamed("id", "page_id")


def p3_found(spark, folder):
    judged = lookalikes.quotes_on_pages(table(spark, folder, "evidence"), table(spark, folder, "pages"))
    return judged.where("looks_same and not as_written").select(F.col("quote_id").alias("evidence_id"))


def p3_pages(spark, folder):
    return lookalikes.one_form(table(spark, folder, "pages"), "id", "text").withColumnRenamed("id", "page_id")


def p4_found(spark, folder):
    return scans.read_scans(table(spark, folder, "pages")).found


def p4_pages(spark, folder):
    return scans.mended_pages(table(spark, folder, "pages"))


def p5_found(spark, folder):
    rows = table(spark, folder, "relationships").where("category = 'CORROBORATES'")
    groups = components.connected_groups(rows, "fact_a_id", "fact_b_id")
    return groups.withColumnRenamed("id", "fact_id")


def p7_ids(spark, folder):
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def _sizes(spark, folder, tokenizer):
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text", path=f"/opt/tokenizers/{tokenizer}.json", sizes_only=True)


def _classes(spark, folder):
    """The capacity classes, three rows at every scale."""
    return {r.class_id: r for r in table(spark, folder, "capacity_classes").orderBy("class_id").collect()}


def p8_containers(spark, folder):
    row = _classes(spark, folder)[2]
    return containers.fill(_sizes(spark, folder, row.tokenizer), "doc_id", "n_tokens", row.capacity)


def p8_fill(spark, folder):
    measured, reports = {}, []
    for row in _classes(spark, folder).values():
        if row.tokenizer not in measured:
            measured[row.tokenizer] = cut(_sizes(spark, folder, row.tokenizer))  # once a tokenizer, not once a class
        reports.append(containers.fill_report(containers.fill(measured[row.tokenizer], "doc_id", "n_tokens", row.capacity), row.capacity))
    return reduce(DataFrame.union, reports)


def _judged(spark, folder, column="text"):
    return truncation.cut_texts(table(spark, folder, "documents"), "doc_id", column, "source", prose=column == "text")


def p9_found(spark, folder):
    return _judged(spark, folder).where("is_cut").select("doc_id")


def p9_sources(spark, folder):
    shares = [truncation.cut_share(_judged(spark, folder, c)).select(F.lit(c).alias("column"), "*") for c in ("text", "title")]
    return shares[0].union(shares[1])


def p9_limits(spark, folder):
    return truncation.length_limits(table(spark, folder, "documents"), ["text", "title"], "source")


def queries() -> dict:
    return {"p1_found": p1_found, "p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_pages": p3_pages, "p4_found": p4_found, "p4_pages": p4_pages, "p5_found": p5_found, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_sources": p9_sources, "p9_limits": p9_limits}


def oracle_sql() -> dict:
    return {
        "p2_found": """
            with c as (
                select c.*, p.text page, c.char_offset + length(c.text) - coalesce(c.header_prefix_len, 0) stop
                from chunks c left join pages p on p.document_id = c.document_id and p.page_index = c.page_index),
            w as (
                select *, lag(stop) over o as before, row_number() over o = 1 as is_first, lead(id) over o is null as is_last
                from c window o as (partition by document_id, page_index order by seq, id))
            select id as chunk_id from w
            where length(text) > 1200
                or not is_last and right(text, 1) not in (' ', chr(10)) and regexp_matches(right(substring(text, header_prefix_len + 1), 200), '[ \n]')
                or not is_first and char_offset <> before - 150
                or is_last and stop < length(page)""",
        "p5_found": """
            with recursive link as (
                select fact_a_id a, fact_b_id b from relationships where category = 'CORROBORATES' and fact_a_id <> fact_b_id
                union select fact_b_id, fact_a_id from relationships where category = 'CORROBORATES' and fact_a_id <> fact_b_id),
            reach as (select a f, a g from link union select r.f, l.b from reach r join link l on l.a = r.g)
            select f as fact_id, min(g) as group_id from reach group by f""",
    }
