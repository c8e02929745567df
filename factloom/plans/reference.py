"""Queries of the fact pipeline's own operators over the whole tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import numbers, periods, text
from factloom.operators import candidates, grounding, records, resolve, retrieval, signals, stages, views
from factloom.sources import ingest
from factloom.tables import cut, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""select doc_id, sha256(text) as sha256, case when text is null then doc_id else min(doc_id) over (partition by sha256(text)) end as first_id,
       coalesce(doc_id > min(doc_id) over (partition by sha256(text)) and text is not null, false) as is_duplicate from documents""")
def doc_sha256_dedup(spark, d):
    return ingest.first_copies(table(spark, d, "documents"), "doc_id", "text")


@query("""with q as (select id as page_id, length(coalesce(text, '')) n, extraction_status = 'EXTRACTION_ERROR' bad from pages)
select page_id, case when bad then 'EXTRACTION_ERROR' when n = 0 then 'EMPTY' when n < 100 or round(n / (595.0::double * 842 / 1000), 3) < 0.35 then 'LOW_TEXT' else 'TEXT_EXTRACTED' end as status,
       case when bad then null when n = 0 then 0.0::double else round(n / (595.0::double * 842 / 1000), 3) end as density from q""")
def page_quality(spark, d):
    status, density = ingest.page_quality(F.length(F.coalesce("text", F.lit(""))), F.lit(595.0), F.lit(842.0), F.col("extraction_status") == "EXTRACTION_ERROR")
    return table(spark, d, "pages").select(F.col("id").alias("page_id"), status.alias("status"), density.cast("double").alias("density"))


@query("""select document_id, count(*) as n_pages, count(*) filter (extraction_status = 'TEXT_EXTRACTED') as n_text, count(*) filter (extraction_status = 'LOW_TEXT') as n_low,
       count(*) filter (extraction_status = 'EMPTY') as n_empty, count(*) filter (extraction_status = 'EXTRACTION_ERROR') as n_error from pages group by 1""")
def ingest_summary(spark, d):
    c = lambda s, n: F.count_if(F.col("extraction_status") == s).alias(n)
    return table(spark, d, "pages").groupBy("document_id").agg(F.count("*").alias("n_pages"), c("TEXT_EXTRACTED", "n_text"), c("LOW_TEXT", "n_low"), c("EMPTY", "n_empty"), c("EXTRACTION_ERROR", "n_error"))


@query(r"""with l as (select p.id, f.page_count, list_filter(list_transform(string_split(p.text, chr(10)), lambda x: trim(x)), lambda x: x <> '') l from pages p join source_files f on f.id = p.document_id),
e as (select id, greatest(page_count + 20, 50) most, unnest([l[-1], l[1]]) x, unnest([1, 2]) k from l),
r as (select *, case when regexp_full_match(x, '\d{1,4}') then x when regexp_full_match(x, '(?i)(?:page|p\.?)\s*\d{1,4}') then regexp_extract(x, '\d{1,4}$') end n,
      case when length(x) <= 6 and length(x) > 0 and regexp_full_match(x, '(?i)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})') then lower(x) end rom from e),
v as (select id, k, n is not null or rom is not null hit, case when n is not null then case when n::int <= most then n end else rom end label from r)
select id as page_id, case when max(case when k = 1 then hit::int end) = 1 then max(case when k = 1 then label end) else max(case when k = 2 then label end) end as label from v group by id""")
def printed_label(spark, d):
    files = table(spark, d, "source_files").select(F.col("id").alias("document_id"), "page_count")
    return table(spark, d, "pages").join(files, "document_id").select(F.col("id").alias("page_id"), ingest.printed_label(F.col("text"), F.col("page_count")).alias("label"))


@query(r"""with recursive w as (
  select id, text, length(text) n, 0 as pos, -1 as stop, 0 as seq from pages where length(text) > 0
  union all
  select id, text, n, case when pos + 1200 >= n then -1 else c - 150 end, case when pos + 1200 >= n then n else c end, seq + 1
  from (select *, pos + 1000 + case when k > 0 then k else 200 end c from (select *, length(regexp_replace(substring(text, pos + 1001, 200), '[^ \n]*$', '')) k from w where pos >= 0)))
select w.id as page_id, (w.seq - 1)::int as seq, p.pos as char_offset, w.stop as char_end from w join w p on p.id = w.id and p.seq = w.seq - 1 where w.seq > 0""")
def chunk_spans(spark, d):
    return table(spark, d, "pages").select(F.col("id").alias("page_id"), F.posexplode(ingest.chunk_spans(F.col("text"))).alias("seq", "s")).select("page_id", "seq", F.col("s.start").alias("char_offset"), F.col("s.stop").alias("char_end"))


@query("""select c.document_id, count(*) as n_chunks, count(*) filter (substring(p.text, c.char_offset + 1, length(c.text) - c.header_prefix_len) <> substring(c.text, c.header_prefix_len + 1)) as n_violations
from chunks c join pages p on p.document_id = c.document_id and p.page_index = c.page_index group by 1""")
def chunk_invariant(spark, d):
    pages = table(spark, d, "pages").select("document_id", "page_index", F.col("text").alias("page"))
    body = F.expr("substring(page, char_offset + 1, length(text) - header_prefix_len) <> substring(text, header_prefix_len + 1)")
    return table(spark, d, "chunks").join(pages, ["document_id", "page_index"]).groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if(body).alias("n_violations"))


NAMES_SQL = "substring(regexp_replace(trim(replace(coalesce(original_filename, ''), chr(92), '/')), '.*/', ''), 1, 255)"


@query(f"select id, case when {NAMES_SQL} in ('', '.', '..') then 'upload.pdf' else {NAMES_SQL} end as display_name from source_files")
def display_name(spark, d):
    return table(spark, d, "source_files").select("id", ingest.display_name(F.col("original_filename")).alias("display_name"))


@query("""with e as (select f.id, f.subject_raw, f.predicate, f.object_raw, f.fact_type, f.modality, f.reporting_period_type, f.value_raw, f.numeric_value, v.quote, v.char_start s, v.char_end e, v.chunk_id, length(p.text) n, v.id evidence_id
  from evidence v join facts f on f.id = v.fact_id join pages p on p.id = v.page_id),
r as (select *, case when trim(coalesce(subject_raw, '')) = '' then 'missing_subject' when trim(coalesce(predicate, '')) = '' then 'missing_predicate' when trim(coalesce(object_raw, '')) = '' then 'missing_object'
  when trim(coalesce(quote, '')) = '' then 'missing_quote' when fact_type is null or fact_type not in ('numeric', 'semantic', 'temporal', 'categorical') then 'invalid_fact_type'
  when modality not in ('ASSERTED', 'HISTORICAL', 'ESTIMATED', 'FORECAST', 'TARGET', 'UNCERTAIN') then 'invalid_modality'
  when reporting_period_type not in ('instant', 'quarter', 'half_year', 'fiscal_year', 'calendar_year', 'range', 'unknown') then 'invalid_period_type'
  when not coalesce(s >= 0 and s < e and e <= n, false) then 'invalid_offsets' when fact_type = 'numeric' and trim(coalesce(value_raw, '')) = '' and numeric_value is null then 'numeric_missing_value' end fault from e)
select evidence_id, case when fault is null and row_number() over (partition by chunk_id, fault is null, lower(trim(subject_raw)), lower(trim(predicate)), lower(trim(object_raw)), s, e order by evidence_id) > 1 then 'duplicate_in_chunk' else fault end as reject_reason from r""")
def candidate_validate(spark, d):
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), F.length("text").alias("n"))
    facts = table(spark, d, "facts").select(F.col("id").alias("fact_id"), "subject_raw", "predicate", "object_raw", "fact_type", "modality", "reporting_period_type", "value_raw", "numeric_value")
    rows = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), "fact_id", "page_id", "chunk_id", "quote", "char_start", "char_end").join(facts, "fact_id").join(pages, "page_id")
    names = {"subject": "subject_raw", "predicate": "predicate", "object": "object_raw", "quote": "quote", "fact_type": "fact_type", "modality": "modality", "period_type": "reporting_period_type", "char_start": "char_start", "char_end": "char_end", "value_raw": "value_raw", "numeric_value": "numeric_value"}
    return candidates.validate(rows, names, "chunk_id", "evidence_id", F.col("n")).select("evidence_id", "reject_reason")


@query("""select id as fact_id, lower(trim(predicate)) as predicate_norm, case when fact_type <> 'numeric' then object_raw end as value_text, coalesce(value_raw, object_raw) as value_out,
  case when coalesce(modality, '') = '' then 'ASSERTED' when lower(modality) = 'projected' then 'FORECAST' else modality end as modality_out from facts""")
def candidate_projection(spark, d):
    c = {k: F.col(v) for k, v in {"predicate": "predicate", "object": "object_raw", "fact_type": "fact_type", "value_raw": "value_raw", "modality": "modality"}.items()} | {"scope": F.lit(None).cast("string")}
    made = candidates.project(c)
    return table(spark, d, "facts").select(F.col("id").alias("fact_id"), made["predicate_norm"].alias("predicate_norm"), made["value_text"].alias("value_text"), made["value_raw"].alias("value_out"), made["modality"].alias("modality_out"))


@query("select id, concat_ws(' | ', title, publisher, nullif(disclosure_type, 'unknown'), publication_date::varchar, nullif(fy_convention, 'unknown')) as header from source_files")
def document_header(spark, d):
    known = lambda c: F.nullif(F.col(c), F.lit("unknown"))
    return table(spark, d, "source_files").select("id", F.concat_ws(" | ", "title", "publisher", known("disclosure_type"), F.col("publication_date").cast("string"), known("fy_convention")).alias("header"))


@query("""select id, trim(regexp_replace(translate(quote, '‘’‚‛“”„‟‐‑‒–—―−', '''''''''""' || '""-------'), '[\\s\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+', ' ', 'g')) as folded from evidence""")
def fold_text(spark, d):
    return table(spark, d, "evidence").select("id", text.fold(F.col("quote")).alias("folded"))


@query("""with t as (select id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) token from pages)
select token, count(*) as n_pages from t where length(token) > 1 and token not in ('a','an','and','as','at','by','for','from','in','of','on','or','per','the','to','with','s') group by token""")
def content_token_df(spark, d):
    return table(spark, d, "pages").select(F.explode(text.content_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n_pages"))


@query(r"""select id, list_sort(list_distinct(list_concat(regexp_extract_all(quote, '\d[\d,]*(?:\.\d+)?'), regexp_extract_all(quote, '[₹$€£]'), list_transform(regexp_extract_all(w, '(?i)\b(?:rs|inr|usd|eur|gbp)\b'), lambda x: lower(x)),
  case when regexp_matches(quote, '(?i)%|per\s?cent|percent') then ['%'] else [] end, list_transform(regexp_extract_all(w, '(?i)\b(?:crores?|cr|lakhs?|lac|millions?|mn|mln|billions?|bn|thousand|bps|basis\s+points?|tonnes?|tons?|units?|days?|sq\.?\s?ft)\b'), lambda x: lower(x))))) as tokens from (select id, quote, regexp_replace(quote, '[\x{c0}-\x{24f}\x{370}-\x{4ff}\x{ff21}-\x{ff5a}]', 'x', 'g') w from evidence)""")
def salient_tokens(spark, d):
    return table(spark, d, "evidence").select("id", F.array_sort(text.salient_tokens(F.col("quote"))).alias("tokens"))


@query(r"""with n as (select id, value_raw, trim(replace(value_raw, '−', '-')) s, regexp_extract_all(trim(replace(value_raw, '−', '-')), '\d[\d,]*(?:\.\d+)?') f from facts where fact_type = 'numeric'),
v as (select *, case when len(f) = 1 then (case when regexp_matches(s, '\(\s*[\d.,]+\s*\)') or starts_with(s, '-') then -1 else 1 end) * try_cast(replace(f[1], ',', '') as double) end val,
  regexp_matches(s, '(?i)\bbps\b|basis\s+points?') bps, regexp_matches(s, '(?i)%|per\s?cent|percent') pct from n),
m as (select *, case when val is null then null when bps then 'bps' when regexp_matches(s, '(?i)\bcrores?') then 'crore' when regexp_matches(s, '(?i)\bcr\b') then 'crore' when regexp_matches(s, '(?i)\blakhs?|lac\b') then 'lakh'
  when regexp_matches(s, '(?i)\bmillions?|mn\b|mln\b') then 'million' when regexp_matches(s, '(?i)\bbillions?|bn\b') then 'billion' when regexp_matches(s, '(?i)\btrillions?|tn\b') then 'trillion' when regexp_matches(s, '(?i)\bthousand') then 'thousand' end mag from v)
select id as fact_id, val as value, mag as magnitude, case when val is not null then bps or pct end as is_pct, case when bps then val / 10000 when pct then val / 100 else
  val * case mag when 'crore' then 1e7 when 'lakh' then 1e5 when 'million' then 1e6 when 'billion' then 1e9 when 'trillion' then 1e12 when 'thousand' then 1e3 else 1.0 end end as base from m""")
def parse_number_matrix(spark, d):
    n = numbers.parse_number(F.col("value_raw"))
    return table(spark, d, "facts").where("fact_type = 'numeric'").select(F.col("id").alias("fact_id"), *[n[k].alias(k) for k in ("value", "magnitude", "is_pct", "base")])


CURRENCY_SQL = r"case when regexp_matches({0}, '(?i)₹|\brs\b|\binr\b') then 'INR' when regexp_matches({0}, '(?i)\$|\busd\b') then 'USD' when regexp_matches({0}, '(?i)€|\beur\b') then 'EUR' when regexp_matches({0}, '(?i)£|\bgbp\b') then 'GBP' end"


@query(rf"""select id as fact_id, {CURRENCY_SQL.format("value_raw")} as currency_read, case when trim(unit_raw) = '' or unit_raw is null then null
  when regexp_matches(trim(lower(unit_raw)), '%|per\s?cent|percent|\bbps\b|basis\s+point|(?:^|\d)\s*x$') then 'ratio' when regexp_matches(lower(unit_raw), 'tonnes?|\btons?\b|\bmt\b') then 'tonne' when regexp_matches(lower(unit_raw), '\bdays?\b') then 'days'
  when regexp_matches(lower(unit_raw), 'sq\.?\s?(?:ft|feet|foot)|square\s+(?:feet|foot)') then 'sqft' else coalesce({CURRENCY_SQL.format("unit_raw")}, currency,
  case when regexp_matches(lower(unit_raw), 'shipments?|units?|pin[\s-]?codes?|customers?|employees?|gateways?|centres?|centers?|orders?|\bcount\b|number\s+of') then 'count' end) end as unit_read from facts where fact_type = 'numeric'""")
def parse_unit_matrix(spark, d):
    return table(spark, d, "facts").where("fact_type = 'numeric'").select(F.col("id").alias("fact_id"), numbers.parse_currency(F.col("value_raw")).alias("currency_read"), numbers.parse_unit(F.col("unit_raw"), F.col("currency")).alias("unit_read"))


@query("""with f as (select f.id, trim(coalesce(f.reporting_period_raw, '')) l, case s.fy_convention when 'jan-dec' then 1 when 'jul-jun' then 7 else 4 end m from facts f join source_files s on s.id = f.document_id),
y as (select *, case when regexp_full_match(l, '(Q[1-4] |H[12] )?FY[0-9]{2}') or regexp_full_match(l, '[0-9]{4}-[0-9]{2}') then 2000 + right(l, 2)::int end fy, try_strptime(regexp_extract(l, '[A-Z][a-z]+ [0-9]+, [0-9]{4}$'), '%B %d, %Y')::date d from f),
b as (select *, case when fy is not null then make_date(case when m = 1 then fy else fy - 1 end, m, 1) end fs from y),
k as (select *, case when l = '' then null when fy is not null and l[1] = 'Q' then 'quarter' when fy is not null and l[1] = 'H' then 'half_year' when fy is not null then 'fiscal_year' when regexp_full_match(l, '[0-9]{4}') then 'calendar_year'
  when d is not null and l like 'as on %' then 'instant' when d is not null and l like 'year ended %' then 'fiscal_year' when d is not null and l like 'nine months ended %' then 'range' else 'unknown' end t from b)
select id as fact_id, (case when t = 'quarter' then fs + to_months(3 * (l[2]::int - 1)) when t = 'half_year' then fs + to_months(6 * (l[2]::int - 1)) when fy is not null then fs when t = 'calendar_year' then make_date(l::int, 1, 1) when t = 'instant' then d
    when t = 'fiscal_year' then d + 1 - to_months(12) when t = 'range' then d + 1 - to_months(9) end)::date as period_start,
  (case when t = 'quarter' then fs + to_months(3 * l[2]::int) when t = 'half_year' then fs + to_months(6 * l[2]::int) when fy is not null then fs + to_months(12) when t = 'calendar_year' then make_date(l::int + 1, 1, 1) when d is not null then d + 1 end)::date as period_end, t as period_type from k""")
def parse_period_matrix(spark, d):
    files = table(spark, d, "source_files").select(F.col("id").alias("document_id"), "fy_convention")
    rows = table(spark, d, "facts").select(F.col("id").alias("fact_id"), "document_id", F.coalesce("reporting_period_raw", F.lit("")).alias("label")).join(files, "document_id")
    rows = rows.withColumn("convention", F.coalesce("fy_convention", F.lit("apr-mar")))
    read = rows.select("label", "convention").distinct().withColumn("p", periods.parse_period(F.col("label"), F.col("convention")))
    return rows.join(read, ["label", "convention"]).select("fact_id", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.type").alias("period_type"))


YEAR_SQL = "year (that )?(ended|ending|ends|end) (on )?(the )?([0-9]{1,2} ?(st|nd|rd|th)? )?([a-z]{3,})"


@query(rf"""with t as (select document_id, page_index, regexp_replace(lower(text), '\s+', ' ', 'g') x from pages),
h as (select document_id, page_index, nullif(regexp_extract(x, '(financial|fiscal) {YEAR_SQL}', 8), '') s, nullif(regexp_extract(x, 'year (ended|ending) (on )?([a-z]{{3,}}) [0-9]', 3), '') w from t),
m as (select document_id, coalesce(arg_min(s, page_index) filter (s is not null), arg_min(w, page_index) filter (w is not null)) mon from h group by 1),
c as (select document_id, case when mon in ('mar', 'march') then 'apr-mar' when mon in ('dec', 'december') then 'jan-dec' when mon in ('jun', 'june') then 'jul-jun' end conv from m)
select f.id as document_id, case when f.fy_convention in ('apr-mar', 'jan-dec', 'jul-jun') then f.fy_convention else coalesce(c.conv, 'apr-mar') end as convention,
  case when f.fy_convention in ('apr-mar', 'jan-dec', 'jul-jun') then 'override' when c.conv is not null then 'detected' else 'config_default' end as source from source_files f left join c on c.document_id = f.id""")
def detect_fy(spark, d):
    return stages.resolve_convention(table(spark, d, "source_files"), table(spark, d, "pages"))


LEGAL = "|".join(text.LEGAL_SUFFIXES)
HONOR = "|".join(text.HONORIFICS)
NAME_SQL = rf"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({{0}}), '[^\w\s&\x{{{{80}}}}-\x{{{{10ffff}}}}-]', ' ', 'g'), '\s+', ' ', 'g')), '(^| )(({LEGAL})( |$))*({LEGAL})$', ''), '^(({HONOR})( |$))+', ''))"
NAME_SQL = NAME_SQL.replace("{{", "{").replace("}}", "}")


@query(f"select id as entity_id, {NAME_SQL.replace('{0}', 'canonical_label')} as name_key, case when split_part(replace(trim(lower(canonical_label)), '.', ' '), ' ', 1) in ({', '.join(repr(h) for h in text.HONORIFICS)}) then 'person' else 'org' end as guessed from entities")
def normalize_name(spark, d):
    return table(spark, d, "entities").select(F.col("id").alias("entity_id"), text.normalize_name(F.col("canonical_label")).alias("name_key"), text.guess_type(F.col("canonical_label")).alias("guessed"))


@query(f"with k as (select id, {NAME_SQL.replace('{0}', 'canonical_label')} name_key from entities) select name_key, min(id) as entity_id, count(*) as n_entities from k where name_key <> '' group by 1")
def entity_exact_block(spark, d):
    return table(spark, d, "entities").select("id", text.normalize_name(F.col("canonical_label")).alias("name_key")).where("name_key <> ''").groupBy("name_key").agg(F.min("id").alias("entity_id"), F.count("*").alias("n_entities"))


@query()
def entity_fuzzy_block(spark, d):
    keys = table(spark, d, "entities").select(text.normalize_name(F.col("canonical_label")).alias("key"))
    return resolve.fuzzy_block(keys, keys).where("key < match")


@query()
def resolve_subjects(spark, d):
    return resolve.resolve(table(spark, d, "facts"), table(spark, d, "entities"))


@query("""with c as (select document_id, subject_entity_id e, count(*) n from facts where subject_entity_id is not null group by all), t as (select *, max(n) over (partition by document_id) top from c)
select document_id, min(e) as subject_entity_id, min(n) as n from t where n = top group by document_id having count(*) = 1""")
def dominant_entity(spark, d):
    return resolve.dominant(table(spark, d, "facts"), "document_id", "subject_entity_id")


@query("""select e.id as entity_id, count(f.id) as n_facts, count(distinct f.subject_raw) as n_surfaces from entities e left join facts f on f.subject_entity_id = e.id group by e.id""")
def entity_counts(spark, d):
    rows = table(spark, d, "facts").where("subject_entity_id is not null").groupBy("subject_entity_id", "subject_raw").agg(F.count("*").alias("n"))
    counts = rows.groupBy("subject_entity_id").agg(F.sum("n").alias("n_facts"), F.count("subject_raw").alias("n_surfaces"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "entities").select(F.col("id").alias("entity_id")).join(counts, F.col("entity_id") == F.col("subject_entity_id"), "left").select("entity_id", zero("n_facts"), zero("n_surfaces"))


@query("select subject_entity_id, id as fact_id, row_number() over (partition by subject_entity_id order by id) as n from facts where subject_entity_id is not null qualify n <= 10")
def entity_sample(spark, d):
    rows = table(spark, d, "facts").where("subject_entity_id is not null").select("subject_entity_id", F.col("id").alias("fact_id"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("subject_entity_id").orderBy("fact_id"))).where("n <= 10")


PAIR = """from relationships r join facts a on a.id = r.fact_a_id join facts b on b.id = r.fact_b_id"""


def _pairs(spark, d):
    return table(spark, d, "relationships").select(F.col("id").alias("relationship_id"), F.col("fact_a_id").alias("a"), F.col("fact_b_id").alias("b"))


@query(f"""with p as (select r.id relationship_id, a.reporting_period_start s1, a.reporting_period_end e1, a.reporting_period_type t1, b.reporting_period_start s2, b.reporting_period_end e2, b.reporting_period_type t2 {PAIR})
select relationship_id, case when t1 = 'unknown' or t2 = 'unknown' then 'unknown' when s1 is null or e1 is null or s2 is null or e2 is null then 'missing' when s1 = s2 and e1 = e2 then 'equal' when s1 <= s2 and e2 <= e1 or s2 <= s1 and e1 <= e2 then 'contains'
  when s1 < e2 and s2 < e1 then 'overlaps' when e1 = s2 or e2 = s1 then 'adjacent' when year(s1) = year(s2) then 'same_year' else 'disjoint' end as period_relation from p""")
def period_relation_pairs(spark, d):
    side = lambda s: {k: F.col(f"{s}.reporting_period_{k}") for k in ("start", "end", "type")}
    return signals.with_pair(_pairs(spark, d), table(spark, d, "facts")).select("relationship_id", periods.period_relation(side("fa"), side("fb")).alias("period_relation"))


@query(f"""with p as (select r.id relationship_id, a.scope x, b.scope y {PAIR}), k as (select *, list_intersect(map_keys(x), map_keys(y)) sh from p),
c as (select *, list_sort(list_filter(sh, lambda q: lower(trim(x[q])) <> lower(trim(y[q])))) conflict from k)
select relationship_id, case when x is null or y is null or cardinality(x) = 0 or cardinality(y) = 0 then 'missing' when len(conflict) > 0 or len(sh) = 0 then 'different' when len(sh) = greatest(cardinality(x), cardinality(y)) then 'same' else 'overlap' end as scope_relation,
  case when x is null or y is null or cardinality(x) = 0 or cardinality(y) = 0 then '' else coalesce(array_to_string(conflict, ','), '') end as conflict_keys from c""")
def scope_relation_pairs(spark, d):
    relation, conflict = signals.scope_relation(F.col("fa.scope"), F.col("fb.scope"))
    return signals.with_pair(_pairs(spark, d), table(spark, d, "facts")).select("relationship_id", relation.alias("scope_relation"), F.array_join(conflict, ",").alias("conflict_keys"))


REL = "case when coalesce(trim({0}), '') = '' or coalesce(trim({1}), '') = '' then 'missing' when lower(trim({0})) = lower(trim({1})) then 'same' else 'different' end"


@query(f"""with p as (select r.id relationship_id, a.base_value va, b.base_value vb, a.fact_type = 'numeric' and b.fact_type = 'numeric' and a.base_value is not null and b.base_value is not null comparable,
  coalesce(a.is_percentage, false) <> coalesce(b.is_percentage, false) pct, {REL.format("a.unit_raw", "b.unit_raw")} u, {REL.format("a.currency", "b.currency")} c {PAIR})
select relationship_id, comparable as numeric_comparable, case when comparable then abs(va - vb) end as base_value_abs_diff, case when comparable then va / nullif(vb, 0) end as base_value_ratio, case when comparable then case when greatest(abs(va), abs(vb)) = 0 then 0.0::double else round(abs(va - vb) / greatest(abs(va), abs(vb)), 6) end end as delta,
  case when comparable then (va >= 0) = (vb >= 0) end as sign_match, pct as pct_vs_abs, u as unit_relation, c as currency_relation, not pct and u <> 'different' and c <> 'different' as unit_equivalent from p""")
def numeric_signals(spark, d):
    side = lambda s: {"base": F.col(f"{s}.base_value"), "is_pct": F.col(f"{s}.is_percentage"), "unit": F.col(f"{s}.unit_raw"), "currency": F.col(f"{s}.currency"), "fact_type": F.col(f"{s}.fact_type")}
    made = signals.numeric_signals(side("fa"), side("fb"))
    return signals.with_pair(_pairs(spark, d), table(spark, d, "facts")).select("relationship_id", *[v.alias(k) for k, v in made.items()])


@query(f"""select r.id as relationship_id, abs(date_diff('day', x.publication_date, y.publication_date)) as gap_days {PAIR} left join source_files x on x.id = a.document_id left join source_files y on y.id = b.document_id""")
def publication_gap(spark, d):
    rows = signals.with_pair(_pairs(spark, d), table(spark, d, "facts"), table(spark, d, "source_files"))
    return rows.select("relationship_id", F.abs(F.date_diff("published_a", "published_b")).cast("long").alias("gap_days"))


@query()
def relationship_verdicts(spark, d):
    pairs = table(spark, d, "relationships").where("fact_a_id <> fact_b_id").select(F.least("fact_a_id", "fact_b_id").alias("a"), F.greatest("fact_a_id", "fact_b_id").alias("b")).distinct()
    return signals.reason(signals.signals(signals.with_pair(pairs, table(spark, d, "facts"), table(spark, d, "source_files"))))


@query()
def retrieve_pairs(spark, d):
    return retrieval.candidate_pairs(table(spark, d, "facts"))


VERDICT_SQL = """with o as (select o_orderkey k, o_custkey c, o_orderstatus st, o_totalprice v, date_trunc('quarter', o_orderdate)::date q from orders join customer on c_custkey = o_custkey),
p as (select *, lag(v) over w pv, lag(st) over w pst, lag(q) over w pq from o window w as (partition by c order by k)),
s as (select *, round(abs(v - pv) / greatest(abs(v), abs(pv)), 6) delta, case when q = pq then 'equal' when q + interval 3 month = pq or pq + interval 3 month = q then 'adjacent' when year(q) = year(pq) then 'same_year' else 'disjoint' end rel from p where pv is not null),
x as (select case when st <> pst then 'UNCERTAIN' when rel <> 'equal' and delta > 0.02 then 'TEMPORAL_EVOLUTION' when rel <> 'equal' then 'UNCERTAIN' when delta <= 0.02 then 'CORROBORATES' when delta > 0.15 then 'CONTRADICTS' else 'UNCERTAIN' end category,
  case when st <> pst then 'weak_predicate' when rel <> 'equal' and delta > 0.02 then 'temporal_numeric' when rel <> 'equal' then 'equal_across_periods' when delta <= 0.02 then 'numeric_equivalent' when delta > 0.15 then 'numeric_conflict' else 'numeric_borderline' end code from s)
select category, code, count(*) as n_pairs from x group by all"""


@query(VERDICT_SQL)
def verdict_categories(spark, d):
    """Order totals as numeric statements of customers by quarter, each against the customer's statement before it."""
    customer = table(spark, d, "customer").select("c_custkey")
    rows = table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.trunc(F.to_date("o_orderdate"), "quarter").alias("q"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = rows.withColumns({"pv": F.lag("o_totalprice").over(w), "ps": F.lag("o_orderstatus").over(w), "pq": F.lag("q").over(w)}).where("pv is not null")
    side = lambda v, q: {"base": F.col(v), "is_pct": F.lit(False), "unit": F.lit(None).cast("string"), "currency": F.lit(None).cast("string"), "fact_type": F.lit("numeric"), "start": F.col(q), "end": F.add_months(q, 3), "type": F.lit("quarter")}
    a, b = side("o_totalprice", "q"), side("pv", "pq")
    same = F.col("o_orderstatus") == F.col("ps")
    made = signals.numeric_signals(a, b) | {
        "entity_relation": F.lit("same"), "period_relation": periods.period_relation(a, b), "predicate_exact": same, "predicate_similarity": F.when(same, 1.0).otherwise(0.0), "predicate_jaccard": F.when(same, 1.0).otherwise(0.0),
        "types_differ": F.lit(False), "both_numeric": F.lit(True), "scope_conflict": F.array().cast("array<string>"), "modality_same": F.lit(True), "modality_comparable": F.lit(True), "objects_equal": F.lit(False),
    }
    v = rows.select(*[c.alias(k) for k, c in made.items()]).select(signals.verdict().alias("v"))
    return v.groupBy(F.col("v.category").alias("category"), F.col("v.code").alias("code")).agg(F.count("*").alias("n_pairs"))


GRID = """(select unnest(['CORROBORATES', 'CONTRADICTS', 'DIFFERENT_CONTEXT', 'UNCERTAIN']) proposal) cross join (select unnest(['same', 'different']) entity_relation) cross join (select unnest(['equal', 'adjacent', 'unknown', 'contains']) period_relation)
cross join (select unnest([0.0, 0.01, 0.1, 0.5]) delta) cross join (select unnest([true, false]) conflict) cross join (select unnest([true, false]) modality_comparable) cross join (select unnest([true, false]) sign_match)"""


@query(f"""select proposal, entity_relation, period_relation, delta::double as delta, conflict, modality_comparable, sign_match,
  case when entity_relation <> 'same' then 'UNCERTAIN' when proposal = 'CONTRADICTS' and delta <= 0.02 and period_relation = 'equal' and not conflict and sign_match then 'CORROBORATES' when proposal in ('CONTRADICTS', 'CORROBORATES') and conflict then 'DIFFERENT_CONTEXT'
  when proposal = 'CONTRADICTS' and period_relation = 'adjacent' and modality_comparable then 'TEMPORAL_EVOLUTION' when proposal = 'CONTRADICTS' and not modality_comparable then 'DIFFERENT_CONTEXT' when proposal = 'CORROBORATES' and delta > 0.15 then 'UNCERTAIN'
  when proposal in ('CONTRADICTS', 'CORROBORATES') and period_relation = 'unknown' then 'UNCERTAIN' else proposal end as category,
  case when entity_relation <> 'same' then 'downgraded' when proposal = 'CONTRADICTS' and delta <= 0.02 and period_relation = 'equal' and not conflict and sign_match then 'overridden' when proposal in ('CONTRADICTS', 'CORROBORATES') and conflict then 'overridden'
  when proposal = 'CONTRADICTS' and period_relation = 'adjacent' and modality_comparable then 'overridden' when proposal = 'CONTRADICTS' and not modality_comparable then 'downgraded' when proposal = 'CORROBORATES' and delta > 0.15 then 'downgraded'
  when proposal in ('CONTRADICTS', 'CORROBORATES') and period_relation = 'unknown' then 'downgraded' else 'accepted' end as action from {GRID}""")
def llm_guard_matrix(spark, d):
    values = {"proposal": ["CORROBORATES", "CONTRADICTS", "DIFFERENT_CONTEXT", "UNCERTAIN"], "entity_relation": ["same", "different"], "period_relation": ["equal", "adjacent", "unknown", "contains"], "delta": [0.0, 0.01, 0.1, 0.5], "conflict": [True, False], "modality_comparable": [True, False], "sign_match": [True, False]}
    rows = spark.range(1)
    for k, v in values.items():
        rows = rows.withColumn(k, F.explode(F.array(*map(F.lit, v))))
    rows = rows.withColumns({"numeric_comparable": F.lit(True), "unit_equivalent": F.lit(True), "scope_conflict": F.when(F.col("conflict"), F.array(F.lit("basis"))).otherwise(F.array().cast("array<string>"))})
    return rows.select(*values, signals.guard(F.col("proposal"))["category"].alias("category"), signals.guard(F.col("proposal"))["action"].alias("action"))


@query("""select least(fact_a_id, fact_b_id) as a, greatest(fact_a_id, fact_b_id) as b, min(id) as id, arg_min(coalesce(category, '~'), id) as category, count(*) as n_rows from relationships where fact_a_id <> fact_b_id group by 1, 2""")
def relationship_first_write(spark, d):
    return views.first_write(table(spark, d, "relationships").withColumn("category", F.coalesce("category", F.lit("~")))).drop("confidence")


@query("select id, document_id, predicate, value_raw from facts where (predicate ilike '%cost%' or predicate_norm ilike '%cost%') and fact_type = 'numeric' and reasoning_eligible order by id desc limit 50 offset 20")
def list_facts_page(spark, d):
    found = views.fact_filter(table(spark, d, "facts"), predicate="cost", fact_type="numeric", eligible=True, lifecycle="NO_SUCH_STATE")
    return views.page_of(found.select("id", "document_id", "predicate", "value_raw"), [F.desc("id")], 50, 20)


@query("select id as fact_id from facts where " + " or ".join(f"contains(' ' || array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+'), ' ') || ' ', ' net worth ')" for c in ("subject_raw", "predicate", "object_raw", "value_raw")))
def fts_phrase(spark, d):
    return views.fact_filter(table(spark, d, "facts"), q="Net  worth").select(F.col("id").alias("fact_id"))


@query("""with f as (select f.id from facts f join source_files s on s.id = f.document_id where s.disclosure_type = 'annual_report') select id as relationship_id, category, confidence from relationships where fact_a_id in (select id from f) or fact_b_id in (select id from f)""")
def either_side_semi(spark, d):
    files = table(spark, d, "source_files").where("disclosure_type = 'annual_report'").select(F.col("id").alias("document_id"))
    facts = table(spark, d, "facts").join(files, "document_id", "left_semi").select("id")
    return views.either_side(table(spark, d, "relationships"), facts).select(F.col("id").alias("relationship_id"), "category", "confidence")


@query("select id, category, confidence from relationships where category in ('CONTRADICTS', 'TEMPORAL_EVOLUTION') and confidence >= 0.6 and not llm_used and validation_action = 'accepted'")
def relationship_filter(spark, d):
    return table(spark, d, "relationships").where("category in ('CONTRADICTS', 'TEMPORAL_EVOLUTION') and confidence >= 0.6 and not llm_used and validation_action = 'accepted'").select("id", "category", "confidence")


@query("""select e.id as evidence_id, p.id is not null as has_page, s.id is not null as has_document, c.id is not null as has_chunk, p.id is not null and s.id is not null and (e.chunk_id is null or c.id is not null) as intact
from evidence e left join pages p on p.document_id = e.document_id and p.page_index = e.page_index left join source_files s on s.id = p.document_id left join chunks c on c.id = e.chunk_id and c.document_id = e.document_id and c.page_index = e.page_index""")
def evidence_chain(spark, d):
    key = ["document_id", "page_index"]
    rows = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), *key, "chunk_id")
    pages = table(spark, d, "pages").select(*key, F.lit(True).alias("p"))
    files = table(spark, d, "source_files").select(F.col("id").alias("document_id"), F.lit(True).alias("s"))
    chunks = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), *key, F.lit(True).alias("c"))
    rows = rows.join(pages, key, "left").join(files, "document_id", "left").join(chunks, [*key, "chunk_id"], "left")
    yes = lambda c: F.col(c).isNotNull()
    return rows.select("evidence_id", yes("p").alias("has_page"), (yes("p") & yes("s")).alias("has_document"), yes("c").alias("has_chunk"), (yes("p") & yes("s") & (F.col("chunk_id").isNull() | yes("c"))).alias("intact"))


@query("""select 'eligible_without_evidence' as rule, count(*) as n from facts f where reasoning_eligible and not exists (select 1 from evidence e where e.fact_id = f.id)
union all select 'quarantined_but_eligible', count(*) from facts where lifecycle_state = 'QUARANTINED' and reasoning_eligible
union all select 'eligible_but_unverified', count(*) from facts where reasoning_eligible and evidence_status = 'UNVERIFIED'
union all select 'self_pair', count(*) from relationships where fact_a_id = fact_b_id
union all select 'pair_out_of_order', count(*) from relationships where fact_a_id > fact_b_id
union all select 'evidence_repeated', count(*) from (select fact_id from evidence group by 1 having count(*) > 1)
union all select 'ineligible_in_relationship', count(*) from (select distinct r.id from relationships r join facts f on f.id in (r.fact_a_id, r.fact_b_id) where not f.reasoning_eligible)""")
def invariants(spark, d):
    facts, evidence, rel = (table(spark, d, n) for n in ("facts", "evidence", "relationships"))
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    bad = facts.where("not reasoning_eligible").select("id")
    found = [
        count("eligible_without_evidence", facts.where("reasoning_eligible").join(evidence, facts["id"] == evidence["fact_id"], "left_anti")),
        count("quarantined_but_eligible", facts.where("lifecycle_state = 'QUARANTINED' and reasoning_eligible")),
        count("eligible_but_unverified", facts.where("reasoning_eligible and evidence_status = 'UNVERIFIED'")),
        count("self_pair", rel.where("fact_a_id = fact_b_id")), count("pair_out_of_order", rel.where("fact_a_id > fact_b_id")),
        count("evidence_repeated", evidence.groupBy("fact_id").agg(F.count("*").alias("c")).where("c > 1")),
        count("ineligible_in_relationship", views.either_side(rel, bad)),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


@query("""with p as (select document_id, count(*) n from pages group by 1), c as (select document_id, count(*) n from chunks group by 1), f as (select document_id, count(*) n, count(*) filter (reasoning_eligible) e, count(*) filter (evidence_status = 'UNVERIFIED') u, count(*) filter (lifecycle_state = 'QUARANTINED') q from facts group by 1),
r as (select f.document_id, count(distinct r.id) n from relationships r join facts f on f.id in (r.fact_a_id, r.fact_b_id) group by 1)
select s.id as document_id, coalesce(p.n, 0) as n_pages, coalesce(c.n, 0) as n_chunks, coalesce(f.n, 0) as n_facts, coalesce(f.e, 0) as n_eligible, coalesce(f.u, 0) as n_unverified, coalesce(f.q, 0) as n_quarantined, coalesce(r.n, 0) as n_relationships
from source_files s left join p on p.document_id = s.id left join c on c.document_id = s.id left join f on f.document_id = s.id left join r on r.document_id = s.id""")
def doc_counts_bundle(spark, d):
    facts = table(spark, d, "facts")
    n = F.count("*")
    parts = [
        table(spark, d, "pages").groupBy("document_id").agg(n.alias("n_pages")), table(spark, d, "chunks").groupBy("document_id").agg(n.alias("n_chunks")),
        facts.groupBy("document_id").agg(n.alias("n_facts"), F.count_if("reasoning_eligible").alias("n_eligible"), F.count_if(F.col("evidence_status") == "UNVERIFIED").alias("n_unverified"), F.count_if(F.col("lifecycle_state") == "QUARANTINED").alias("n_quarantined")),
    ]
    ends = table(spark, d, "relationships").select("id", F.explode(F.array_distinct(F.array("fact_a_id", "fact_b_id"))).alias("fact"))
    at = ends.join(facts.select(F.col("id").alias("fact"), "document_id"), "fact").select("document_id", "id").distinct()
    parts.append(at.groupBy("document_id").agg(n.alias("n_relationships")))
    out = table(spark, d, "source_files").select(F.col("id").alias("document_id"))
    for x in parts:
        out = out.join(x, "document_id", "left")
    return out.na.fill(0)


@query("select document_id, max(run_id) as run_id, arg_max(lifecycle_state, (run_id, id)) as last_state, count(distinct run_id) as n_runs from facts group by 1")
def latest_run(spark, d):
    runs = table(spark, d, "facts").groupBy("document_id", "run_id").agg(F.max_by("lifecycle_state", "id").alias("state"))
    return runs.groupBy("document_id").agg(F.max("run_id").alias("run_id"), F.max_by("state", "run_id").alias("last_state"), F.count("run_id").alias("n_runs"))


@query("""with m as (select user_id, event_type = 'error' bad, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by ts, event_id) run from events), r as (select user_id, run, count(*) filter (bad) n from m group by all)
select user_id, max(n) as longest_run, max(n) >= 5 as aborted from r group by 1""")
def consecutive_errors(spark, d):
    return candidates.error_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


@query("select document_id, id as chunk_id, row_number() over (partition by document_id order by page_index, seq, id) as call_no from chunks qualify call_no <= 800")
def call_budget(spark, d):
    return candidates.within_budget(table(spark, d, "chunks").select("document_id", F.col("id").alias("chunk_id"), "page_index", "seq"), "document_id", ["page_index", "seq", "chunk_id"]).select("document_id", "chunk_id", "call_no")


@query("select verification_method, count(*) as n from evidence where evidence_status <> 'VERIFIED' group by 1 order by n desc, verification_method limit 3")
def failure_reasons_top3(spark, d):
    return table(spark, d, "evidence").where("evidence_status <> 'VERIFIED'").groupBy("verification_method").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verification_method").limit(3)


@query("""select e.id as evidence_id, substring(p.text, greatest(e.char_start - 200, 0) + 1, least(e.char_end + 200, length(p.text)) - greatest(e.char_start - 200, 0)) as context from evidence e join pages p on p.id = e.page_id where e.char_start >= 0 and e.char_start < e.char_end and e.char_end <= length(p.text)""")
def context_window(spark, d):
    pages = table(spark, d, "pages").select(F.col("id").alias("page_id"), "text")
    rows = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), "page_id", "char_start", "char_end").join(pages, "page_id").where("char_start >= 0 and char_start < char_end and char_end <= length(text)")
    low = F.greatest(F.col("char_start") - 200, F.lit(0))
    return rows.select("evidence_id", F.substring("text", low + 1, F.least(F.col("char_end") + 200, F.length("text")) - low).alias("context"))


@query("""select failure_type, document_id, count(*) as n from (select case when extraction_status = 'EXTRACTION_ERROR' then 'run_error' else 'ocr_page' end failure_type, document_id from pages where extraction_status <> 'TEXT_EXTRACTED'
union all select 'grounding_failed', document_id from facts where lifecycle_state = 'QUARANTINED' union all select 'entity_ambiguous', document_id from facts where subject_entity_id is null
union all select 'relationship_uncertain', f.document_id from relationships r join facts f on f.id = r.fact_a_id where r.category = 'UNCERTAIN') group by all""")
def failure_union_counts(spark, d):
    facts = table(spark, d, "facts")
    made = lambda rows, name: rows.select(name.alias("failure_type"), "document_id")
    uncertain = table(spark, d, "relationships").where("category = 'UNCERTAIN'").select(F.col("fact_a_id").alias("id")).join(facts.select("id", "document_id"), "id")
    out = made(table(spark, d, "pages").where("extraction_status <> 'TEXT_EXTRACTED'"), F.when(F.col("extraction_status") == "EXTRACTION_ERROR", "run_error").otherwise("ocr_page"))
    out = out.union(made(facts.where("lifecycle_state = 'QUARANTINED'"), F.lit("grounding_failed"))).union(made(facts.where("subject_entity_id is null"), F.lit("entity_ambiguous"))).union(made(uncertain, F.lit("relationship_uncertain")))
    return out.groupBy("failure_type", "document_id").agg(F.count("*").alias("n"))


@query("select document_id, sum((length(text) + 3) // 4)::bigint as tokens_in, round(sum((length(text) + 3) // 4) * 0.0000003::double + count(*) * 200 * 0.0000025::double, 6) as cost from chunks group by 1")
def cost_estimate(spark, d):
    tokens = F.sum(F.floor((F.length("text") + 3) / 4))
    return table(spark, d, "chunks").groupBy("document_id").agg(tokens.alias("tokens_in"), F.round(tokens * 3e-7 + F.count("*") * 200 * 2.5e-6, 6).alias("cost"))


@query(f"""with p as (select abs(a.base_value - b.base_value) / nullif(greatest(abs(a.base_value), abs(b.base_value)), 0) delta {PAIR} where a.base_value is not null and b.base_value is not null), c as (select unnest(['strict', 'default', 'loose', 'very_loose']) config, unnest([0.005, 0.02, 0.05, 0.1])::double tol, unnest([0.05, 0.15, 0.3, 0.5])::double con)
select config, count(*) filter (delta <= tol) as n_agree, count(*) filter (delta > con) as n_conflict, count(*) filter (delta > tol and delta <= con) as n_between from p cross join c group by 1""")
def sweep_configs(spark, d):
    configs = [("strict", 0.005, 0.05), ("default", 0.02, 0.15), ("loose", 0.05, 0.3), ("very_loose", 0.1, 0.5)]
    rows = signals.with_pair(_pairs(spark, d), table(spark, d, "facts")).where("fa.base_value is not null and fb.base_value is not null")
    delta = F.abs(F.col("fa.base_value") - F.col("fb.base_value")) / F.nullif(F.greatest(F.abs("fa.base_value"), F.abs("fb.base_value")), F.lit(0.0))
    grid = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(t).alias("tol"), F.lit(c).alias("con")) for n, t, c in configs])
    rows = rows.select(delta.alias("delta"), F.inline(grid))
    return rows.groupBy("config").agg(F.count_if(F.col("delta") <= F.col("tol")).alias("n_agree"), F.count_if(F.col("delta") > F.col("con")).alias("n_conflict"), F.count_if((F.col("delta") > F.col("tol")) & (F.col("delta") <= F.col("con"))).alias("n_between"))


@query("select coalesce(category, '') as category, coalesce(context_dimension, '') as dimension, validation_action, count(*) as n, round(avg(confidence), 6) as mean_confidence from relationships group by all")
def pair_histogram(spark, d):
    none = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "relationships").groupBy(none("category").alias("category"), none("context_dimension").alias("dimension"), "validation_action").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("""with e as (select unnest([fact_a_id, fact_b_id]) f from relationships where fact_a_id <> fact_b_id), c as (select f, count(*) n from e group by 1) select min(n) as least, list_sort(list(n))[(count(*) // 2 + 1)::int] as median, max(n) as most from c""")
def pairs_per_fact(spark, d):
    ends = table(spark, d, "relationships").where("fact_a_id <> fact_b_id").select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("f"))
    by_count = ends.groupBy("f").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    # a histogram: as many rows as there are different counts
    run = by_count.withColumn("upto", F.sum("c").over(Window.orderBy("n"))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    return run.agg(F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.max("n").alias("most"))


@query("""select f.id as fact_id, case when f.lifecycle_state = 'QUARANTINED' or f.evidence_status = 'UNVERIFIED' and e.n > 0 then 'QUARANTINED' when f.evidence_status = 'UNVERIFIED' then 'CANDIDATE' when f.fact_type = 'numeric' and f.base_value is null and f.numeric_value is null then 'GROUNDED'
  when f.subject_entity_id is null then 'NORMALIZED' else 'ELIGIBLE_FOR_REASONING' end as derived_state from facts f left join (select fact_id, count(*) n from evidence group by 1) e on e.fact_id = f.id""")
def lifecycle_derived(spark, d):
    n = table(spark, d, "evidence").groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("n"))
    c = F.col
    unverified = c("evidence_status") == "UNVERIFIED"
    state = F.when((c("lifecycle_state") == "QUARANTINED") | (unverified & (F.coalesce("n", F.lit(0)) > 0)), "QUARANTINED").when(unverified, "CANDIDATE").when((c("fact_type") == "numeric") & c("base_value").isNull() & c("numeric_value").isNull(), "GROUNDED").when(c("subject_entity_id").isNull(), "NORMALIZED").otherwise("ELIGIBLE_FOR_REASONING")
    return table(spark, d, "facts").join(n, "id", "left").select(F.col("id").alias("fact_id"), state.alias("derived_state"))


@query("select run_id, count(*) as examined, count(*) filter (evidence_status = 'VERIFIED') as verified, count(*) filter (evidence_status = 'PARTIAL') as partial, count(*) filter (lifecycle_state = 'QUARANTINED') as quarantined, count(*) filter (reasoning_eligible) as eligible from facts group by 1")
def stage_summary(spark, d):
    n = lambda c, name: F.count_if(c).alias(name)
    return table(spark, d, "facts").groupBy("run_id").agg(F.count("*").alias("examined"), n(F.col("evidence_status") == "VERIFIED", "verified"), n(F.col("evidence_status") == "PARTIAL", "partial"), n(F.col("lifecycle_state") == "QUARANTINED", "quarantined"), n(F.col("reasoning_eligible"), "eligible"))


@query("""with f as (select id, subject_raw from facts where subject_raw ilike '%textiles%' union select f.id, f.subject_raw from facts f join entities e on e.id = f.subject_entity_id where e.canonical_label ilike '%textiles%') select id as fact_id, subject_raw from f""")
def entity_search(spark, d):
    facts = table(spark, d, "facts")
    labelled = table(spark, d, "entities").where(views.contains(F.col("canonical_label"), "textiles")).select(F.col("id").alias("subject_entity_id"))
    by_name = facts.where(views.contains(F.col("subject_raw"), "textiles")).select(F.col("id").alias("fact_id"), "subject_raw")
    return by_name.union(facts.join(labelled, "subject_entity_id", "left_semi").select(F.col("id").alias("fact_id"), "subject_raw")).distinct()


@query("""with e as (select fact_id, arg_min(quote, id) quote, arg_min(coalesce(verification_method, ''), id) verification_method from evidence group by 1), p as (select document_id, page_index, arg_min(printed_label, id) filter (printed_label is not null) printed_label from pages group by all)
select f.id, coalesce(s.title, s.original_filename) as document_title, p.printed_label, n.canonical_label as entity_label, case when f.fact_type = 'numeric' then f.value_raw end as value_raw, f.reporting_period_start as period_start, e.quote, e.verification_method, f.extraction_model
from facts f left join e on e.fact_id = f.id left join entities n on n.id = f.subject_entity_id left join source_files s on s.id = f.document_id left join p on p.document_id = f.document_id and p.page_index = f.page_index""")
def facts_out(spark, d):
    names = ("facts", "evidence", "entities", "source_files", "pages")
    rows = views.facts_out(*(table(spark, d, n) for n in names))
    return rows.select("id", F.col("document.title").alias("document_title"), "printed_label", F.col("entity.canonical_label").alias("entity_label"), F.col("numeric.value_raw").alias("value_raw"), F.col("reporting_period.start").alias("period_start"), F.col("evidence.quote").alias("quote"), F.when(F.col("evidence").isNotNull(), F.coalesce("evidence.verification_method", F.lit(""))).alias("verification_method"), F.col("repro.extraction_model").alias("extraction_model"))


@query(f"""select r.id as relationship_id, case category when 'CORROBORATES' then 'Corroborates' when 'CONTRADICTS' then 'Contradicts' when 'DIFFERENT_CONTEXT' then 'Different context' when 'TEMPORAL_EVOLUTION' then 'Temporal evolution' when 'UNCERTAIN' then 'Uncertain' end as category_label,
  a.predicate as predicate_a, b.predicate as predicate_b {PAIR} where category in ('CONTRADICTS', 'UNCERTAIN') and confidence >= 0.3 order by confidence desc nulls last, r.id desc limit 200""")
def relationships_out(spark, d):
    rel = table(spark, d, "relationships").where("category in ('CONTRADICTS', 'UNCERTAIN')")
    page = views.page_of(views.relationship_filter(rel, least=0.3), [F.desc_nulls_last("confidence"), F.desc("id")], 200)
    rows = views.relationships_out(page, table(spark, d, "facts").select("id", "predicate"))
    return rows.select(F.col("id").alias("relationship_id"), "category_label", F.col("fact_a.predicate").alias("predicate_a"), F.col("fact_b.predicate").alias("predicate_b"))


@query("""with p as (select document_id, count(*) n from pages group by 1), f as (select document_id, count(*) n, count(*) filter (evidence_status = 'UNVERIFIED') u, count(*) filter (lifecycle_state = 'QUARANTINED') q, count(*) filter (lifecycle_state = 'ELIGIBLE_FOR_REASONING') e from facts group by 1),
t as (select distinct f.document_id, r.id, coalesce(r.category, '') category from relationships r join facts f on f.id in (r.fact_a_id, r.fact_b_id)), c as (select document_id, category, count(*) n from t group by all), k as (select document_id, sum(n) n, string_agg(category || '=' || n, ',' order by category) mix from c group by 1)
select s.id as document_id, s.status, coalesce(p.n, 0) as pages, coalesce(f.n, 0) as facts, coalesce(f.u, 0) as facts_unverified, coalesce(f.q, 0) as facts_quarantined, coalesce(f.e, 0) as eligible_facts, coalesce(k.n, 0)::bigint as relationships, coalesce(k.mix, '') as mix
from source_files s left join p on p.document_id = s.id left join f on f.document_id = s.id left join k on k.document_id = s.id""")
def documents_out(spark, d):
    rows = views.documents_out(*(table(spark, d, n) for n in ("source_files", "pages", "facts", "relationships")))
    mix = F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("document_id", "status", "pages", "facts", "facts_unverified", "facts_quarantined", "eligible_facts", "relationships", mix.alias("mix"))


RUNS_SQL = "select document_id, run_id as id, case when right(run_id::varchar, 1) in ('0', '3', '6', '9') then 'full' else 'extract' end as run_type, count(*) as n_facts from facts where run_id is not null group by all"


@query(f"""with r as ({RUNS_SQL}), t as (select *, row_number() over (partition by document_id order by run_type = 'full' desc, id desc) k from r)
select s.id as document_id, s.status, t.id as run_id, t.run_type from source_files s left join t on t.document_id = s.id and k = 1""")
def status_out(spark, d):
    kind = F.when(F.right(F.col("run_id").cast("string"), F.lit(1)).isin("0", "3", "6", "9"), "full").otherwise("extract")
    runs = table(spark, d, "facts").where("run_id is not null").groupBy("document_id", F.col("run_id").alias("id"), kind.alias("run_type")).agg(F.count("*").alias("n_facts"))
    return views.status_out(table(spark, d, "source_files"), runs).select("document_id", "status", F.col("run.id").alias("run_id"), F.col("run.run_type").alias("run_type"))


@query("select e.id as entity_id, e.canonical_label, e.entity_type, coalesce(f.n, 0) as fact_count, coalesce(a.n, 0) as alias_count from entities e left join (select subject_entity_id i, count(*) n from facts group by 1) f on f.i = e.id left join (select subject_entity_id i, count(distinct trim(subject_raw)) n from facts group by 1) a on a.i = e.id where e.entity_type = 'org' and e.canonical_label ilike '%power%'")
def entities_out(spark, d):
    facts = table(spark, d, "facts")
    names = facts.where("subject_entity_id is not null and subject_raw is not null").select(F.col("subject_entity_id").alias("entity_id"), F.trim("subject_raw").alias("surface")).distinct()
    rows = views.entities_out(table(spark, d, "entities"), facts, names).where((F.col("entity_type") == "org") & views.contains(F.col("canonical_label"), "power"))
    return rows.select(F.col("id").alias("entity_id"), "canonical_label", "entity_type", "fact_count", "alias_count")


@query("""select 'documents' as measure, count(*) as n from source_files union all select 'facts', count(*) from facts union all select 'eligible facts', count(*) from facts where reasoning_eligible union all select 'entities', count(*) from entities
union all select 'relationships', count(*) from relationships union all select coalesce(category, 'none'), count(*) from relationships group by 1""")
def overview(spark, d):
    return views.overview(*(table(spark, d, n) for n in ("source_files", "facts", "relationships", "entities")))


@query("""with f as (select f.*, s.id is null no_file, p.document_id is null no_page from facts f left join source_files s on s.id = f.document_id left join (select distinct document_id, page_index from pages) p on p.document_id = f.document_id and p.page_index = f.page_index)
select id, case when no_file then 'unknown_document' when no_page then 'page_not_in_document' when fact_type is null or fact_type not in ('numeric', 'semantic', 'temporal', 'categorical') then 'invalid_fact_type'
  when modality not in ('ASSERTED', 'HISTORICAL', 'ESTIMATED', 'FORECAST', 'TARGET', 'UNCERTAIN') then 'invalid_modality' when fact_type = 'numeric' and value_raw is null and numeric_value is null then 'numeric_missing_value' end as fault from f""")
def fact_faults(spark, d):
    return records.fact_faults(*(table(spark, d, n) for n in ("facts", "source_files", "pages")))


@query("""with p as (select document_id, page_index, min(id) id, arg_min(length(text), id) n from pages group by 1, 2),
e as (select e.*, row_number() over (partition by fact_id order by id) rank from evidence e)
select e.id, case when f.id is null then 'unknown_fact' when rank > 1 then 'evidence_exists' when f.document_id <> e.document_id then 'evidence_document_mismatch' when p.id is null then 'page_not_in_document' when e.page_id <> p.id then 'page_id_mismatch'
  when e.chunk_id is not null and c.id is null then 'unknown_chunk' when e.chunk_id is not null and not (c.document_id = e.document_id and c.page_index = e.page_index) then 'chunk_not_in_page'
  when not (e.char_start is null and e.char_end is null or coalesce(e.char_start >= 0 and e.char_start < e.char_end and e.char_end <= p.n, false)) then 'invalid_offsets' end as fault
from e left join facts f on f.id = e.fact_id left join p on p.document_id = e.document_id and p.page_index = e.page_index left join chunks c on c.id = e.chunk_id""")
def evidence_faults(spark, d):
    return records.evidence_faults(*(table(spark, d, n) for n in ("evidence", "facts", "pages", "chunks")))


@query("""with r as (select r.id, least(fact_a_id, fact_b_id) a, greatest(fact_a_id, fact_b_id) b from relationships r)
select r.id, case when r.a = r.b then 'self_relationship' when x.id is null or y.id is null then 'unknown_fact' when not (coalesce(x.reasoning_eligible, false) and coalesce(y.reasoning_eligible, false)) then 'not_reasoning_eligible' end as fault
from r left join facts x on x.id = r.a left join facts y on y.id = r.b""")
def relationship_faults(spark, d):
    return records.relationship_faults(table(spark, d, "relationships").select("id", "fact_a_id", "fact_b_id"), table(spark, d, "facts")).select("id", "fault")


@query("""with r as (select id, least(fact_a_id, fact_b_id) a, greatest(fact_a_id, fact_b_id) b from relationships),
s as (select id, case when lifecycle_state <> 'ELIGIBLE_FOR_REASONING' or not coalesce(reasoning_eligible, false) then 'fact_not_eligible' when evidence_status = 'UNVERIFIED' then 'fact_unverified' else '' end f from facts)
select r.id, coalesce(nullif(coalesce(x.f, 'unknown_fact'), ''), nullif(coalesce(y.f, 'unknown_fact'), '')) as reason from r left join s x on x.id = r.a left join s y on y.id = r.b where x.f <> '' or y.f <> '' or x.f is null or y.f is null""")
def pair_guard(spark, d):
    pairs = table(spark, d, "relationships").select("id", F.least("fact_a_id", "fact_b_id").alias("a"), F.greatest("fact_a_id", "fact_b_id").alias("b"))
    return signals.guard_pairs(pairs, table(spark, d, "facts"))[1].select("id", "reason")


@query("""with e as (select fact_id, arg_min(document_id, id) document_id, arg_min(page_index, id) page_index, arg_min(coalesce(chunk_id, -1), id) chunk_id from evidence group by 1),
c as (select e.fact_id from e join (select distinct document_id, page_index from pages) p using (document_id, page_index) join source_files s on s.id = e.document_id left join chunks k on k.id = e.chunk_id and k.document_id = e.document_id and k.page_index = e.page_index where e.chunk_id = -1 or k.id is not null)
select f.id, case when lifecycle_state = 'QUARANTINED' then 'fact_quarantined' when c.fact_id is null then 'evidence_required' when coalesce(evidence_status, '') not in ('VERIFIED', 'PARTIAL') then 'evidence_unverified' end as fault,
  case when lifecycle_state in ('NORMALIZED', 'ELIGIBLE_FOR_REASONING') and c.fact_id is not null and evidence_status in ('VERIFIED', 'PARTIAL') then 'ELIGIBLE_FOR_REASONING' else lifecycle_state end as lifecycle_state from facts f left join c on c.fact_id = f.id""")
def promotion(spark, d):
    facts, evidence, files, pages, chunks = (table(spark, d, n) for n in ("facts", "evidence", "source_files", "pages", "chunks"))
    done = records.promote(facts, records.chains(facts, evidence, files, pages, chunks))
    return done.select("id", F.col("promotion_fault").alias("fault"), "lifecycle_state")


@query("""with g as (select unnest(['TEMPORAL_EVOLUTION', 'DIFFERENT_CONTEXT', 'CORROBORATES']) category, unnest([1, 2, 3])), d as (select r.id, a.modality in ('ASSERTED', 'HISTORICAL') and b.modality in ('ASSERTED', 'HISTORICAL') comparable, """ + REL.format("a.currency", "b.currency") + """ c, """ + REL.format("a.unit_raw", "b.unit_raw") + """ u,
  list_sort(list_filter(list_intersect(map_keys(a.scope), map_keys(b.scope)), lambda q: lower(trim(a.scope[q])) <> lower(trim(b.scope[q])))) k """ + PAIR + """)
select d.id, g.category, case g.category when 'TEMPORAL_EVOLUTION' then 'time' when 'DIFFERENT_CONTEXT' then case when len(k) > 0 then 'scope:' || k[1] when not comparable then 'modality' when c = 'different' then 'currency' when u = 'different' then 'units' else 'period' end end as dimension from d cross join g""")
def context_dimension(spark, d):
    rows = signals.with_pair(_pairs(spark, d), table(spark, d, "facts"))
    _, conflict = signals.scope_relation(F.col("fa.scope"), F.col("fb.scope"))
    known = ["ASSERTED", "HISTORICAL"]
    rows = rows.select("relationship_id", conflict.alias("scope_conflict"), (F.col("fa.modality").isin(known) & F.col("fb.modality").isin(known)).alias("modality_comparable"), signals.relation(F.col("fa.currency"), F.col("fb.currency")).alias("currency_relation"), signals.relation(F.col("fa.unit_raw"), F.col("fb.unit_raw")).alias("unit_relation"))
    rows = rows.withColumn("category", F.explode(F.array(*map(F.lit, ("TEMPORAL_EVOLUTION", "DIFFERENT_CONTEXT", "CORROBORATES")))))
    return rows.select(F.col("relationship_id").alias("id"), "category", signals.context_dimension(F.col("category"), F.lit(None).cast("string"), False).alias("dimension"))


@query()
def pipeline_failures(spark, d):
    """The pipeline over the stored facts: failures by type and reason."""
    names = ("source_files", "pages", "chunks", "entities", "facts", "evidence")
    files, pages, chunks, entities, facts, evidence = (table(spark, d, n) for n in names)
    facts = facts.withColumn("percentage_ratio", F.lit(None).cast("double"))
    return stages.run(files, pages, chunks, entities, facts, evidence).failures.groupBy("failure_type", "reason").agg(F.count("*").alias("n"))


@query()
def sweep_verdicts(spark, d):
    return stages.sweep(table(spark, d, "facts"), table(spark, d, "source_files"), stages.SWEEP)


@query()
def retrieval_summary(spark, d):
    facts, files = table(spark, d, "facts"), table(spark, d, "source_files")
    pairs = cut(retrieval.candidate_pairs(facts))
    made = signals.signals(signals.with_pair(pairs.select("a", "b"), facts, files))
    return retrieval.retrieval_summary(pairs, made, facts)


@query(r"""with p as (select e.id, e.fact_id, coalesce(e.quote, '') q, e.char_start s, e.char_end z, coalesce(p.text, w.text) t, e.chunk_id from evidence e left join pages p on p.id = e.page_id left join pages w on w.document_id = e.document_id and w.page_index = e.page_index),
b as (select p.*, c.char_offset o, coalesce(c.char_end, c.char_offset + length(c.text) - coalesce(c.header_prefix_len, 0)) k from p left join chunks c on c.id = p.chunk_id),
n as (select *, coalesce(o >= 0 and o < k and k <= length(t), false) ok from b), m as (select *, case when ok then substring(t, o + 1, k - o) else t end span, case when ok then o else 0 end base from n),
x as (select *, instr(span, q) pos, case when s >= 0 and s < z and z <= length(t) then substring(t, s + 1, z - s) end piece from m), y as (select *, case when pos > 0 then instr(substring(span, pos + 1), q) else 0 end again,
  trim(regexp_replace(translate(q, '‘’‚‛“”„‟‐‑‒–—―−', '''''''''""' || '""-------'), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) fq, trim(regexp_replace(translate(piece, '‘’‚‛“”„‟‐‑‒–—―−', '''''''''""' || '""-------'), '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g')) fp from x)
select id, case when coalesce(t, '') = '' then 'source_unavailable' when q <> '' and piece = q then 'exact' when q <> '' and fp = fq then 'normalized_exact' when q <> '' and pos > 0 and again = 0 then 'recovered_exact' when q <> '' and pos > 0 then 'ambiguous_quote_match' when length(trim(q)) < 12 then 'too_short' else 'later' end as rung,
  case when coalesce(t, '') = '' then null when q <> '' and piece = q or q <> '' and fp = fq then s when q <> '' and pos > 0 and again = 0 then base + pos - 1 end as char_start from y""")
def quote_rungs(spark, d):
    rows = grounding.ladder(grounding.sources(table(spark, d, "evidence"), table(spark, d, "pages"), table(spark, d, "chunks")))
    early = F.when(F.col("_v.reason").isin("source_unavailable", "ambiguous_quote_match"), F.col("_v.reason")).when(F.col("_v.status") == "VERIFIED", F.col("_v.method"))
    rung = F.coalesce(early, F.when(F.length(F.trim(F.coalesce("quote", F.lit("")))) < 12, "too_short").otherwise("later"))
    return rows.select("id", rung.alias("rung"), F.col("_v.char_start").alias("char_start"))


@query()
def quote_ground(spark, d):
    facts = table(spark, d, "facts").withColumn("percentage_ratio", F.lit(None).cast("double"))
    return grounding.verify(*(table(spark, d, n) for n in ("evidence", "pages", "chunks")), facts)


@query()
def numeric_consistency(spark, d):
    facts = table(spark, d, "facts").where("fact_type = 'numeric'").select(F.col("id").alias("fact_id"), "value_raw", "numeric_value", "currency", "magnitude", "unit_raw")
    rows = table(spark, d, "evidence").select(F.col("id").alias("evidence_id"), "fact_id", "quote").join(facts, "fact_id")
    ok = grounding.numeric_consistent(F.col("value_raw"), F.col("numeric_value"), F.col("currency"), F.col("magnitude"), F.col("unit_raw"), F.coalesce("quote", F.lit("")))
    return rows.select("evidence_id", ok.alias("consistent"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
