"""Subjects resolved to entities: by key, by similarity, by the dominant entity of a document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fuzzy, text
from factloom.tables import cut


def _numbered(items: list[str]) -> list[str]:
    """Each item with its number among its like."""
    seen: Counter = Counter()
    for k, x in enumerate(items):
        seen[x] += 1
        items[k] = f"{x}{seen[x]}"
    return items


def _signature(items: list[str]) -> int:
    """64 bits; two collections differ in at least as many items as their signatures differ in bits."""
    bits = 0
    for x in items:
        bits ^= 1 << (crc32(x.encode()) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def _described(batches):
    """The pairs of characters of padded words, whose order does not matter, and signatures of these and of the characters."""
    for rows in batches:
        out = []
        for name, words in zip(rows["name"], rows["words"]):
            whole = " ".join(words)
            grams = _numbered([f" {w} "[k : k + 2] for w in words for k in range(len(w) + 1)])
            out.append((name, len(whole), _signature(grams), _signature(_numbered(list(whole))), grams))
        yield pd.DataFrame(out, columns=["name", "size", "of_grams", "of_chars", "g"])


def _near(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(key, match) that may reach a ratio of ``least``, words put in any order; ``left``: key, words; ``right``: match, words. None that reaches it is missing.

    Deleting x and inserting y characters takes at most 2 x + y pairs of characters away from a key of n characters, and
    (2 - c) x + c y <= 2 (1 - c) n where the ratio is c or more. So the first common pair in the order from rare to
    common is among the first that many, and one more, of both keys; words in many keys have their pairs last.
    """
    c = least / 100
    share = max(4 * (1 - c) / (2 - c), 2 * (1 - c) / c)
    a, b = (x.select(F.col(x.columns[0]).alias("name"), "words").mapInPandas(_described, "name string, size int, of_grams long, of_chars long, g array<string>") for x in (left, right))
    order = a.select(F.explode("g").alias("gram")).union(b.select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count("*").alias("df"))

    def prefix(df, name):
        own = ["name", "size", "of_grams", "of_chars"]
        x = df.select(*own, F.explode("g").alias("gram")).join(order, "gram").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
        first = F.slice("g", F.lit(1), F.floor(F.col("size") * share + 1e-6).cast("int") + 1)
        return x.select(*own, F.explode(first["gram"]).alias("gram")).withColumnRenamed("name", name)

    a, b = prefix(a, "key"), prefix(b, "match").withColumnsRenamed({"size": "b_size", "of_grams": "b_grams", "of_chars": "b_chars"})
    edits = (1 - c) * (F.col("size") + F.col("b_size")) + 1e-6
    differ = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    met = a.join(b, "gram").where((F.abs(F.col("size") - F.col("b_size")) <= edits) & (differ("of_chars", "b_chars") <= edits) & (differ("of_grams", "b_grams") <= 3 * edits))
    return met.select("key", "match").distinct()


def _held(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(key, match) where the common words alone may make up ``least`` of ``key``: one of its rarest words, as many as may be missing, is in ``match``."""
    c = least / 100
    share = 2 * (1 - c) / (2 - c)
    b = right.select("match", F.explode("words").alias("w"))
    dfs = b.groupBy("w").agg(F.count("*").alias("df"))
    a = left.select("key", F.length(F.array_join("words", " ")).alias("size"), "words", F.explode("words").alias("w")).join(dfs, "w", "left")
    before = Window.partitionBy("key").orderBy(F.coalesce("df", F.lit(0)), "w").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("before", F.coalesce(F.sum(F.length("w") + 1).over(before), F.lit(0))).where(F.col("before") <= share * F.col("size") + 1e-6)
    met = a.join(b, "w").select("key", "match", "words", "size").join(right.withColumnRenamed("words", "others"), "match")
    missing = F.aggregate(F.array_except("words", "others"), F.lit(0), lambda n, w: n + F.length(w) + 1)
    return met.where(missing <= share * F.col("size") + 1e-6).select("key", "match").distinct()


def fuzzy_block(left: DataFrame, right: DataFrame, block: float = 88.0, merge: float = 0.0) -> DataFrame:
    """(key, match, set_ratio, sort_ratio): all pairs of distinct name keys (both: key) that reach ``block``, and ``merge`` in ``sort_ratio``.

    Pairs meet through their rarest pairs of characters, or through the rarest words of a key that the other may hold
    whole; both ways miss none, however many keys hold a word.
    """
    words = F.split("key", " ")
    a, b = (x.select("key").where("key <> ''").distinct().withColumn("words", words) for x in (left, right))
    b = b.withColumnRenamed("key", "match")
    if merge >= block:
        met = _near(a, b, merge)
    else:
        a, b = (x.withColumn("words", F.array_distinct("words")) for x in (a, b))
        turned = _held(b.withColumnRenamed("match", "key"), a.withColumnRenamed("key", "match"), block).select(F.col("match").alias("key"), F.col("key").alias("match"))
        met = _near(a, b, block).union(_held(a, b, block)).union(turned).distinct()
    return met.withColumns({"set_ratio": fuzzy.set_ratio("key", "match"), "sort_ratio": fuzzy.sort_ratio("key", "match")}).where((F.col("set_ratio") >= block) & (F.col("sort_ratio") >= merge))


def dominant(rows: DataFrame, owner: str, entity: str) -> DataFrame:
    """(owner, entity, n): the entity that most rows of an owner name; none where two share the first place."""
    counts = rows.where(F.col(entity).isNotNull()).groupBy(owner, entity).agg(F.count("*").alias("n"))
    top = counts.groupBy(owner).agg(F.max("n").alias("n"))
    first = counts.join(top, [owner, "n"]).groupBy(owner, "n").agg(F.min(entity).alias(entity), F.count("*").alias("_ties"))
    return first.where("_ties = 1").select(owner, entity, "n")


def resolve(facts: DataFrame, entities: DataFrame, merge: float = 94.0, block: float = 88.0, confirmer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fact_id, entity_id, method, score, reason) of every fact with a subject; ``entity_id`` null and a ``reason`` where it stays open.

    Exact key first. Else the known key with the highest set ratio of at least ``block``, of equal ones the entity of the
    smallest id: it is taken if it also reaches ``merge`` in sort ratio, else if the ``confirmer`` says so, else the
    subject stays open. A key that nothing is near makes a new entity, named after the smallest fact id, negated.
    General references ("the Company") follow the dominant entity of their document. ``confirmer``: (key, match) ->
    (key, same, confidence), asked only about the open keys; a doubt or a confidence below 0.5 leaves them open.
    """
    named = facts.where("subject_raw is not null").select(F.col("id").alias("fact_id"), "document_id", text.normalize_name(F.col("subject_raw")).alias("key"), text.is_anaphora(F.col("subject_raw")).alias("general"))
    known = entities.select(text.normalize_name(F.col("canonical_label")).alias("key"), "id").where("key <> ''").groupBy("key").agg(F.min("id").alias("entity_id"))
    none, whole = F.lit(None).cast("double"), F.lit(None).cast("string")
    asked = named.where("not general and key <> ''").select("key").distinct()
    open_ = asked.join(known, "key", "left_anti")
    best = Window.partitionBy("key").orderBy(F.desc("set_ratio"), "entity_id")
    near = fuzzy_block(open_, known, block).join(known.withColumnRenamed("key", "match"), "match").withColumn("r", F.row_number().over(best)).where("r = 1")
    near = cut(near.select("key", "match", "entity_id", "sort_ratio"))
    merged = F.col("sort_ratio") >= merge
    close = near.where(merged).select("key", "entity_id", F.lit("similarity").alias("method"), (F.col("sort_ratio") / 100).alias("score"), whole.alias("reason"))
    left = near.where(~merged)
    if confirmer is None:
        doubt = left.select("key", F.lit(None).cast("long").alias("entity_id"), whole.alias("method"), none.alias("score"), F.lit("similar_unconfirmed").alias("reason"))
    else:
        said = left.join(confirmer(left.select("key", "match")).select("key", "same", "confidence"), "key", "left")
        yes = F.coalesce(F.col("same") & (F.col("confidence") >= 0.5), F.lit(False))
        doubt = said.select("key", F.when(yes, F.col("entity_id")).alias("entity_id"), F.when(yes, "llm").alias("method"), F.when(yes, F.col("confidence")).alias("score"), F.when(~yes, "llm_not_same").alias("reason"))
    made = named.where("not general").join(open_, "key").join(near, "key", "left_anti").groupBy("key").agg((-F.min("fact_id")).alias("entity_id"))
    table = known.select("key", "entity_id", F.lit("deterministic").alias("method"), none.alias("score"), whole.alias("reason")).unionByName(close).unionByName(doubt)
    table = table.unionByName(made.select("key", "entity_id", F.lit("new_entity").alias("method"), none.alias("score"), whole.alias("reason")))
    direct = cut(named.where("not general").join(table, "key", "left").select("fact_id", "document_id", "entity_id", "method", "score", F.coalesce("reason", F.when(F.col("key") == "", "empty_key")).alias("reason")))
    leading = dominant(direct.select("document_id", "entity_id"), "document_id", "entity_id").select("document_id", "entity_id")
    derived = named.where("general").join(leading, "document_id", "left")
    derived = derived.select("fact_id", "entity_id", F.when(F.col("entity_id").isNotNull(), "anaphora").alias("method"), none.alias("score"), F.when(F.col("entity_id").isNull(), "anaphora_no_dominant_entity").alias("reason"))
    return direct.drop("document_id").unionByName(derived)


def aliases(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(entity_id, surface, normalized, match_method, score, source_fact_id): every spelling that led to an entity, with the first fact that has it."""
    surface = F.trim("subject_raw")
    rows = facts.select(F.col("id").alias("fact_id"), surface.alias("surface")).join(resolved.where("entity_id is not null"), "fact_id")
    first = rows.groupBy("entity_id", "surface").agg(F.min_by(F.struct("method", "score", "fact_id"), "fact_id").alias("f"))
    key = F.nullif(text.normalize_name(F.col("surface")), F.lit(""))
    return first.select("entity_id", "surface", F.when(F.col("f.method") != "anaphora", key).alias("normalized"), F.regexp_replace(F.regexp_replace("f.method", "anaphora", "similarity"), "new_entity", "deterministic").alias("match_method"), "f.score", F.col("f.fact_id").alias("source_fact_id"))


def new_entities(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """(id, canonical_label, entity_type, normalization_key, resolution_method): the entities that resolution made, labelled by their first fact."""
    made = resolved.where("method = 'new_entity'").groupBy("entity_id").agg(F.min("fact_id").alias("fact_id"))
    rows = made.join(facts.select(F.col("id").alias("fact_id"), F.trim("subject_raw").alias("canonical_label")), "fact_id")
    return rows.select(F.col("entity_id").alias("id"), "canonical_label", text.guess_type(F.col("canonical_label")).alias("entity_type"), text.normalize_name(F.col("canonical_label")).alias("normalization_key"), F.lit("deterministic").alias("resolution_method"))


def rename_map(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(old_id, keep_id): entities that a fact says are the former name of its subject; a kept one that is itself renamed leads on."""
    said = facts.where("subject_entity_id is not null and object_raw <> ''").where(text.is_rename(F.col("predicate"), F.col("predicate_norm")))
    said = said.select(F.col("subject_entity_id").alias("keep_id"), text.normalize_name(F.col("object_raw")).alias("key")).where("key <> ''").distinct()
    old = entities.select(F.col("id").alias("old_id"), text.normalize_name(F.col("canonical_label")).alias("key"))
    pairs = said.join(old, "key").where("old_id <> keep_id").groupBy("old_id").agg(F.min("keep_id").alias("keep_id"))
    onward = pairs.select(F.col("old_id").alias("keep_id"), F.col("keep_id").alias("next"))
    return pairs.join(onward, "keep_id", "left").select("old_id", F.when(F.col("next") != F.col("old_id"), F.coalesce("next", "keep_id")).otherwise(F.coalesce(F.when(F.col("next").isNull(), F.col("keep_id")), F.least("old_id", "keep_id"))).alias("keep_id")).where("old_id <> keep_id")


def renames(facts: DataFrame, rename_to: DataFrame) -> DataFrame:
    """Facts with entities that were merged into others pointed at the kept one; ``rename_to``: old_id, keep_id."""
    return facts.join(rename_to, facts["subject_entity_id"] == rename_to["old_id"], "left").withColumn("subject_entity_id", F.coalesce("keep_id", "subject_entity_id")).drop("old_id", "keep_id")
