"""Candidate fact pairs by blocking, scored, the best few of every fact.

Three blocks make candidates: facts of one entity, facts of one predicate, and facts that share a token which not too
many facts hold. The last are bounded and joined fact by fact, where entity or predicates let the pair pass at all. In the
first two a pair that shares no such token scores by entity, predicate and the frequent tokens only, so facts that have
these in common form a kind, and of each kind only the lowest ids can be among anybody's best. Since a score counts three
shared tokens at most, kinds of one entity and predicate, or of one predicate, meet through the sets of up to three tokens
that they hold, each with its lowest ids: neither a hot entity nor a hot predicate is joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import fuzzy, text
from factloom.operators.signals import Thresholds
from factloom.tables import cut


def fact_rows(facts: DataFrame) -> DataFrame:
    """(id, document_id, e, p, t): eligible facts with entity, predicate text and the content tokens of subject, predicate and object."""
    said = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("subject_raw", "predicate", "object_raw")])
    key = F.lower(text.predicate_text(F.col("predicate"), F.col("predicate_norm")))
    return facts.where("lifecycle_state = 'ELIGIBLE_FOR_REASONING'").select("id", "document_id", F.col("subject_entity_id").alias("e"), key.alias("p"), text.content_tokens(said).alias("t"))

#: A score counts so many shared tokens at most.
FULL = 3
#: A kind with more sets of tokens than that is compared with the kinds of its block one by one.
SUBSETS = 2500
METHODS = ["entity", "predicate_exact", "predicate_similar", "lexical"]


def _score(same: Column, sim: Column, shared: Column, p: Thresholds) -> Column:
    whole = p.weight_predicate + p.weight_lexical + p.weight_entity
    if whole <= 0:
        return F.lit(0.0)
    return F.round((p.weight_entity * same.cast("int") + p.weight_predicate * sim + p.weight_lexical * F.least(F.lit(1.0), shared / FULL)) / whole, 6)


def _methods(same: Column, exact: Column, sim: Column, lexical: Column, p: Thresholds) -> Column:
    """The names of ``METHODS`` that hold, as bits."""
    return F.when(same, 1).otherwise(0) + F.when(exact, 2).when(sim >= p.predicate, 4).otherwise(0) + F.when(lexical, 8).otherwise(0)


def _subsets(c: Column, most: Column) -> Column:
    """The subsets of an ordered array that have ``most`` members or fewer, at most three."""
    after = lambda n: F.slice(c, n, F.size(c))
    none = F.array(F.array().cast("array<long>"))
    one = F.transform(c, lambda x: F.array(x))
    two = F.flatten(F.transform(c, lambda x, i: F.transform(after(i + 2), lambda y: F.array(x, y))))
    three = F.flatten(F.transform(c, lambda x, i: F.flatten(F.transform(after(i + 2), lambda y, j: F.transform(after(i + j + 3), lambda z: F.array(x, y, z))))))
    return F.when(most <= 0, none).when(most == 1, F.concat(none, one)).when(most == 2, F.concat(none, one, two)).otherwise(F.concat(none, one, two, three))


def _nearest(kinds: DataFrame, key: list[str], k: int, flat: bool) -> DataFrame:
    """(kind, best): for every kind the first ``k`` of (o, level) among the ids of the kinds of equal ``key``, itself included.

    ``kinds``: kind, key, d (tokens in order), ids. The level is the number of tokens shared, ``FULL`` at most; highest
    level first, then lowest id. Tokens that all kinds of a key hold are shared anyway, so only sets of the others are
    made, as large as is missing. Whoever is among the first of a kind is among the first of a set that both hold.
    ``flat``: levels don't count, all are 0.
    """
    if flat:
        rows = kinds.select("kind", *key, "ids", F.lit(0).alias("b"), F.lit(0).alias("most"), F.array().cast("array<long>").alias("rest"))
    else:
        whole = kinds.groupBy(*key).agg(F.count("*").alias("all"))
        base = kinds.select(*key, F.explode("d").alias("w")).groupBy(*key, "w").agg(F.count("*").alias("n")).join(whole, key).where(F.col("n") == F.col("all")).groupBy(*key).agg(F.collect_list("w").alias("base"))
        rest = F.array_except("d", F.coalesce("base", F.array().cast("array<long>")))
        rows = kinds.join(base, key, "left").select("kind", *key, "d", "ids", F.greatest(F.size("base"), F.lit(0)).alias("b"), rest.alias("rest")).withColumn("most", F.greatest(F.lit(FULL) - F.col("b"), F.lit(0)))
    n = F.size("rest").cast("double")
    long_ = F.when(F.col("most") == 1, n).when(F.col("most") == 2, n * (n - 1) / 2).when(F.col("most") == 3, n * (n - 1) * (n - 2) / 6).otherwise(0.0) > SUBSETS
    rows = cut(rows.withColumn("long", long_))
    sets = rows.where("not long").select("kind", *key, "ids", "b", F.explode(_subsets(F.col("rest"), F.col("most"))).alias("s"))
    first = sets.select(*key, "s", F.explode("ids").alias("o")).withColumn("r", F.row_number().over(Window.partitionBy(*key, "s").orderBy("o"))).where(F.col("r") <= k)
    first = first.groupBy(*key, "s").agg(F.collect_list("o").alias("first"))
    found = sets.select("kind", *key, "s", F.least(F.lit(FULL), F.col("b") + F.size("s")).alias("level")).join(first, [*key, "s"]).select("kind", "level", F.col("first").alias("ids"))
    if not flat:
        other = rows.select(*key, F.col("d").alias("dd"), F.col("ids").alias("o"), F.col("long").alias("long_o"))
        met = rows.where("long").select("kind", *key, "d").join(other.drop("long_o"), key).union(rows.where("not long").select("kind", *key, "d").join(other.where("long_o").drop("long_o"), key))
        met = met.select("kind", F.least(F.lit(FULL), F.size(F.array_intersect("d", "dd"))).alias("level"), F.explode("o").alias("o"))
        met = met.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("level"), "o"))).where(F.col("r") <= k)
        found = found.union(met.groupBy("kind", "level").agg(F.collect_list("o").alias("ids")))
    out = found.groupBy("kind").agg(F.collect_list(F.struct("level", "ids")).alias("found")).withColumn("taken", F.array().cast("array<long>")).withColumn("best", F.array().cast("array<struct<o:long,level:int>>"))
    for level in [0] if flat else range(FULL, -1, -1):
        at = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("found", lambda x: x["level"] == level), lambda x: x["ids"]))))  # noqa: B023
        out = out.withColumn("at", F.slice(F.array_except(at, "taken"), 1, k)).withColumns({"taken": F.concat("taken", "at"), "best": F.concat("best", F.transform("at", lambda o: F.struct(o.alias("o"), F.lit(level).alias("level"))))})  # noqa: B023
    return out.select("kind", F.slice("best", 1, k).alias("best"))


def readings(facts: DataFrame, p: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame]:
    """((x, o, score, methods), (id, document_id, ...)): the partners o of every fact x among which its first ``top_k`` are, methods as bits; the facts.

    They hold the first of every smaller ``top_k`` and higher ``candidate`` too, all else being equal.
    """
    k, whole = p.top_k, p.weight_predicate + p.weight_lexical + p.weight_entity
    flat = whole <= 0 or p.weight_lexical == 0
    if not flat and p.weight_lexical / FULL / whole < 2e-6:  # a shared token must show in a rounded score
        raise ValueError("weight_lexical must be 0, or above a hundred thousandth of all weights")
    rows = cut(fact_rows(facts))
    words = rows.select("id", F.explode("t").alias("w"))
    counts = cut(words.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").withColumn("c", F.monotonically_increasing_id()))
    often = F.col("n") > p.bucket_max
    held = words.join(counts, "w").groupBy("id").agg(F.sort_array(F.collect_list(F.when(often, F.col("c")))).alias("d"), F.collect_list(F.when(~often, F.col("c"))).alias("w"))
    # predicates by number, a blank one by -1
    names = cut(rows.select("p").distinct().select(F.col("p").alias("name"), F.when(F.col("p") == "", -1).otherwise(F.monotonically_increasing_id()).alias("p")))
    empty = F.array().cast("array<long>")
    keyed = cut(rows.withColumnRenamed("p", "name").join(held, "id", "left").join(names, "name").select("id", "document_id", "e", "p", F.coalesce("d", empty).alias("d"), F.coalesce("w", empty).alias("w")))

    yes, no = F.lit(True), F.lit(False)

    def similar(pairs):
        """(p, q, sim) of different pairs of predicates."""
        said = pairs.join(names.withColumnRenamed("name", "x"), "p").join(names.withColumnsRenamed({"p": "q", "name": "y"}), "q")
        alike = said.where("p <> q and p >= 0 and q >= 0").select("p", "q", (fuzzy.set_ratio("x", "y") / 100).alias("sim"))
        return alike.union(said.where("p = q or p < 0 or q < 0").select("p", "q", F.when((F.col("p") == F.col("q")) & (F.col("p") >= 0), 1.0).otherwise(0.0).alias("sim")))

    # pairs that share a token of a block: of one entity, or of predicates that are equal or similar enough for a pair of two entities
    rare = keyed.select("id", "e", "p", "d", F.explode("w").alias("w"))
    said = rare.select("w", "p").distinct()
    mates = similar(said.join(said.select("w", F.col("p").alias("q")), "w").where("p <= q").select("p", "q").distinct())
    mates = cut(mates.union(mates.where("p <> q").select(F.col("q").alias("p"), F.col("p").alias("q"), "sim")))
    exact = (F.col("p") == F.col("q")) & (F.col("p") >= 0)
    able = mates.where(exact | (_score(no, F.col("sim"), F.lit(FULL), p) >= p.candidate))
    right = rare.select("w", F.col("id").alias("b"), F.col("e").alias("eb"), F.col("p").alias("q"), F.col("d").alias("db"))
    dense = F.size(F.array_intersect("d", "db")).alias("dense")
    one = rare.where("e is not null").join(right.withColumnRenamed("eb", "e"), ["w", "e"]).where("id < b").select(F.col("id").alias("a"), "b", "p", "q", dense)
    one = one.groupBy("a", "b", "p", "q", "dense").agg(F.count("*").alias("rare")).join(mates, ["p", "q"]).select("a", "b", "p", "q", "sim", "dense", "rare", yes.alias("same"))
    two = rare.join(able, "p").join(right, ["w", "q"]).where("id < b and not coalesce(e = eb, false)").select(F.col("id").alias("a"), "b", "p", "q", "sim", dense)
    two = two.groupBy("a", "b", "p", "q", "sim", "dense").agg(F.count("*").alias("rare")).select("a", "b", "p", "q", "sim", "dense", "rare", no.alias("same"))
    met = one.union(two).withColumn("shared", F.col("rare") + F.col("dense")).withColumn("score", _score(F.col("same"), F.col("sim"), F.col("shared"), p))
    met = met.where(F.col("same") | exact | ((F.col("shared") >= p.min_shared) & (F.col("score") >= p.candidate)))
    met = met.select("a", "b", "score", _methods(F.col("same"), exact, F.col("sim"), yes, p).alias("methods"))
    # nobody's reading of a pair is better than this one, so the first k of a fact are enough, of those that only a token block gives and of the others
    lexical = met.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("o")), F.struct(F.col("b").alias("x"), F.col("a").alias("o")))).alias("m"), "score", "methods").select("m.x", "m.o", "score", "methods")
    lexical = lexical.withColumn("r", F.row_number().over(Window.partitionBy("x", _loose()).orderBy(F.desc("score"), "o"))).where(F.col("r") <= k).drop("r")

    # kinds: no fact needs more of one than the k lowest ids beside itself
    def lowest(*key):
        of = Window.partitionBy(*key).orderBy("id")
        return keyed.withColumn("r", F.row_number().over(of)).where(F.col("r") <= k + 1).groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("kind", F.monotonically_increasing_id())

    def read(lists, same, exact, sim):
        """``best`` with score and methods in place of the level."""
        return lists.withColumn("best", F.transform("best", lambda x: F.struct(x["o"].alias("o"), _score(same, sim, x["level"], p).alias("score"), _methods(same, exact, sim, no, p).alias("methods"))))

    kinds = cut(lowest("e", "p", "d").where("e is not null"))
    named_, full = F.col("p") >= 0, F.when(F.col("p") >= 0, 1.0).otherwise(0.0)
    own = cut(read(kinds.drop("ids").join(_nearest(kinds, ["e", "p"], k + 1, flat), "kind"), yes, named_, full))
    # predicates of an entity that cannot reach what its own facts of the same predicate score are not looked at
    least = own.select("kind", "e", "p", "d", F.when(F.size("best") > k, F.array_min(F.transform("best", lambda x: x["score"]))).otherwise(0.0).alias("least"))
    floor = least.groupBy("e", "p").agg(F.min("least").alias("floor"))
    named = kinds.select("e", "p").distinct()
    other = named.join(named.select("e", F.col("p").alias("q")), "e").where("p <> q")
    other = other.join(similar(other.select("p", "q").distinct()), ["p", "q"]).join(floor, ["e", "p"]).where(_score(yes, F.col("sim"), F.lit(FULL), p) >= F.col("floor"))
    other = other.join(least, ["e", "p"]).where(_score(yes, F.col("sim"), F.lit(FULL), p) >= F.col("least")).drop("floor", "least")
    other = other.join(kinds.select("e", F.col("p").alias("q"), F.col("d").alias("dd"), "ids"), ["e", "q"])
    other = other.select("kind", _score(yes, F.col("sim"), F.size(F.array_intersect("d", "dd")), p).alias("score"), _methods(yes, no, F.col("sim"), no, p).alias("methods"), F.explode("ids").alias("o"))
    other = other.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "o"))).where(F.col("r") <= k + 1)
    other = kinds.drop("ids").join(other.groupBy("kind").agg(F.collect_list(F.struct("o", "score", "methods")).alias("best")), "kind")
    wide = cut(lowest("p", "d").where("p >= 0"))
    across = read(wide.drop("ids").join(_nearest(wide, ["p"], k + 1, flat), "kind"), no, yes, F.lit(1.0))

    listed = lambda lists, key: keyed.join(lists.drop("kind"), key).select(F.col("id").alias("x"), F.inline("best")).where("x <> o").select("x", "o", "score", "methods")
    every = lexical.union(listed(own, ["e", "p", "d"])).union(listed(other, ["e", "p", "d"])).union(listed(across, ["p", "d"]))
    # the readings of one pair differ in what they leave out: the fullest has the highest score and all methods
    fullest = [F.max("score").alias("score"), F.bit_or("methods").alias("methods")]
    return every.repartition("x").groupBy("x", "o").agg(*_fullest()), keyed


def _fullest() -> list[Column]:
    return [F.max("score").alias("score"), F.bit_or("methods").alias("methods")]


def _loose() -> Column:
    """Whether only a token block gives a pair."""
    return F.col("methods").bitwiseAND(3) == 0


def best(every: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """(a, b, score, methods) of ``readings``, made with this ``top_k`` or a higher one and this ``candidate`` or a lower one."""
    top = every.where(~_loose() | (F.col("score") >= p.candidate)).withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "o"))).where(F.col("r") <= p.top_k)
    pairs = top.groupBy(F.least("x", "o").alias("a"), F.greatest("x", "o").alias("b")).agg(*_fullest())
    return pairs.select("a", "b", "score", F.array_compact(F.array(*[F.when(F.col("methods").bitwiseAND(1 << i) > 0, name) for i, name in enumerate(METHODS)])).alias("methods"))


def candidate_pairs(facts: DataFrame, p: Thresholds = Thresholds(), documents: DataFrame | None = None) -> DataFrame:
    """(a, b, score, methods) with a < b: pairs within the first ``top_k`` of either fact, best score first, then lowest ids.

    Tokens held by more than ``bucket_max`` facts make no block, but count as shared. A pair that only a token block
    gives needs ``min_shared`` shared tokens and a score of ``candidate``. ``documents`` (id): only pairs that touch one
    of them are returned; their partners come from all documents. Rows must have unique ids.
    """
    every, keyed = readings(facts, p)
    pairs = best(every, p)
    if documents is not None:
        touched = keyed.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id")).join(touched, "id", "left_semi").select("a", "b").distinct()
        pairs = pairs.join(ends, ["a", "b"], "left_semi")
    return pairs


def retrieval_summary(pairs: DataFrame, signals: DataFrame, facts: DataFrame, p: Thresholds = Thresholds()) -> DataFrame:
    """(measure, key, n): eligible facts, pairs, the most there could be, and pairs by method, period and entity relation, across documents, comparable in numbers, with a scope conflict."""
    eligible = facts.where("lifecycle_state = 'ELIGIBLE_FOR_REASONING'").agg(F.count("*").alias("n"))
    row = lambda df, measure, key=F.lit(""): df.select(F.lit(measure).alias("measure"), key.alias("key"), "n")
    count = lambda df, measure: row(df.agg(F.count("*").alias("n")), measure)
    grouped = lambda df, measure, c: row(df.groupBy(F.col(c).alias("_k")).agg(F.count("*").alias("n")), measure, F.col("_k"))
    out = row(eligible, "facts_eligible").union(row(eligible.select((F.col("n") * p.top_k).alias("n")), "max_possible")).union(count(pairs, "candidate_pairs"))
    out = out.union(grouped(pairs.select(F.explode("methods").alias("method")), "by_method", "method"))
    out = out.union(grouped(signals, "by_period_relation", "period_relation")).union(grouped(signals, "by_entity_relation", "entity_relation"))
    return out.union(count(signals.where("not same_document"), "cross_document")).union(count(signals.where("numeric_comparable"), "numeric_comparable")).union(count(signals.where("size(scope_conflict) > 0"), "scope_conflict"))
