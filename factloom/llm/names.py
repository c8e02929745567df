"""Variant spellings of names (problem 1).

The words of all distinct names, typed and registered, are joined on character q-grams once: each word's grams are
ordered by rarity and only its prefix is joined, which no pair above the set similarity can miss. A name needs a partner
for each of its rare words, so it meets only the names that hold a match of the word with the fewest of them, and of
these only those that hold matches of its other rare words too. Names of short words only meet through these, or through
their initials and trade, which stand in the same join as words. What remains is verified by soft weighted word
similarity, in which rare words count more. Registered names that match each other form one party, and a name is linked
to all of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import spelling
from factloom.llm.components import connected_groups
from factloom.tables import cut


@dataclass(frozen=True)
class Rule:
    """``jaccard``: least set similarity of two words' grams; ``common``: share of the registered names above which a word is common (trades); ``accept``, ``accept_party``: least similarity of a name to a registered one, and of two registered ones; ``accept_short``: the same for a name cut down to initials or its first word, which only links where one party fits; ``margin``: what a second party may fall short by before the first one is clear."""

    jaccard: float = 0.3
    common: float = 0.008
    accept: float = 0.8
    accept_party: float = 0.84
    accept_short: float = 0.6
    margin: float = 0.04


@F.pandas_udf(T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("readings", T.ArrayType(T.ArrayType(T.StringType())))]))
def _read(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"words": names.map(spelling.parts), "readings": names.map(spelling.rejoined)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fused(words: pd.Series, dfs: pd.Series, common: pd.Series) -> pd.Series:
    return pd.Series([spelling.fused(list(w), [n < c for n in d]) for w, d, c in zip(words, dfs, common)], dtype=object)


@F.pandas_udf(T.StringType())
def _letters(words: pd.Series) -> pd.Series:
    return words.map(lambda w: spelling.letters_of(list(w)))


def _grams(word: Column) -> Column:
    """The q-grams of a padded word with their places: pairs for words of up to six letters, triples for five and more; words of up to three letters, and initials with a trade, as one."""
    padded = F.concat(F.lit("^"), word, F.lit("$"))

    def of(q):
        return F.transform(F.sequence(F.lit(1), F.length(padded) - (q - 1)), lambda k: F.struct(F.substring(padded, k, F.lit(q)).alias("gram"), k.alias("at")))

    none = F.array().cast("array<struct<gram:string,at:int>>")
    whole = F.array(F.struct(padded.alias("gram"), F.lit(1).alias("at")))
    return F.when((F.length(word) < 4) | F.contains(word, F.lit("|")), whole).otherwise(F.concat(F.when(F.length(word) <= 6, of(2)).otherwise(none), F.when(F.length(word) >= 5, of(3)).otherwise(none)))


def similar_words(left: DataFrame, right: DataFrame, rule: Rule = Rule(), nicknames: spelling.Nicknames | None = None) -> DataFrame:
    """(word, match): pairs of a word of ``left`` and one of ``right`` (both: word) that are equal, forms of one given name, or within two edits.

    Prefix filter: with grams ordered from rare to common, two sets of n grams each and Jaccard similarity t share one
    of the first n - ceil(t n) + 1 of either; a gram counts only where it stands at about the same place (within two),
    and lengths may differ by two. What meets is verified by edits.
    """
    left, right = left.distinct(), right.distinct()
    l_grams, r_grams = (x.where("length(word) >= 1").select("word", F.inline(_grams(F.col("word")))) for x in (left, right))
    order = l_grams.union(r_grams).groupBy("gram").agg(F.count("*").alias("df"))

    def prefix(grams):
        # the planner counts one gram a word and would send all grams to the driver, here and below
        ranked = grams.hint("merge").join(order, "gram").groupBy("word", F.length("gram").alias("q")).agg(F.sort_array(F.collect_list(F.struct("df", "gram", "at"))).alias("g"))
        # two edits change at most 2 q grams, so that one of the first 2 q + 1 is shared too
        size = F.size("g")
        first = F.least(size - F.ceil(size * rule.jaccard).cast("int") + 1, 2 * F.col("q") + 1)
        return ranked.select("word", F.explode(F.slice("g", F.lit(1), first)).alias("x")).select("word", "x.gram", "x.at")

    a, b = prefix(l_grams), prefix(r_grams).withColumnsRenamed({"word": "match", "at": "there"})
    near = a.hint("merge").join(b, "gram").where((F.abs(F.col("at") - F.col("there")) <= 2) & (F.abs(F.length("word") - F.length("match")) <= 2)).select("word", "match").distinct()
    close = near.where(F.levenshtein("word", "match", 2) >= 0)
    if nicknames is None:
        return close

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def forms(words: pd.Series) -> pd.Series:
        return words.map(nicknames.forms)

    short = left.withColumn("match", F.explode(forms("word"))).join(right.withColumnRenamed("word", "match"), "match", "left_semi").select("word", "match")
    return close.union(short).distinct()


def _verify(total: int, common: int, rule: Rule, names: spelling.Nicknames):
    def run(batches):
        for rows in batches:
            out = []
            for core, party, a, x, b, y in zip(rows["core"], rows["party"], rows["a"], rows["df_a"], rows["b"], rows["df_b"]):
                a, x, b, y = list(a), list(x), list(b), list(y)
                s, initial = spelling.similarity(a, x, b, y, total, common, names)
                short = False if s >= rule.accept else (s := spelling.short_form(a, x, b, y, total, common)) >= rule.accept_short
                if short or s >= rule.accept:
                    out.append((core, party, s, initial, short))
            yield pd.DataFrame(out, columns=["core", "party", "similarity", "by_initial", "short"])

    return run


def _rare(common: int, condition) -> Column:
    return F.transform(F.filter(F.arrays_zip("words", "dfs"), lambda x: (x["dfs"] < common) & condition(F.length(x["words"]))), lambda x: x["words"])


def _trade(common: int, least: int) -> Column:
    return F.transform(F.filter(F.arrays_zip("words", "dfs"), lambda x: (x["dfs"] >= common) & (F.length(x["words"]) >= least)), lambda x: F.substring(x["words"], 1, 1))


def _meet(names: DataFrame, total: int, common: int, rule: Rule, nicknames: spelling.Nicknames) -> DataFrame:
    """(core, party, similarity, by_initial, short) of all names with the registered ones that pass; ``names``: core, words, dfs, own (is registered)."""
    marked = lambda letters, trade: F.transform(F.array_distinct(trade), lambda t: F.concat(letters, F.lit("|"), t))
    # registered names: their words, neighbours written as one, initials of their rare words with each trade
    initials = F.array_join(F.transform(_rare(common, lambda n: n >= 1), lambda w: F.substring(w, 1, 1)), "")
    held = F.concat("words", _fused("words", "dfs", F.lit(common)), F.when(F.length(initials) >= 2, marked(initials, _trade(common, 2))).otherwise(F.array().cast("array<string>")))
    right = cut(names.where("own").select(F.col("core").alias("party"), F.col("words").alias("b"), F.col("dfs").alias("df_b"), F.array_distinct(held).alias("held")))
    # what a name needs a match for: each of its rare words of four letters and more; without any, its short ones or its initials
    left = names.withColumns({"rare": F.array_distinct(_rare(common, lambda n: n >= 4)), "letters": _letters("words")})
    brief = F.array_distinct(F.concat(_rare(common, lambda n: n.between(2, 3)), F.when(F.length("letters") >= 2, marked(F.col("letters"), _trade(common, 2))).otherwise(F.array().cast("array<string>"))))
    need = lambda need, words: F.transform(words, lambda w: F.struct(F.coalesce(need, w).alias("need"), w.alias("word")))
    needs = F.when(F.size("rare") > 0, need(F.lit(None).cast("string"), F.col("rare"))).otherwise(need(F.lit(""), brief))
    asked = cut(left.select("core", F.inline(needs)))
    holders = right.select("party", F.explode("held").alias("match"))
    sizes = holders.groupBy("match").agg(F.count("*").alias("parties"))
    matches = similar_words(asked.select("word"), sizes.select(F.col("match").alias("word")), rule, nicknames)
    lists = matches.join(sizes, "match").groupBy("word").agg(F.collect_set("match").alias("matches"), F.sum("parties").alias("parties"))
    lists = asked.join(lists, "word", "left").groupBy("core", "need").agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"), F.sum("parties").alias("parties"))
    # a need without any match leaves the name without a party
    lists = lists.groupBy("core").agg(F.collect_list(F.struct("parties", "matches")).alias("lists"), F.count_if(F.col("parties").isNull()).alias("lost")).where("lost = 0")
    probes = lists.select("core", F.transform("lists", lambda x: x["matches"]).alias("needs"), F.explode(F.array_min("lists")["matches"]).alias("match"))
    found = probes.join(holders, "match").select("core", "needs", "party").join(right, "party")
    found = found.where(F.forall("needs", lambda m: F.arrays_overlap(m, F.col("held")))).select("core", "party", "b", "df_b").dropDuplicates(["core", "party"])
    found = found.join(names.select("core", F.col("words").alias("a"), F.col("dfs").alias("df_a")), "core").select("core", "party", "a", "df_a", "b", "df_b")
    return found.mapInPandas(_verify(total, common, rule, nicknames), "core string, party string, similarity double, by_initial boolean, short boolean")


def _clear(links: DataFrame, rule: Rule) -> DataFrame:
    """Per name the party it is closest to; none where an initial leaves it open between several, or it is cut down and several fit."""
    of = Window.partitionBy("core")
    links = links.withColumn("best", F.max("similarity").over(of)).where(F.col("similarity") >= F.when(F.col("short"), 0.0).otherwise(F.col("best") - rule.margin))
    links = links.withColumn("n", F.size(F.collect_set("group_id").over(of)))
    links = links.where("n = 1 or not (by_initial or short)").withColumn("rank", F.rank().over(of.orderBy(F.desc("similarity"))))
    return links.where("n = 1 or rank = 1").select("core", "group_id").distinct()


def _weighed(cores: DataFrame, dfs: DataFrame, common: int, common_words: list[str]) -> DataFrame:
    """``cores`` (core, words, ...) with ``dfs``, the number of registered names that each word is in; short forms of common words count as common."""

    @F.pandas_udf(T.BooleanType())
    def short_form(words: pd.Series) -> pd.Series:
        return words.map(lambda w: any(spelling.abbreviates(w, c) for c in common_words))

    rest = [c for c in cores.columns if c != "words"]
    placed = cores.select(*rest, F.posexplode("words").alias("at", "word"))
    known = placed.select("word").distinct().join(dfs, "word", "left")
    known = known.select("word", F.greatest("df", F.when(short_form("word"), F.lit(common)), F.lit(1)).cast("int").alias("df"))
    placed = placed.join(known, "word").groupBy(*rest).agg(F.sort_array(F.collect_list(F.struct("at", "word", "df"))).alias("x"))
    return placed.select(*rest, F.col("x.word").alias("words"), F.col("x.df").alias("dfs"))


def link_names(facts: DataFrame, key: str, name: str, entities: DataFrame, entity_key: str, label: str, rule: Rule = Rule(), nicknames: Mapping[str, str] = spelling.NICKNAMES) -> DataFrame:
    """(key, entity_id): every row of ``facts`` with every row of ``entities`` for the party that its name means.

    ``nicknames``: given names with their short forms, a table that every task holds. Null, blank and general names ("the
    Company") have no rows. A name cut down to initials or to the first rare word, beside its trade, is linked where a
    single party fits; one of common words only, to the ones of the same words. Repeated rows come out once; only the
    four named columns are read. Both tables may be empty.
    """
    known = spelling.Nicknames(nicknames)
    registered = entities.select(F.col(entity_key).cast("long").alias("entity_id"), F.col(label).alias("raw")).where("entity_id is not null and raw is not null")
    both = facts.select(F.col(name).alias("raw"), F.lit(False).alias("own")).where("raw is not null").union(registered.select("raw", F.lit(True)))
    both = both.groupBy("raw").agg(F.max("own").alias("own"), F.max(~F.col("own")).alias("asked"))
    typed = both.select("*", _read("raw").alias("r")).select("raw", "own", "asked", "r.*").where("size(words) > 0")
    typed = cut(typed.withColumn("core", F.concat_ws(" ", "words")))
    same = lambda words: F.array_join(F.sort_array(words), " ")
    # names with a blank inside a word: each reading is a name of its own; those of the words of a registered one need none
    spelt = typed.where("own").select(same("words").alias("same")).distinct()
    readings = typed.where("asked").withColumn("same", same("words")).join(spelt, "same", "left_anti").select(F.col("core").alias("as_typed"), F.explode("readings").alias("words")).select("as_typed", "words", F.concat_ws(" ", "words").alias("core")).distinct()
    no = F.lit(False)
    cores = typed.select("core", "words", "own", "asked").union(readings.select("core", "words", no, no))
    cores = cut(cores.groupBy("core").agg(F.first("words").alias("words"), F.max("own").alias("own"), F.max("asked").alias("asked")))
    held = cores.where("own")
    total = held.count()
    common = max(4, int(rule.common * total))
    dfs = cut(held.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    # at most (words a name) / rule.common words are common, whatever the number of names
    common_words = [r.word for r in dfs.where((F.col("df") >= common) & (F.length("word") >= 4)).collect()]
    weighed = cut(_weighed(cores, dfs, common, common_words))
    pairs = cut(_meet(weighed, total, common, rule, known))

    first = cut(registered.join(typed.select("raw", "core"), "raw").groupBy("core").agg(F.min("entity_id").alias("first"), F.collect_set("entity_id").alias("ids")))
    ends = first.select("core", F.col("first").alias("a")), first.select(F.col("core").alias("party"), F.col("first").alias("b"))
    twins = pairs.where((F.col("similarity") >= rule.accept_party) | F.col("short")).where("core <> party").join(ends[0], "core").join(ends[1], "party")
    # one that gives an initial, or is cut down, is another's twin where only one fits
    twins = twins.withColumn("others", F.size(F.collect_set(F.when(F.col("by_initial") | F.col("short"), F.col("b"))).over(Window.partitionBy("a"))))
    twins = twins.where("others <= 1")
    groups = connected_groups(twins, "a", "b")
    group_of = cut(first.join(groups, first["first"] == groups["id"], "left").select(F.col("core").alias("party"), F.coalesce("group_id", "first").alias("group_id"), "ids"))

    links = pairs.join(group_of.select("party", "group_id"), "party")
    asked = cut(weighed.where("asked").select("core", "words"))
    clear = cut(_clear(links.where("not short").join(asked.select("core"), "core", "left_semi"), rule))
    lost = asked.join(links.where("not short").select("core"), "core", "left_anti")
    # what is not found as typed: through names of the same words, through its readings, cut down
    alike = lost.select("core", same("words").alias("same")).join(group_of.select(same(F.split("party", " ")).alias("same"), "group_id"), "same").select("core", "group_id").distinct()
    lost = cut(lost.select("core").join(alike, "core", "left_anti"))
    again = readings.join(lost.withColumnRenamed("core", "as_typed"), "as_typed", "left_semi").select("as_typed", "core").join(links.where("not short"), "core")
    again = again.select(F.col("as_typed").alias("core"), "party", "similarity", "by_initial", "short", "group_id")
    short = links.where("short").join(lost, "core", "left_semi").select(*again.columns)
    short = short.join(again.select("core").distinct(), "core", "left_anti")
    clear = clear.union(alike).union(_clear(again.union(short), rule)).distinct()
    rows = group_of.groupBy("group_id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    named = facts.select(F.col(key).alias(key), F.col(name).alias("raw")).join(typed.select("raw", "core"), "raw").join(clear, "core").join(rows, "group_id")
    return named.select(key, F.explode("ids").alias("entity_id")).distinct()
