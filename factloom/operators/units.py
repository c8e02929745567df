"""Quantities in common units (problem 6).

A value's figure is read with column expressions; what is left of the text and the fields beside it is its unit string.
Only distinct unit strings are segmented: dynamic programming over tries of scale words, prefixes, roots and exponents
gives all decompositions with their scores, and the dimensions that the same predicate is otherwise stated in decide
between those that remain ambiguous (``m``: metres or millions). The dictionary that results is joined back to the rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.tables import cut

# Scale words, prefixes, and roots as (dimension, unit, factor into the dimension's common unit).
SCALES = {
    1e3: ["thousand", "thousands", "'000", "k", "K", "tsd"],
    1e5: ["lakh", "lakhs", "lac", "lacs"],
    1e6: ["million", "millions", "mln", "mn", "Mn", "MN", "MM", "mio", "m", "M"],
    1e7: ["crore", "crores", "cr", "Cr", "CR"],
    1e9: ["billion", "billions", "bn", "Bn", "BN", "bln", "B"],
    1e12: ["trillion", "trillions", "tn", "trn"],
    1e2: ["hundred", "hundreds"],
}
PREFIXES = {1e3: ["k", "K", "kilo"], 1e6: ["M", "mega"], 1e9: ["G", "giga"], 1e12: ["T", "tera"], 1e-3: ["milli"], 1e-2: ["c", "centi"]}
ROOTS = {
    ("money", "INR", 1.0): ["₹", "Rs", "INR", "rupee", "rupees", "Re"],
    ("money", "USD", 1.0): ["$", "US$", "USD", "dollar", "dollars", "US dollar", "US dollars"],
    ("money", "EUR", 1.0): ["€", "EUR", "euro", "euros"],
    ("money", "GBP", 1.0): ["£", "GBP", "pounds sterling", "pound sterling", "sterling", "pounds", "pound"],
    ("mass", "g", 1e-3): ["g", "gs", "gm", "gms", "gram", "grams", "gramme", "grammes"],
    ("mass", "t", 1e3): ["t", "T", "tonne", "tonnes", "ton", "tons", "metric ton", "metric tons", "metric tonne", "metric tonnes", "MT", "mt"],
    ("mass", "quintal", 1e2): ["quintal", "quintals", "qtl", "qtls"],
    ("mass", "lb", 0.45359237): ["lb", "lbs", "pound weight", "pounds weight", "pounds", "pound"],
    ("length", "m", 1.0): ["m", "ms", "metre", "metres", "meter", "meters", "mtr", "mtrs"],
    ("length", "ft", 0.3048): ["ft", "foot", "feet"],
    ("length", "yd", 0.9144): ["yd", "yds", "yard", "yards"],
    ("length", "mi", 1609.344): ["mi", "mile", "miles"],
    ("area", "ha", 1e4): ["ha", "hectare", "hectares"],
    ("area", "acre", 4046.8564224): ["acre", "acres"],
    ("area", "sqm", 1.0): ["sqm", "sqmt", "sqmtr"],
    ("area", "sft", 0.09290304): ["sft", "sqft"],
    ("volume", "l", 1.0): ["l", "L", "ltr", "ltrs", "litre", "litres", "liter", "liters"],
    ("volume", "gal", 3.785411784): ["gal", "gallon", "gallons", "US gal", "US gallon", "US gallons", "gal US", "gallons US"],
    ("volume", "bbl", 158.987294928): ["bbl", "bbls", "barrel", "barrels"],
    ("duration", "day", 1.0): ["day", "days", "d"],
    ("duration", "hour", 1 / 24): ["h", "hr", "hrs", "hour", "hours"],
    ("duration", "week", 7.0): ["week", "weeks", "wk", "wks"],
    ("share", "bps", 1.0): ["bps", "bp", "basis point", "basis points"],
    ("share", "%", 100.0): ["%", "percent", "per cent", "pct"],
    ("share", "‰", 10.0): ["‰", "per mille", "permille"],
    ("share", "x", 10_000.0): ["x", "times", "ratio"],
    ("energy", "wh", 1e-3): ["Wh", "wh", "watt hour", "watt hours"],
    ("energy", "j", 1 / 3.6e6): ["J", "joule", "joules"],
    ("energy", "mu", 1e6): ["MU", "MUs", "million units"],
    ("power", "w", 1e-3): ["W", "w", "watt", "watts"],
    ("tally", "one", 1.0): ["pin code", "pin codes", "customer", "customers", "employee", "employees", "shipment", "shipments", "nos", "units", "persons", "people", "numbers"],
}
PREFIXED = {"g", "m", "l", "wh", "j", "w", "t"}
EXPONENTS = {2: ["²", "^2", "2"], 3: ["³", "^3", "3"]}
POWERS_BEFORE = {2: ["sq", "square"], 3: ["cu", "cubic"]}
RAISED = {("length", 2): "area", ("length", 3): "volume"}
FILLERS = ["in", "amount", "of", "the", "value", "figures", "all", "approx", "about", "ca"]
COMMON = {"mass": 1.0, "area": 1.0, "length": 1.0, "duration": 1.0, "share": 1.0, "energy": 1.0, "power": 1.0, "volume": 1.0, "tally": 1.0, "money": 1.0}
POINTER = r"(?i)\b(note|notes|refer|see|annex|annexure|schedule|page|para|table)\b"

WORD, PREFIX_COST, UNKNOWN, CLASH, PRIOR = 1.0, 0.4, 4.0, 6.0, 0.8


class Trie:
    """Entries by their characters; ``match`` gives every entry that begins at a place."""

    def __init__(self):
        self.root: dict = {}

    def add(self, text: str, entry: tuple) -> None:
        node = self.root
        for char in text:
            node = node.setdefault(char, {})
        node.setdefault("", []).append(entry)

    def match(self, text: str, at: int):
        node = self.root
        for end in range(at, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            for entry in node.get("", ()):
                yield end + 1, entry


def _tries() -> tuple[Trie, Trie, Trie]:
    first, roots, exponents = Trie(), Trie(), Trie()

    def both(trie, words, entry):
        for word in words:
            forms = {word} | ({word.lower(), word.upper(), word.capitalize()} if len(word) > 2 else set())
            for form in sorted(forms):
                trie.add(form, entry)

    for factor, words in SCALES.items():
        both(first, words, ("scale", factor))
    for factor, words in PREFIXES.items():
        both(first, words, ("prefix", factor))
    for power, words in POWERS_BEFORE.items():
        both(first, words, ("power", power))
    both(first, FILLERS, ("filler",))
    for root, words in ROOTS.items():
        both(roots, words, ("root", root))
    for power, marks in EXPONENTS.items():
        for mark in marks:
            exponents.add(mark, ("raise", power))
    return first, roots, exponents


_TRIES: list = []


def segment(text: str) -> list[tuple[float, float | None, tuple | None]]:
    """(cost, scale, root) of all decompositions of a unit string, the cheapest of each kind, cheapest first; root: (dimension, unit, factor) or None."""
    if not _TRIES:
        _TRIES.extend(_tries())
    first, roots, exponents = _TRIES
    n = len(text)
    letter = lambda k: 0 <= k < n and text[k].isalpha()
    # state at a place: (scale, root, pending prefix, pending power) -> cost
    best: list[dict[tuple, float]] = [{} for _ in range(n + 1)]
    best[0][(None, None, None, None)] = 0.0

    def reach(at, state, cost):
        if cost < best[at].get(state, math.inf):
            best[at][state] = cost

    for at in range(n):
        for (scale, root, prefix, power), cost in sorted(best[at].items(), key=lambda x: x[1]):
            begins = not letter(at - 1) or not letter(at)
            if not text[at].isalnum() and text[at] not in "₹$€£%‰²³'^":
                if prefix is None:
                    reach(at + 1, (scale, root, None, power), cost)
                continue
            if begins or prefix is not None:
                for end, (kind, found) in roots.match(text, at):
                    whole = not letter(end) or not letter(end - 1)
                    dim, unit, factor = found
                    if not whole or (prefix is not None and unit not in PREFIXED):
                        continue
                    if power is not None and (dim, power) not in RAISED:
                        continue
                    k = power or 1
                    made = (RAISED.get((dim, k), dim), unit if k == 1 else f"{unit}{k}", (factor * (prefix or 1.0)) ** k if k > 1 else factor * (prefix or 1.0))
                    if dim == "length" and k == 3:
                        made = (made[0], made[1], made[2] * 1000.0)  # litres
                    clash = CLASH * (root is not None and root[:2] != made[:2])
                    reach(end, (scale, root or made, None, None), cost + WORD + clash)
                    if power is None and dim == "length":
                        for stop, (_, raised) in exponents.match(text, end):
                            if not letter(stop) and not (stop < n and text[stop].isdigit()):
                                size = (factor * (prefix or 1.0)) ** raised * (1000.0 if raised == 3 else 1.0)
                                reach(stop, (scale, root or (RAISED[(dim, raised)], f"{unit}{raised}", size), None, None), cost + WORD + clash)
            if prefix is None and power is None and begins:
                for end, entry in first.match(text, at):
                    whole = not letter(end) or not letter(end - 1)
                    if entry[0] == "prefix" and letter(end) and root is None:
                        reach(end, (scale, root, entry[1], None), cost + PREFIX_COST)
                    elif entry[0] == "scale" and whole:
                        reach(end, (scale or entry[1], root, None, None), cost + WORD + CLASH * (scale is not None and scale != entry[1]))
                    elif entry[0] == "power" and (whole or letter(end)):
                        reach(end, (scale, root, None, entry[1]), cost + (PREFIX_COST if not whole else 0.5))
                    elif entry[0] == "filler" and whole:
                        reach(end, (scale, root, None, None), cost + 0.1)
            if prefix is None and begins:  # a word that no table knows
                end = at + 1
                while end < n and text[end].isalnum() and text[end].isalpha() == text[at].isalpha():
                    end += 1
                reach(end, (scale, root, None, None), cost + UNKNOWN)
    out: dict[tuple, float] = {}
    for (scale, root, prefix, power), cost in best[n].items():
        if prefix is None and power is None:
            out[(scale, root)] = min(cost, out.get((scale, root), math.inf))
    return [(c, *k) for k, c in sorted(out.items(), key=lambda x: (x[1], str(x[0])))]


def decompose(fields: list[str]) -> list[tuple[float, str, str, float]]:
    """(cost, dimension, unit, factor) of the readings of a value's fields together, cheapest first.

    The fields say one thing: a scale or root that several of them name counts once; the first one wins where they differ.
    """
    states: dict[tuple, float] = {(None, None): 0.0}
    for field in fields:
        if not field.strip():
            continue
        after: dict[tuple, float] = {}
        for (scale, root), cost in states.items():
            for c, s, r in segment(field):
                clash = CLASH * ((scale is not None and s is not None and s != scale) + (root is not None and r is not None and r[:2] != root[:2]))
                key = (scale or s, root or r)
                after[key] = min(after.get(key, math.inf), cost + c + clash)
        states = after
    out = []
    for (scale, root), cost in states.items():
        if root is not None:
            dim, unit, factor = root
            out.append((cost, dim, unit if dim == "money" else "", factor * (scale or 1.0)))
    return sorted(out)


def with_figure(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with ``number`` (null unless the text ``value`` holds one clear figure) and ``unit_text``, what is left of it.

    Each step is a column of its own, so that no expression is computed more than once a row.
    """
    shape = r"\d(?:[\d.,]*\d)?"
    c = F.col
    rows = rows.withColumn("_clean", F.regexp_replace(F.regexp_replace(F.translate(value, "−–", "--"), r"['’‘`]000\b", " thousand "), r"(?<!\p{L})([kc]?m|ft)([23])(?![\d.,])", "$1^$2 "))
    rows = rows.withColumn("_bare", F.regexp_replace("_clean", r"\^[23]", ""))
    rows = rows.withColumn("_found", F.regexp_extract_all("_bare", F.lit(shape), F.lit(0)))
    rows = rows.withColumn("_one", F.when(F.size("_found") == 1, F.element_at("_found", 1)))
    plain = (
        F.when(c("_one").rlike(r"^\d{1,3}(\.\d{3})+,\d+$"), F.translate("_one", ",.", "."))
        .when(c("_one").rlike(r"^\d{1,3}(\.\d{3}){2,}$"), F.translate("_one", ".", ""))
        .when(c("_one").rlike(r"^\d+,\d{1,2}$"), F.translate("_one", ",", "."))
        .otherwise(F.translate("_one", ",", ""))
    )
    negative = c("_bare").rlike(r"-[^\d]*\d|\([^()\d]*\d[\d.,]*[^()\d]*\)|\d\s*-\s*$")
    rows = rows.withColumns({"_size": F.when(~c("_bare").rlike(POINTER), plain.try_cast("double")), "_minus": F.contains("_bare", F.lit("-")) | F.contains("_bare", F.lit("("))})
    number = F.when(c("_minus") & negative, -c("_size")).otherwise(c("_size"))
    rest = F.trim(F.regexp_replace(F.regexp_replace("_clean", r"(?<!\^)" + shape, " "), r"[-\s]+", " "))
    return rows.withColumns({"number": number, "unit_text": F.coalesce(rest, F.lit(""))}).drop("_clean", "_bare", "_found", "_one", "_size", "_minus")


DICTIONARY = "unit_key string, predicate string, n long, dimension string, unit string, factor double, cost double, ambiguous boolean"


def _read_units(batches):
    for rows in batches:
        out = []
        memo: dict[str, list] = {}
        for key, predicate, n in zip(rows["unit_key"], rows["predicate"], rows["n"]):
            if key not in memo:
                memo[key] = decompose(key.split("\x01"))
            readings = {}
            for cost, dim, unit, factor in memo[key]:
                readings.setdefault((dim, unit), (cost, factor))
            low = min((c for c, _ in readings.values()), default=0)
            close = {k: v for k, v in readings.items() if v[0] < low + 3}
            for (dim, unit), (cost, factor) in close.items():
                out.append((key, predicate, n, dim, unit, factor, cost - low, len({d for d, _ in close}) > 1))
        yield pd.DataFrame(out, columns=["unit_key", "predicate", "n", "dimension", "unit", "factor", "cost", "ambiguous"])


def unit_dictionary(rows: DataFrame) -> DataFrame:
    """(unit_key, predicate, dimension, unit, factor): the reading of every distinct unit string under every predicate."""
    distinct = rows.groupBy("unit_key", "predicate").agg(F.count("*").alias("n"))
    readings = distinct.mapInPandas(_read_units, DICTIONARY)
    sure = readings.where("not ambiguous").groupBy("predicate", "dimension").agg(F.sum("n").alias("sure"))
    total = sure.groupBy("predicate").agg(F.sum("sure").alias("total"))
    weighed = readings.join(sure, ["predicate", "dimension"], "left").join(total, "predicate", "left")
    prior = F.log((F.coalesce("sure", F.lit(0)) + 0.5) / (F.coalesce("total", F.lit(0)) + 5.0))
    weighed = weighed.withColumn("score", F.col("cost") - PRIOR * prior)
    best = weighed.groupBy("unit_key", "predicate").agg(F.min_by(F.struct("dimension", "unit", "factor"), F.struct("score", "dimension", "unit")).alias("best"))
    return best.select("unit_key", "predicate", "best.*")


def quantities(facts: DataFrame, common_units: DataFrame) -> DataFrame:
    """(fact_id, dimension, common_unit, value) of every numeric fact with one clear quantity.

    Null, empty and textual values, values with several figures and pointers to another place ("refer note 14") have no
    row, nor has a unit that no decomposition explains or whose dimension ``common_units`` does not list. Repeated rows
    come out as often as they went in; only the columns named here are read. Money stays in its currency.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = facts.where("fact_type = 'numeric' and value_raw is not null").select(F.col("id").alias("fact_id"), text("predicate_norm").alias("predicate"), "value_raw", text("unit_raw").alias("u"), text("magnitude").alias("m"), text("currency").alias("c"))
    rows = with_figure(rows, "value_raw").withColumn("unit_key", F.concat_ws("\x01", "unit_text", "u", "m", "c")).select("fact_id", "predicate", "number", "unit_key")
    # figures are read once, for the dictionary and for the rows; a filter before this would read them twice
    rows = cut(rows).where("number is not null")
    known = rows.join(unit_dictionary(rows), ["unit_key", "predicate"])
    listed = common_units.select("dimension", "common_unit").where("dimension is not null and common_unit is not null").distinct()
    same = (known["dimension"] == listed["dimension"]) & ((known["unit"] == "") | (known["unit"] == listed["common_unit"]))
    return known.join(listed, same).select("fact_id", known["dimension"], "common_unit", (F.col("number") * F.col("factor")).alias("value"))


KEY = ["run_id", "subject_entity_id", "predicate_norm", "reporting_period_raw"]


def _stated(facts: DataFrame, common_units: DataFrame, width: float) -> DataFrame:
    """Quantities of facts that may have equals, with the bin of a logarithmic scale that they lie in."""
    stated = facts.where("fact_type = 'numeric' and document_id is not null").where(" and ".join(f"{c} is not null" for c in KEY)).select(F.col("id").alias("fact_id"), "document_id", *KEY)
    rows = stated.join(quantities(facts, common_units), "fact_id").withColumn("sign", F.signum("value").cast("int"))
    return rows.withColumn("bin", F.when(F.col("value") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("value")) / width)))


def _width(tolerance: float) -> float:
    return -math.log(1 - tolerance) * (1 + 1e-9)


def equal_statements(facts: DataFrame, common_units: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(fact_a_id, fact_b_id): pairs of different documents that state the same quantity, the smaller id first.

    Run, subject, predicate and period must be equal and not null; values may differ by ``tolerance`` of the larger one;
    signs count and zero equals zero. Values meet only within their own or the next bin of a logarithmic scale as wide
    as the tolerance, so that a hot subject is never compared as a whole.
    """
    rows = _stated(facts, common_units, _width(tolerance))
    keys = [*KEY, "common_unit", "sign", "bin"]
    a = rows.select(*[F.col(c) for c in keys if c != "bin"], F.col("fact_id").alias("a"), F.col("document_id").alias("da"), F.col("value").alias("va"), F.col("bin").alias("ba"), F.explode(F.when(F.col("value") == 0, F.array("bin")).otherwise(F.array("bin", F.col("bin") + 1))).alias("bin"))
    b = rows.select(*keys, F.col("fact_id").alias("b"), F.col("document_id").alias("db"), F.col("value").alias("vb"))
    near = F.abs(F.col("va") - F.col("vb")) <= tolerance * F.greatest(F.abs("va"), F.abs("vb"))
    once = (F.col("bin") > F.col("ba")) | (F.col("a") < F.col("b"))
    pairs = a.join(b, keys).where(near & once & (F.col("da") != F.col("db")) & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("fact_a_id"), F.greatest("a", "b").alias("fact_b_id")).distinct()


def equal_classes(facts: DataFrame, common_units: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """(fact_id, class_id, n_links): facts that ``equal_statements`` pairs, without the pairs.

    ``class_id``: the smallest id of the facts that state exactly the same value; ``n_links``: facts of other documents
    that state it within the tolerance. Only different values meet, each with its number of facts, so that a value which
    a third of all facts state is compared once.
    """
    rows = _stated(facts, common_units, _width(tolerance)).distinct()
    group = [*KEY, "common_unit", "sign"]
    rows = cut(rows)
    docs = rows.groupBy(*group, "bin", "value", "document_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("least"))
    values = docs.groupBy(*group, "bin", "value").agg(F.sum("n").alias("n"), F.min("least").alias("class_id"))
    reach = F.when(F.col("value") == 0, F.array("bin")).otherwise(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))
    asked = values.select(*group, "value", "class_id", F.explode(reach).alias("bin"))
    met = asked.join(values.select(*group, "bin", F.col("value").alias("other"), F.col("n").alias("m")), [*group, "bin"])
    met = cut(met.where(F.abs(F.col("value") - F.col("other")) <= tolerance * F.greatest(F.abs("value"), F.abs("other"))))
    whole = met.groupBy(*group, "value", "class_id").agg(F.sum("m").alias("all"))
    # what the fact's own document states is no link
    own = met.select(*group, "value", F.col("other")).join(docs.select(*group, F.col("value").alias("other"), "document_id", "n"), [*group, "other"]).groupBy(*group, "value", "document_id").agg(F.sum("n").alias("own"))
    out = rows.join(whole, [*group, "value"]).join(own, [*group, "value", "document_id"]).withColumn("n_links", F.col("all") - F.col("own"))
    return out.where("n_links > 0").select("fact_id", "class_id", "n_links")
