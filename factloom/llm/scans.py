"""Noise in text of scanned pages (problem 4).

Words that are rare in the corpus meet the well-supported ones through an inverted join of character q-grams; a
gradient-boosted ranker, trained on supported words damaged on purpose, tells misreadings from other rare words and
chooses the replacement. Two more judge pairs of lines: the ones on either side of a mark of division, and the outer lines
of a page with the ones in the same place on the neighbouring pages of its file, which are heads, page numbers or text.
Files are taken as scanned by what their pages show, not by what is stored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.boost import Boosted
from factloom.llm.names import Rule, similar_words
from factloom.tables import cut

# Characters that recognition takes for one another, and marks of division.
CONFUSED = ["il1", "o0", "s5", "b8", "gq9", "hb", "ce", "tf", "z2"]
MERGED = [("rn", "m"), ("cl", "d"), ("ii", "u"), ("vv", "w"), ("li", "h")]
TO_DIGIT = str.maketrans("oilsbzgq", "01158299")
MARKS = "-‐­¬"
ALIKE = {a + b for group in CONFUSED for a in group for b in group if a != b}


@dataclass(frozen=True)
class Noise:
    """``supported``: pages that a word of the vocabulary is on at least, and ``ratio`` times as many as its misreading; ``sample``: words that the classifiers are trained on at most; ``scanned``: share of a file's pages with misreadings from which it is a scan; ``elsewhere``: share of a misreading's pages that may lie in other files; ``head_pages``: pages that a head stands on at least; ``accept``: probability from which a classifier's answer is yes."""

    supported: int = 6
    ratio: float = 4.0
    sample: int = 1500
    scanned: float = 0.34
    elsewhere: float = 0.2
    head_pages: int = 3
    accept: float = 0.5


WORD = re.compile(r"[^\W_]+")
NUMBER = re.compile(r"^(?P<open>page\s+|p\.?\s*|[-–—]\s*|\[\s*|\(\s*)?(?P<n>[\dlioszbgq|]{1,4}|[ivxlcd1]{1,7})(?P<close>\s*[-–—]|\s*\]|\s*\)|\s+of\s+[\dlioszbgq|]{1,4})?$")
ROMAN = re.compile(r"^(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500}


def roman(text: str) -> int | None:
    text = text.replace("1", "i")
    if not text or not ROMAN.match(text):
        return None
    n = [VALUES[c] for c in text]
    return sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))


def page_number(line: str) -> list[tuple[int, bool]]:
    """(number, has a style of its own) for each reading of a line that carries nothing but a page number, misread digits aside."""
    line = re.sub(r"^pa[gq9][ec]\b", "page", line.strip().lower())
    m = NUMBER.match(line)
    if not m:
        return []
    styled = bool(m["open"] or m["close"])
    digits = m["n"].replace("|", "1").translate(TO_DIGIT)
    numbers = [int(digits)] if digits.isdigit() else []
    if not any(c.isdigit() for c in m["n"].replace("1", "i")) and (n := roman(m["n"])) is not None:
        numbers.append(n)
    return [(n, styled) for n in dict.fromkeys(numbers)]


def head_form(line: str) -> str:
    """A line with characters that are taken for one another made equal."""
    out = line.lower()
    for wide, narrow in MERGED[:4]:
        out = out.replace(wide, narrow)
    for group in CONFUSED:
        for c in group:
            out = out.replace(c, group[0])
    return re.sub(r"[hb8]", "b", re.sub(r"\W+", " ", out)).strip()


# legal forms whose stop ends no sentence, as head_form gives them
LEGAL_END = re.compile(rf"(^| )({'|'.join(map(head_form, ('ltd', 'corp', 'inc', 'co', 'pvt', 'llc', 'llp', 'plc', 'bros')))})$")


def runs_on(side: str, line: str, beside: str) -> bool:
    """Whether an outer line looks like a row of the table or a part of the sentence that the line beside it belongs to."""
    if "|" in line and "|" in beside:
        return True
    low, open_, stop = line[0].islower(), line.endswith((",", ";")), line.endswith(".") and not LEGAL_END.search(head_form(line))
    if side == "top":
        return low and stop or (low or open_) and beside[0].islower()
    return not beside.endswith((".", "!", "?", ":")) and (low or open_ or stop)


def read_page(text: str) -> dict:
    """The outer lines, divided words and words of a page."""
    lines = [x.strip() for x in text.split("\n")]
    full = [k for k, x in enumerate(lines) if re.search(r"\w", x)]
    out = {"heads": [], "numbers": [], "breaks": [], "words": [], "figures": [], "compounds": [], "inner": []}
    outer = []
    for side, order in (("top", full), ("bottom", full[::-1])):
        k = 0
        if order and (n := page_number(lines[order[0]])):
            out["numbers"] += [(side, *x) for x in n]
            k = 1
        if len(order) > k:
            beside = lines[order[k + 1]] if len(order) > k + 1 else None
            outer.append((side, lines[order[k]], beside is None, beside is not None and runs_on(side, lines[order[k]], beside)))
    # any outer line may be a head: what the file's pages repeat decides
    out["heads"] = [(side, head_form(line), alone, text, crc32(line.encode()), len(line)) for side, line, alone, text in outer]
    for k in range(len(lines) - 1):
        here, after = lines[k], lines[k + 1]
        if len(here) > 1 and here[-1] in MARKS and after:
            a, b = WORD.findall(here[:-1]), WORD.match(after)
            if a and b and here[-2].isalpha() and b.group().isalpha():
                out["breaks"].append((a[-1].lower(), b.group().lower(), here[-1]))
    flat = re.sub(rf"[{MARKS}]\n\s*", "\n", text).lower()
    out["inner"] = [lines[k] for k in full[2:-2]][crc32(text.encode()) % 7 :: 16]  # some lines to learn from
    out["figures"] = sorted({w for w in WORD.findall(flat) if len(w) >= 4 and w.isdigit()})
    out["words"] = sorted({w for w in WORD.findall(flat) if len(w) > 1 and not w.isdigit()})
    out["compounds"] = sorted({f"{a}-{b}" for a, b in re.findall(r"([^\W\d_]+)-(?=([^\W\d_]+))", flat)})
    return out


PAGE = "page_id long, document_id long, page_index int, heads array<struct<side:string,form:string,alone:boolean,text:boolean,code:long,size:int>>, numbers array<struct<side:string,n:int,styled:boolean>>, breaks array<struct<a:string,b:string,mark:string>>, words array<string>, figures array<string>, compounds array<string>, inner array<string>"


def _read(batches):
    for rows in batches:
        out = [read_page(t) for t in rows["text"]]
        yield pd.DataFrame({"page_id": rows["page_id"], "document_id": rows["document_id"], "page_index": rows["page_index"]} | {k: [x[k] for x in out] for k in ("heads", "numbers", "breaks", "words", "figures", "compounds", "inner")})


def confusion(a: str, b: str, most: int = 4) -> tuple[float, int]:
    """(edits that recognition does not explain, confusions) between a read word and a true one; edits beyond ``most`` are not told apart."""
    worst = (99.0, 0)
    rows: list[dict[int, tuple[float, int]]] = [{} for _ in range(len(a) + 3)]
    rows[0][0] = (0.0, 0)
    for i in range(len(a) + 1):
        for j in range(max(0, i - most), min(len(b), i + most) + 1):  # no more than a band can be reached
            cost, n = rows[i].get(j, worst)
            if cost > most:
                continue
            steps = []
            if i < len(a) and j < len(b):
                steps.append((i + 1, j + 1, 0.0, 0) if a[i] == b[j] else (i + 1, j + 1, 0.0, 1) if a[i] + b[j] in ALIKE else (i + 1, j + 1, 1.0, 0))
            if i < len(a):
                steps.append((i + 1, j, 1.0, 0))
            if j < len(b):
                steps.append((i, j + 1, 1.0, 0))
            for wide, narrow in MERGED:
                if a.startswith(wide, i) and b.startswith(narrow, j):
                    steps.append((i + 2, j + 1, 0.0, 1))
                if a.startswith(narrow, i) and b.startswith(wide, j):
                    steps.append((i + 1, j + 2, 0.0, 1))
            for x, y, c, m in steps:
                if (cost + c, n + m) < rows[x].get(y, worst):
                    rows[x][y] = (cost + c, n + m)
    return rows[len(a)].get(len(b), worst)


def word_features(word: str, match: str, n_word: int, n_match: int) -> list[float]:
    rest, n = confusion(word, match)
    return [rest, n, len(match), np.log1p(n_match), np.log1p(n_match) - np.log1p(n_word), any(c.isdigit() for c in word), abs(len(word) - len(match))]


def damage(word: str, rng: random.Random) -> str:
    """A word as recognition may misread it."""
    places = [(k, c, x) for k, c in enumerate(word) for g in CONFUSED if c in g for x in g if x != c] + [(k, n, w) for w, n in MERGED for k in range(len(word)) if word.startswith(n, k)] + [(k, w, n) for w, n in MERGED for k in range(len(word)) if word.startswith(w, k)]
    if not places:
        return word
    k, old, new = rng.choice(places)
    return word[:k] + new + word[k + len(old) :]


def mistype(word: str, rng: random.Random) -> str:
    k, c = rng.randrange(len(word)), rng.choice("abcdefghijklmnopqrstuvwxyz")
    return rng.choice([word[:k] + c + word[k + 1 :], word[:k] + word[k + 1 :], word[:k] + c + word[k:], word[:k] + word[k : k + 2][::-1] + word[k + 2 :], word + c, word + "s"])


def train_ranker(words: list[tuple[str, int]], seed: int = 1) -> Boosted:
    """Misreadings against mistypings and other words, made out of supported words with their counts."""
    rng, x, y = random.Random(seed), [], []
    for word, n in words:
        for label, made in ((1, damage(word, rng)), (1, damage(damage(word, rng), rng)), (0, mistype(word, rng)), (0, mistype(mistype(word, rng), rng))):
            if made != word:
                x.append(word_features(made, word, 1 + int(rng.random() * n * 0.1), n))
                y.append(label)
        other, m = rng.choice(words)
        if other != word:
            x.append(word_features(word, other, n, m)), y.append(0)
    return Boosted().fit(np.array(x, float), np.array(y, float)) if len(set(y)) == 2 else Boosted()


def join_features(joined: int, compound: int, a: int, b: int, mark: str, size: int) -> list[float]:
    return [np.log1p(joined), np.log1p(compound), np.log1p(a), np.log1p(b), mark != "-", size]


def train_joiner(words: list[tuple[str, int]], count: dict[str, int], compounds: list[tuple[str, int]], seed: int = 2) -> Boosted:
    """Divided words against compounds broken at their own hyphen."""
    rng, x, y = random.Random(seed), [], []
    for word, n in words:
        if len(word) >= 5:
            k = rng.randrange(2, len(word) - 1)
            whole = n if rng.random() < 0.8 else 0  # misread in the process
            x.append(join_features(whole, 0, count.get(word[:k], 0), count.get(word[k:], 0), rng.choice("--¬"), len(word))), y.append(1)
    for word, n in compounds:
        a, b = word.split("-")
        for mark in "--":
            x.append(join_features(count.get(a + b, 0), n, count.get(a, n), count.get(b, n), mark, len(word))), y.append(0)
    return Boosted().fit(np.array(x, float), np.array(y, float)) if len(set(y)) == 2 else Boosted()


def furniture_features(pages: int, distance: int | None, exact: bool, text: bool, text_share: float, alone: bool, size: int, number: bool, styled: bool, step: bool) -> list[float]:
    """Of an outer line and the line in the same place on a neighbouring page: pages that carry the like, how far the neighbour is, whether both are the same to the letter, whether the line and its like run on into the text beside them, whether it is all its page holds, and for page numbers whether they have a style and count with the pages."""
    return [np.log1p(pages), np.log1p(distance or 99), exact, text, text_share, alone, np.log1p(size), number, styled, step]


def train_furniture(lines: list[str], least: int, seed: int = 3) -> Boosted:
    """Heads and page numbers made out of lines of the corpus, against running text, tables, repeated sentences and figures."""
    rng, x, y = random.Random(seed), [], []
    lines = [t for t in lines if t]
    while len(lines) < 60:  # a corpus without lines to learn from
        lines.append(" ".join("".join(rng.choices("aeinorstl", k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 9))) + rng.choice(["", ".", ","]))
    for _ in range(4 * len(lines)):
        line, beside = rng.choice(lines), rng.choice(lines)
        apart, many, few = rng.randrange(1, 6), rng.randrange(least, 60), rng.randrange(1, least)
        head = line.title().rstrip(",;")
        odd = rng.random() * 0.4  # pages on which a head happens to look like text
        add = lambda label, **f: (x.append(furniture_features(**({"pages": many, "distance": apart, "exact": rng.random() < 0.7, "text": False, "text_share": odd, "alone": False, "size": len(line), "number": False, "styled": False, "step": False} | f))), y.append(label))  # noqa: B023, E731
        add(1, size=len(head))
        add(1, size=len(head), text=True, text_share=max(odd, 0.1))
        add(0, pages=few, distance=None if few == 1 else apart, text=runs_on("top", line, beside))
        add(0, text=True, text_share=0.6 + 0.4 * rng.random())
        add(0, text=False, text_share=0.55 + 0.4 * rng.random())
        add(0, alone=True)
        number = {"number": True, "size": rng.randrange(1, 5)}
        add(1, **number, styled=True, step=True, pages=rng.randrange(2, 60))
        add(1, **number, styled=True, pages=1, distance=None)
        add(1, **number, step=True, pages=rng.randrange(2, 60))
        add(0, **number, pages=1, distance=None)
    return Boosted().fit(np.array(x, float), np.array(y, float)) if len(set(y)) == 2 else Boosted()


def _rank(model: Boosted, accept: float):
    def run(batches):
        for rows in batches:
            if len(rows):
                x = np.array([word_features(*r) for r in zip(rows["word"], rows["match"], rows["n"], rows["m"])], float)
                rows = rows.assign(p=model.predict(x))[["word", "match", "p"]]
                rows = rows[rows["p"] >= accept]
                yield rows

    return run


PAGES_A_BLOCK = 4096


def _furniture(read: DataFrame, p: Noise) -> tuple[DataFrame, DataFrame]:
    """(heads, numbers), each (page_id, side): the outer lines that the line-pair classifier takes for furniture."""
    place = ["document_id", "kind", "side", "same"]
    blank = F.lit(False)
    heads = read.where("document_id is not null and page_index is not null").select("page_id", "document_id", "page_index", F.inline("heads")).where("length(form) > 0")
    heads = heads.select("page_id", "document_id", "page_index", "side", F.lit("head").alias("kind"), F.col("form").alias("same"), "alone", "text", "code", "size", blank.alias("styled"))
    numbers = read.select("page_id", "document_id", "page_index", F.inline("numbers"))
    offset = F.coalesce((F.col("n") - F.col("page_index")).cast("string"), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    numbers = numbers.select("page_id", F.coalesce("document_id", -F.col("page_id")).alias("document_id"), F.coalesce("page_index", F.lit(0)).alias("page_index"), "side", F.lit("number").alias("kind"), offset.alias("same"), blank.alias("alone"), blank.alias("text"), F.lit(0).cast("long").alias("code"), F.length(F.col("n").cast("string")).alias("size"), "styled")
    lines = cut(heads.union(numbers))
    groups = lines.groupBy(*place).agg(F.count_distinct("page_id").alias("pages"), F.avg(F.col("text").cast("int")).alias("text_share"))
    # the neighbour is the nearest page before with the like of it, else the nearest after; blocks of pages bound the windows
    near = Window.partitionBy(*place, F.floor(F.col("page_index") / PAGES_A_BLOCK)).orderBy("page_index", "page_id")
    pairs = lines.withColumns({"code_": F.coalesce(F.lag("code").over(near), F.lead("code").over(near)), "at": F.coalesce(F.lag("page_index").over(near), F.lead("page_index").over(near))})
    pairs = pairs.join(groups, place).select("page_id", *place, "pages", F.abs(F.col("at") - F.col("page_index")).alias("distance"), F.coalesce(F.col("code") == F.col("code_"), blank).alias("exact"), "text", "text_share", "alone", "size", (F.col("kind") == "number").alias("number"), "styled", ((F.col("kind") == "number") & F.col("at").isNotNull()).alias("step"))
    # a bounded sample of the corpus's inner lines teaches the classifier
    inner = [r.line for r in read.select(F.explode("inner").alias("line")).orderBy(F.xxhash64("line"), "line").limit(p.sample // 5).collect()]
    model = train_furniture(inner, p.head_pages)

    def judge(batches):
        for rows in batches:
            if len(rows):
                fields = ["pages", "distance", "exact", "text", "text_share", "alone", "size", "number", "styled", "step"]
                x = np.array([furniture_features(n, None if d != d else d, *rest) for n, d, *rest in zip(*(rows[f] for f in fields))], float)
                yield rows.assign(p=model.predict(x))[["page_id", *place, "pages", "p"]]

    judged = pairs.mapInPandas(judge, f"page_id long, {', '.join(f'{c} {t}' for c, t in pairs.select(*place).dtypes)}, pages long, p double")
    judged = cut(judged)
    whole = judged.groupBy(*place).agg(F.avg("p").alias("mean"))
    # a head is judged by all of its pages together, a page number by itself
    kept = judged.join(whole, place).where(((F.col("kind") == "head") & (F.col("mean") >= p.accept) & (F.col("pages") >= p.head_pages)) | ((F.col("kind") == "number") & (F.col("p") >= p.accept)))
    kept = cut(kept.select("page_id", "side", "kind").distinct())
    return kept.where("kind = 'head'").drop("kind"), kept.where("kind = 'number'").drop("kind")


@dataclass
class Reading:
    """What is found on the pages: ``pages`` as read, (page_id, noise_kind) ``found``, (word, match) ``misread`` by file, ``joins`` (a, b, mark)."""

    pages: DataFrame
    found: DataFrame
    corrections: DataFrame
    joins: DataFrame
    heads: DataFrame


def read_scans(pages: DataFrame, p: Noise = Noise()) -> Reading:
    """All noise of ``pages`` (id, document_id, page_index, text).

    Null and empty texts have none; a null document or page index leaves a page without heads and bare numbers. Pages
    repeated under one id count once a kind. Other columns are not read.
    """
    read = pages.where("text is not null and text <> ''").select(F.col("id").alias("page_id"), "document_id", "page_index", "text").mapInPandas(_read, PAGE)
    read = cut(read)
    words = read.select("page_id", "document_id", F.explode("words").alias("word"))
    counts = cut(words.groupBy("word").agg(F.count("*").alias("n")))
    trusted = counts.where(F.col("n") >= p.supported)
    # a bounded sample of the words teaches the classifiers; the vocabulary itself stays where it is
    sample = [tuple(r) for r in trusted.where("length(word) between 4 and 20 and not word rlike '[0-9]'").orderBy(F.xxhash64("word")).limit(p.sample).collect()]
    ranker = train_ranker(sample)
    letters = F.length(F.regexp_replace("word", "[0-9]", ""))
    mixed = (letters > 0) & (letters < F.length("word"))
    rare = counts.select("word", "n").where((F.length("word") >= 4) & ((2 * letters > F.length("word")) | mixed))
    # figures are what a misread figure stands for; they are no misread words themselves
    figures = read.select(F.explode("figures").alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= p.supported)
    known = cut(trusted.where("length(word) >= 3").select("word", "n").union(figures))
    near = similar_words(rare.select("word"), known.select("word"), Rule(jaccard=0.25)).where("word <> match")
    near = near.join(rare, "word").join(known.select(F.col("word").alias("match"), F.col("n").alias("m")), "match").where(F.col("m") >= p.ratio * F.col("n"))
    ranked = near.select("word", "match", "n", "m").mapInPandas(_rank(ranker, p.accept), "word string, match string, p double")
    guess = ranked.join(known.select(F.col("word").alias("match"), F.col("n").alias("m")), "match")
    guess = cut(guess.groupBy("word").agg(F.max_by("match", F.struct(F.round("p", 1), "m", "match")).alias("match")))
    # a replacement that is itself misread leads on to its own
    onward = guess.select(F.col("word").alias("match"), F.col("match").alias("onward"))
    guess = cut(guess.join(onward, "match", "left").select("word", F.coalesce("onward", "match").alias("match")).where("word <> match"))
    # the planner counts one word a page and would send all words of a middling table to the driver
    hits = cut(words.hint("merge").join(guess, "word"))
    files = read.groupBy("document_id").agg(F.count_distinct("page_id").alias("pages"))
    damaged = hits.where("not word rlike '^[0-9]'").groupBy("document_id").agg(F.count_distinct("page_id").alias("damaged"))
    scans = files.join(damaged, "document_id").where((F.col("damaged") >= p.scanned * F.col("pages")) & F.col("document_id").isNotNull()).select("document_id", F.lit(True).alias("scan"))
    marked = hits.join(scans, "document_id", "left")
    wide = marked.groupBy("word").agg(F.avg(F.when(F.col("scan"), 0.0).otherwise(1.0)).alias("outside")).where(F.col("outside") <= p.elsewhere).select("word")
    misread = marked.where("scan").join(wide, "word")

    pairs = read.select("page_id", F.inline("breaks")).distinct()
    compounds = read.select(F.explode("compounds").alias("compound")).groupBy("compound").agg(F.count("*").alias("c"))
    kinds = pairs.select("a", "b", "mark").distinct().withColumns({"joined": F.concat("a", "b"), "compound": F.concat_ws("-", "a", "b")})
    n_of = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    kinds = kinds.join(n_of("joined"), "joined", "left").join(n_of("a"), "a", "left").join(n_of("b"), "b", "left").join(compounds, "compound", "left").na.fill(0)
    parts = {w[:k] for w, _ in sample for k in range(2, len(w))} | {w[k:] for w, _ in sample for k in range(2, len(w))}
    known = compounds.where("c >= 3").orderBy(F.xxhash64("compound")).limit(p.sample).collect()
    parts |= {x for r in known for x in (*r.compound.split("-"), r.compound.replace("-", ""))}
    wanted = read.sparkSession.createDataFrame([(x,) for x in sorted(parts)], "word string")
    count = {r.word: r.n for r in counts.join(wanted, "word").collect()}  # at most the sample's parts
    joiner = train_joiner(sample, count, [(r.compound, r.c) for r in known])

    def judge(batches):
        for rows in batches:
            if len(rows):
                x = np.array([join_features(*r) for r in zip(rows["n_joined"], rows["c"], rows["n_a"], rows["n_b"], rows["mark"], rows["joined"].str.len())], float)
                yield rows.assign(keep=joiner.predict(x) >= 0.5)[["a", "b", "mark", "keep"]].query("keep")[["a", "b", "mark"]]

    joins = cut(kinds.select("a", "b", "mark", "joined", "n_joined", "n_a", "n_b", "c").mapInPandas(judge, "a string, b string, mark string"))
    broken = pairs.join(joins, ["a", "b", "mark"])

    headed, numbers = _furniture(read, p)
    kind = lambda df, name: df.select("page_id", F.lit(name).alias("noise_kind"))
    found = kind(broken, "hyphen_break").union(kind(misread, "misread")).union(kind(headed, "running_head")).union(kind(numbers, "page_number")).distinct()
    corrections = misread.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "match"))).alias("fix"))
    return Reading(read, found, corrections, broken.groupBy("page_id").agg(F.collect_set(F.concat_ws("\n", "a", "b", "mark")).alias("joins")), headed.select("page_id", "side").union(numbers.select("page_id", F.concat(F.lit("#"), "side"))).groupBy("page_id").agg(F.collect_set("side").alias("sides")))


def _as_typed(word: str, fixed: str) -> str:
    return fixed.upper() if word.isupper() and len(word) > 1 else fixed.capitalize() if word[:1].isupper() else fixed


def mend(text: str, fix: dict, joins: set, sides: set) -> str:
    """A page's text without furniture, with its words joined and corrected, as paragraphs of one line each."""
    lines = [x.strip() for x in text.split("\n")]
    for side in ("top", "bottom"):
        drop = ("#" + side in sides) + (side in sides)
        while drop and lines:
            k = 0 if side == "top" else -1
            drop -= bool(re.search(r"\w", lines[k]))
            lines.pop(k)
    out: list[str] = []
    for line in lines:
        if not line:
            out.append("")
            continue
        if out and out[-1]:
            before = out[-1]
            a, b = WORD.findall(before[:-1])[-1:], WORD.match(line)
            if before[-1] in MARKS and a and b:
                whole = "\n".join((a[0].lower(), b.group().lower(), before[-1])) in joins
                out[-1] = (before[:-1] if whole else before) + line
            elif "|" in line or "|" in before:
                out.append(line)
            else:
                out[-1] = before + " " + line
        else:
            out.append(line)
    whole = "\n".join(x for k, x in enumerate(out) if x or (k and out[k - 1]))
    return WORD.sub(lambda m: _as_typed(m.group(), fix[m.group().lower()]) if m.group().lower() in fix else m.group(), whole).strip()


def mended_pages(pages: DataFrame, p: Noise = Noise()) -> DataFrame:
    """(page_id, text, noise_kinds): every page repaired into paragraphs, with what was found on it; null stays null."""
    r = read_scans(pages, p)
    kinds = r.found.groupBy("page_id").agg(F.array_sort(F.collect_set("noise_kind")).alias("noise_kinds"))
    rows = pages.select(F.col("id").alias("page_id"), "text")
    for part in (r.corrections, r.joins, r.heads, kinds):
        rows = rows.join(part, "page_id", "left")

    def run(batches):
        for b in batches:
            none = lambda v: v is None or isinstance(v, float)
            texts = [None if t is None else t if none(k) else mend(t, dict([] if none(f) else f), set([] if none(j) else j), set([] if none(s) else s)) for t, f, j, s, k in zip(b["text"], b["fix"], b["joins"], b["sides"], b["noise_kinds"])]
            yield pd.DataFrame({"page_id": b["page_id"], "text": texts, "noise_kinds": [[] if none(k) else list(k) for k in b["noise_kinds"]]})

    return rows.mapInPandas(run, "page_id long, text string, noise_kinds array<string>")
