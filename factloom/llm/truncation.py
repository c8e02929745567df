"""Texts cut off by field limits or in transfer (problem 9).

Per source and column, lengths in characters and bytes are counted; a length that is far more frequent than the lengths
around it, with hardly anything just above it, is a limit: the maximum of the source, or of what one of its feeds lets
through. A text at a limit that ends neither in a mark of sentence end nor in a closing line was cut by that limit. What
was cut in transfer lies at no particular length and is told by stricter evidence, kept apart in a column of its own: a
mark left by whoever cut it, or running text that just stops. Closing lines (signatures, table rows, tags) are known by
how many different texts of several sources end in the same form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_SOURCE = "(none)"


@dataclass(frozen=True)
class Limits:
    """``least``: different texts that a spike needs; ``tail_share``: its share of all texts of its length or more; ``ratio``: times the mean of the lengths around it; ``around``: how far these reach on either side; ``slack``: bytes by which a cut at a whole character may fall short of a limit in bytes; ``closing_share``, ``closing_least``: share and number of different texts that must end in one form for it to be a closing line."""

    least: int = 5
    ratio: float = 6.0
    tail_share: float = 0.2
    around: int = 40
    slack: int = 3
    closing_share: float = 0.0004
    closing_least: int = 4


# Marks that a cut leaves, ends of sentences in the corpus's scripts, short forms whose full stop ends no sentence.
MARK = r"(…|\.\.\.|\[\.\.\.\]|\[…\]|\[truncated\]|\(truncated\)|\[cut\]|\(more\)|\[more\]|read more|continued|�)$"
TERMINAL = r"[.!?।॥。！？][\"'”’»)\]]*$"
SHORT_FORM = r"(?i)(^|[\s(])(ltd|pvt|inc|corp|co|no|nos|rs|mr|mrs|ms|dr|prof|m/s|vs|viz|approx|incl|resp|st|fig|para)\.$"
OPEN_NUMBER = r"(^|[\s₹$€£(])[−-]?\d{1,3}\.$"
# two words beside each other in lower case, or in a script without cases
RUNNING = r"[\p{Ll}\p{Lo}\p{M}]{2,} [\p{Ll}\p{Lo}\p{M}]+"
BLANKS = " \t\n\r\u00a0"


def _form(line: Column) -> Column:
    """A closing line's form: figures folded, what follows the last comma left out."""
    folded = F.regexp_replace(F.regexp_replace(line, r"\d[\d.,]*", "9"), r"(January|February|March|April|May|June|July|August|September|October|November|December)", "M")
    return F.regexp_replace(folded, r", [^,|]*$", ", *")


def length_limits(docs: DataFrame, columns: list[str], source: str, p: Limits = Limits()) -> DataFrame:
    """(column, source, unit, limit, n_at, at_maximum): the lengths in ``chars`` or ``bytes`` at which a source's values of a column heap up.

    Copies of one value count once. ``at_maximum``: no value of the source is longer.
    """
    src = F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("source")
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.length(c).alias("c"), F.octet_length(c).alias("b"), F.xxhash64(c).alias("h")) for c in columns])
    rows = docs.select(src, F.inline(values)).where("c > 0").distinct()
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("c").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("b").alias("size")))
    counts = rows.select("column", "source", F.inline(units)).groupBy("column", "source", "unit", "size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("column", "source", "unit").orderBy("size")
    reach = lambda a, b: F.sum("n").over(near.rangeBetween(a, b))
    in_bytes = F.col("unit") == "bytes"
    counts = counts.withColumns({
        "heap": F.when(in_bytes, reach(-p.slack, 0)).otherwise(F.col("n")),
        "width": F.when(in_bytes, F.lit(p.slack + 1)).otherwise(F.lit(1)),  # lengths that the heap gathers
        "below": F.greatest(F.coalesce(reach(-p.around - p.slack, -1 - p.slack), F.lit(0)) / p.around, F.lit(0.25)),
        "tail": F.sum("n").over(near.rangeBetween(1, Window.unboundedFollowing)),
        "above": F.coalesce(reach(1 + p.slack, p.around + p.slack), F.lit(0)) / p.around,
        "most": F.max("size").over(Window.partitionBy("column", "source", "unit")),
    })
    c = F.col
    heaps = (c("heap") >= p.least) & (c("heap") >= p.tail_share * (c("heap") + F.coalesce("tail", F.lit(0))))
    stands_out = (c("heap") >= p.ratio * c("width") * c("below")) & (c("above") <= 2 * c("below")) & (c("heap") >= 2 * p.ratio * c("above"))
    spikes = counts.where(heaps & stands_out)
    # neighbouring sizes in bytes share a heap: the largest of them is the limit
    spikes = spikes.withColumn("next", F.lead("size").over(near)).where(f"next is null or next > size + {p.slack}")
    return spikes.select("column", "source", "unit", c("size").alias("limit"), c("heap").alias("n_at"), (c("most") <= c("size") + p.slack).alias("at_maximum"))


def cut_texts(docs: DataFrame, key: str, text: str, source: str, p: Limits = Limits(), prose: bool = True) -> DataFrame:
    """(key, source, at_limit, limit_cut, marked, transfer_cut, is_cut) for every row.

    ``limit_cut``: the text lies at a limit of its source and ends neither a sentence nor in a closing line.
    ``transfer_cut``: it does not lie at a limit, and ends in a mark of a cut or, in a column of ``prose``, in running
    text without an end. Null, empty and blank texts are not cut. A null source counts as one source. Repeated rows are
    judged alike; columns other than the three named are not read, whatever their names.
    """
    limits = length_limits(docs, [text], source, p).groupBy("source").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("limit"))).alias("by_chars"), F.collect_set(F.when(F.col("unit") == "bytes", F.col("limit"))).alias("by_bytes")
    )
    whole = F.rtrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    rows = docs.select(
        F.col(key).alias(key), F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("source"), F.length(text).alias("c"), F.octet_length(text).alias("b"), F.xxhash64(text).alias("h"),
        F.trim(F.substring_index(whole, "\n", -1)).alias("line"), (F.instr(whole, "\n") > 0).alias("many"),
    )
    rows = rows.withColumns({"blank": F.col("line") == "", "marked": F.lower("line").rlike(MARK), "ends": F.col("line").rlike(TERMINAL), "short": F.col("line").rlike(SHORT_FORM) | F.col("line").rlike(OPEN_NUMBER), "running": F.col("line").rlike(RUNNING)})
    rows = rows.withColumn("form", F.when(F.col("many") & ~F.col("blank") & ~F.col("ends") & ~F.col("marked"), F.xxhash64(_form(F.col("line")))))
    # as many rows reach every task as forms can have their share of the texts: at most 1 / closing_share
    total = rows.where("not blank").agg(F.count_distinct("h").alias("total"))
    forms = rows.where("form is not null").groupBy("form", "h").agg(F.min("source").alias("low"), F.max("source").alias("high"))
    forms = forms.groupBy("form").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where((F.col("n") >= p.closing_least) & (F.col("low") < F.col("high")))
    closing = forms.join(F.broadcast(total)).where(F.col("n") >= p.closing_share * F.col("total")).select("form", F.lit(True).alias("closing"))
    rows = rows.join(F.broadcast(closing), "form", "left").join(limits, "source", "left")
    at_limit = F.array_contains("by_chars", F.col("c")) | F.exists("by_bytes", lambda m: (m >= F.col("b")) & (m - p.slack <= F.col("b")))
    open_ = ~F.col("blank") & ~F.col("ends") & F.col("closing").isNull()
    rows = rows.withColumns({"at_limit": F.coalesce(at_limit, F.lit(False)) & ~F.col("blank"), "open": open_})
    limit_cut = F.col("at_limit") & (F.col("open") | F.col("short"))
    transfer = ~F.col("at_limit") & (F.col("marked") | (F.col("open") & F.col("running") & F.lit(prose)))
    return rows.select(key, "source", "at_limit", limit_cut.alias("limit_cut"), "marked", transfer.alias("transfer_cut"), (limit_cut | transfer).alias("is_cut"))


def cut_share(judged: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, n_limit, n_transfer, share): how often each source's texts are cut, and how."""
    n, k = F.count("*"), F.count_if("is_cut")
    return judged.groupBy("source").agg(n.alias("n_docs"), k.alias("n_cut"), F.count_if("limit_cut").alias("n_limit"), F.count_if("transfer_cut").alias("n_transfer"), F.round(k / n, 6).alias("share"))
