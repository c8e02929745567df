"""Cutting of oversized texts at natural boundaries (problem 2).

Texts and files are taken apart into byte ranges. A worker sees one range and a halo of the bytes behind it, finds the
range's boundaries and, for every place where a piece may begin near its head, the place where the following range is
entered and the pieces cut on the way. Ranges compose: character counts, last boundaries, entries and piece numbers of a
giant text are stitched by a tree of bounded groups, up and down again, and the pieces of a range are then cut where it
lies. No worker ever holds a whole text, nor the boundary table of one; texts of one range are not shuffled at all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.tables import cut

FAN = 128  # nodes of the tree that one task holds at once; three levels reach over FAN ** 3 ranges at the least

@dataclass(frozen=True)
class Rule:
    """Size limit, overlap of consecutive pieces and reach back for a boundary, in characters (code points)."""

    limit: int = 1200
    overlap: int = 150
    reach: int = 200
    range_bytes: int = 65_536

    def __post_init__(self):
        if not (self.limit > self.overlap + self.reach and self.overlap >= 0 and self.reach >= 0 and self.range_bytes > 0):
            raise ValueError("the limit must be larger than overlap and reach together")

    @property
    def halo(self) -> int:
        return 4 * (self.limit + 1)


def byte_ranges(texts: DataFrame, keys: list[str], text: str, rule: Rule) -> DataFrame:
    """(keys, range_no, ranges, final, own, body): ``own`` bytes of the range and, behind them, the halo; ``ranges``: those of the text; ``final``: the body reaches the text's end."""
    raw = texts.select(*keys, F.encode(text, "UTF-8").alias("_raw")).where("_raw is not null and octet_length(_raw) > 0")
    return _ranges(raw, keys, F.octet_length("_raw"), rule).withColumn("body", F.substring("_raw", F.col("_from").cast("int") + 1, F.lit(rule.range_bytes + rule.halo))).drop("_raw", "_from")


def _ranges(rows: DataFrame, keys: list[str], size, rule: Rule) -> DataFrame:
    step = rule.range_bytes
    rows = rows.withColumn("_size", size).withColumn("ranges", ((F.col("_size") - 1) / step).cast("int") + 1)
    rows = rows.withColumn("range_no", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    at = F.col("range_no").cast("long") * step
    rest = [c for c in rows.columns if c not in (*keys, "_size", "ranges", "range_no")]
    return rows.select(*keys, "range_no", "ranges", (F.col("_size") <= at + step + rule.halo).alias("final"), F.least(F.lit(step).cast("long"), F.col("_size") - at).cast("int").alias("own"), at.alias("_from"), *rest)


def file_ranges(spark: SparkSession, path: str, rule: Rule) -> DataFrame:
    """``byte_ranges`` of UTF-8 files, keyed by ``path``: each task reads its ranges and their halos at their places, never a whole file."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", F.col("length").alias("_length"))
    ranges = _ranges(files, ["path"], F.col("_length"), rule).drop("_length")
    spread = ranges.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "range_no")

    def read(batches):
        from pyarrow import fs

        opened: dict = {}
        for batch in batches:
            bodies = []
            for name, at in zip(batch.column(0).to_pylist(), batch.column(batch.schema.get_field_index("_from")).to_pylist()):
                if name not in opened:
                    system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                    opened = {name: system.open_input_file(inner)}
                file = opened[name]
                bodies.append(file.read_at(min(rule.range_bytes + rule.halo, file.size() - at), at))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(5)] + [pa.array(bodies, pa.binary())], ["path", "range_no", "ranges", "final", "own", "body"])

    return spread.mapInArrow(read, "path string, range_no int, ranges int, final boolean, own int, body binary")


class _Range:
    """Boundaries and cuts of one range; positions are characters from its first own one."""

    def __init__(self, body: bytes, own: int, final: bool, rule: Rule):
        data = np.frombuffer(body, np.uint8)
        self.at = np.flatnonzero((data & 0xC0) != 0x80)  # bytes at which a character begins; a head left by the range before is its own
        self.chars = int(np.searchsorted(self.at, own))
        self.seen, self.final, self.rule, self.body = len(self.at), final, rule, body
        first = data[self.at]
        self.bounds = np.flatnonzero((first == 0x20) | (first == 0x0A))

    def ends(self, start: np.ndarray) -> np.ndarray:
        """Where pieces that begin at ``start`` end."""
        hard = start + self.rule.limit
        k = np.searchsorted(self.bounds, hard, "left") - 1
        last = np.where(k >= 0, self.bounds[np.maximum(k, 0)] if len(self.bounds) else -1, -1)
        end = np.where(last >= hard - self.rule.reach, last + 1, hard)
        return np.where(self.final & (hard >= self.seen), self.seen, end)

    def exits(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry the offset in the following range at which pieces go on, -1 where the text ends with a piece of this range; and the pieces that begin here."""
        at, n = entry.copy(), np.zeros(len(entry), np.int64)
        while (inside := np.flatnonzero((at >= 0) & (at < self.chars))).size:
            end = self.ends(at[inside])
            over = self.final & (end >= self.seen)
            n[inside] += 1
            at[inside] = np.where(over, -1, end - self.rule.overlap)
        return np.where(at < 0, -1, at - self.chars), n

    def pieces(self, entry: int):
        at = entry
        while 0 <= at < self.chars:
            end = int(self.ends(np.array([at]))[0])
            stop = self.at[end] if end < self.seen else len(self.body)
            yield at, end, self.body[self.at[at] : stop].decode("utf-8")
            if self.final and end >= self.seen:
                return
            at = end - self.rule.overlap


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _scan(ranges: DataFrame, keys: list[str], rule: Rule, bounds: bool, exits: bool) -> DataFrame:
    """(keys, no, chars, last, bounds, exits, counts) of every range; ``last``: its last boundary, -1 for none. One value where all entries agree."""
    n = len(keys)

    def run(batches):
        width = rule.limit - rule.overlap
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in ("range_no", "final", "own", "body")}
            cols = [batch.column(at[k]).to_pylist() for k in at]
            out: list[list] = [[] for _ in range(5)]
            for number, final, own, body in zip(*cols):
                r = _Range(body, own, final, rule)
                mine = r.bounds[: np.searchsorted(r.bounds, r.chars)].astype(np.int32)
                to, made = r.exits(np.arange(width if number else 1)) if exits else (np.full(1, -1), np.zeros(1))
                if (to == to[0]).all() and (made == made[0]).all():
                    to, made = to[:1], made[:1]
                for column, x in zip(out, (r.chars, mine[-1] if len(mine) else -1, mine if bounds else mine[:0], to.astype(np.int32), made.astype(np.int32))):
                    column.append(x)
            ints = pa.list_(pa.int32())
            made = [pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), ints, ints, ints))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n)), batch.column(at["range_no"]), *made], names=[*keys, "no", "chars", "last", "bounds", "exits", "counts"])

    return ranges.mapInArrow(run, f"{_ddl(ranges, keys)}, no int, chars long, last long, bounds array<int>, exits array<int>, counts array<int>")


def _through(exits: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``exits`` at the places ``at``; ``rest`` where there is none."""
    return np.where(at < 0, rest, exits[np.where(at < 0, 0, at)] if len(exits) > 1 else exits[0])


def _merge(keys: list[str]):
    """Neighbouring nodes as one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        chars, last, to, made = 0, -1, None, None
        for n, low, e, c in zip(rows["chars"], rows["last"], rows["exits"], rows["counts"]):
            last = chars + low if low >= 0 else last
            chars += n
            e, c = np.asarray(e), np.asarray(c)
            if to is None:
                to, made = e, c
            else:
                made, to = made + _through(c, to, np.zeros(1, int)), _through(e, to, np.full(1, -1))
        if (to == to[0]).all() and (made == made[0]).all():
            to, made = to[:1], made[:1]
        return pd.DataFrame([[*(rows[k].iloc[0] for k in keys), rows["up"].iloc[0], chars, last, to, made]], columns=[*keys, "no", "chars", "last", "exits", "counts"])

    return run


def _spread(keys: list[str]):
    """What lies before each of neighbouring nodes, from what lies before the first one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("no")
        base, before, entry, first = (int(rows[k].iloc[0]) for k in ("base", "before", "entry", "first"))
        out = []
        for n, low, e, c in zip(rows["chars"], rows["last"], rows["exits"], rows["counts"]):
            out.append((base, before, entry, first))
            before = base + low if low >= 0 else before
            base += n
            if entry >= 0:
                entry, first = int(e[0] if len(e) == 1 else e[entry]), first + int(c[0] if len(c) == 1 else c[entry])
        made = pd.DataFrame(out, columns=["base", "before", "entry", "first"])
        return pd.concat([rows[[*keys, "no"]].reset_index(drop=True), made], axis=1)[[*keys, "no", "base", "before", "entry", "first"]]

    return run


def _stitch(scanned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, no, base, before, entry, first) of every range of texts with several: characters, last boundary and pieces before it, and where its first piece begins (-1: nowhere)."""
    node = f"{_ddl(scanned, keys)}, no int, chars long, last long, exits array<int>, counts array<int>"
    state = f"{_ddl(scanned, keys)}, no int, base long, before long, entry int, first long"
    levels = [scanned.select(*keys, "no", "chars", "last", "exits", "counts")]
    for _ in range(2):
        levels.append(levels[-1].withColumn("up", F.floor(F.col("no") / FAN).cast("int")).groupBy(*keys, "up").applyInPandas(_merge(keys), node))
    at = levels.pop().withColumns({"base": F.lit(0), "before": F.lit(-1), "entry": F.lit(0), "first": F.lit(0)}).groupBy(*keys).applyInPandas(_spread(keys), state)
    for nodes in reversed(levels):
        below = nodes.withColumn("up", F.floor(F.col("no") / FAN).cast("int")).join(at.withColumnRenamed("no", "up"), [*keys, "up"])
        at = below.groupBy(*keys, "up").applyInPandas(_spread(keys), state)
    return at


def boundary_table(ranges: DataFrame, keys: list[str], rule: Rule = Rule()) -> DataFrame:
    """One row per range: (keys, no, chars, bounds, base, bound_before, length).

    ``bounds``: its boundaries, from its first character; ``base``: characters before it in the text; ``bound_before``: the
    last boundary before it, in the text; ``length``: characters of the text.
    """
    none = F.lit(None).cast("long")
    alone = _scan(ranges.where("ranges = 1"), keys, rule, True, False).select(*keys, "no", "chars", "bounds", F.lit(0).cast("long").alias("base"), none.alias("bound_before"), F.col("chars").alias("length"))
    many = cut(_scan(ranges.where("ranges > 1"), keys, rule, True, False))
    long_ = many.groupBy(*keys).agg(F.sum("chars").alias("length"))
    many = many.join(_stitch(many, keys), [*keys, "no"]).join(long_, keys).select(*keys, "no", "chars", "bounds", "base", F.when(F.col("before") >= 0, F.col("before")).alias("bound_before"), "length")
    return alone.unionByName(many)


def cut_ranges(ranges: DataFrame, key: str, rule: Rule = Rule()) -> DataFrame:
    """(key, piece_no, char_offset, char_end, text): the pieces of texts given as ranges; a text of one range is cut where it lies."""
    zero = F.lit(0).cast("long")
    places = _stitch(cut(_scan(ranges.where("ranges > 1"), [key], rule, False, True)), [key]).where("entry >= 0").withColumnRenamed("no", "range_no")
    fields = ["final", "own", "body", "base", "entry", "first"]
    alone = ranges.where("ranges = 1").select(key, "final", "own", "body", zero.alias("base"), F.lit(0).alias("entry"), zero.alias("first"))
    many = ranges.where("ranges > 1").join(places, [key, "range_no"]).select(key, *fields)

    def run(batches):
        for batch in batches:
            cols = batch.to_pydict()
            out: dict[str, list] = {key: [], "piece_no": [], "char_offset": [], "char_end": [], "piece": []}
            for k, final, own, body, base, entry, first in zip(cols[key], *(cols[f] for f in fields)):
                for n, (start, end, piece) in enumerate(_Range(body, own, final, rule).pieces(entry)):
                    for column, x in zip(out.values(), (k, first + n, base + start, base + end, piece)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[key], batch.schema.field(key).type), *(pa.array(out[c], pa.int64()) for c in ("piece_no", "char_offset", "char_end")), pa.array(out["piece"], pa.string())], [*out])

    pieces = alone.unionByName(many).mapInArrow(run, f"{_ddl(ranges, [key])}, piece_no long, char_offset long, char_end long, piece string")
    return pieces.select(key, F.col("piece_no").cast("int").alias("piece_no"), "char_offset", "char_end", F.col("piece").alias("text"))


def cut_pieces(texts: DataFrame, key: str, text: str, rule: Rule = Rule()) -> DataFrame:
    """(key, piece_no, char_offset, char_end, text): every text as pieces within the limit.

    A piece ends behind the last boundary (blank or line feed) among the last ``reach`` characters before the limit, or
    at the limit where there is none; the next one begins ``overlap`` characters before that end. A text within the
    limit is one piece; null and empty texts give none. ``key`` must be unique and not null; other columns are not read.
    """
    return cut_ranges(byte_ranges(texts, [key], text, rule), key, rule)


def cut_files(spark: SparkSession, path: str, rule: Rule = Rule()) -> DataFrame:
    """(path, piece_no, char_offset, char_end, text): UTF-8 files of any size as pieces within the limit; empty files give none."""
    return cut_ranges(file_ranges(spark, path, rule), "path", rule)


def faulty_chunks(chunks: DataFrame, pages: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(chunk_id, too_long, misses_boundary, wrong_overlap, stops_early) for every stored chunk, judged against its page's boundary table.

    A chunk without a page, text, offset or prefix length is judged by what it has; ties in ``seq`` go by ``id``.
    """
    page = ["document_id", "page_index"]
    spans = chunks.select(
        F.col("id").alias("chunk_id"), *page, "seq", "char_offset",
        F.length("text").alias("size"),
        (F.col("char_offset") + F.length("text") - F.coalesce("header_prefix_len", F.lit(0))).cast("long").alias("stop"),
    )
    of_page = Window.partitionBy(*page).orderBy("seq", "chunk_id")
    spans = spans.withColumns({
        "before": F.lag("stop").over(of_page),
        "is_first": F.row_number().over(of_page) == 1,
        "is_last": F.lead("chunk_id").over(of_page).isNull(),
        "span": F.floor((F.greatest("stop", F.lit(1)) - 1) / rule.range_bytes).cast("int"),
    })
    found = boundary_table(byte_ranges(pages.where("document_id is not null and page_index is not null"), page, "text", rule), page, rule)
    # a range lies in at most two stretches of `range_bytes` characters
    stretch = lambda c: F.floor(c / rule.range_bytes).cast("int")
    stretches = F.sequence(stretch(F.col("base")), stretch(F.col("base") + F.greatest("chars", F.lit(1)) - 1))
    table = found.select(*page, "chars", "bounds", "base", "bound_before", "length", F.explode(stretches).alias("span"))
    s, t = spans.alias("s"), table.alias("t")
    same = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in (*page, "span")]
    joined = s.join(t, [*same, F.col("s.stop") > F.col("t.base"), F.col("s.stop") <= F.col("t.base") + F.col("t.chars")], "left")
    inside = F.array_max(F.filter("t.bounds", lambda x: x < F.col("s.stop") - F.col("t.base")))
    bound = F.coalesce(inside + F.col("t.base"), F.col("t.bound_before"))
    stop = F.col("s.stop")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        "s.chunk_id",
        yes(F.col("s.size") > rule.limit).alias("too_long"),
        yes(~F.col("s.is_last") & (bound < stop - 1) & (bound >= F.greatest(stop - rule.reach, F.col("s.char_offset")))).alias("misses_boundary"),
        yes(~F.col("s.is_first") & (F.col("s.char_offset") != F.col("s.before") - rule.overlap)).alias("wrong_overlap"),
        yes(F.col("s.is_last") & (stop < F.col("t.length"))).alias("stops_early"),
    )
