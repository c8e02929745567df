"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

No tokenizer library runs here: words are cut by the vocabulary's published pattern, and the words of a batch that were
not met before are merged together. All their symbols lie in one flat array; in each round the lowest-ranked pair of
every word is found by binary search over the sorted pair keys and all its occurrences are merged at once.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that this vocabulary's words are cut by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in set(own)]
    return {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(others)}


class BytePairs:
    """The merge table of a vocabulary file, as sorted arrays."""

    def __init__(self, path: str = VOCABULARY, kept_words: int = 400_000):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        vocab = model["vocab"]
        letters = byte_letters()
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[x] * self.size + vocab[y] for x, y in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)[order]
        self.words = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}
        self.kept_words = kept_words

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(x) for x in raw], np.int64)
        symbol = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(words)), length)
        done_symbols, done_owners = [], []
        while len(symbol):
            key = symbol[:-1] * self.size + symbol[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NEVER)
            # lowest rank of each word: the words lie one after the other
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, NEVER], start)
            count = np.diff(np.r_[start, len(symbol)])
            lowest = np.repeat(lowest, count)
            still = lowest != NEVER
            hit = (rank == lowest[:-1]) & still[:-1]
            # of occurrences that overlap (as in "aaa") every second one counts, from the left
            begins = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            where = np.flatnonzero(hit)
            if len(where):
                run = begins[np.searchsorted(begins, where, "right") - 1]
                where = where[(where - run) % 2 == 0]
                symbol = symbol.copy()
                symbol[where] = self.made[at[where]]
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            ready = ~still
            done_symbols.append(symbol[ready])
            done_owners.append(owner[ready])
            keep &= still
            symbol, owner = symbol[keep], owner[keep]
        symbols, owners = np.concatenate(done_symbols or [symbol]), np.concatenate(done_owners or [owner])
        order = np.argsort(owners, kind="stable")
        return np.split(symbols[order].astype(np.int32), np.cumsum(np.bincount(owners, minlength=len(words)))[:-1]) if words else []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each text."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > self.kept_words:
            self.known.clear()
        new = list({w for words in cut for w in words if w not in self.known})
        self.known.update(zip(new, self.merge(new)))
        parts = [[self.known[w] for w in words] for words in cut]
        counts = np.array([sum(map(len, p)) for p in parts], np.int64)
        flat = [x for p in parts for x in p]
        return (np.concatenate(flat) if flat else np.empty(0, np.int32)), counts


_loaded: dict[str, BytePairs] = {}


def pairs_of(path: str) -> BytePairs:
    """The merge table of ``path``, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def _blocks(batch: pa.RecordBatch, chars: int = 4_000_000):
    """Slices of a batch with about ``chars`` bytes of text each, at least one row."""
    size = np.array([len(x) if x else 0 for x in batch.column(1).cast(pa.binary()).to_pylist()], np.int64)
    block = np.cumsum(size) // chars
    for k in np.unique(block):
        rows = np.flatnonzero(block == k)
        yield batch.slice(rows[0], len(rows))


def encode(docs: DataFrame, key: str, text: str, path: str = VOCABULARY, sizes_only: bool = False) -> DataFrame:
    """(``key``, ids array<int>) of every row, or with ``sizes_only`` (``key``, n_tokens long).

    Null and empty texts have an empty list (0 tokens); strings of special tokens are ordinary text; repeated rows and
    keys, also null ones, come out as often as they went in; other columns are not read. Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    docs.sparkSession.sparkContext.addFile(path)  # executors need no copy of their own

    def run(batches):
        table = pairs_of(SparkFiles.get(Path(path).name))
        for whole in batches:
            for batch in _blocks(whole):
                ids, counts = table.encode(batch.column(1).to_pylist())
                if sizes_only:
                    out = pa.array(counts)
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), out], [key, "n"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n {'long' if sizes_only else 'array<int>'}").withColumnRenamed("n", "n_tokens" if sizes_only else "ids")
