"""Benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

Words are lower-cased and cut at white space and ASCII punctuation. A match of the alignment gives 2
points, a mismatch or gap takes 1, and the best local score over that of the whole item is the score.

Seeds lose no alignment that reaches the score. Of an item with n words it has m matches and takes at
most 2 m - 2 n * score points off, so it spans n * (3 - 2 * score) words at most, and at least
n * score - 1 of its neighbouring matches have one other word between them at most: all others take 2
points each. Two words, next to each other or one apart, are a seed, in items as in documents. A
passage is aligned word by word where a document holds so many seeds of an item within that span.
Each item leaves out its commonest seeds, up to half of that number, and asks for so many fewer. For
items of `FEWEST` words and more and n * score > 1, the result is that of aligning every document
with every item.

Test items are the small side. They are read in blocks of at most `BLOCK_WORDS` words, so what is
broadcast has a fixed bound; each block goes over all documents.

Defined results: null or empty texts and items match nothing, nor do items under `FEWEST` words; items
with equal text are reported each; repeated documents give repeated rows; without items no document
is reported, and all are kept. Columns besides doc_id and text are kept as they are.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvane.llm.common import arrow_map, hash_words

#: Words of the shortest item that can match.
FEWEST = 3
MATCH, MISS = 2, 1
#: Least share of an item's best possible score.
SCORE = 0.4
#: Words of test items broadcast at a time; 64 MB at most with hashes and seeds.
BLOCK_WORDS = 1 << 20

_CUT = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def word_hashes(text: str | None) -> np.ndarray:
    return hash_words((text or "").lower().encode().translate(_CUT).split())


_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pair_hashes(words: np.ndarray, distance: int) -> np.ndarray:
    """Hashes of each word with the one `distance` after it."""
    return words[:-distance] * _FIRST + words[distance:] * _SECOND


class Items:
    """A block of test items: word hashes of each, and which of them hold a seed."""

    def __init__(self, rows: list[tuple], least: float):
        self.ids = [item_id for item_id, _ in rows]
        self.words = [word_hashes(text) for _, text in rows]
        n = np.array([len(w) for w in self.words], np.int64)
        #: The longest stretch of a document that an alignment of the least score takes.
        self.reach = np.floor(n + MATCH * n * (1 - least) / MISS + 1e-9).astype(np.int64)
        needed = np.maximum(np.ceil(n * least - 1 - 1e-9).astype(np.int64), 1)
        seeds = [
            np.concatenate([pair_hashes(w, 1), pair_hashes(w, 2)])
            if len(w) >= FEWEST
            else np.zeros(0, np.uint64)
            for w in self.words
        ]
        every, inverse, counts = np.unique(
            np.concatenate([np.zeros(0, np.uint64), *seeds]), return_inverse=True, return_counts=True
        )
        common = np.split(counts[inverse], np.cumsum([len(s) for s in seeds])[:-1])
        left_out = needed // 2
        kept = [
            np.unique(s[np.argsort(c, kind="stable")[: len(s) - k]])
            for s, c, k in zip(seeds, common, left_out.tolist(), strict=True)
        ]
        self.needed = needed - left_out
        seed = np.concatenate([np.zeros(0, np.uint64), *kept])
        item = np.repeat(np.arange(len(rows), dtype=np.int32), [len(k) for k in kept])
        order = np.argsort(seed, kind="stable")
        self.item = item[order]
        self.seed, first, count = np.unique(seed[order], return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        bits = min(max(len(self.seed).bit_length() + 6, 16), 24)
        self.shift = np.uint64(64 - bits)
        self.known = np.zeros(1 << bits, bool)
        self.known[self._slot(self.seed)] = True

    def _slot(self, seeds: np.ndarray) -> np.ndarray:
        return (seeds >> self.shift).astype(np.int64)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, place) of the places of a document that hold a seed of an item, in this order."""
        places, found = [], []
        for distance in (1, 2):
            seeds = pair_hashes(words, distance)
            at = np.flatnonzero(self.known[self._slot(seeds)])
            if len(at):
                row = np.minimum(np.searchsorted(self.seed, seeds[at]), len(self.seed) - 1)
                same = self.seed[row] == seeds[at]
                places.append(at[same])
                found.append(row[same])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, row = np.concatenate(places), np.concatenate(found)
        counts = self.count[row].astype(np.int64)
        which = np.repeat(self.first[row] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = self.item[which].astype(np.int64) * len(words) + np.repeat(place, counts)
        return np.divmod(np.unique(both), len(words))

    def passages(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of the stretches of a document that can hold an alignment."""
        item, place = self.hits(words)
        if not len(item):
            return
        last = np.arange(len(item)) + self.needed[item] - 1
        end = np.minimum(last, len(item) - 1)
        reach = self.reach[item]
        enough = np.flatnonzero(
            (last < len(item)) & (item[end] == item) & (place[end] - place < reach)
        )
        if not len(enough):
            return
        item, reach = item[enough], reach[enough]
        start = np.maximum(place[end[enough]] + 1 - reach, 0)
        stop = np.minimum(place[enough] + reach, len(words))
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] > stop[:-1])])
        begin = np.flatnonzero(new)
        for a, b in zip(begin.tolist(), np.append(begin[1:], len(item)).tolist(), strict=True):
            yield int(item[a]), int(start[a]), int(stop[b - 1])


def _best_end(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the position after its last word in `words`.

    One row per word of the item; a gap along the row is a running maximum.
    """
    steps = np.arange(len(words) + 1, dtype=np.int32) * MISS
    row = np.zeros(len(words) + 1, np.int32)
    best, end = 0, 0
    for word in item:
        scored = row[:-1] + np.where(words == word, MATCH, -MISS)
        new = np.maximum(row - MISS, 0)
        np.maximum(new[1:], scored, out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Score from 0 to 1, and the stretch of `words` (start, end) that is aligned."""
    best, end = _best_end(item, words)
    if not best:
        return 0.0, 0, 0
    _, back = _best_end(item[::-1], words[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items of the benchmark in blocks of bounded size; one block is on the driver at a time."""
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    sized = items.withColumn("_words", F.size(F.split("text", r"\s+")))
    total = sized.agg(F.sum("_words")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield sorted((r.item_id, r.text) for r in rows)


def _seeded(spark: SparkSession, benchmark: DataFrame, least: float) -> Iterator[Broadcast]:
    """Blocks of items with their seeds."""
    for rows in _blocks(benchmark):
        yield spark.sparkContext.broadcast(Items(rows, least))


def _matches(block: Items, text: str | None, least: float) -> Iterator[tuple]:
    words = word_hashes(text)
    for item, start, end in block.passages(words):
        score, a, b = align(block.words[item], words[start:end])
        if score >= least:
            yield block.ids[item], score, start + a, start + b


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, score, and the best passage's words
    (`start`, `end`, counted as words are cut here)."""
    spark = docs.sparkSession
    parts = []
    for items in _seeded(spark, benchmark, least):

        def work(rows: dict[str, list], items=items):
            out = [
                (doc_id, *match)
                for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True)
                for match in _best_by_item(items.value, text, least)
            ]
            names = ("doc_id", "item_id", "score", "start", "end")
            yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {
                name: [] for name in names
            }

        schema = "doc_id long, item_id long, score double, start long, end long"
        parts.append(arrow_map(docs.select("doc_id", "text"), work, schema))
    if not parts:
        schema = "doc_id long, item_id long, score double, start long, end long"
        return spark.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _best_by_item(block: Items, text: str | None, least: float) -> list[tuple]:
    best: dict = {}
    for match in _matches(block, text, least):
        if match[0] not in best or match[1] > best[match[0]][1]:
            best[match[0]] = match
    return list(best.values())


def clean(docs: DataFrame, benchmark: DataFrame, least: float = SCORE) -> DataFrame:
    """The rows of `docs` that hold no test item, with all their columns."""
    for items in _seeded(docs.sparkSession, benchmark, least):

        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [
                    next(_matches(items.value, text, least), None) is None
                    for text in batch.column(batch.schema.get_field_index("text")).to_pylist()
                ]
                yield batch.filter(pa.array(kept, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
