"""Language-model scores from a log-frequency Bloom filter.

Tokens are words with A to Z lower-cased, then one end per text. Words and pairs of neighbours are
counted over all training documents (`split_mod`): each chunk's counts travel in packed columns and
are added up by sets of hashes. The filter holds, for every word and
every pair, its count quantised on a log scale: level q means a count
of about `BASE` ** (q - 1), and the n-gram is stored once for each level 1 … q. A lookup probes level
after level until one is missing, so an n-gram costs bits by the logarithm of its count, and counts
can only come out too large, by the filter's small error.

The model is a pair model with Dirichlet smoothing towards single words,

    p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU),   p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)),

whose logarithm falls apart into a part that needs only counts that end in w and a part that needs
only c(v). All n-grams that end in one word share a segment of the filter. A segment is broadcast
only up to `SEGMENT_BYTES`; a larger filter is scored one segment after the other, and the parts are
added. The filter grows with the corpus; each worker holds one segment.

The exact single-word score beside it takes the counts of the most frequent words (at most
`FREQUENT`) from one broadcast array and those of all others from a join.

Words are told apart by 64-bit hashes. Defined results: null text counts as empty and is one end;
an empty table gives no rows; without training tokens N, V and all counts are 0; repeated rows give
repeated results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import SPACES, arrow_map, hash_pieces, hash_words, mix, stable_bucket
from logvane.session import stage

SPLIT_MOD = 10
BASE = math.sqrt(2)
PROBES = 6
BITS_PER_ITEM = 10
#: Bits of one block; all levels of an n-gram lie in one block.
BLOCK_BITS = 1 << 18
SEGMENT_BYTES = 64 << 20
MU = 300.0
FREQUENT = 1 << 19
_PRIOR = 0.1
#: Bytes of text for every set of n-grams that is counted in one task, and the least number of sets.
SET_BYTES, LEAST_SETS = 8 << 20, 16
#: N-grams that are laid out at once, and blocks that one task builds together.
LAID_GRAMS, BUILT_BLOCKS = 1 << 20, 32

_END = hash_words([b""])[0] & ~np.uint64(1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text with its end; the lowest bit is 0. And their numbers."""
    parts = [(text or "").encode().lower() for text in texts]
    data = b"\n".join([*parts, bytes(8)])
    is_word = ~_IS_SPACE[np.frombuffer(data, np.uint8, len(data) - 8)]
    edges = np.flatnonzero(np.diff(is_word, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    words = hash_pieces(data, starts, ends - starts) & ~np.uint64(1)
    upto = np.searchsorted(starts, np.cumsum([len(part) + 1 for part in parts]))
    last = upto + np.arange(len(parts))
    out = np.full(len(words) + len(parts), _END)
    inside = np.ones(len(out), bool)
    inside[last] = False
    out[inside] = words
    return out, np.diff(last, prepend=-1)


def contexts(words: np.ndarray) -> np.ndarray:
    """The token before each; a text starts after an end, be it that of the text before."""
    return np.concatenate([[_END], words[:-1]])


#: The high bits of an n-gram's hash are its last word's, and tell its segment.
_WORD_SHIFT = 48


def pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of pairs, with the high bits of the second word; the lowest bit is 1."""
    with np.errstate(over="ignore"):
        own = mix(before * _PAIR + mix(words)) >> np.uint64(64 - _WORD_SHIFT)
    return words >> np.uint64(_WORD_SHIFT) << np.uint64(_WORD_SHIFT) | own | np.uint64(1)


def held_out(doc_id: Column, split_mod: int = SPLIT_MOD) -> Column:
    return stable_bucket(doc_id, split_mod) == 0


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and behind-last place of each run of equal keys."""
    edges = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]]))
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _add_up(found: pa.Table) -> pa.Table:
    """One set of n-grams: the counts of all chunks added."""
    grams, n = (
        np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in found.column(name)])
        for name, kind in (("grams", np.int64), ("counts", np.uint32))
    )
    order = np.argsort(grams)
    grams, n = grams[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return pa.table({"gram": grams[first], "n": np.add.reduceat(n, first)})


def count_ngrams(training: DataFrame) -> DataFrame:
    """`gram` and `n` over all texts.

    Each chunk's n-grams are counted, dealt into sets by hash, as many as the text asks for, and
    travel in packed columns; one task adds up a set.
    """
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = max(LEAST_SETS, -(-size // SET_BYTES))

    def work(rows: dict[str, list]):
        words, _ = tokens(rows["text"])
        grams, n = np.unique(np.concatenate([words, pairs(contexts(words), words)]), return_counts=True)
        number = ((grams >> np.uint64(1)) % np.uint64(sets)).astype(np.int32)
        order = np.argsort(number)
        grams, n, number = grams[order], n[order].astype(np.uint32), number[order]
        cuts = list(_runs(number))
        yield {
            "number": number[[a for a, _ in cuts]],
            "grams": [grams[a:b].tobytes() for a, b in cuts],
            "counts": [n[a:b].tobytes() for a, b in cuts],
        }

    schema = "number int, grams binary, counts binary"
    counted = arrow_map(training.select("text"), work, schema, chunk_bytes=6 << 20)
    return counted.groupBy("number").applyInArrow(_add_up, "gram long, n long")


def _start(grams: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        seed = mix(grams + np.uint64(level) * _PAIR)
        return seed, mix(seed) | np.uint64(1)


def _place(seed: np.ndarray, step: np.ndarray, probe: int) -> np.ndarray:
    """The bit of a probe within its block."""
    with np.errstate(over="ignore"):
        return ((seed + np.uint64(probe) * step) >> np.uint64(20) & np.uint64(BLOCK_BITS - 1)).view(np.int64)


def _build_block(found: pa.Table) -> pa.Table:
    bits = np.zeros(BLOCK_BITS, bool)
    grams = found.column("gram").to_numpy().view(np.uint64)
    top = found.column("level").to_numpy()
    for level in range(1, int(top.max(initial=0)) + 1):
        seed, step = _start(grams[top >= level], level)
        for probe in range(PROBES):
            bits[_place(seed, step, probe)] = True
    return pa.table(
        {
            "segment": pa.array([found.column("segment")[0].as_py()], pa.int64()),
            "block": pa.array([found.column("block")[0].as_py()], pa.int64()),
            "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
        }
    )


#: Bits of an n-gram's hash, after the lowest eight, that tell its block.
_BLOCK_MASK = (1 << (_WORD_SHIFT - 8)) - 1


def _block_of(grams: np.ndarray, blocks: int | np.ndarray) -> np.ndarray:
    return (grams.view(np.int64) >> 8 & _BLOCK_MASK) % blocks


def _lay_out(levelled: DataFrame, blocks: tuple[int, ...]) -> DataFrame:
    """The blocks of the filter as rows; n-grams travel packed, by segment and `BUILT_BLOCKS` blocks."""
    sizes = np.array(blocks)
    groups = -(-sizes // BUILT_BLOCKS)
    before = np.cumsum(groups) - groups

    def packed(grams: np.ndarray, level: np.ndarray) -> pa.RecordBatch:
        segment = (grams.view(np.uint64) >> np.uint64(_WORD_SHIFT)).astype(np.int64) % len(sizes)
        group = before[segment] + _block_of(grams, sizes[segment]) // BUILT_BLOCKS
        order = np.argsort(group)
        grams, level, group, segment = grams[order], level[order], group[order], segment[order]
        cuts = list(_runs(group))
        at = [a for a, _ in cuts]
        columns = [
            pa.array(segment[at]),
            pa.array(group[at]),
            pa.array([grams[a:b].tobytes() for a, b in cuts], pa.binary()),
            pa.array([level[a:b].tobytes() for a, b in cuts], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["segment", "group", "grams", "levels"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(tuple(batch.column(name).to_numpy() for name in ("gram", "level")))
            rows += batch.num_rows
            if rows >= LAID_GRAMS:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if rows:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    def build(found: pa.Table) -> pa.Table:
        grams, level = (
            np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in found.column(name)])
            for name, kind in (("grams", np.int64), ("levels", np.int8))
        )
        segment = found.column("segment")[0].as_py()
        block = _block_of(grams, blocks[segment])
        order = np.argsort(block)
        whole = pa.table(
            {
                "segment": np.full(len(grams), segment),
                "block": block[order],
                "gram": grams[order],
                "level": level[order],
            }
        )
        return pa.concat_tables([_build_block(whole.slice(a, b - a)) for a, b in _runs(block[order])])

    placed = levelled.select("gram", F.col("level").cast("byte").alias("level")).mapInArrow(
        pack, "segment long, group long, grams binary, levels binary"
    )
    return placed.groupBy("group").applyInArrow(build, "segment long, block long, bits binary")


class Segment:
    """The n-grams of every word whose hash falls to this segment."""

    def __init__(self, number: int, segments: int, blocks: int):
        self.number, self.segments, self.blocks = number, segments, blocks
        self.bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)

    def mine(self, words: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(_WORD_SHIFT)).astype(np.int64) % self.segments == self.number

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The quantised count of each n-gram: probe levels until one is missing."""
        found, left, level = np.zeros(len(grams), np.int64), np.arange(len(grams)), 0
        block = _block_of(grams, self.blocks) * BLOCK_BITS
        while len(left):
            level += 1
            seed, step = _start(grams[left], level)
            for k in range(PROBES):
                place = block + _place(seed, step, k)
                held = (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).view(bool)
                if not held.all():
                    at = np.flatnonzero(held)
                    left, block, seed, step = left[at], block[at], seed[at], step[at]
            found[left] = level
        return found


@dataclass(frozen=True)
class Model:
    """Totals of the training tokens, and the filter as a staged table of blocks."""

    total: int
    distinct: int
    counts: DataFrame
    filter: DataFrame
    blocks: tuple[int, ...]

    def segment(self, number: int) -> Segment:
        """One segment on the driver, `SEGMENT_BYTES` or one word's n-grams large."""
        out = Segment(number, len(self.blocks), self.blocks[number])
        rows = self.filter.where(F.col("segment") == number).select("block", "bits").toArrow()
        size = BLOCK_BITS // 8
        for block, bits in zip(rows.column("block"), rows.column("bits"), strict=True):
            at = block.as_py() * size
            out.bits[at : at + size] = np.frombuffer(bits.as_buffer(), np.uint8)
        return out


def fit(training: DataFrame) -> Model:
    """Count the training texts and lay the filter out."""
    counts = stage(count_ngrams(training))
    single = F.col("gram").bitwiseAND(1) == 0
    levelled = counts.withColumn(
        "level", (1 + F.floor(F.log("n") / math.log(BASE) + 1e-9)).cast("long")
    )
    total, distinct, items = levelled.agg(
        F.sum(F.when(single, F.col("n"))), F.count(F.when(single, 1)), F.sum("level")
    ).first()
    segments = max(1, -(-(items or 0) * BITS_PER_ITEM // (8 * SEGMENT_BYTES)))
    word_bits = F.shiftrightunsigned("gram", _WORD_SHIFT)
    placed = levelled.withColumn("segment", F.pmod(word_bits, F.lit(segments)).cast("long"))
    sizes = {r.segment: r.items for r in placed.groupBy("segment").agg(F.sum("level").alias("items")).collect()}
    blocks = tuple(max(1, -(-sizes.get(k, 0) * BITS_PER_ITEM // BLOCK_BITS)) for k in range(segments))
    return Model(total or 0, distinct or 0, counts, stage(_lay_out(levelled, blocks)), blocks)


def _sum_by_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def _parts(segment: Segment, totals: tuple[int, int], words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text, what this segment adds to log10 of its probability.

    The contexts of a text are its own tokens, as it starts after an end and ends with one; so a token
    brings its part as a context with it.
    """
    total, distinct = totals
    scale = MU / (total + _PRIOR * (distinct + 1))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    mine = segment.mine(words)
    own = words[mine]

    def count(grams: np.ndarray) -> np.ndarray:
        unique, inverse = np.unique(grams, return_inverse=True)
        level = segment.levels(unique)
        return np.where(level > 0, BASE ** (level - 1.0), 0.0)[inverse]

    joint, single = count(pairs(contexts(words)[mine], own)), count(own)
    value = np.log10(joint + single * scale + _PRIOR * scale) - np.log10(single + MU)
    return _sum_by_text(value, owner[mine], len(lengths))


def _frequent(model: Model) -> tuple[np.ndarray, np.ndarray, int]:
    """The words of count `least` or more, at most `FREQUENT`, with log10(count + 0.1)."""
    singles = model.counts.where(F.col("gram").bitwiseAND(1) == 0).select("gram", "n")
    step = F.floor(8 * F.log2("n")).cast("int")
    steps = sorted(
        ((r.step, r.words) for r in singles.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()),
        reverse=True,
    )
    held, last = 0, None
    for number, words in steps:
        if held + words > FREQUENT:
            break
        held, last = held + words, number
    if last is None:
        return np.zeros(0, np.uint64), np.zeros(0), 0
    rows = singles.where(step >= last).toArrow()
    grams = rows.column("gram").to_numpy().view(np.uint64)
    n = rows.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], np.log10(n[order] + _PRIOR), held


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    grams, logs, _ = _frequent(model)
    frequent = spark.sparkContext.broadcast((grams, logs))
    first = spark.sparkContext.broadcast(model.segment(0))
    totals = total, distinct = model.total, model.distinct

    def work(rows: dict[str, list]):
        known, log_count = frequent.value
        words, lengths = tokens(rows["text"])
        owner = np.repeat(np.arange(len(lengths)), lengths)
        unique, inverse = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(known, unique), max(len(known) - 1, 0))
        is_known = known[at] == unique if len(known) else np.zeros(len(unique), bool)
        value = np.where(is_known, log_count[at], 0.0) if len(known) else np.zeros(len(unique))
        rare = ~is_known[inverse]
        both = np.stack([owner[rare], inverse[rare]], 1)
        rare_pairs, times = np.unique(both[:, 0] * len(unique) + both[:, 1], return_counts=True)
        rare_owner, rare_word = rare_pairs // max(len(unique), 1), unique[rare_pairs % max(len(unique), 1)]
        cuts = np.searchsorted(rare_owner, np.arange(len(lengths) + 1))
        ids = rare_word.view(np.int64)
        yield {
            "doc_id": rows["doc_id"],
            "key": rows["key"],
            "n_tokens": lengths,
            "known": _sum_by_text(is_known[inverse].astype(float), owner, len(lengths)).astype(np.int64),
            "base": _sum_by_text(value[inverse], owner, len(lengths)),
            "part": _parts(first.value, totals, words, lengths),
            "rare": [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
            "times": [times[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
        }

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    found = arrow_map(
        keyed,
        work,
        "doc_id long, key long, n_tokens long, known long, base double, part double,"
        " rare array<long>, times array<long>",
        chunk_bytes=3 << 20,
    )
    # written once, so that a row keeps its number
    found = stage(found.withColumn("row", F.monotonically_increasing_id()))
    singles = model.counts.where(F.col("gram").bitwiseAND(1) == 0).select("gram", "n")
    rest = (
        found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
        .select("row", F.col("x.rare").alias("gram"), F.col("x.times").alias("times"))
        .join(singles, "gram", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + _PRIOR)).alias("rare_base"),
            F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"),
        )
    )
    parts = found.drop("rare", "times")
    for number in range(1, len(model.blocks)):
        held = spark.sparkContext.broadcast(model.segment(number))

        def more(rows: dict[str, list], held=held):
            yield {"key": rows["key"], "more": _parts(held.value, totals, *tokens(rows["text"]))}

        extra = arrow_map(keyed, more, "key long, more double", chunk_bytes=3 << 20)
        extra = extra.dropDuplicates(["key"])
        parts = parts.join(extra, "key").withColumn("part", F.col("part") + F.col("more")).drop("more")
    whole = math.log10(total + _PRIOR * (distinct + 1))
    return parts.join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * whole
        ).alias("base_score"),
        F.least(F.col("part"), F.lit(0.0)).alias("score"),
    )
