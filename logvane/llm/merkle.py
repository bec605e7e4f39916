"""Merkle manifest of a table of documents: a tree of SHA-256 midstates.

Every document is a leaf. Per source, leaves ascend by doc_id; three consecutive nodes become their
hash, level by level, until one is left, the source's subroot. The subroots, ordered by source, give
the root the same way. A parent keeps the hash state before each child slot. To see what a changed
document does to the root, folding resumes the state before its slot with the new digest and the
siblings to its right; nothing to its left is read again.

How it is spread: leaves get their place by a range sort and offsets per sorted part. Blocks of
3 ** `height` consecutive nodes are aligned with the tree, so each is climbed by one task whatever
the source's size, and only block tops go on to the next round. A task holds one chunk of whole
blocks. States, siblings and half-read proofs are columns, so the upper rounds may run elsewhere.

Defined results: a null or absent field is hashed as `-`; a null source is a source of its own and
comes first; null doc_ids come first within a source. Documents with the same doc_id stand in the
order of their leaves, and equal leaves are interchangeable. An empty table gives no rows and has no
root. Other columns of the table are not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm import sha
from logvane.llm.common import placed
from logvane.session import stage

FANOUT = 3
#: Levels that one task climbs; 3 ** 8 = 6 561 nodes a block.
HEIGHT = 8
#: A chunk is closed at the end of a block once it has so many rows.
CHUNK_ROWS = 1 << 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of all fields, each as its UTF-8 byte count, a colon and its value, or `-` if null."""
    parts = []
    for field in fields:
        value = field.cast("string")
        said = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(said, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, changed_text: Column | None = None) -> DataFrame:
    """doc_id, tree (the source; sorts as sources do, null first), leaf, the leaf with `changed_text`,
    and a salt that parts equal leaves."""
    fields = [F.col(f"`{c}`") for c in FIELDS]
    changed = F.lit(None)
    if changed_text is not None:
        changed = F.when(changed_text.isNotNull(), leaf_digest([*fields[:-1], changed_text]))
    tree = F.when(fields[1].isNull(), "").otherwise(F.concat(F.lit("="), fields[1]))
    return docs.select(
        fields[0].alias("doc_id"),
        tree.alias("tree"),
        leaf_digest(fields).alias("leaf"),
        changed.cast("binary").alias("changed"),
        F.rand(0).alias("salt"),
    )


class Level:
    """What each lane (a node of the lowest level) needs to climb one level.

    slot: its ancestor's place among the parent's children; size: number of children; state: the
    parent's retained state before that slot; siblings: the other children, left to right. Lanes
    whose tree is done have size 0.
    """

    def __init__(self, slot: np.ndarray, size: np.ndarray, state: np.ndarray, siblings: list[np.ndarray]):
        self.slot, self.size, self.state, self.siblings = slot, size, state, siblings


def climb(block: np.ndarray, pos: np.ndarray, levels: np.ndarray, digests: np.ndarray):
    """The levels of whole blocks, for every lane, and the digest each lane ends in.

    `block` numbers the blocks and ascends, `pos` ascends by one within a block, from a multiple of
    the block's width; `levels` says how many levels a lane's block is climbed.
    """
    lanes = len(block)
    node = np.arange(lanes)
    found: list[Level] = []
    for k in range(int(levels.max(initial=0))):
        active = levels > k
        run = np.where(active, pos // FANOUT, pos)
        first = np.ones(len(block), bool)
        first[1:] = (block[1:] != block[:-1]) | (run[1:] != run[:-1])
        begins = np.flatnonzero(first)
        parent = np.cumsum(first) - 1
        size = np.diff(np.append(begins, len(block)))
        live = active[begins]
        child = [digests[:, np.minimum(begins + j, len(block) - 1)] for j in range(FANOUT)]
        states = [sha.starts(len(begins))]
        for j in range(FANOUT):
            states.append(sha.absorb(states[-1], child[j], live & (size > j)))
        above = np.where(live, sha.close(states[-1], size, live), child[0])
        slot = np.arange(len(block)) - begins[parent]
        own, at = parent[node], slot[node]
        state = np.choose(at, [s[:, own] for s in states[:FANOUT]])
        siblings = [
            np.where(at > j, child[j][:, own], child[j + 1][:, own]) for j in range(FANOUT - 1)
        ]
        found.append(Level(at, np.where(active[node], size[own], 0), state, siblings))
        node = own
        block, pos, levels, digests = block[begins], run[begins], levels[begins], above
    return found, digests[:, node]


def fold(value: np.ndarray, level: Level) -> np.ndarray:
    """The parents' digests if their child in the lane's slot were `value`."""
    on = level.size > 0
    state = sha.absorb(np.where(on, level.state, value), value, on)
    for j, sibling in enumerate(level.siblings):
        state = sha.absorb(state, sibling, on & (j >= level.slot) & (j + 1 < level.size))
    return sha.close(state, level.size, on)


def prove(state: np.ndarray, n_blocks: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Running hashes of all siblings met so far, and how many those are."""
    for j, sibling in enumerate(level.siblings):
        state = sha.absorb(state, sibling, j + 1 < level.size)
    return state, n_blocks + np.maximum(level.size - 1, 0)


def _height(n: np.ndarray, most: int) -> np.ndarray:
    """Levels until one of `n` nodes is left, `most` at most."""
    out = np.zeros(len(n), np.int64)
    for _ in range(most):
        out += n > 1
        n = -(-n // FANOUT)
    return out


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows that end where a block ends."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = _new_block(whole)[-1]
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
        count -= cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _new_block(table: pa.Table) -> np.ndarray:
    """The rows that begin a block."""
    runs = pc.run_end_encode(table.column("tree").combine_chunks())
    runs = runs.chunk(0) if isinstance(runs, pa.ChunkedArray) else runs
    inside = np.diff(table.column("block").to_numpy(), prepend=-1) != 0
    inside[np.asarray(runs.run_ends)[:-1]] = True
    return np.flatnonzero(inside)


def _climbed(table: pa.Table, height: int):
    begins = _new_block(table)
    block = np.zeros(table.num_rows, np.int64)
    block[begins[1:]] = 1
    levels = _height(table.column("n").to_numpy(), height)
    digests = sha.words(table.column("digest").to_pylist())
    return climb(np.cumsum(block), table.column("idx").to_numpy(), levels, digests)


def _in_blocks(nodes: DataFrame, height: int) -> DataFrame:
    width = FANOUT**height
    cut = nodes.withColumn("block", F.expr(f"idx div {width}"))
    return cut.repartition("tree", "block").sortWithinPartitions("tree", "idx")


def _next_round(climbed: DataFrame, height: int) -> DataFrame:
    """One node per block, its top, as input of the next round."""
    width = FANOUT**height
    return climbed.where(F.col("idx") % width == 0).select(
        "tree",
        F.expr(f"idx div {width}").alias("idx"),
        F.expr(f"(n + {width - 1}) div {width}").alias("n"),
        F.col("top").alias("digest"),
    )


PATH = "tree string, idx long, n long, path binary, top binary"


def _store(levels: list[Level], lanes: int) -> list[bytes]:
    """Per lane and level: slot, size, state, siblings."""
    out = [bytearray() for _ in range(lanes)]
    for level in levels:
        state, siblings = sha.raw(level.state), [sha.raw(s) for s in level.siblings]
        for i in np.flatnonzero(level.size):
            size = int(level.size[i])
            out[i] += bytes([level.slot[i], size]) + state[i]
            for sibling in siblings[: size - 1]:
                out[i] += sibling[i]
    return list(map(bytes, out))


def _restore(paths: list[bytes]) -> list[Level]:
    """Stored paths, one per lane, level by level."""
    at = np.zeros(len(paths), np.int64)
    ends = np.array([len(p) for p in paths], np.int64)
    found = []
    none = bytes(32)
    while (at < ends).any():
        slot, size = np.zeros(len(paths), np.int64), np.zeros(len(paths), np.int64)
        state, siblings = [none] * len(paths), [[none] * len(paths) for _ in range(FANOUT - 1)]
        for i in np.flatnonzero(at < ends):
            p, k = paths[i], int(at[i])
            slot[i], size[i], state[i] = p[k], p[k + 1], p[k + 2 : k + 34]
            for j in range(int(size[i]) - 1):
                siblings[j][i] = p[k + 34 + 32 * j : k + 66 + 32 * j]
            at[i] += 2 + 32 * size[i]
        found.append(Level(slot, size, sha.words(state), [sha.words(s) for s in siblings]))
    return found


def paths(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Of every node (tree, idx, n, digest) its whole path to the tree's root, and that root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, CHUNK_ROWS):
            levels, tops = _climbed(table, height)
            columns = [table.column(c).combine_chunks() for c in ("tree", "idx", "n")]
            columns += [pa.array(_store(levels, table.num_rows), pa.binary()), pa.array(sha.raw(tops), pa.binary())]
            yield from pa.table(columns, names=["tree", "idx", "n", "path", "top"]).to_batches()

    here = stage(_in_blocks(nodes, height).mapInArrow(run, PATH))
    most = here.agg(F.max("n")).first()[0] or 0
    if most <= FANOUT**height:
        return here.select("tree", "idx", "path", F.col("top").alias("root"))
    above = paths(_next_round(here, height), height)
    block = F.expr(f"idx div {FANOUT**height}")
    return (
        here.select("tree", "idx", "path", block.alias("_block"))
        .join(above.select("tree", F.col("idx").alias("_block"), F.col("path").alias("_rest"), "root"), ["tree", "_block"])
        .select("tree", "idx", F.concat("path", "_rest").alias("path"), "root")
    )


FOLDED = (
    "doc_id long, tree string, idx long, n long, leaf binary, changed binary, folded binary,"
    " proof binary, n_siblings long, top binary"
)


def _first_round(ranked: DataFrame, height: int) -> DataFrame:
    """Leaves folded as far as their block's top, with the proof read so far."""
    names = ["doc_id", "tree", "idx", "n", "leaf", "changed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, CHUNK_ROWS):
            levels, tops = _climbed(table.append_column("digest", table.column("leaf")), height)
            changed = pc.coalesce(table.column("changed"), table.column("leaf"))
            value = sha.words(changed.to_pylist())
            state, met = sha.starts(table.num_rows), np.zeros(table.num_rows, np.int64)
            for level in levels:
                value = fold(value, level)
                state, met = prove(state, met, level)
            columns = [table.column(c).combine_chunks() for c in names]
            for lanes in (value, state):
                columns.append(pa.array(sha.raw(lanes), pa.binary()))
            columns += [pa.array(met), pa.array(sha.raw(tops), pa.binary())]
            yield from pa.table(columns, names=[*names, "folded", "proof", "n_siblings", "top"]).to_batches()

    return stage(_in_blocks(ranked.select(*names), height).mapInArrow(run, FOLDED))


MANIFEST = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string,"
    " folded_root string, verified boolean, n_siblings long, changed boolean"
)


def manifest(docs: DataFrame, changed_text: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """Per document its leaf, subroot, root, the hash of its proof, and the root its change leads to.

    `changed_text` is the text to verify against the manifest (null: the document as it is).
    The proof of a document is the siblings on its way to the root, level by level, left to right.
    """
    ranked = placed(stage(leaves(docs, changed_text)), "tree", ["doc_id", "leaf", "salt"])
    low = _first_round(ranked, height)
    blocks = paths(_next_round(low, height), height)
    subroots = blocks.where("idx = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")
    )
    ordered = placed(subroots, "tree", ["source"])
    tops = paths(ordered.select("tree", "idx", "n", "digest"), height).select(
        "idx", F.col("path").alias("_last"), F.col("root").alias("_root")
    )
    sources = ordered.select("idx", F.col("source").alias("tree")).join(tops, "idx").drop("idx")
    upper = blocks.join(sources, "tree").select(
        "tree",
        F.col("idx").alias("block"),
        F.concat("path", "_last").alias("path"),
        F.col("root").alias("subroot"),
        F.col("_root").alias("root"),
    )
    joined = low.withColumn("block", F.expr(f"idx div {FANOUT**height}")).join(upper, ["tree", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            known = column["path"].dictionary_encode()
            own = known.indices.to_numpy()
            value, state = sha.words(column["folded"].to_pylist()), sha.words(column["proof"].to_pylist())
            met = column["n_siblings"].to_numpy()
            for level in _restore(known.dictionary.to_pylist()):
                lanes = Level(
                    level.slot[own], level.size[own], level.state[:, own], [s[:, own] for s in level.siblings]
                )
                value = fold(value, lanes)
                state, met = prove(state, met, lanes)
            root = sha.words(column["root"].to_pylist())
            texts = [
                pa.array([d.hex() for d in digests])
                for digests in (
                    column["leaf"].to_pylist(), column["subroot"].to_pylist(), column["root"].to_pylist(),
                    sha.raw(sha.close(state, met)), sha.raw(value),
                )
            ]
            same = pa.array((value == root).all(axis=0))
            changed = column["changed"].is_valid()
            yield pa.RecordBatch.from_arrays(
                [column["doc_id"], *texts, same, pa.array(met), changed],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings", "changed"],
            )

    kept = ["doc_id", "leaf", "changed", "folded", "proof", "n_siblings", "path", "subroot", "root"]
    return joined.select(*kept).mapInArrow(run, MANIFEST)
