"""N-gram Jaccard join by chosen paths: near copies of documents.

A document is the set of its shingles, `SHINGLE` words each (a shorter text is one shingle). Two sets
are linked if their Jaccard similarity is at least `THRESHOLD`.

1. Equal sets are one node from here on. Each set is embedded in `POSITIONS` min-hash tokens, so that
   similar sets share about as many tokens as they are similar.
2. Chosen paths: from the root of each run every set follows the tokens that a hash of the path
   samples, one in `SPLIT` * `POSITIONS` each. A pair of similarity `THRESHOLD` then shares more than
   one branch per level on average, a dissimilar pair fewer, level after level. Sets that have
   followed the same path `DEPTH` levels down share a bucket. Buckets of more than `LIMIT` sets are
   split by `DEPTH` further levels, up to `DEEPEST`.
3. Buckets are brute-forced on the tokens; what may be similar is joined by a spanning forest, not by
   all pairs. A bucket still above `LIMIT` at the deepest level is cut into blocks that meet two by
   two. The runs are repeated until the chance that a pair of similarity `THRESHOLD` shares no
   deepest path in any is below 1 - `RECALL`.
4. Connected sets are compared exactly, all with all, block by block: links are counted, and a
   spanning forest of the exact links gives the classes.

Defined results: null text counts as empty; a text without words is similar to no other document;
rows with equal doc_id and text are one document; class ids are the smallest doc_id of a class, null
only if none has one. An empty table gives no rows; other columns are ignored, `keep_one` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import arrow_map, hash_words, mix, window_hashes
from logvane.llm.components import components
from logvane.session import stage

SHINGLE = 5
THRESHOLD = 0.8
POSITIONS = 128
SPLIT = 0.7
DEPTH, DEEPEST = 3, 6
RECALL = 0.99
#: Sets of a bucket compared in one task at a time.
LIMIT = 1024
#: Sets compared exactly in one task at a time.
EXACT_LIMIT = 256
#: Share of equal tokens from which a pair is compared exactly: the threshold less about five
#: standard deviations of the share.
LIKELY = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / POSITIONS)

_ODD = np.uint64(0xD6E8FEB86659FD93)
_WIDTH = np.uint64(int(2**64 / (SPLIT * POSITIONS)))
_FACTORS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)


def runs() -> int:
    """Repetitions until the target recall: a pair's shared paths are a branching process."""
    alive = 1.0
    for _ in range(DEEPEST):
        alive = 1 - math.exp(-THRESHOLD / SPLIT * alive)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - alive))


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of shingle hashes."""
    words = hash_words((text or "").encode().split())
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(SHINGLE, len(words))))


def _embed(items: np.ndarray) -> np.ndarray:
    """The least value of each of `POSITIONS` hash functions, 32 bits of it."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(items), 2048):
            part = items[start : start + 2048, None] * _FACTORS[None, :]
            np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    return (mix(least) >> np.uint64(32)).astype(np.uint32)


def _sets(docs: DataFrame) -> DataFrame:
    """Per document: its `key`, its text's hash, its set's id, and the set's tokens (null without words)."""

    def work(rows: dict[str, list]):
        ids, sketches = [], []
        for key, text in zip(rows["key"], rows["text"], strict=True):
            items = shingles(text)
            if len(items):
                with np.errstate(over="ignore"):
                    digest = mix(items * _ODD).sum(dtype=np.uint64) ^ np.uint64(len(items))
                ids.append(int(digest.view(np.int64)))
                sketches.append(_embed(items).tobytes())
            else:
                ids.append(key)
                sketches.append(None)
        kept = {c: rows[c] for c in ("doc_id", "key", "said")}
        yield kept | {"set": ids, "sketch": sketches}

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("said"))
    return arrow_map(keyed, work, "doc_id long, key long, said long, set long, sketch binary")


def _tokens(sketches: list[bytes]) -> np.ndarray:
    values = np.frombuffer(b"".join(sketches), np.uint32).reshape(-1, POSITIONS)
    place = np.arange(POSITIONS, dtype=np.uint64) << np.uint64(32)
    return mix(values.astype(np.uint64) | place)


def _follow(tokens: np.ndarray, owner: np.ndarray, path: np.ndarray, levels: int):
    """Paths `levels` further down, with the row of `tokens` each belongs to."""
    for _ in range(levels):
        own, paths = [], []
        for start in range(0, len(owner), 8192):
            at, node = owner[start : start + 8192], path[start : start + 8192]
            mine = tokens[at]
            with np.errstate(over="ignore"):
                row, column = np.nonzero(mine - mix(node)[:, None] < _WIDTH)
                paths.append(mix(node[row] * _ODD + mine[row, column]))
            own.append(at[row])
        owner = np.concatenate(own) if own else owner[:0]
        path = np.concatenate(paths) if paths else path[:0]
    return owner, path


def _first_buckets(reps: DataFrame) -> DataFrame:
    roots = mix(np.arange(1, runs() + 1, dtype=np.uint64))

    def work(rows: dict[str, list]):
        n = len(rows["set"])
        owner = np.repeat(np.arange(n), len(roots))
        owner, path = _follow(_tokens(rows["sketch"]), owner, np.tile(roots, n), DEPTH)
        yield {"bucket": path.view(np.int64), "set": np.array(rows["set"], np.int64)[owner]}

    return arrow_map(reps, work, "bucket long, set long", text="sketch", chunk_bytes=1 << 20)


def _deeper_buckets(rows: DataFrame) -> DataFrame:
    def work(rows: dict[str, list]):
        path = np.array(rows["bucket"], np.int64).view(np.uint64)
        owner, path = _follow(_tokens(rows["sketch"]), np.arange(len(path)), path, DEPTH)
        yield {"bucket": path.view(np.int64), "set": np.array(rows["set"], np.int64)[owner]}

    return arrow_map(rows, work, "bucket long, set long", text="sketch", chunk_bytes=1 << 20)


def _in_blocks(rows: DataFrame, group: str, node: str, limit: int) -> DataFrame:
    """`rows` (with `size`, their group's) once for every pair of blocks their block is in.

    A group of up to `limit` rows is one block that meets itself.
    """
    blocks = F.ceil(F.col("size") / limit).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    others = F.sequence(F.lit(0), blocks - 1)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.select(
        *rows.columns,
        F.struct(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("tile"),
        (F.col("own") != F.least("own", "other")).alias("right"),
    )


def _by_tile(rows: DataFrame, work: Callable, columns: list[str], schema: str) -> DataFrame:
    """Run `work` on the rows of each tile, one tile in memory at a time."""
    flat = rows.select(
        F.xxhash64("tile").alias("tile"),
        (F.col("tile.i") != F.col("tile.j")).alias("crossed"),
        "right",
        *columns,
    )
    dealt = flat.repartition("tile").sortWithinPartitions("tile")
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: dict[str, list] = {name: [] for name, _ in fields}
        size = 0

        def flush():
            nonlocal out, size
            columns_ = [pa.array(np.concatenate(out[f.name]), f.type) for f in arrow]
            out, size = {name: [] for name, _ in fields}, 0
            return pa.RecordBatch.from_arrays(columns_, schema=arrow)

        def take():
            nonlocal size
            if sum(b.num_rows for b in held) > 1:
                found = work(pa.Table.from_batches(held))
                for name, values in found.items():
                    out[name].append(values)
                size += len(next(iter(found.values())))

        for batch in batches:
            tiles = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1], [True]])) if len(tiles) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != tiles[a]:
                    take()
                    held = []
                held.append(batch.slice(a, b - a))
            if size > 10_000:
                yield flush()
        if held:
            take()
        if size:
            yield flush()

    return dealt.mapInArrow(run, schema)


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over rows 0 … n - 1."""
    parent = list(range(n))
    a, b = [], []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for left, right in pairs:
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
    return np.array(a, np.int64), np.array(b, np.int64)


def _likely_links(found: pa.Table) -> dict[str, np.ndarray]:
    """A bucket: a spanning forest of the pairs that share enough tokens."""
    nodes = found.column("set").to_numpy()
    right = found.column("right").to_numpy(zero_copy_only=False)
    crossed = found.column("crossed")[0].as_py()
    values = np.frombuffer(b"".join(found.column("sketch").to_pylist()), np.uint32).reshape(-1, POSITIONS)
    least = math.ceil(LIKELY * POSITIONS)
    linked = np.zeros(len(nodes), bool)

    def pairs():
        for k in range(len(nodes) - 1):
            later = np.arange(k + 1, len(nodes))
            if crossed:
                later = later[right[later] != right[k]]
            equal = (values[later] == values[k]).sum(axis=1, dtype=np.int32)
            match = later[equal >= least]
            if len(match):
                linked[match] = True
                yield np.full(len(match), k), match

    a, b = _forest(len(nodes), pairs())
    return {"a": nodes[a], "b": nodes[b]}


def _exact_links(found: pa.Table) -> dict[str, np.ndarray]:
    """A tile of a component: texts that each set is linked to, and a spanning forest of the links.

    Sets meet as rows of a 0/1 matrix over the shingles that more than one of them has, a slice of
    the shingles at a time.
    """
    nodes = found.column("set").to_numpy()
    right = found.column("right").to_numpy(zero_copy_only=False)
    crossed = found.column("crossed")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in found.column("items").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[inverse] > 1
    number = np.cumsum(counts > 1) - 1
    column, owner = number[inverse[shared]], owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(number[-1]) + 1, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    similar = common >= THRESHOLD * union - 1e-6
    np.fill_diagonal(similar, False)
    similar &= (right[:, None] != right[None, :]) if crossed else (nodes[:, None] != nodes[None, :])
    links = similar @ found.column("texts").to_numpy()
    pair_a, pair_b = np.nonzero(np.triu(similar))
    a, b = _forest(len(nodes), iter([(pair_a, pair_b)]))
    own = np.flatnonzero(links)
    return {
        "a": np.concatenate([nodes[own], nodes[a]]),
        "b": np.concatenate([nodes[own], nodes[b]]),
        "links": np.concatenate([links[own], np.zeros(len(a), np.int64)]),
    }


def _candidates(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets found likely to be similar."""
    rows, forests = _first_buckets(reps), []
    for depth in range(DEPTH, DEEPEST + 1, DEPTH):
        rows = stage(rows)
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        sized = stage(rows.join(sizes, "bucket"))
        ready = sized if depth + DEPTH > DEEPEST else sized.where(F.col("size") <= LIMIT)
        sketched = _in_blocks(ready, "bucket", "set", LIMIT).join(reps, "set")
        forests.append(_by_tile(sketched, _likely_links, ["set", "sketch"], "a long, b long"))
        rows = _deeper_buckets(sized.where(F.col("size") > LIMIT).join(reps, "set"))
    edges = forests[0]
    for forest in forests[1:]:
        edges = edges.union(forest)
    return edges


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their sets; (set, links) of those linked to other texts; (node, root) of sets with links."""
    sets = stage(_sets(docs))
    whole = sets.where("sketch is not null")
    reps = stage(whole.select("set", "sketch").dropDuplicates(["set"]))
    near = components(_candidates(reps))
    sized = near.join(near.groupBy("root").agg(F.count("*").alias("size")), "root")
    first = stage(whole.groupBy("set").agg(F.min("key").alias("key"), F.count_distinct("said").alias("texts")))
    member = sized.withColumnRenamed("node", "set").join(first, "set")
    keyed = docs.select("text", F.xxhash64("doc_id", "text").alias("key")).dropDuplicates(["key"])

    def work(rows: dict[str, list]):
        items = [shingles(text).tobytes() for text in rows["text"]]
        yield {name: rows[name] for name in ("set", "root", "size", "texts")} | {"items": items}

    texts = keyed.join(member, "key")
    items = arrow_map(texts, work, "set long, root long, size long, texts long, items binary")
    tiles = _in_blocks(items, "root", "set", EXACT_LIMIT)
    exact = stage(_by_tile(tiles, _exact_links, ["set", "texts", "items"], "a long, b long, links long"))
    others = exact.where("a = b").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("others"))
    # different texts of one set are linked too
    linked = first.join(others, "set", "left").select("set", (F.col("texts") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return sets, linked.where("links > 0"), components(exact.select("a", "b"))


def classes(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, `key`, `class_id`, `n_links` (other texts it is linked to)."""
    sets, links, roots = similar_sets(docs.select("doc_id", "text"))
    placed = (
        sets.select("doc_id", "key", "set")
        .join(roots.withColumnRenamed("node", "set"), "set", "left")
        .join(links, "set", "left")
        .withColumn("root", F.coalesce("root", "set"))
    )
    least = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least, "root").select(
        "doc_id", "key", "root", "class_id", F.coalesce("links", F.lit(0)).alias("n_links")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each class the row of smallest doc_id, with all columns."""
    found = classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias("_key"))
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_key"))
    return rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
