"""How far the sources of each language differ in their words: an audit by inverted index.

The index is built in a single pass. A task takes texts in until they fill `BLOCK_BYTES`, makes the
block's postings (term, language, source, count, with the language's own total and number of documents
per term) and spills them as a run, sorted by term, cut by hash into shards and those into parts. Per
shard the runs are heap-merged, each read part by part, at most `FAN_IN` at a time (more runs: another
round). A term in too few documents is dropped there. Counts then become exact shares, and pairs of sources of
one language get their sum over all kept terms as: what two sources without any term would differ
by, corrected once per count of either source, corrected once more per term that both have. Only the
last of these meets postings; they are streamed, and each task adds pairs up in memory.

A source's terms are grouped per (language, term) in blocks of `SOURCES` sources, two blocks at a
time, so a term of all sources is no unbounded group. The pairs themselves are what is asked for.

Defined results: null text, language or source counts as ''. A group without kept terms takes part
with count 0 everywhere; where a language keeps no term, its pairs have value 0 and there are no
term rows. Equal values are ranked by the item's UTF-8 bytes. Repeated rows count as often as they
stand there. An empty table gives no rows. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logvane.llm.common import whole_text
from logvane.operators.prefix import top_per_group
from logvane.session import stage

FEWEST_DOCUMENTS = 10
SHARE = 1_000_000_000
TOP_TERMS = 10
#: Bytes of text whose postings a task holds before it spills a run.
BLOCK_BYTES = 12 << 20
#: Postings of one part of a run, and runs that are merged at once: what a merge holds in memory.
PART_POSTINGS = 8_000
FAN_IN = 256
#: Terms that a merge passes on at once.
MERGED_TERMS = 4_096
#: Sources of a language that are paired in one go.
SOURCES = 1024
#: Tasks that share the pairs of one language.
SALTS = 16
#: Cells of pairs that a task adds up before it passes them on.
CELLS = 1 << 22

#: Letters to small letters, bytes beyond ASCII as they are, all else to spaces.
_TERMS = bytes(
    c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def terms(text: str) -> bytes:
    """Runs of letters A-Z, a-z and characters beyond ASCII, only A-Z lower-cased, with spaces between."""
    return text.encode().translate(_TERMS)


class Postings:
    """Terms in order; per term its languages with documents and occurrences, and its groups with occurrences.

    `lang_ends` and `group_ends` say where a term's entries end. Languages are ids into `langs`, groups
    ids into `groups`, a list of (language, source).
    """

    def __init__(self, names, langs, groups, lang_ends, lang, documents, totals, group_ends, group, counts):  # noqa: ANN001
        self.names, self.langs, self.groups = names, langs, groups
        self.lang_ends, self.lang, self.documents, self.totals = lang_ends, lang, documents, totals
        self.group_ends, self.group, self.counts = group_ends, group, counts

    def pick(self, at: np.ndarray) -> Postings:
        """The terms at these places, in this order."""
        lang_ends, i = _ranges(self.lang_ends, at)
        group_ends, j = _ranges(self.group_ends, at)
        return Postings(
            self.names.take(pa.array(at)), self.langs, self.groups, lang_ends, self.lang[i], self.documents[i],
            self.totals[i], group_ends, self.group[j], self.counts[j],
        )


def _ranges(ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and places of the entries of the terms at `at`; `ends` begins with a 0."""
    begins, size = ends[at], ends[at + 1] - ends[at]
    new = np.concatenate([[0], np.cumsum(size)])
    return new, np.repeat(begins - new[:-1], size) + np.arange(new[-1])


def _ends(term: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n))]).astype(np.int64)


def _block(rows: list[tuple[str, str, bytes]]) -> Postings | None:
    """Postings of some documents (language, source, terms); None if they have no term."""
    langs = {g: i for i, g in enumerate(dict.fromkeys(g for g, _, _ in rows))}
    groups = {k: i for i, k in enumerate(dict.fromkeys((g, s) for g, s, _ in rows))}
    text = np.frombuffer(b" ".join([b"", *[t for *_, t in rows], b""]), np.uint8)
    inside = text != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begins, ends = edges[0::2], edges[1::2]
    if not len(begins):
        return None
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(text[inside])]
    ).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    term = rank[words.indices.to_numpy()]
    starts = np.cumsum([1] + [len(t) + 1 for *_, t in rows[:-1]])
    document = np.searchsorted(starts, begins, side="right") - 1
    lang_of = np.array([langs[g] for g, *_ in rows])
    group_of = np.array([groups[g, s] for g, s, _ in rows])
    n = len(rank)
    found, counts = np.unique(term * len(groups) + group_of[document], return_counts=True)
    spoken, totals = np.unique(term * len(langs) + lang_of[document], return_counts=True)
    once = np.unique(term * len(rows) + document)
    _, documents = np.unique(once // len(rows) * len(langs) + lang_of[once % len(rows)], return_counts=True)
    return Postings(
        words.dictionary.take(order), list(langs), list(groups),
        _ends(spoken // len(langs), n), spoken % len(langs), documents, totals,
        _ends(found // len(groups), n), found % len(groups), counts,
    )


RUNS = "shard int, run string, part int, first binary, names string, data binary"
_RUNS = pa.schema(
    [("shard", pa.int32()), ("run", pa.string()), ("part", pa.int32()), ("first", pa.binary()), ("names", pa.string()), ("data", pa.binary())]
)
_FAST = pa.ipc.IpcWriteOptions(compression="zstd")


def _part(shard: int, run: str, part: int, p: Postings) -> dict:
    """One row of a run, with only those languages and groups that its postings name."""
    langs, lang = np.unique(p.lang, return_inverse=True)
    groups, group = np.unique(p.group, return_inverse=True)
    columns = {"term": p.names}
    for name, ends, values in (
        ("lang", p.lang_ends, lang), ("documents", p.lang_ends, p.documents), ("totals", p.lang_ends, p.totals),
        ("group", p.group_ends, group), ("counts", p.group_ends, p.counts),
    ):
        columns[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_FAST) as writer:
        writer.write_table(table)
    names = json.dumps([[p.langs[i] for i in langs], [p.groups[i] for i in groups]])
    return {
        "shard": shard, "run": run, "part": part, "first": p.names[0].as_py(), "names": names,
        "data": sink.getvalue().to_pybytes(),
    }


def _parts(shard: int, run: str, p: Postings, first: int = 0) -> list[dict]:
    """Parts of about `PART_POSTINGS` postings."""
    size = p.lang_ends[1:] + p.group_ends[1:]
    cut = np.searchsorted(size, np.arange(PART_POSTINGS, size[-1], PART_POSTINGS)) if len(size) else []
    bounds = np.unique([0, *(np.asarray(cut) + 1), len(size)])
    return [
        _part(shard, run, first + k, p.pick(np.arange(a, b)))
        for k, (a, b) in enumerate(zip(bounds, bounds[1:]))
    ]


def _spill(p: Postings, run: str, shards: int) -> Iterator[pa.RecordBatch]:
    """One run: per shard its postings in the order of terms, in parts."""
    shard = np.fromiter(map(zlib.crc32, p.names.to_pylist()), np.int64, len(p.names)) % shards
    order = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[order], np.arange(shards + 1))
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a < b:
            yield pa.RecordBatch.from_pylist(_parts(k, run, p.pick(order[a:b])), _RUNS)


def runs(docs: DataFrame, shards: int, block: int = BLOCK_BYTES) -> DataFrame:
    """Term-sorted runs of `docs`, cut into shards and parts."""
    slim = docs.select(
        whole_text("lang").alias("lang"), whole_text("source").alias("source"), whole_text("text").alias("text")
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        held: list[tuple[str, str, bytes]] = []
        size = 0

        def spill() -> Iterator[pa.RecordBatch]:
            found = _block(held)
            if found is not None:
                yield from _spill(found, f"{task}-{n}", shards)

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for lang, source, text in zip(*(c.slice(k, 256).to_pylist() for c in batch.columns)):
                    held.append((lang, source, terms(text)))
                    size += len(text)
                    if size >= block:
                        yield from spill()
                        held, size, n = [], 0, n + 1
        if held:
            yield from spill()

    return slim.mapInArrow(index, RUNS)


class Names:
    """Ids of the languages and groups that a merge meets."""

    def __init__(self) -> None:
        self.langs: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}

    def open(self, row: dict) -> Postings:
        langs, groups = json.loads(row["names"])
        lang_ids = np.array([self.langs.setdefault(g, len(self.langs)) for g in langs])
        group_ids = np.array([self.groups.setdefault((g, s), len(self.groups)) for g, s in groups])
        table = pa.ipc.open_stream(row["data"]).read_all().combine_chunks()
        c = {name: table.column(name).chunk(0) for name in table.column_names}
        ends = {name: c[name].offsets.to_numpy().astype(np.int64) for name in ("lang", "group")}
        flat = {name: c[name].flatten().to_numpy() for name in table.column_names[1:]}
        return Postings(
            c["term"], self.langs, self.groups, ends["lang"], lang_ids[flat["lang"]], flat["documents"],
            flat["totals"], ends["group"], group_ids[flat["group"]], flat["counts"],
        )


class _Cursor:
    """A part that a merge has opened: its terms, how many documents each has, and which are taken."""

    def __init__(self, postings: Postings):
        self.postings = postings
        self.terms = postings.names.to_pylist()
        seen = np.concatenate([[0], np.cumsum(postings.documents)])
        self.documents = np.diff(seen[postings.lang_ends]).tolist()
        self.at = 0
        self.taken: list[int] = []
        self.places: list[int] = []


def _merged(rows: Iterator[dict], fewest: int = 0) -> Iterator[Postings]:
    """Postings of all runs in the order of terms, `MERGED_TERMS` at a time; `rows` are parts by first term.

    A heap holds the next term of every open part, and a part is opened only when the merge reaches its
    first term, so one part of each run is held at a time. Terms in fewer than `fewest` documents, of all
    languages together, are left out.
    """
    names = Names()
    heap: list[tuple[bytes, int, _Cursor]] = []
    opened = 0
    ahead = next(rows, None)
    held: list[bytes] = []
    taking: set[_Cursor] = set()
    while heap or ahead is not None:
        while ahead is not None and (not heap or ahead["first"] <= heap[0][0]):
            cursor = _Cursor(names.open(ahead))
            heapq.heappush(heap, (cursor.terms[0], opened, cursor))
            opened += 1
            ahead = next(rows, None)
        term = heap[0][0]
        same: list[tuple[_Cursor, int]] = []
        documents = 0
        while heap and heap[0][0] == term:
            _, order, cursor = heap[0]
            same.append((cursor, cursor.at))
            documents += cursor.documents[cursor.at]
            cursor.at += 1
            if cursor.at < len(cursor.terms):
                heapq.heapreplace(heap, (cursor.terms[cursor.at], order, cursor))
            else:
                heapq.heappop(heap)
        if documents >= fewest:
            for cursor, at in same:
                cursor.taken.append(at)
                cursor.places.append(len(held))
                taking.add(cursor)
            held.append(term)
            if len(held) == MERGED_TERMS:
                yield _added(held, taking, names)
                held, taking = [], set()
    if held:
        yield _added(held, taking, names)


def _added(held: list[bytes], taking: set[_Cursor], names: Names) -> Postings:
    """Postings of the held terms, those of the same language or group added up."""
    entries: list[list[np.ndarray]] = [[], [], [], [], []]
    n_langs, n_groups = len(names.langs), len(names.groups)
    for cursor in taking:
        at, place = np.array(cursor.taken), np.array(cursor.places)
        own = cursor.postings.pick(at)
        entries[0].append(np.repeat(place, np.diff(own.lang_ends)) * n_langs + own.lang)
        entries[1].append(own.documents)
        entries[2].append(own.totals)
        entries[3].append(np.repeat(place, np.diff(own.group_ends)) * n_groups + own.group)
        entries[4].append(own.counts)
        cursor.taken, cursor.places = [], []
    lang, documents, totals, group, counts = map(np.concatenate, entries)
    (lang, documents, totals), (group, counts) = _sums(lang, documents, totals), _sums(group, counts)
    n = len(held)
    return Postings(
        pa.array(held, pa.binary()), list(names.langs), list(names.groups),
        _ends(lang // n_langs, n), lang % n_langs, documents, totals,
        _ends(group // n_groups, n), group % n_groups, counts,
    )


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return key[begins], *[np.add.reduceat(v[order], begins) for v in values]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one; a batch of parts is opened in small pieces."""
    for batch in batches:
        for k in range(0, batch.num_rows, 16):
            yield from batch.slice(k, 16).to_pylist()


def _sorted(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first")


def _merge_round(parts: DataFrame, groups: int) -> DataFrame:
    """Merge the runs of each shard into `groups` runs."""
    dealt = parts.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard, name), rows in groupby(_rows(batches), itemgetter("shard", "run")):
            n = 0
            for postings in _merged(rows):
                made = _parts(shard, name, postings, n)
                n += len(made)
                yield pa.RecordBatch.from_pylist(made, _RUNS)

    return _sorted(dealt, "shard", "run").mapInArrow(run, RUNS)


FREQUENCIES = "lang string, term string, source string, count long, total long"


def frequencies(
    docs: DataFrame, fewest: int = FEWEST_DOCUMENTS, shards: int | None = None,
    block: int = BLOCK_BYTES, fan_in: int = FAN_IN,
) -> DataFrame:
    """Per kept term: one row with a null source for the language, and one per source that has it.

    `count` is the number of occurrences there, `total` that of the language.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = stage(runs(docs, shards, block))
    n_runs = parts.select("run").distinct().count()
    while n_runs > fan_in:
        n_runs = -(-n_runs // fan_in)
        parts = stage(_merge_round(parts, n_runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_rows(batches), itemgetter("shard")):
            for postings in _merged(rows, fewest):
                yield from _kept(postings, fewest)

    return _sorted(parts, "shard").mapInArrow(run, FREQUENCIES)


def _kept(p: Postings, fewest: int) -> Iterator[pa.RecordBatch]:
    """Rows of `FREQUENCIES` for the terms that a language keeps."""
    n_langs = len(p.langs)
    names = p.names.cast(pa.string())
    langs = pa.array(p.langs, pa.string())
    kept = p.documents >= fewest
    term = np.repeat(np.arange(len(names)), np.diff(p.lang_ends))[kept]
    key, total = term * n_langs + p.lang[kept], p.totals[kept]
    if not len(key):
        return
    ids = {g: i for i, g in enumerate(p.langs)}
    lang_of = np.array([ids[g] for g, _ in p.groups])
    sources = pa.array([s for _, s in p.groups], pa.string())
    own = np.repeat(np.arange(len(names)), np.diff(p.group_ends)) * n_langs + lang_of[p.group]
    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
    here = key[at] == own
    for keys, source, count, whole in (
        (key, pa.nulls(len(key), pa.string()), total, total),
        (own[here], sources.take(pa.array(p.group[here])), p.counts[here], total[at[here]]),
    ):
        columns = [langs.take(pa.array(keys % n_langs)), names.take(pa.array(keys // n_langs)), source, pa.array(count), pa.array(whole)]
        batch = pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "count", "total"])
        for k in range(0, batch.num_rows, 10_000):
            yield batch.slice(k, 10_000)


def share(count: str, size: str) -> Column:
    """1 + floor(SHARE * (count + 2) / size), digit by digit to base 1000 so that nothing overflows."""
    digits, rest = "0L", f"({count} + 2L)"
    for _ in range(3):
        digits = f"({digits} * 1000 + ({rest} * 1000) div {size})"
        rest = f"(({rest} * 1000) % {size})"
    return F.expr(f"1 + {digits}")


def distance(p: str, q: str) -> str:
    """floor((p - q) ** 2 / (p + q)) in SQL; shares stay below 2 ** 31, so the square fits."""
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def groups_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every (lang, source): n, the kept terms' occurrences there; whole, those of the language; v, kept terms."""
    every = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source")).distinct()
    own = found.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("count").alias("n"))
    langs = found.where("source IS NULL").groupBy("lang").agg(F.sum("total").alias("whole"), F.count("*").alias("v"))
    nothing = F.lit(0).cast("long")
    return (
        every.join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, nothing).alias(c) for c in ("n", "whole", "v")])
    )


SUMS = "lang string, a string, b string, value long"


def both_have(postings: DataFrame, groups: DataFrame, sources: int = SOURCES) -> DataFrame:
    """Per pair of sources (a < b) the correction summed over the terms that both have.

    For a term with shares p and q where a source without it would have p0 and q0, the pair's value
    changes by f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) beyond what either count has changed.
    """
    cut = groups.groupBy("lang").agg((F.count("*") / sources).cast("int").alias("more"))
    block = F.expr("pmod(xxhash64(source), more + 1)")
    dealt = (
        postings.join(cut, "lang")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("more").cast("long"))))
    )
    grouped = dealt.groupBy(
        "lang", "term", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    ).agg(F.collect_list(F.struct("source", "block", "p", "p0")).alias("have"))
    lists = grouped.where(F.size("have") > 1).select(
        "lang", "low", "high", *[F.col(f"have.{c}").alias(c) for c in ("source", "block", "p", "p0")]
    )

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple, tuple[dict, np.ndarray]] = {}
        cells = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, *_), (names, sums) in tables.items():
                known = np.array(list(names), object)
                i, j = np.nonzero(sums)
                swap = np.array([x.encode() > y.encode() for x, y in zip(known[i], known[j])], bool)
                a, b = np.where(swap, j, i), np.where(swap, i, j)
                for k in range(0, len(a), 10_000):
                    part = slice(k, k + 10_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(a[part]), pa.string()),
                            *[pa.array(known[x[part]], pa.string()) for x in (a, b)],
                            pa.array(sums[i[part], j[part]], pa.int64()),
                        ],
                        names=["lang", "a", "b", "value"],
                    )

        for batch in batches:
            columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            lists = columns["source"]
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = {c: columns[c].flatten() for c in ("source", "block", "p", "p0")}
            sources, blocks = flat["source"].to_pylist(), flat["block"].to_numpy()
            p, p0 = flat["p"].to_numpy(), flat["p0"].to_numpy()
            keys = list(zip(*(columns[c].to_pylist() for c in ("lang", "low", "high"))))
            for row, (key, lo, hi) in enumerate(zip(keys, ends, ends[1:])):
                if key not in tables:
                    tables[key] = ({}, np.zeros((64, 64), np.int64))
                names, sums = tables[key]
                ids = np.array([names.setdefault(s, len(names)) for s in sources[lo:hi]])
                if len(names) > len(sums):
                    cells -= sums.size
                    grown = np.zeros((2 * len(names),) * 2, np.int64)
                    grown[: len(sums), : len(sums)] = sums
                    tables[key] = (names, sums := grown)
                    cells += sums.size
                i, j = np.triu_indices(hi - lo, 1)
                if key[1] != key[2]:  # within one block the pairs belong to that block's own turn
                    apart = blocks[lo:hi][i] != blocks[lo:hi][j]
                    i, j = i[apart], j[apart]
                a, b, a0, b0 = p[lo:hi][i], p[lo:hi][j], p0[lo:hi][i], p0[lo:hi][j]
                sums[ids[i], ids[j]] += f(a, b) - f(a, b0) - f(a0, b) + f(a0, b0)
            if cells > CELLS:
                yield from flush()
                tables, cells = {}, 0
        yield from flush()

    sums = lists.mapInArrow(run, SUMS)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, fewest: int = FEWEST_DOCUMENTS, top: int = TOP_TERMS, sources: int = SOURCES, **how
) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others, and its own terms.

    Part `pair`: every other source of the language and how far its shares of the kept terms differ.
    Part `term`: the `top` kept terms that the source has more of than its language as a whole.
    """
    found = stage(frequencies(docs, fewest, **how))
    groups = stage(
        groups_of(docs, found)
        .withColumn("size", F.greatest(F.expr("n + 2 * v"), F.lit(1)))
        .withColumn("p0", share("0", "size"))
    )
    rows = found.where("source IS NOT NULL").join(groups, ["lang", "source"])
    postings = stage(
        rows.withColumn("p", share("count", "size"))
        .withColumn("q", share("total", "(whole + 2 * v)"))
        .select("lang", "source", "term", "count", "p", "p0", "q")
    )
    order = [F.desc("value"), F.col("item").cast("binary")]
    own = postings.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(distance("p", "q")).alias("value")
    )
    first = top_per_group(own, ["lang", "source"], order, top)
    # how often a source has each count: what one source's terms change against any other
    held = postings.groupBy("lang", "source", "count", "p").agg(F.count("*").alias("terms"))
    counted = held.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("held"))
    sides = groups.join(counted, ["lang", "source"], "left").select(
        "lang", "source", "v", "p0", F.coalesce("held", F.expr("cast(array() AS array<struct<p:bigint, terms:bigint>>)")).alias("held")
    )
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    left = sides.select(
        "lang", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("long").alias("salt"), "v",
        *[F.col(c).alias(f"{c}_a") for c in ("source", "p0", "held")],
    )
    right = sides.select("lang", salts.alias("salt"), *[F.col(c).alias(f"{c}_b") for c in ("source", "p0", "held")])
    pairs = left.join(right, ["lang", "salt"]).where("source_a < source_b")
    neither = distance("p0_a", "p0_b")

    def one(held: str, other: str) -> str:
        change = f"x.terms * ({distance('x.p', other)} - {neither})"
        return f"aggregate({held}, 0L, (sum, x) -> sum + {change})"

    alone = pairs.select(
        "lang", F.col("source_a").alias("a"), F.col("source_b").alias("b"),
        F.expr(f"v * {neither} + {one('held_a', 'p0_b')} + {one('held_b', 'p0_a')}").alias("alone"),
    )
    shared = both_have(postings.select("lang", "source", "term", "p", "p0"), groups, sources)
    whole = alone.join(shared, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", (F.col("alone") + F.coalesce("value", F.lit(0))).alias("value")
    )
    both_ways = whole.select(
        "lang", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])), "value"
    )
    pair = both_ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    window = W.partitionBy("lang", "source").orderBy(*order)
    ranked = [x.withColumn("rank", F.row_number().over(window)) for x in (pair, first)]
    return ranked[0].unionByName(ranked[1])
