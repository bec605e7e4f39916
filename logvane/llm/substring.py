"""Substring de-duplication: repeated word windows, counted in Spark, merged and removed.

A window is `size` consecutive words of one document (no lower-casing, nothing stripped). Its
Rabin-Karp hash is rolled over 64-bit word hashes. A window is repeated if its hash also starts in
a document with a smaller doc_id; windows that overlap or touch merge into maximal intervals, and
the words in those go.

How the work is dealt out
    Each task hashes bounded chunks of documents. Within a chunk all but the smallest document of
    each hash is decided at once, so however often a line stands in the corpus, a chunk sends each
    of its windows for one document only; no hash gathers more rows than there are chunks. The rest
    travels as packed columns by hash, meets there, and what was found repeated goes back
    by chunk. The text is joined to its intervals once, at the end.

Defined results: null text has no words; a text shorter than a window loses nothing; documents with
the same doc_id don't remove each other's words, but remove those of larger ones; a null doc_id
counts as larger than all; repeated rows give repeated results; an empty table gives no rows.
Columns besides doc_id and text are kept as they are, whatever their names.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logvane.llm.common import arrow_map, hash_words, mix, window_hashes

WINDOW = 13
#: Bytes of text for every set of hashes that meets in one task; about 19 bytes are kept of a window.
BUCKET_BYTES = 8 << 20
_LAST = np.iinfo(np.int64).max
_CHUNK, _LOCAL, _WINDOWS = 0, 1, 2


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side; small numbers leave long runs of zeros to the codec."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: memoryview, kind: type, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind)[:, 0]


def _pack(rest: np.ndarray, at: np.ndarray, doc: np.ndarray) -> bytes:
    """Hashes without what their bucket tells (7 bytes), positions and documents as steps."""
    steps = np.diff(at, prepend=at[:1] * 0).astype(np.uint32)
    jumps = np.diff(doc, prepend=doc[:1] * 0)
    short = rest.view(np.uint8).reshape(-1, 8)[:, :7]
    return short.tobytes() + _planes(steps) + _planes(jumps)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, view = len(blob) // 19, memoryview(blob)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :7] = np.frombuffer(view[: 7 * n], np.uint8).reshape(n, 7)
    at = np.cumsum(_unplanes(view[7 * n : 11 * n], np.uint32, n), dtype=np.int64)
    return wide.view(np.uint64)[:, 0], at, np.cumsum(_unplanes(view[11 * n :], np.int64, n))


def _first_docs(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, the smallest document with its hash."""
    order = np.lexsort((doc, hashes))
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    first = np.empty_like(doc)
    first[order] = np.repeat(doc[order][starts], np.diff(np.append(starts, len(h))))
    return first


def _chunk_rows(size: int, buckets: int):
    def work(rows: dict[str, list]):
        ids = np.array([_LAST if d is None else d for d in rows["doc_id"]], np.int64)
        keys = np.array(rows["_key"], np.int64)
        hashed, counts = [], np.zeros(len(ids), np.int64)
        by_id = np.argsort(ids, kind="stable")
        for k in by_id:
            text = rows["text"][k]
            if text:
                windows = window_hashes(hash_words(text.encode().split()), size)
                counts[k] = len(windows)
                hashed.append(windows)
        counts = counts[by_id]
        if not counts.any():
            return
        hashes, doc = np.concatenate(hashed), np.repeat(ids[by_id], counts)
        sizes = counts.astype(np.int64)
        chunk = int(mix(keys.view(np.uint64) + np.arange(len(keys), dtype=np.uint64)).sum().view(np.int64))
        out = [(chunk % buckets, _CHUNK, keys[by_id].tobytes() + sizes.tobytes())]
        again = _first_docs(hashes, doc) < doc
        if again.any():
            out.append((chunk % buckets, _LOCAL, np.flatnonzero(again).astype(np.uint32).tobytes()))
        left = np.flatnonzero(~again)
        bucket = (hashes[left] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        left, bucket = left[order], bucket[order]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            at = left[a:b]
            out.append((int(bucket[a]), _WINDOWS, _pack(hashes[at] // np.uint64(buckets), at, doc[at])))
        yield {
            "bucket": [b for b, _, _ in out],
            "chunk": [chunk] * len(out),
            "kind": [k for _, k, _ in out],
            "blob": [x for _, _, x in out],
        }

    return work


def _meet(found: pa.Table) -> pa.Table:
    """One range of hashes: which windows start in a smaller document, as positions by chunk."""
    chunks, kinds, blobs = (found.column(c).to_pylist() for c in ("chunk", "kind", "blob"))
    out = [(c, k, b) for c, k, b in zip(chunks, kinds, blobs, strict=True) if k != _WINDOWS]
    own = [c for c, k in zip(chunks, kinds, strict=True) if k == _WINDOWS]
    parts = [_unpack(b) for k, b in zip(kinds, blobs, strict=True) if k == _WINDOWS]
    if parts:
        hashes, at, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        again = _first_docs(hashes, doc) < doc
        ends = np.cumsum([len(p[0]) for p in parts])
        for c, end, part in zip(own, ends, parts, strict=True):
            mine = slice(end - len(part[0]), end)
            if again[mine].any():
                out.append((c, _LOCAL, at[mine][again[mine]].astype(np.uint32).tobytes()))
    return pa.table(
        {
            "chunk": pa.array([c for c, _, _ in out], pa.int64()),
            "kind": pa.array([k for _, k, _ in out], pa.int32()),
            "blob": pa.array([b for _, _, b in out], pa.binary()),
        }
    )


def _back_to_documents(size: int):
    def work(found: pa.Table) -> pa.Table:
        """One chunk: its repeated windows as intervals of words for each document."""
        kinds, blobs = found.column("kind").to_pylist(), found.column("blob").to_pylist()
        layout = next(b for k, b in zip(kinds, blobs, strict=True) if k == _CHUNK)
        keys, counts = np.frombuffer(layout, np.int64).reshape(2, -1)
        lists = [
            np.frombuffer(b, np.uint32) for k, b in zip(kinds, blobs, strict=True) if k == _LOCAL
        ]
        at = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.uint32)
        ends = np.cumsum(counts)
        owner = np.searchsorted(ends, at, side="right")
        place = at.astype(np.int64) - (ends - counts)[owner]
        spans: dict[str, list] = {"_key": [], "starts": [], "ends": []}
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(at) else ():
            p = place[a:b]
            gap = np.flatnonzero(np.diff(p) > size)
            spans["_key"].append(int(keys[owner[a]]))
            spans["starts"].append(p[np.concatenate([[0], gap + 1])].tolist())
            spans["ends"].append((p[np.append(gap, len(p) - 1)] + size).tolist())
        return pa.table(
            {
                "_key": pa.array(spans["_key"], pa.int64()),
                "starts": pa.array(spans["starts"], pa.list_(pa.int64())),
                "ends": pa.array(spans["ends"], pa.list_(pa.int64())),
            }
        )

    return work


def repeated_spans(docs: DataFrame, size: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Per text with repeats: `_key` (hash of doc_id and text), and its intervals of words.

    `buckets` sets of hashes meet in one task each; by default as many as there are `BUCKET_BYTES` of
    text, so a set's size does not grow with the table, and at least 256, so that a byte of each hash
    is saved.
    """
    if not buckets:
        text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = math.ceil(text_bytes / BUCKET_BYTES)
    buckets = max(256, buckets)
    keyed = docs.select("doc_id", "text", _key()).where("text is not null")
    rows = arrow_map(
        keyed, _chunk_rows(size, buckets), "bucket int, chunk long, kind int, blob binary"
    )
    repeated = rows.groupBy("bucket").applyInArrow(_meet, "chunk long, kind int, blob binary")
    spans = repeated.groupBy("chunk").applyInArrow(
        _back_to_documents(size), "_key long, starts array<long>, ends array<long>"
    )
    return spans.dropDuplicates(["_key"])


def _key():
    return F.xxhash64("doc_id", "text").alias("_key")


def _cut(rows: dict[str, list]):
    """Words outside the intervals, joined by one space."""
    out: dict[str, list] = {"row": rows["row"], "n_words": [], "n_removed": [], "kept_text": []}
    for text, starts, ends in zip(rows["text"], rows["starts"], rows["ends"], strict=True):
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for a, b in zip(starts or (), ends or (), strict=True):
            gone[a:b] = True
        out["n_words"].append(len(words))
        out["n_removed"].append(int(gone.sum()))
        kept = compress(words, ~gone) if starts else words
        out["kept_text"].append(b" ".join(kept).decode())
    yield out


def remove_repeats(docs: DataFrame, size: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """Per row of `docs`: `row` (its columns but text), n_words, n_removed, kept_text."""
    spans = repeated_spans(docs, size, buckets)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    whole = docs.select(F.struct(*others).alias("row"), "text", _key())
    joined = whole.join(spans, "_key", "left").select("row", "text", "starts", "ends")
    schema = StructType(
        [
            joined.schema["row"],
            StructField("n_words", LongType()),
            StructField("n_removed", LongType()),
            StructField("kept_text", StringType()),
        ]
    )
    return arrow_map(joined, _cut, schema)
