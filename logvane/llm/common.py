"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logvane.operators.prefix import join_same
from logvane.session import stage

#: The characters between words: space and U+0009 to U+000D. `bytes.split()` cuts at the same six.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def split_words(text: Column) -> Column:
    """Words of a text, in order; no word, no entry."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_RUN, -1))


def computed_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and `columns`, each computed once per row however often it is read later.

    Catalyst copies an expression into every lambda that reads it; it copies nothing through a
    generator, and this one makes exactly one row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def stable_bucket(column: Column, modulus: int) -> Column:
    """crc32 of the value written as text, modulo `modulus`; null counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2 ** 64."""
    steps = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(steps)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: What is left of eight bytes if a piece has 0 … 8 more of them.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer pieces are looked at one by one.
_LONG_PIECE = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _eights(data: bytes, starts: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
    """Up to eight bytes of each piece from its byte `at` on, zeros behind its end."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return eight[starts + at] & _FIRST_BYTES[np.minimum(sizes - at, 8)]


def hash_pieces(data: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of pieces of `data`, eight bytes of all of them at once; eight bytes follow the last."""
    with np.errstate(over="ignore"):
        out = mix(sizes.astype(np.uint64) * _STEP ^ _eights(data, starts, sizes, 0) ^ np.uint64(seed))
        left = np.flatnonzero(sizes > 8)
        for at in range(8, _LONG_PIECE, 8):
            out[left] = mix(out[left] * _STEP ^ _eights(data, starts[left], sizes[left], at))
            left = left[sizes[left] > at + 8]
    for k in left.tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]], seed)
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each run of `size` consecutive word hashes, modulo 2 ** 64.

    Prefix sums of hash * base ** i give the polynomial of any window as one difference; the
    inverse power moves it back to position 0, so equal windows hash alike wherever they stand.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_BASE, len(hashes)))])
        return mix((sums[size:] - sums[:-size]) * powers(_INVERSE, n))


def arrow_map(
    df: DataFrame,
    work: Callable[[dict[str, list]], Iterable[dict]],
    schema: str | StructType,
    chunk_bytes: int = 8 << 20,
    text: str = "text",
) -> DataFrame:
    """Run `work` on chunks of rows (columns as lists) until a chunk's texts reach `chunk_bytes`.

    A task holds one chunk at a time. `work` yields dicts of equally long columns.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for out in work(held):
                columns = [pa.array(out[f.name], f.type, from_pandas=False) for f in arrow]
                if columns and len(columns[0]):
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for name in part.schema.names:
                    held.setdefault(name, []).extend(part.column(name).to_pylist())
                size += sum(len(x) for x in held[text][-part.num_rows :] if x)
                if size >= chunk_bytes:
                    yield from flush()
                    held, size = {}, 0
        if held:
            yield from flush()

    return df.mapInArrow(run, schema)


class Memory:
    """What a Python worker has computed, by text; what it has not met for long is forgotten.

    `young` holds what the last chunks asked for. Where it has outgrown the limit when a chunk begins,
    it becomes `old`, from where entries come back when they are asked for again.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def begin(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}

    def missing(self, keys: Iterable[str]) -> list[str]:
        """Keys that must be computed and put into `young`, which then has all of `keys`."""
        absent = set(filterfalse(self.young.__contains__, keys))
        back = {k: self.old[k] for k in absent if k in self.old}
        self.young.update(back)
        return [k for k in absent if k not in back]


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add `idx`, the row's place within its `key` (from 0), and `n`, the key's number of rows.

    Rows are sorted by range, so those of a large key lie in many parts; each part numbers its own
    rows, and one row per key and part carries the numbers over. Null is a key like any other.
    `order` should end with a column that parts equal rows where there may be very many of them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    schema = ordered.select("*", F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_at")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(batch.schema.get_field_index(key)))
            ends = np.asarray(runs.run_ends)
            begins = np.concatenate([[0], ends[:-1]])
            at = np.arange(batch.num_rows) - np.repeat(begins, ends - begins)
            if runs.values[0].as_py() == last:
                at[: ends[0]] += seen
            last, seen = runs.values[-1].as_py(), int(at[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(at)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_at"])

    numbered = stage(ordered.mapInArrow(number, schema))
    counts = numbered.groupBy(key, "_part").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        key,
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(W.partitionBy(key)).alias("n"),
    )
    both = join_same(numbered, offsets, [key, "_part"])
    return both.withColumn("idx", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")
