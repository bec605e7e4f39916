"""Token ids as wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents in ascending doc_id order, each document ended by
`END`. Its ids are bit-planes from the highest bit down; every plane is stably parted by its bits,
zeros first, before the next one is cut. Planes are stored in blocks of `BLOCK` bits, compressed one
by one, beside a directory of the blocks' places and of the ones before each block. Rank and select
read the directory and one block per plane, so that a token, a count or the next occurrence is
answered without unpacking the file.

    8 bytes   b"LVWAVE1\\n"
    4 bytes   length of the header, little-endian
    header    JSON: tokens, documents, planes (zeros of each), and place and length of each section
    sections  compressed: doc ids (int64), doc lengths (int64), per plane block places (int64) and
              ones before each block (int64); then the blocks

Files are written under the folder that `spark.checkpoint.dir` names, through Arrow's file systems,
under a name of their own and moved into place, so a repeated task leaves one whole file.

Defined results: null text counts as empty and gives the end id alone; an empty table gives no
files; documents with equal doc_id stand next to each other, ordered by text; a null doc_id comes
first. Other columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvane.llm.common import arrow_map, hash_pieces
from logvane.session import shared_checkpoint_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 0
MAGIC = b"LVWAVE1\n"
BLOCK = 1 << 16
#: A shard is closed once it holds so many tokens.
SHARD_TOKENS = 4 << 20
#: Pieces of text of which a Python worker keeps the ids, twice as many at most.
REMEMBERED = 500_000
#: Marks that may end a word, and the letters up to here, on which all libraries agree.
_MARKS = b".,;:!?"
_PLAIN_LETTERS = "\u0250"
#: What stands for a space in a byte-level vocabulary.
_SPACE = "\u0120"
_SEED = 0x5851F42D4C957F2D
_IS_LETTER, _IS_MARK = np.zeros(256, bool), np.zeros(256, bool)
_IS_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_IS_MARK[list(_MARKS)] = True
#: Marks and the line feed are one token each.
_SINGLE = _MARKS + b"\n"
_SINGLE_PLACE = np.zeros(256, np.int64)
_SINGLE_PLACE[list(_SINGLE)] = np.arange(len(_SINGLE))
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 4 << 20


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(own))
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


def _taken(pool: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of `pool`, one behind the other."""
    upto = np.cumsum(sizes)
    return pool[np.repeat(places - upto + sizes, sizes) + np.arange(sizes.sum())]


class Known:
    """Ids of pieces by 128-bit hashes (`low` ascending); what has not been met for long is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.now = limit, 0
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.places, self.sizes, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.pool = np.zeros(0, "<u4")

    def begin(self) -> None:
        self.now += 1
        if len(self.low) > 2 * self.limit:
            kept = np.sort(np.argsort(self.met, kind="stable")[-self.limit :])
            self.pool = _taken(self.pool, self.places[kept], self.sizes[kept])
            self.low, self.high, self.sizes, self.met = (
                x[kept] for x in (self.low, self.high, self.sizes, self.met)
            )
            self.places = np.cumsum(self.sizes) - self.sizes

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of them stands, and whether it does."""
        if not len(self.low):
            return np.zeros(len(low), np.int64), np.zeros(len(low), bool)
        at = np.minimum(np.searchsorted(self.low, low), len(self.low) - 1)
        held = (self.low[at] == low) & (self.high[at] == high)
        self.met[at[held]] = self.now
        return at, held

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        places = len(self.pool) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.low, low)
        self.low, self.high = np.insert(self.low, at, low), np.insert(self.high, at, high)
        self.places, self.sizes = np.insert(self.places, at, places), np.insert(self.sizes, at, sizes)
        self.met = np.insert(self.met, at, self.now)
        self.pool = np.concatenate([self.pool, ids])


@dataclass(frozen=True)
class Pieces:
    """Pieces of texts that are encoded by themselves, and what stands around each.

    A piece follows a space (`spaced`) or a line feed, and a mark may follow it.
    """

    data: bytes
    before: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    mark: np.ndarray

    @classmethod
    def of(cls, rests: list[bytes]) -> Pieces:
        """The pieces of texts that begin with a space that a non-space follows."""
        data = b"".join([*rests, b" " * 8])
        raw = np.frombuffer(data, np.uint8, len(data) - 7)
        letter, mark = _IS_LETTER[raw], _IS_MARK[raw]
        stop = raw == ord(" ")
        feed = np.flatnonzero(raw == ord("\n"))
        stop[feed[letter[feed + 1] & (letter[feed - 1] | mark[feed - 1])]] = True
        stops = np.flatnonzero(stop)
        before, ends = stops[:-1], stops[1:]
        marked = mark[ends - 1] & letter[ends - 2]
        return cls(data, before, before + 1, ends - marked, marked)

    @property
    def spaced(self) -> np.ndarray:
        return np.frombuffer(self.data, np.uint8)[self.before] == ord(" ")

    def plain(self) -> np.ndarray:
        """Whether a piece holds nothing but letters from A to z."""
        others = np.cumsum(~_IS_LETTER[np.frombuffer(self.data, np.uint8)], dtype=np.int32)
        return others[self.ends - 1] == others[self.before]


class LibraryEncoder:
    """Whole texts to ids with the tokenizers library.

    The vocabulary's pattern always cuts before a space that a non-space follows, around a single line
    feed between a letter or mark and a letter, and between a letter and a mark. So a text's ids are those
    of its pieces between such places, and the library sees each head and new piece once. A word of
    plain letters is one piece of the pattern, so the library's model gets it at once. Texts with other
    spaces, or with one of the vocabulary's special tokens, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)")
        self.odd_space = re.compile(r" (?:\s|$)")
        self.letters = _byte_letters()
        self.known = Known(REMEMBERED)
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[k for token, k in vocabulary.items() if token.startswith(_SPACE)]] = True
        plain = "".join(filter(str.isalpha, map(chr, range(ord(_PLAIN_LETTERS)))))
        pieces = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f" {plain}.\n{plain}")]
        spelled = self._spelled(plain.encode())
        if self.tokenizer.normalizer or pieces != [_SPACE + spelled, ".", self._spelled(b"\n"), spelled]:
            raise ValueError("the vocabulary takes words of plain letters apart")
        single = [np.frombuffer(x, "<u4") for x in self._library([chr(c) for c in _SINGLE])]
        self.singles = np.concatenate(single)
        if len(self.singles) != len(_SINGLE):
            raise ValueError("a mark is more than one token")

    def _spelled(self, word: bytes) -> str:
        return word.decode("latin-1").translate(self.letters)

    def _library(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _spaced(self, stretches: list[str]) -> list[bytes]:
        """Ids of each stretch with the space before it.

        The library gets many at once as one text; a token that begins with a space opens the next.
        """
        out = []
        for start in range(0, len(stretches), 1000):
            part = stretches[start : start + 1000]
            (found,) = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            cuts = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
            if len(cuts) != len(part) + 1:
                raise ValueError("the vocabulary joins words over a space")
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _learn(self, pieces: list[bytes], spaced: list[bool], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        words, others = [], []
        for k, (piece, after_space, is_plain) in enumerate(zip(pieces, spaced, plain, strict=True)):
            if is_plain:
                words.append(_SPACE + piece.decode() if after_space else piece.decode())
                continue
            letters = piece.decode()
            if letters.isalpha() and max(letters) < _PLAIN_LETTERS:
                words.append(_SPACE + self._spelled(piece) if after_space else self._spelled(piece))
            else:
                others.append(k)
        found = list(map(self.model.tokenize, words))
        ids = np.fromiter((x.id for tokens in found for x in tokens), "<u4")
        is_word = np.ones(len(pieces), bool)
        is_word[others] = False
        sizes = np.zeros(len(pieces), np.int64)
        sizes[is_word] = np.fromiter(map(len, found), np.int64, len(found))
        after = [k for k in others if spaced[k]]
        bare = [k for k in others if not spaced[k]]
        rest = dict(zip(after, self._spaced([pieces[k].decode() for k in after]), strict=True))
        rest |= zip(bare, self._library([pieces[k].decode() for k in bare]), strict=True)
        sizes[others] = [len(rest[k]) // 4 for k in others]
        out = np.zeros(sizes.sum(), "<u4")
        own = np.repeat(is_word, sizes)
        out[own] = ids
        out[~own] = np.frombuffer(b"".join([rest[k] for k in others]), "<u4")
        return out, sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known
        known.begin()
        heads, rests = [], []
        for text in texts:
            odd = not text or self.odd_space.search(text) or self.special.search(text)
            head, space, rest = (text or "", "", "") if odd else text.partition(" ")
            heads.append(head)
            rests.append((space + rest).encode())
        found = Pieces.of(rests)
        spaced, lengths = found.spaced, found.ends - found.starts
        low, high = (
            hash_pieces(found.data, found.starts, lengths, seed) ^ spaced.astype(np.uint64) for seed in (0, _SEED)
        )
        low, first, which = np.unique(low, return_index=True, return_inverse=True)
        same = (high == high[first][which]).all()
        high = high[first]
        _, held = known.find(low, high)
        new = first[~held]
        starts, ends = found.starts[new].tolist(), found.ends[new].tolist()
        texts_of = [found.data[a:b] for a, b in zip(starts, ends, strict=True)]
        ids, sizes = self._learn(texts_of, spaced[new].tolist(), found.plain()[new].tolist())
        known.add(low[~held], high[~held], ids, sizes)
        at, held = known.find(low, high)
        if not same or not held.all():
            # two pieces with the same first 64 bits
            return [np.frombuffer(x, "<u4") for x in self._library([text or "" for text in texts])]
        # the runs of ids of each piece: the line feed before it, itself, the mark after it
        pool = np.concatenate([self.singles, known.pool])
        runs = 1 + ~spaced + found.mark
        last = np.cumsum(runs)
        own = last - 1 - found.mark
        places, sizes = np.zeros(runs.sum(), np.int64), np.ones(runs.sum(), np.int64)
        places[own], sizes[own] = known.places[at][which] + len(self.singles), known.sizes[at][which]
        places[own[~spaced] - 1] = _SINGLE.index(b"\n")
        raw = np.frombuffer(found.data, np.uint8)
        places[own[found.mark] + 1] = _SINGLE_PLACE[raw[found.ends[found.mark]]]
        ids = _taken(pool, places, sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], last])]
        cuts = upto[np.searchsorted(found.before, np.cumsum([0, *map(len, rests)]))]
        return [
            np.concatenate([np.frombuffer(head, "<u4"), ids[a:b]])
            for head, a, b in zip(self._library(heads), cuts[:-1], cuts[1:], strict=True)
        ]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def pack(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of one file. A null doc_id is given as the smallest int64."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    bits = max(1, int(ids.max(initial=0)).bit_length())
    places, ones, zeros, blocks, at = [], [], [], [], 0
    rest = ids.astype(np.uint16) if bits <= 16 else ids
    for level in reversed(range(bits)):
        plane = rest & rest.dtype.type(1 << level) != 0
        bytes_ = np.packbits(plane)
        held = [squeeze(bytes_[s : s + BLOCK // 8]) for s in range(0, len(bytes_), BLOCK // 8)]
        counts = [
            int(np.bitwise_count(bytes_[s : s + BLOCK // 8]).sum(dtype=np.int64))
            for s in range(0, len(bytes_), BLOCK // 8)
        ]
        zeros.append(len(plane) - sum(counts))
        if level:
            rest = np.concatenate([rest[~plane], rest[plane]])
        sizes = np.array([len(h) for h in held], np.int64)
        places.append(at + np.concatenate([[0], np.cumsum(sizes)]))
        at += int(sizes.sum())
        ones.append(np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]))
        blocks += held
    parts = [doc_ids, lengths, np.concatenate(places), np.concatenate(ones)]
    sections = [squeeze(np.ascontiguousarray(x, "<i8").tobytes()) for x in parts]
    header = json.dumps(
        {
            "tokens": len(ids),
            "documents": len(doc_ids),
            "planes": zeros,
            "sections": [len(s) for s in sections],
        }
    ).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *sections, *blocks])


class WaveletFile:
    """One shard, read in place: `data` is bytes or anything that slices to bytes."""

    def __init__(self, data):
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a wavelet file")
        self.data = data
        self._open = zstandard.ZstdDecompressor().decompress
        start = len(MAGIC) + 4
        size = int.from_bytes(data[len(MAGIC) : start], "little")
        header = json.loads(bytes(data[start : start + size]))
        start += size
        found = []
        for length in header["sections"]:
            found.append(np.frombuffer(self._open(bytes(data[start : start + length])), "<i8"))
            start += length
        self.n, self.zeros, self.first_block = header["tokens"], header["planes"], start
        self.bits = len(self.zeros)
        self.doc_ids, self.lengths = found[:2]
        self.places, self.ones = (x.reshape(self.bits, -1) for x in found[2:])
        self._block = lru_cache(maxsize=64)(self._read_block)

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        a, b = (self.first_block + int(x) for x in self.places[plane, block : block + 2])
        packed = np.frombuffer(self._open(bytes(self.data[a:b])), np.uint8)
        return np.unpackbits(packed)[: min(BLOCK, self.n - block * BLOCK)]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first `i` bits of a plane."""
        block, inside = divmod(i, BLOCK)
        if not inside:
            return int(self.ones[plane, block])
        return int(self.ones[plane, block]) + int(self._block(plane, block)[:inside].sum())

    def access(self, i: int) -> int:
        """The token at position `i`."""
        token = 0
        for plane, zeros in enumerate(self.zeros):
            bit = int(self._block(plane, i // BLOCK)[i % BLOCK])
            ones = self._rank1(plane, i)
            i, token = (zeros + ones if bit else i - ones), token << 1 | bit
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for plane, zeros in enumerate(self.zeros):
            a, b = self._rank1(plane, lo), self._rank1(plane, hi)
            if token >> (self.bits - 1 - plane) & 1:
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of `token` at positions lo … hi - 1."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane."""
        edges = np.minimum(np.arange(self.ones.shape[1]) * BLOCK, self.n)
        before = self.ones[plane] if bit else edges - self.ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        inside = np.flatnonzero(self._block(plane, block) == bit)[k - int(before[block])]
        return block * BLOCK + int(inside)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of `token`; -1 if there are fewer."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for plane in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - plane) & 1
            at = self._select(plane, bit, at - self.zeros[plane] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane undoes its own parting."""
        values = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in reversed(range(self.bits)):
            parts = [self._read_block(plane, b) for b in range(self.ones.shape[1] - 1)]
            ones = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
            out = np.empty_like(values)
            out[~ones] = values[: self.zeros[plane]]
            out[ones] = values[self.zeros[plane] :] | values.dtype.type(1 << (self.bits - 1 - plane))
            values = out
        return values.astype(np.uint32)


_NO_ID = np.iinfo(np.int64).min


def write(docs: DataFrame, folder: str, shards: int | None = None, path: str = VOCABULARY) -> DataFrame:
    """Encode `docs` into files below `folder`: per file its name, order, documents and tokens.

    Documents are dealt out by range of doc_id, `shards` ranges (by default one per shuffle
    partition); a range is cut into several files where it holds more than `SHARD_TOKENS`.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def run(batches):
        system, root = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        ids: list[int] = []
        made = {"part": [], "seq": [], "file": [], "documents": [], "tokens": []}
        tokens = 0

        def close():
            name = f"{root}/shard-{part:06d}-{len(made['part']):05d}.wave"
            data = pack(np.concatenate(held), np.array(ids), np.array([len(h) for h in held]))
            own = f"{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(own) as file:
                file.write(data)
            system.move(own, name)
            for key, value in (
                ("part", part), ("seq", len(made["part"])), ("file", name),
                ("documents", len(ids)), ("tokens", tokens),
            ):
                made[key].append(value)

        end = np.array([END], "<u4")
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
            chunk = (np.cumsum(size, dtype=np.int64) - size) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.slice(start, stop - start)
                texts = rows.column("text").to_pylist()
                coded = library_encoder(path).encode(texts)
                held += [np.concatenate([x, end]) for x in coded]
                ids += [_NO_ID if d is None else d for d in rows.column("doc_id").to_pylist()]
                tokens += sum(len(x) + 1 for x in coded)
                if tokens >= SHARD_TOKENS:
                    close()
                    held, ids, tokens = [], [], 0
        if ids:
            close()
        if made["part"]:
            yield pa.RecordBatch.from_pydict(made, schema=_FILES)

    return ordered.mapInArrow(run, "part long, seq long, file string, documents long, tokens long")


_FILES = pa.schema(
    [
        ("part", pa.int64()),
        ("seq", pa.int64()),
        ("file", pa.string()),
        ("documents", pa.int64()),
        ("tokens", pa.int64()),
    ]
)


def with_starts(files: DataFrame) -> DataFrame:
    """`files` with `start`: tokens in all files before. Parts are summed first."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of documents, whatever they hold
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = files.groupBy("part").agg(F.sum("tokens").alias("_total"))
    before = totals.select("part", F.coalesce(F.sum("_total").over(parts), F.lit(0)).alias("_before"))
    within = files.withColumn("_within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return within.join(before, "part").select(
        *files.columns, (F.col("_before") + F.col("_within")).alias("start")
    )


def read(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files, in any order: doc_id, start, n_tokens and `ids` (binary)."""
    # rows are tiny and files are not, so the number of tasks is given and never coalesced
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = files.select("part", "seq", "file", "start").repartitionByRange(tasks, "part", "seq")

    def work(rows: dict[str, list]):
        system, _ = pafs.FileSystem.from_uri(folder)
        for name, start in zip(rows["file"], rows["start"], strict=True):
            with system.open_input_file(name) as file:
                shard = WaveletFile(file.read())
            ends = np.cumsum(shard.lengths)
            data = shard.tokens().astype("<u4").tobytes()
            bounds = [0, *ends.tolist()]
            yield {
                "doc_id": [None if d == _NO_ID else d for d in shard.doc_ids.tolist()],
                "start": (start + ends - shard.lengths).tolist(),
                "n_tokens": shard.lengths.tolist(),
                "ids": [data[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)],
            }

    schema = "doc_id long, start long, n_tokens long, ids binary"
    return arrow_map(spread, work, schema, chunk_bytes=1, text="file")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own, as a URI, below the shared checkpoint folder."""
    shared = shared_checkpoint_dir(spark).rstrip("/")
    uri = f"{shared if '://' in shared or shared.startswith('file:') else 'file://' + shared}/tokens-{uuid.uuid4().hex}"
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    system, root = pafs.FileSystem.from_uri(uri)
    system.create_dir(root, recursive=True)
    return uri
