"""Byte-level BPE encoding and decoding by merge ranks, with a rank queue.

The queue has one bucket per merge rank; a bucket holds positions in a linked list of tokens. A
hierarchical bitmap tells the lowest rank whose bucket is not empty (find-first-set on each of three
levels), whose positions are popped together; positions whose pair has changed since are stale and
skipped. Every byte enters the queue a bounded number of times, so a pre-token of any length costs
in proportion to its length, and all new pre-tokens of a chunk share one queue, in numpy.

Popping a whole bucket equals merging one pair at a time, leftmost first, unless a merge makes a
pair of still lower rank. Where it does, the pre-token's later positions go back into the bucket.

Defined results: null or empty text gives no ids and decodes to no bytes; repeated rows give
repeated results; special tokens are ordinary text. Columns besides the text are kept.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from logvane.llm.common import Memory, arrow_map

#: Ranks of the multilingual vocabulary, and the pattern that cuts text before the merges.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pre-tokens and stretches of text of which a Python worker keeps the ids, twice each at most.
REMEMBERED = 120_000

_NONE = np.iinfo(np.int32).max


class RankQueue:
    """Buckets of positions by rank; `pop` gives the lowest rank and all positions held for it."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * ranks)

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1], [True]])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(ranks) else ():
            rank = int(ranks[a])
            held = self.buckets.get(rank)
            if held is None:
                self.buckets[rank] = [positions[a:b]]
                self._mark(rank)
            else:
                held.append(positions[a:b])

    def _mark(self, at: int) -> None:
        for level in self.levels:
            word = level[at >> 6]
            level[at >> 6] = word | 1 << (at & 63)
            if word:
                return
            at >>= 6

    def _clear(self, at: int) -> None:
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                return
            at >>= 6

    def __bool__(self) -> bool:
        return bool(self.levels[-1][0])

    def pop(self) -> tuple[int, np.ndarray]:
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            at = at << 6 | (word & -word).bit_length() - 1
        self._clear(at)
        parts = self.buckets.pop(at)
        return at, parts[0] if len(parts) == 1 else np.concatenate(parts)


class Vocabulary:
    """Token bytes by id, and the rank of every pair of tokens that merges into one."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = file.read().splitlines()
        self.ranks = {
            base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x)
        }
        self.size = max(self.ranks.values(), default=0) + 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.full(256, -1, np.int64)
        for byte in range(256):
            self.single[byte] = self.ranks[bytes([byte])]
        pairs = [
            (left, right, rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if (left := self.ranks.get(token[:k])) is not None
            and (right := self.ranks.get(token[k:])) is not None
        ]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], table[order, 2].astype(np.int32)
        left, right, rank = table.T
        self.reopening = {*left[rank < left].tolist(), *right[rank < right].tolist()}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.merged[at], _NONE)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        longer = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif piece:
                longer.append(k)
        if longer:
            for k, ids in zip(longer, self._merge([pieces[k] for k in longer]), strict=True):
                out[k] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = n, -1
        rank = np.full(n, _NONE, np.int32)
        open_ = np.flatnonzero(after < n)
        rank[open_] = self.pair_ranks(ids[open_], ids[open_ + 1])
        queue = RankQueue(self.size)

        def push(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            queue.push(rank[at], at)

        push(open_)
        while queue:
            r, at = queue.pop()
            at = np.unique(at[rank[at] == r])
            if not len(at):
                continue
            found = at
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():  # of overlapping pairs every second, from the left
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - start) % 2 == 0]
            if r in self.reopening:
                at = self._until_reopened(r, at, ids, before, after, owner)
            gone = after[at]
            follower = after[gone]
            ids[at], ids[gone] = r, -1
            rank[at] = rank[gone] = _NONE
            after[at] = follower
            inner = follower < n
            before[follower[inner]] = at[inner]
            left = before[at]
            left = left[left >= 0]
            changed = np.unique(np.concatenate([left, at[inner]]))
            rank[changed] = self.pair_ranks(ids[changed], ids[after[changed]])
            push(changed)
            if len(found) > len(at):
                push(found[rank[found] == r])
        alive = ids >= 0
        flat = ids[alive].astype("<u4").tobytes()
        kept = np.cumsum(np.add.reduceat(alive, ends - lengths, dtype=np.int64)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *kept[:-1]], kept, strict=True)]

    def _until_reopened(self, r, at, ids, before, after, owner) -> np.ndarray:
        """Of the pairs `at`, those merged before a pair of lower rank than `r` comes up.

        Merging from the left, a merge opens two pairs: with the token before (itself `r` if the
        pair before has just been merged) and with the token after. The first merge of a pre-token
        that opens a lower rank is the last one for now.
        """
        n = len(ids)
        left, right = before[at], after[after[at]]
        joined = np.concatenate([[False], right[:-1] == at[1:]]) & (left >= 0)
        left_id = np.where(joined, r, ids[np.maximum(left, 0)])
        lower = (left >= 0) & (self.pair_ranks(left_id, np.full(len(at), r)) < r)
        right_id = ids[np.minimum(right, n - 1)]
        lower |= (right < n) & (self.pair_ranks(np.full(len(at), r), right_id) < r)
        if not lower.any():
            return at
        earlier = np.cumsum(lower) - lower
        first = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
        return at[earlier == np.maximum.accumulate(np.where(first, earlier, 0))]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """Texts to ids. Remembers the ids of pre-tokens and of the stretches between spaces.

    The pattern always cuts before a space that a non-space follows, so a text is its head and such
    stretches; heads, new stretches, and texts with other spaces are cut by the pattern itself.
    """

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.odd_space = re.compile(r" (?:\s|$)")
        self.stretches, self.tokens = Memory(REMEMBERED), Memory(REMEMBERED)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        self.stretches.begin()
        self.tokens.begin()
        cut = self.pattern.findall
        heads, tails = [], []
        for text in texts:
            if not text:
                heads.append([])
                tails.append([])
            elif self.odd_space.search(text):
                heads.append(cut(text))
                tails.append([])
            else:
                head, *rest = text.split(" ")
                heads.append(cut(head))
                tails.append(rest)
        new = {s: cut(" " + s) for s in self.stretches.missing(chain.from_iterable(tails))}
        unmet = self.tokens.missing(chain(chain.from_iterable(heads), chain.from_iterable(new.values())))
        coded = self.vocabulary.encode_pieces([t.encode() for t in unmet])
        self.tokens.young.update(zip(unmet, coded, strict=True))
        of_token, of_stretch = self.tokens.young.__getitem__, self.stretches.young.__getitem__
        self.stretches.young.update((s, b"".join(map(of_token, x))) for s, x in new.items())
        return [
            b"".join(chain(map(of_token, head), map(of_stretch, rest)))
            for head, rest in zip(heads, tails, strict=True)
        ]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """Per row of `docs`: `row` (its columns but text), `ids` and `decoded`, both binary.

    `ids` are little-endian unsigned 32-bit integers; `decoded` are the bytes they stand for.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), "text")
    schema = StructType(
        [rows.schema["row"], StructField("ids", BinaryType()), StructField("decoded", BinaryType())]
    )

    def work(found: dict[str, list]):
        coder = encoder(path)
        ids = coder.encode(found["text"])
        yield {"row": found["row"], "ids": ids, "decoded": [*map(coder.vocabulary.decode, ids)]}

    return arrow_map(rows, work, schema, chunk_bytes=4 << 20)
