"""Operators 1 and 7: token ids in files, and byte-level BPE."""

import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from logvane.llm import bpe, queries, wavelet

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", "a", " ", " a", "a ", "a  b", "a \n b", "\n\n a\tb  \n c", "=" * 50, "the" * 3000,
    "ab" * 600, "  x", "x   y", "don't we'll  'S", "日本語テキスト " * 20, "\x00\x01 a", "é ñ",
    "\x1c a \x1fb", "a  b", "a 　b", " " * 500 + "x", "<|endoftext|> x", "a\r\n b",
]


@pytest.fixture(scope="module")
def reference():
    with open(bpe.RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_same_ids_as_tiktoken(reference, text):
    coder = bpe.encoder(bpe.RANKS)
    (found,) = coder.encode([text])
    assert ids(found) == reference.encode_ordinary(text or "")
    assert coder.vocabulary.decode(found) == (text or "").encode()


def test_very_long_pre_tokens(reference):
    random.seed(1)
    letters = "".join(random.choice("abcdefghijthe") for _ in range(60_000))
    coder = bpe.encoder(bpe.RANKS)
    for text in (letters, "the" * 20_000, "=" * 30_000):
        assert ids(coder.encode([text])[0]) == reference.encode_ordinary(text)


def test_memory_starts_anew_when_full(reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    coder = bpe.Encoder(bpe.RANKS)
    for n in range(30):
        text = " ".join(f"word{n}x{k}" for k in range(10))
        assert ids(coder.encode([text])[0]) == reference.encode_ordinary(text)
    assert len(coder.stretches.young) < 200 and len(coder.tokens.old) < 200


def test_rank_queue_gives_lowest_rank_first():
    queue, random_ = bpe.RankQueue(50_256), np.random.default_rng(2)
    ranks = random_.integers(0, 50_256, 400).astype(np.int32)
    queue.push(ranks, np.arange(400))
    seen = []
    while queue:
        rank, at = queue.pop()
        assert (ranks[at] == rank).all()
        seen.append(rank)
    assert seen == sorted(set(ranks.tolist()))


def test_encode_keeps_columns_and_rows(spark, make_docs, reference):
    docs = make_docs([*enumerate(ODD), (None, "a b"), (1, ""), (1, "")])
    found = bpe.encode(docs).select("row.*", "ids", "decoded").collect()
    assert len(found) == len(ODD) + 3
    for r in found:
        text = "a b" if r.doc_id is None else ODD[r.doc_id] or ""
        assert bytes(r.decoded) == text.encode() and r.row == 1 and r.key == "x"
        assert ids(r.ids) == reference.encode_ordinary(text)
    assert bpe.encode(docs.limit(0)).count() == 0


def test_op7_whole_table(spark, reference):
    rows = queries.QUERIES["op7_byte_bpe"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r.n_tokens == len(reference.encode_ordinary(texts[r.doc_id])) for r in rows)


def test_wavelet_access_rank_select():
    random_ = np.random.default_rng(1)
    data = np.concatenate([random_.integers(0, 300, 90_000), random_.integers(0, 50_000, 60_000)])
    shard = wavelet.WaveletFile(wavelet.pack(data.astype("<u4"), np.arange(2), np.array([1, len(data) - 1])))
    assert (shard.tokens() == data).all()
    assert all(shard.access(int(i)) == data[i] for i in random_.integers(0, len(data), 20))
    for token in (0, 7, 299, 49_999, 1 << 17):
        at = np.flatnonzero(data == token)
        assert shard.count(token) == len(at)
        assert shard.count(token, 100, 70_000) == ((at >= 100) & (at < 70_000)).sum()
        for k in (0, len(at) // 2, len(at) - 1, len(at)):
            assert shard.select(token, k) == (at[k] if 0 <= k < len(at) else -1)


def test_wavelet_of_nothing_and_of_one_token():
    none = np.zeros(0, np.int64)
    assert len(wavelet.WaveletFile(wavelet.pack(none.astype("<u4"), none, none)).tokens()) == 0
    one = wavelet.WaveletFile(wavelet.pack(np.zeros(3, "<u4"), np.arange(3), np.ones(3, int)))
    assert one.tokens().tolist() == [0, 0, 0] and one.count(0) == 3
    with pytest.raises(ValueError):
        wavelet.WaveletFile(b"something else")


def _odd_texts():
    random_ = random.Random(5)
    signs = [*"abXyzABz", *"  \n\n.,;:!?", "é", "ß", "日", "7", "'", "'s", "-", "|", "\r", "\t", "\u00a0", "\0", "word", "Other"]
    texts = ["".join(random_.choices(signs, k=random_.randrange(40))) for _ in range(4000)]
    return [None, "", "a.\nB", "a.\n\nB", "be.\nShe's,\nwe;\né x.", " ,\nA .\nB", *texts, " ".join(texts[:50])]


def _plain_ids(texts):
    coder = Tokenizer.from_file(wavelet.VOCABULARY)
    return [coder.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_pieces_give_the_librarys_ids_and_words_go_to_its_model():
    coder, seen = wavelet.LibraryEncoder(wavelet.VOCABULARY), []
    spaced = coder._spaced
    coder._spaced = lambda pieces: seen.extend(pieces) or spaced(pieces)
    texts = [*ODD, *_odd_texts()]
    assert [x.tolist() for x in coder.encode(texts)] == _plain_ids(texts)
    # words with marks and line feeds around them are no pieces that the library parts itself
    line = r"[A-Za-z]+[.,;:!?]?"
    assert seen and not any(re.fullmatch(rf"{line}(\n{line})*", x) for x in seen)
    again = len(seen)
    assert [x.tolist() for x in coder.encode(texts[::-1])] == _plain_ids(texts[::-1])
    assert len(seen) == again


@pytest.mark.parametrize("remembered", [1, 60])
def test_forgotten_pieces_are_learnt_again(monkeypatch, remembered):
    monkeypatch.setattr(wavelet, "REMEMBERED", remembered)
    coder, texts = wavelet.LibraryEncoder(wavelet.VOCABULARY), _odd_texts()[:400]
    for start in [*range(0, len(texts), 20), 0, 20]:
        part = texts[start : start + 20]
        assert [x.tolist() for x in coder.encode(part)] == _plain_ids(part)
    assert len(coder.known.low) < 2 * remembered + 400


def test_pieces_of_equal_hash_are_not_mixed_up(monkeypatch):
    own = wavelet.hash_pieces
    monkeypatch.setattr(wavelet, "hash_pieces", lambda *a: own(*a) if a[-1] else own(*a) % np.uint64(64) << np.uint64(1))
    coder, texts = wavelet.LibraryEncoder(wavelet.VOCABULARY), _odd_texts()[:300]
    for start in range(0, len(texts), 5):
        part = texts[start : start + 5]
        assert [x.tolist() for x in coder.encode(part)] == _plain_ids(part)


def _expected(pairs):
    coder = Tokenizer.from_file(wavelet.VOCABULARY)
    start, out = 0, []
    for doc_id, text in pairs:
        found = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(found), zlib.crc32(found.tobytes())))
        start += len(found)
    return out


def _read(spark, docs, **how):
    folder = wavelet.new_folder(spark)
    files = wavelet.with_starts(wavelet.write(docs, folder, **how).cache())
    rows = wavelet.read(files, folder).collect()
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in rows]


def test_files_give_back_what_was_written(spark, make_docs):
    pairs = [(k - 3, t) for k, t in enumerate(ODD)]
    assert sorted(_read(spark, make_docs(pairs), shards=4)) == _expected(pairs)


def test_null_and_equal_ids_and_many_files(spark, make_docs, monkeypatch):
    pairs = [(None, "z"), (1, "a"), (1, "b"), (1, "b"), (2, None)]
    found = _read(spark, make_docs(pairs), shards=2)
    assert sorted(found, key=lambda r: r[1]) == _expected(pairs)
    assert _read(spark, make_docs(pairs).limit(0)) == []


def test_op1_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = queries.QUERIES["op1_wavelet_tokens"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == _expected([(r.doc_id, r.text) for r in docs])
