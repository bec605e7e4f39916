"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit a binary n-gram classifier tells the languages
whose bit is 1 from the others: the weight of a hashed 3-byte gram is the log ratio of its mean
probability in either set of languages, all languages counting alike, and a text's margin is its mean
weight over its grams. Decoding adds up the logistic losses of a codeword against the margins, each
weighted by how reliably that classifier separates that language, and takes the codeword of least
loss. The score is the share of the best codeword in exp(-loss) over all; a text whose best two
codewords are closer than `AMBIGUOUS` is flagged.

Gram counts cover all training texts and are gathered in Spark; the model is two bounded arrays, of
languages by `FEATURES` and bits by `FEATURES`.

Defined results: `und`, score 0, for null text, text without a letter, or if nothing was learned;
rows without a language teach nothing; repeated rows give repeated results; an empty table gives no
rows. Columns besides doc_id, text and (for training) lang are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import arrow_map, stable_bucket

SPLIT_MOD, SPLIT_HELD = 4, 2
FEATURES = 1 << 15
SMOOTHING = 0.5
#: Grams from which a text's margins count in full, and the weight of a full margin.
FULL_LENGTH, SHARPNESS = 60, 12.0
AMBIGUOUS = 0.5
#: All codewords of a shorter length than this are used up to 7 languages (63 bits).
EXHAUSTIVE = 7

_GAP = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    return stable_bucket(doc_id, SPLIT_MOD) == SPLIT_HELD


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def grams(text: str) -> np.ndarray:
    """Feature numbers of a text's 3-byte grams; whatever is no letter counts as a gap."""
    words = text.lower().encode().translate(_GAP).split()
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64)


def codewords(languages: int) -> np.ndarray:
    """+1 or -1 per language and bit.

    Up to `EXHAUSTIVE` languages every way to part them in two is a bit; beyond, ten bits per
    doubling are drawn from a fixed seed, the draw of largest least distance among fifty.
    """
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        rest = [p for p in product((1, -1), repeat=languages - 1) if -1 in p]
        return np.array([[1] * len(rest), *zip(*rest, strict=True)])
    bits = math.ceil(10 * math.log2(languages))
    random, best, found = np.random.default_rng(0), -1, None
    for _ in range(50):
        drawn = random.choice((-1, 1), (languages, bits))
        drawn[:, np.abs(drawn.sum(axis=0)) == languages] *= np.where(np.arange(languages) % 2, 1, -1)[:, None]
        distance = min((drawn[a] != drawn[b]).sum() for a in range(languages) for b in range(a))
        if distance > best:
            best, found = distance, drawn
    return found


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def decode(self, margins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: its language's number, score, and whether it is ambiguous."""
        sure = np.minimum(lengths / FULL_LENGTH, 1.0)[:, None, None] * SHARPNESS
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None] * sure)
        total = (loss * self.trust[None]).sum(axis=2)
        likely = np.exp(total.min(axis=1, keepdims=True) - total)
        share = likely / likely.sum(axis=1, keepdims=True)
        best = total.argmin(axis=1)
        rows = np.arange(len(best))
        gap = np.sort(total, axis=1)
        close = gap[:, 1] - gap[:, 0] < AMBIGUOUS if len(self.languages) > 1 else rows < 0
        return best, share[rows, best], close


def count_grams(training: DataFrame) -> DataFrame:
    """(lang, feature, n) over all training texts."""

    def work(rows: dict[str, list]):
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            if has_letter(text):
                held.setdefault(lang, []).append(grams(text))
        for lang, found in held.items():
            n = np.bincount(np.concatenate(found), minlength=FEATURES)
            feature = np.flatnonzero(n)
            yield {"lang": [lang] * len(feature), "feature": feature, "n": n[feature]}

    rows = training.where("lang is not null and text is not null").select("lang", "text")
    counted = arrow_map(rows, work, "lang string, feature long, n long", chunk_bytes=16 << 20)
    return counted.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit(training: DataFrame) -> Model:
    counts = count_grams(training).toArrow()  # languages x FEATURES rows at most
    languages = tuple(sorted(set(counts.column("lang").to_pylist())))
    place = {lang: k for k, lang in enumerate(languages)}
    table = np.zeros((len(languages), FEATURES))
    rows = [place[x] for x in counts.column("lang").to_pylist()]
    table[rows, counts.column("feature").to_numpy()] = counts.column("n").to_numpy()
    chance = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((code.shape[1], FEATURES))
    for bit in range(code.shape[1]) if len(languages) > 1 else ():
        yes = code[:, bit] > 0
        weights[bit] = np.log(chance[yes].mean(axis=0) / chance[~yes].mean(axis=0))
    # reliability: how far from 0, in deviations, a full-length text's margin is on its own side
    mean = chance @ weights.T
    spread = np.sqrt(np.maximum(chance @ (weights**2).T - mean**2, 1e-9) / FULL_LENGTH)
    normal = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
    trust = np.maximum(2 * normal(mean * code / spread) - 1, 1e-6) if len(languages) else mean
    trust = trust / trust.sum(axis=1, keepdims=True) * code.shape[1] if len(languages) else trust
    return Model(languages, code, np.ascontiguousarray(weights.T, np.float32), trust)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(rows: dict[str, list]):
        model: Model = held.value
        n = len(rows["text"])
        lang, score, close = ["und"] * n, np.zeros(n), np.zeros(n, bool)
        told = [k for k, text in enumerate(rows["text"]) if model.languages and has_letter(text)]
        if told:
            margins, lengths = np.zeros((len(told), model.code.shape[1])), np.zeros(len(told))
            for at, k in enumerate(told):
                found = grams(rows["text"][k])
                lengths[at] = len(found)
                if len(found):
                    margins[at] = model.weights[found].mean(axis=0)
            best, share, near = model.decode(margins, lengths)
            for at, k in enumerate(told):
                lang[k], score[k], close[k] = model.languages[best[at]], share[at], near[at]
        yield {"doc_id": rows["doc_id"], "lang_pred": lang, "score": score, "ambiguous": close}

    schema = "doc_id long, lang_pred string, score double, ambiguous boolean"
    return arrow_map(docs.select("doc_id", "text"), work, schema)
