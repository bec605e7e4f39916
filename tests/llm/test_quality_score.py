"""Operator 9's score and verdict against both multinomials counted plainly."""

import collections
import math
import re

import pytest
import regex
import xxhash

from logvane.llm import quality, queries

SF = "/root/testdata/sf0.001"


def bucket(*parts):
    seed = 42
    for part in parts:
        seed = xxhash.xxh64_intdigest(part.encode(), seed)
    return seed % quality.BUCKETS


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    shapes = [regex.sub(r"[\p{L}\p{N}]+", "a", w) for w in words]
    return [bucket(w.lower()) for w in words] + [bucket(a, b) for a, b in zip(shapes, [*shapes[1:], ""])]


def scores(pairs, trusted):
    raw, good = collections.Counter(), collections.Counter()
    for doc_id, text in pairs:
        raw.update(grams(text))
        if doc_id in trusted:
            good.update(grams(text))
    n_raw, n_good = (sum(c.values()) + quality.SMOOTHING * quality.BUCKETS for c in (raw, good))

    def weight(b):
        if not good:
            return 0.0
        return math.log((good[b] + quality.SMOOTHING) / n_good) - math.log((raw[b] + quality.SMOOTHING) / n_raw)

    return [sum(map(weight, g)) / len(g) if (g := grams(text)) else 0.0 for _, text in pairs]


def test_score_and_verdict_of_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trusted = {r.doc_id for r in quality.trusted(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: s for (i, _), s in zip(pairs, scores(pairs, trusted))}
    found = queries.QUERIES["op9_quality_rules"](spark, SF).collect()
    assert len(found) == len(pairs)
    for row in found:
        assert row.score == pytest.approx(want[row.doc_id], abs=1e-9)
        assert row.kept == (not row.base_failed and want[row.doc_id] >= quality.THRESHOLD)
    assert 0 < sum(r.kept for r in found) < len(found)


def test_score_of_odd_texts(spark, make_docs):
    pairs = [
        (1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one,two ONE\t— $$$ x1y2"), (6, "É é straße 中文 a b"), (7, "w " * 20_000),
        (8, "ok " * 60), (8, "ok " * 60), (None, "plain words"), (9, "<a> <b> ## 12"),
    ]
    trusted = spark.createDataFrame([(5,), (8,), (8,), (None,)], "doc_id long")
    found = quality.judge(make_docs(pairs), trusted).collect()
    want = collections.defaultdict(list)
    for (i, _), s in zip(pairs, scores(pairs, {5, 8})):
        want[i].append(s)
    assert len(found) == len(pairs)
    for row in found:
        assert row.score == pytest.approx(want[row.doc_id][0], abs=1e-9), row.doc_id
    nobody = quality.judge(make_docs(pairs), trusted.limit(0)).collect()
    assert {r.score for r in nobody} == {0.0}
