"""The pipeline: every stage on what its predecessor kept."""

import importlib
import sys

import numpy as np

import __spark_entry__
import corpus_pipeline
from logvane.llm import bpe, decontam, jaccard, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_and_rows(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_copies", "benchmark_leaks", "personal_data", "token_ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, counts = docs, []
    for _, work in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(work(spark, now, SF).collect(), docs.schema)
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and counts[2] == counts[3] > 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = quality.judge(docs, quality.trusted(labels))
    assert counts[0] == judged.where("kept").count() < docs.count()
    pairs = {r.doc_id: set(jaccard.shingles(r.text).tolist()) for r in now.collect()}
    ids = sorted(pairs)
    for a in ids:
        for b in ids[: ids.index(a)]:
            common = len(pairs[a] & pairs[b])
            assert common < 0.8 * (len(pairs[a]) + len(pairs[b]) - common)
    assert decontam.leaks(now, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    texts = {r.doc_id: r.text for r in now.collect()}
    assert all(r.n_chars == len(r.text) for r in now.collect())
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    decode = bpe.encoder(bpe.RANKS).vocabulary.decode
    for r in rows:
        assert decode(bytes(r.ids)).decode() == texts[r.doc_id]
        assert r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4"))


def test_stages_take_an_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, none, SF).count() == 0


def test_one_query_for_each_operator():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in found) == 1
    assert "pipeline" in found and queries.SQL.keys() <= found.keys()


def test_entry_imports_without_the_folder(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("logvane.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    found = entry.queries()
    assert "pipeline" not in found and "parse_syslog" in found and entry.oracle_sql().keys() <= found.keys()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
