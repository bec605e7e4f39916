"""Operators 8, 9 and 10: repeated windows, quality rules, personal data."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from logvane.llm import pseudonyms, quality, queries, substring

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def words(text):
    return WORDS.findall(text or "")


# --- 8: repeated windows


def removed(pairs, size):
    """Per row: the words outside windows that start in a document with a smaller id."""
    first = {}
    for doc_id, text in pairs:
        w = words(text)
        for k in range(len(w) - size + 1):
            key, i = tuple(w[k : k + size]), float("inf") if doc_id is None else doc_id
            first[key] = min(first.get(key, i), i)
    out = []
    for doc_id, text in pairs:
        w, gone = words(text), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < (float("inf") if doc_id is None else doc_id):
                gone.update(range(k, k + size))
        out.append((doc_id, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def cut(docs, size=13, **how):
    found = substring.remove_repeats(docs, size, **how)
    rows = found.select("row.doc_id", "n_words", "n_removed", "kept_text").collect()
    return sorted(map(tuple, rows), key=repr)


PASSAGE = " ".join(f"w{k}" for k in range(20))
REPEATS = [
    (3, PASSAGE), (1, "start " + PASSAGE + " end"), (2, PASSAGE + "\n" + PASSAGE), (7, None), (8, ""),
    (4, " ".join(f"w{k}" for k in range(5, 18))), (5, "x\ty  z"), (6, PASSAGE.upper()), (5, PASSAGE),
    (5, PASSAGE), (None, PASSAGE + " tail"), (9, "a " * 40), (10, "a " * 15), (11, " \n\t "),
]


def test_repeats_against_brute_force(spark, make_docs):
    assert cut(make_docs(REPEATS)) == removed(REPEATS, 13)
    assert cut(make_docs(REPEATS), 3) == removed(REPEATS, 3)
    assert cut(make_docs(REPEATS, 1)) == removed(REPEATS, 13)
    assert cut(make_docs(REPEATS).limit(0)) == []


def test_very_long_text_and_shared_line(spark, make_docs):
    long = " ".join(f"v{k % 9000}" for k in range(30_000))
    pairs = [(0, long), *((k, PASSAGE + f" own {k}") for k in range(1, 60))]
    assert cut(make_docs(pairs, 5)) == removed(pairs, 13)


def test_op8_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op8_substring_dedup"](spark, SF).collect()
    expected = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in removed(docs, 13)]
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)


# --- 9: quality rules


def facts(text):
    w = words(text)
    count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) for j in range(3) if count[tuple(w[k : k + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)


FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
TEXTS = [
    None, "", " \t\n", "one", "one two", "a b c", "a b c a b c", "a a a a a a", "é|ñ <b> $5 # & %",
    "same line\nsame line\n\n \nsame line\nother", "x y z " * 40, " ".join(f"t{k}" for k in range(60)),
    "\x0bv\x0cf\rr", " nbsp stays one word", " ".join(f"u{k % 700}" for k in range(9000)),
    "".join(chr(0x4E00 + k) for k in range(80)),
]


def test_quality_facts_and_rows(spark, make_docs):
    docs = make_docs([*enumerate(TEXTS), (2, TEXTS[9]), (None, "q")])
    good = spark.createDataFrame([(11,), (11,), (None,)], "doc_id long")
    rows = quality.judge(docs, good).collect()
    found = sorted(((r.doc_id, *(r[c] for c in FACTS)) for r in rows), key=repr)
    pairs = [*enumerate(TEXTS), (2, TEXTS[9]), (None, "q")]
    assert found == sorted(((i, *facts(t)) for i, t in pairs), key=repr)
    assert all(not r.kept for r in rows if r.base_failed)
    kept = quality.keep(docs, good)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.kept for r in rows)


def test_quality_without_trusted_or_rows(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long")
    docs = make_docs([(1, TEXTS[11]), (2, "few")])
    rows = {r.doc_id: r for r in quality.judge(docs, none).collect()}
    assert rows[1].kept and rows[1].score == 0 and not rows[2].kept
    assert quality.judge(docs.limit(0), none).count() == 0


def test_score_tells_layout_apart(spark, make_docs):
    clean = [(k, " ".join(f"{c}{(k * 7 + j) % 90}" for j, c in enumerate("abcdefghij" * 8))) for k in range(40)]
    junk = [(100 + k, t.replace(" ", "### ")) for k, t in clean[:6]]
    good = spark.createDataFrame([(k,) for k in range(30)], "doc_id long")
    rows = {r.doc_id: r.kept for r in quality.judge(make_docs(clean + junk), good).collect()}
    assert all(rows[k] for k, _ in clean) and not any(rows[k] for k, _ in junk)


def test_op9_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(tuple(r[c] for c in FACTS) == facts(texts[r.doc_id]) for r in rows)
    judged = {r.doc_id: r.kept for r in rows}
    good = [r.doc_id for r in queries.quality.trusted(spark.read.parquet(f"{SF}/labels.parquet")).collect()]
    passed = [judged[k] for k in good if facts(texts[k])[-1] is False]
    assert sum(passed) >= 0.98 * len(passed)


# --- 10: personal data


def rewrite(spark, pairs):
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in pairs], "doc_id long, text string, row string, _at int")
    out = pseudonyms.pseudonymise(df)
    return {r.doc_id: (r.text, r.found) for r in out.select("row.doc_id", "text", "found").collect()}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_same_value_same_pseudonym_same_format(spark):
    texts = {
        1: "card 4041894974608795 and 4041 8949 7460 8795, mail a.b@x.example.com",
        2: "A.B@X.example.com; 4041894974608795. tel +1 (988) 555-2485 or 988-555-2485",
        3: "10.0.0.1 then 2020-02-29, 29/02/2020, 02/29/2020 and 31.12.1999; 123-45-6789",
    }
    out = rewrite(spark, texts.items())
    one, two, three = (out[k][0] for k in (1, 2, 3))
    card = re.search(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), mail (\S+)$", one)
    assert card[1] == card[2].replace(" ", "") != "4041894974608795" and luhn(card[1])
    assert two.startswith(f"{card[3]}; {card[1]}. tel +1 (")
    assert re.search(r"tel \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} or [2-9]\d\d-[2-9]\d\d-\d{4}$", two)
    phones = re.findall(r"\(?(\d{3})\)?[ -](\d{3})-(\d{4})", two)
    assert phones[0] == phones[1]
    address, iso, european, american, _, social = re.match(
        r"(\S+) then (\S+), (\S+), (\S+) and (\S+); (\S+)$", three
    ).groups()
    assert all(int(x) <= 255 for x in address.split(".")) and address != "10.0.0.1"
    y, m, d = iso.split("-")
    assert european == f"{d}/{m}/{y}" and american == f"{m}/{d}/{y}" and 1901 <= int(y) <= 2096
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", social) and social != "123-45-6789"
    assert out[3][1] == ["address", "date", "date", "date", "date", "social"]


def test_what_does_not_validate_stays(spark):
    texts = {
        1: "4041894974608796 999.1.1.1 1.2.3.4.5 2021-02-29 1800-01-01 666-12-1234 000-11-2222 12345678901234567890",
        2: None, 3: "", 4: "no digits at all", 5: "v1.2.3 at 10:30, pages 12-14 @ home",
        6: "9" * 200_000, 7: "a" * 200_000 + "@", 8: "0000000000000000",
    }
    out = rewrite(spark, texts.items())
    assert {k: v[0] for k, v in out.items()} == texts and not any(v[1] for v in out.values())


@pytest.mark.parametrize(("a", "b"), [(2, 2), (3, 5), (10, 100), (21, 487)])
def test_feistel_is_a_permutation(spark, a, b):
    df = spark.range(a * b).select(
        pseudonyms.feistel(
            F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), "key", "t"
        ).alias("x")
    )
    assert df.select("x.l", "x.r").distinct().where(f"l between 0 and {a - 1} and r between 0 and {b - 1}").count() == a * b


def test_every_card_body_maps_to_its_own(spark):
    df = spark.range(1, 501).select(F.col("id").alias("doc_id"), F.lpad(F.col("id").cast("string"), 12, "0").alias("body"))

    def check(body):
        return next(c for c in "0123456789" if luhn(body + c))

    pairs = [(r.doc_id, r.body + check(r.body)) for r in df.collect()]
    out = rewrite(spark, pairs)
    found = [v[0] for v in out.values()]
    assert len(set(found)) == 500 and all(luhn(x) and len(x) == 13 for x in found)
    other = pseudonyms.pseudonymise(
        spark.createDataFrame(pairs, "doc_id long, text string"), key="another"
    ).select("text")
    assert {r.text for r in other.collect()} != set(found)


def test_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(1, "10.0.0.1"), (1, "10.0.0.1"), (None, "10.0.0.1")], "doc_id long, text string")
    assert pseudonyms.pseudonymise(df).select("text").distinct().count() == 1
    assert pseudonyms.pseudonymise(df.limit(0)).count() == 0


def test_op10_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.QUERIES["op10_pii_pseudonyms"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    card = re.compile(r"(?<!\d)\d{16}(?!\d)")
    for k, text in texts.items():
        for found in card.findall(text or ""):
            assert not luhn(found) or found not in rows[k].text
        if not rows[k].n_found:
            assert rows[k].text == text
