"""Operator 10 against a plain re-implementation, on sentences made by hand and on whole tables."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logvane.llm import pseudonyms

SF = "/root/testdata/sf0.001"
KEY = pseudonyms.DEMO_KEY
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
PHONE = (
    r"(?<![0-9+])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}"
    r"|\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3})[ .-][0-9]{4}(?![0-9])"
)
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9./])[0-9]{2}(?P<by>[./])[0-9]{2}(?P=by)[0-9]{4}(?![0-9])"
ANY = re.compile("|".join(f"(?:{p})" for p in (MAIL, ADDRESS, CARD, PHONE, SOCIAL, DATE)))


def keyed(kind, *message):
    inner = hashlib.sha256("|".join([KEY, kind, *map(str, message)]).encode()).hexdigest()
    return hashlib.sha256(f"{KEY}|{inner}".encode()).hexdigest()


def network(left, right, a, b, kind):
    for i in range(10):
        other = right if i % 2 == 0 else left
        drawn = int(keyed(kind, i, a, b, other)[:14], 16)
        if i % 2 == 0:
            left = (left + drawn) % a
        else:
            right = (right + drawn) % b
    return left, right


def luhn(digits, doubled):
    total = 0
    for place, c in enumerate(reversed(digits), 1):
        d = int(c) * (2 if place % 2 == doubled % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def fill(shape, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in shape)


def day_of(x, d):
    orders = ["%Y%m%d"] if re.match(r"\d{4}-", x) else ["%d%m%Y", "%m%d%Y"]
    for order in orders:
        try:
            return (dt.datetime.strptime(d, order).date() - dt.date(1901, 1, 1)).days, order
        except ValueError:
            pass
    return None


def rewritten(x):
    """The kind of a stretch and what it becomes; None if it is not valid."""
    d = re.sub("[^0-9]", "", x)
    if "@" in x:
        low = x.lower()
        return "mail", f"u{keyed('mail', low)[:16]}@d{keyed('domain', low.split('@')[1])[:12]}.invalid"
    if re.fullmatch(ADDRESS, x) and all(int(o) <= 255 for o in x.split(".")):
        o = [int(v) for v in x.split(".")]
        moved = network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "address")
        return "address", ".".join(str(v) for h in moved for v in divmod(h, 256))
    if re.fullmatch(CARD, x) and luhn(d, 2) == 0 and set(d) != {"0"}:
        u = (len(d) - 1) // 2
        w = len(d) - 1 - u
        left, right = network(int(d[:u]), int(d[u:-1]), 10**u, 10**w, "card")
        body = f"{left:0{u}d}{right:0{w}d}"
        return "card", fill(x, body + str(-luhn(body, 1) % 10))
    if re.fullmatch(PHONE, x):
        area, rest = int(d[-10:-7]), int(d[-7:])
        if area < 200:
            left, right = network(area, rest, 200, 10_000_000, "phone")
        elif rest < 2_000_000:
            left, right = network(area - 200, rest, 800, 2_000_000, "phone")
            left += 200
        else:
            left, right = network(area - 200, rest - 2_000_000, 800, 8_000_000, "phone")
            left, right = left + 200, right + 2_000_000
        return "phone", fill(x, f"{d[:-10]}{left:03d}{right:07d}")
    if re.fullmatch(SOCIAL, x) and 1 <= int(d[:3]) <= 899 and d[:3] != "666" and d[3:5] != "00" and d[5:] != "0000":
        area = int(d[:3])
        at = area - 2 if area > 666 else area - 1
        left, right = network(at, (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 99 * 9999, "social")
        group, serial = divmod(right, 9999)
        return "social", fill(x, f"{left + 2 if left >= 665 else left + 1:03d}{group + 1:02d}{serial + 1:04d}")
    if len(d) == 8 and re.fullmatch(DATE, x):
        found = day_of(x, d)
        if found and 0 <= found[0] < 10_227 * 7:
            inside = found[0] % 10_227
            left, right = network(inside // 487, inside % 487, 21, 487, "date")
            day = dt.date(1901, 1, 1) + dt.timedelta(found[0] - inside + left * 487 + right)
            return "date", fill(x, f"{day:{found[1]}}")
    return None


def whole(text):
    if text is None:
        return None, 0
    out, end, n = [], 0, 0
    for m in ANY.finditer(text):
        made = rewritten(m[0])
        out += [text[end : m.start()], made[1] if made else m[0]]
        end, n = m.end(), n + (made is not None)
    return "".join([*out, text[end:]]), n


SENTENCES = [
    f"Write to john@example.com{after}" for after in (".", ".\n", ",", ";", ")", "\n", "!", ". Or not.", ".1", "..", "-", ".x", "")
] + [
    "a.b+c@mail.example.co.uk.", "x@y", "x@y.z", "@example.com", "two@a.org,three@b.org.", "a@" + "b." * 120 + "com.",
    "+1 (017) 555-7713 and +1 (974) 555-3436, (974) 555-3436; 974-555-3436", "+44 (020) 794-6095", "+1 (250) 055-1234.",
    "017-555-7713", "+1(099)000-0000", "1.2.3.4.", "1.2.3.4.5", "300.1.2.3", "4041 8949 7460 8795.", "4041894974608796",
    "123-45-6789 666-12-3456 000-12-3456 900-12-3456", "2024-02-29 2023-02-29 31/12/1999 12/31/1999 01.02.2030. 1900-01-01 2097-01-01",
    "", "no data here", "é john@exämple.com john@example.com",
]


def told(docs):
    found = pseudonyms.pseudonymise(docs).select("row.doc_id", "text", F.size("found").alias("n"))
    return {r.doc_id: (r.text, r.n) for r in found.collect()}


def test_sentences_against_a_plain_version(spark, make_docs):
    pairs = list(enumerate([*SENTENCES, None]))
    found = told(make_docs(pairs))
    for k, text in pairs:
        assert found[k] == whole(text), text
    assert "john@example.com" not in "".join(t for t, _ in found.values() if t)


def test_every_mail_and_phone_of_the_table_is_rewritten(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = told(docs)
    for row in docs.collect():
        assert found[row.doc_id] == whole(row.text)


@pytest.mark.parametrize("area, rest", [(200, 10_000_000), (800, 2_000_000)])
def test_other_phones_are_permuted_among_themselves(area, rest):
    draws = [(k * 7919 % area, k * 104_729 % rest) for k in range(2000)]
    moved = {network(left, right, area, rest, "phone") for left, right in draws}
    assert len(moved) == len(set(draws)) and all(0 <= a < area and 0 <= b < rest for a, b in moved)


def test_the_stage_rewrites_as_the_operator_does(spark, make_docs):
    docs = make_docs([(k, t) for k, t in enumerate(SENTENCES)]).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.personal_data(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {k: (whole(t)[0], len(whole(t)[0])) for k, t in enumerate(SENTENCES)}
