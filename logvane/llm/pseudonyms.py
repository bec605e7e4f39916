"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Validated numbers and dates become other values of the same format by a keyed permutation, so equal
values stay equal across documents and different ones stay different. The permutation is a Feistel
network over a pair (l, r) of Z_a x Z_b: ten rounds in turn add a keyed hash of one half to the
other. Per format:

    card     13 to 19 digits that pass Luhn; all but the last are permuted, the last is recomputed
    phone    North American numbers, area and exchange codes 200 to 999; with a country code and
             brackets around the area code any digits. Area codes below 200, and exchange codes
             below 200 after others, are permuted among themselves; the country code stays
    address  four octets of 0 to 255, as two halves of 16 bits
    social   ###-##-#### with area 001 to 899 but 666, group and serial not 0
    date     yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, mm/dd/yyyy if it can be no other, from 1901 to
             2096; the 28 years from 1901, 1929, … have 10 227 days each, within which days move
    mail     no number: local part and domain (of up to 127 labels, as names have) become keyed hashes,
             in the reserved domain `invalid`

What doesn't validate stays as it is. Separators and signs stay where they are.

Defined results: null text stays null with count 0; empty text stays empty; repeated rows give
repeated results; other columns are kept whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.llm.common import computed_once

ROUNDS = 10
#: For tests and examples; give a secret of your own.
DEMO_KEY = "an example, not a secret"

KINDS = ("mail", "address", "card", "phone", "social", "date")
_MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}+"
_ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_CARD = (
    r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
    r"(?![0-9])"
)
_PHONE = (
    r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])"
    r"[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
)
_SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_DATE = (
    r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
    r"|(?<![0-9./])[0-9]{2}([./])[0-9]{2}\1[0-9]{4}(?![0-9])"
)
_ANY = "|".join(f"(?:{p})" for p in (_MAIL, _ADDRESS, _CARD, _PHONE, _SOCIAL, _DATE))

_FIRST_DAY, _CYCLE_DAYS, _CYCLES = "1901-01-01", 10_227, 7


def _keyed(key: str, kind: str, *message: Column) -> Column:
    """64 hex digits; the key goes in twice, so a longer message can't be made from a known one."""
    inner = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *message), 256)
    return F.sha2(F.concat_ws("|", F.lit(key), inner), 256)


def feistel(l: Column, r: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """Struct (l, r): a keyed permutation of Z_a x Z_b."""

    def turn(half: Column, other: Column, i: Column, size: Column) -> Column:
        drawn = F.conv(F.substring(_keyed(key, kind, i, a, b, other), 1, 14), 16, 10).cast("long")
        return F.pmod(half + F.pmod(drawn, size), size)

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, turn(s["l"], s["r"], i, a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(turn(s["r"], s["l"], i, b)).alias("r"),
        )

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), step)


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _power(n: Column) -> Column:
    return F.get(F.array(*[F.lit(10**i) for i in range(19)]), n)


def _part(digits: Column, start: int | Column, length: int | Column) -> Column:
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.substring(digits, start, length).cast("long")


def _fill(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced by `digits`, in order."""
    places = F.transform(
        F.sequence(F.lit(1), F.length(shape)), lambda i: F.substring(shape, i, F.lit(1))
    )
    return F.aggregate(
        places,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(
            c.between("0", "9"),
            F.struct(
                F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))).alias("out"),
                (s["k"] + 1).alias("k"),
            ),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
        lambda s: s["out"],
    )


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; from the right, digits at places of parity `doubled` (1 is last) count double."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = 2 * digit
        return F.when(i % 2 != doubled % 2, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + worth(i))


def _card(e: Column, key: str) -> Column:
    n = F.length(e["d"]) - 1
    u = F.floor(n / 2).cast("int")
    halves = feistel(
        _part(e["d"], 1, u), _part(e["d"], u + 1, n - u), _power(u), _power(n - u), key, "card"
    )
    body = F.transform(
        F.array(halves), lambda h: F.concat(_padded(h["l"], u), _padded(h["r"], n - u))
    )
    whole = F.transform(
        body, lambda x: F.concat(x, F.pmod(10 - _luhn(x, 1) % 10, F.lit(10)).cast("string"))
    )
    return _fill(e["x"], F.get(whole, F.lit(0)))


def _phone(e: Column, key: str) -> Column:
    country = F.length(e["d"]) - 10
    area, rest = _part(e["d"], country + 1, 3), _part(e["d"], country + 4, 7)
    low_area = area < 200
    low = low_area | (rest < 2_000_000)
    area_from, rest_from = F.when(low_area, 0).otherwise(200), F.when(low, 0).otherwise(2_000_000)
    areas = F.when(low_area, 200).otherwise(800)
    rests = F.when(low_area, 10_000_000).when(low, 2_000_000).otherwise(8_000_000)
    moved = F.transform(
        F.array(feistel(area - area_from, rest - rest_from, areas, rests, key, "phone")),
        lambda h: F.concat(
            F.substring(e["d"], F.lit(1), country),
            _padded(h["l"] + area_from, 3),
            _padded(h["r"] + rest_from, 7),
        ),
    )
    return _fill(e["x"], F.get(moved, F.lit(0)))


def _octets(e: Column) -> Column:
    return F.transform(F.split(e["x"], r"\."), lambda o: o.cast("long"))


def _address(e: Column, key: str) -> Column:
    o = _octets(e)
    half = [F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1)) for i in (0, 2)]
    moved = F.transform(
        F.array(feistel(half[0], half[1], F.lit(65536), F.lit(65536), key, "address")),
        lambda h: F.concat_ws(
            ".", *[x for s in ("l", "r") for x in (F.floor(h[s] / 256), h[s] % 256)]
        ),
    )
    return F.get(moved, F.lit(0))


def _social(e: Column, key: str) -> Column:
    area, group, serial = _part(e["d"], 1, 3), _part(e["d"], 4, 2), _part(e["d"], 6, 4)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    low = (group - 1) * 9999 + serial - 1
    moved = F.transform(
        F.array(feistel(index, low, F.lit(898), F.lit(99 * 9999), key, "social")),
        lambda h: F.concat(
            _padded(F.when(h["l"] >= 665, h["l"] + 2).otherwise(h["l"] + 1), 3),
            _padded(F.floor(h["r"] / 9999) + 1, 2),
            _padded(h["r"] % 9999 + 1, 4),
        ),
    )
    return _fill(e["x"], F.get(moved, F.lit(0)))


def _day(e: Column) -> Column:
    """Day number from the start of 1901, null if this is no date."""
    d = e["d"]

    def read(*cuts: tuple[int, int]) -> Column:
        text = F.concat_ws("-", *[F.substring(d, F.lit(a), F.lit(n)) for a, n in cuts])
        return F.datediff(F.try_to_date(text, "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date"))

    year_first = e["x"].rlike(r"^[0-9]{4}-")
    return F.when(year_first, read((1, 4), (5, 2), (7, 2))).otherwise(
        F.coalesce(read((5, 4), (3, 2), (1, 2)), read((5, 4), (1, 2), (3, 2)))
    )


def _date(e: Column, key: str) -> Column:
    day = e["day"].cast("long")
    inside = day % _CYCLE_DAYS
    month_first = ~e["x"].rlike(r"^[0-9]{4}-") & (_part(e["d"], 3, 2) > 12)
    # 10 227 = 21 * 487
    moved = F.transform(
        F.array(
            feistel(F.floor(inside / 487), inside % 487, F.lit(21), F.lit(487), key, "date")
        ),
        lambda h: F.date_add(
            F.lit(_FIRST_DAY).cast("date"), (day - inside + h["l"] * 487 + h["r"]).cast("int")
        ),
    )
    at = F.get(moved, F.lit(0))
    digits = (
        F.when(e["x"].rlike(r"^[0-9]{4}-"), F.date_format(at, "yyyyMMdd"))
        .when(month_first, F.date_format(at, "MMddyyyy"))
        .otherwise(F.date_format(at, "ddMMyyyy"))
    )
    return _fill(e["x"], digits)


def _mail(e: Column, key: str) -> Column:
    at = F.split(F.lower(e["x"]), "@")
    local = F.substring(_keyed(key, "mail", F.lower(e["x"])), 1, 16)
    domain = F.substring(_keyed(key, "domain", F.get(at, F.lit(1))), 1, 12)
    return F.concat(F.lit("u"), local, F.lit("@d"), domain, F.lit(".invalid"))


def _valid(e: Column) -> Column:
    """The kind of a stretch of text, null if it doesn't validate."""
    x, d = e["x"], e["d"]
    days = F.lit(_CYCLE_DAYS * _CYCLES)
    checks = {
        "mail": x.contains("@"),
        "address": x.rlike(f"^{_ADDRESS}$") & F.forall(_octets(e), lambda o: o <= 255),
        "card": x.rlike(f"^{_CARD}$") & (_luhn(d, 2) % 10 == 0) & (F.length(F.translate(d, "0", "")) > 0),
        "phone": x.rlike(f"^(?:{_PHONE})$"),
        "social": x.rlike(f"^{_SOCIAL}$")
        & _part(d, 1, 3).between(1, 899)
        & (_part(d, 1, 3) != 666)
        & (_part(d, 4, 2) > 0)
        & (_part(d, 6, 4) > 0),
        "date": (e["day"] >= 0) & (e["day"] < days),
    }
    kind = None
    for name, check in checks.items():
        kind = F.when(check, name) if kind is None else kind.when(check, name)
    return kind


_MOVES = {
    "mail": _mail,
    "address": _address,
    "card": _card,
    "phone": _phone,
    "social": _social,
    "date": _date,
}


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY) -> DataFrame:
    """Per row of `docs`: `row` (its columns but text), `text` rewritten, `found` kinds in order."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    may_hold = F.col("text").rlike("[0-9@]")
    none = F.array().cast("array<string>")
    cut = computed_once(
        docs.select(F.struct(*others).alias("row"), "text"),
        ["row", "text"],
        _at=F.when(may_hold, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))).otherwise(none),
    )
    hits = F.transform(
        "_at", lambda x: F.struct(x.alias("x"), F.regexp_replace(x, "[^0-9]", "").alias("d"))
    )
    dated = F.transform(
        hits,
        lambda e: F.struct(
            e["x"].alias("x"),
            e["d"].alias("d"),
            F.when(F.length(e["d"]) == 8, F.when(e["x"].rlike(f"^(?:{_DATE})$"), _day(e))).alias("day"),
        ),
    )
    judged = computed_once(
        cut,
        ["row", "text"],
        _hits=F.transform(
            dated,
            lambda e: F.struct(
                e["x"].alias("x"), e["d"].alias("d"), e["day"].alias("day"), _valid(e).alias("kind")
            ),
        ),
    )

    def moved(e: Column) -> Column:
        out = None
        for kind, move in _MOVES.items():
            is_kind = e["kind"] == kind
            out = F.when(is_kind, move(e, key)) if out is None else out.when(is_kind, move(e, key))
        return out.otherwise(e["x"])

    new = computed_once(
        judged,
        ["row", "text", "_hits"],
        _new=F.transform("_hits", moved),
    )
    between = F.split("text", _ANY, -1)
    rebuilt = F.concat(
        F.array_join(F.zip_with(F.slice(between, 1, F.size("_new")), "_new", lambda a, b: F.concat(a, b)), ""),
        F.element_at(between, -1),
    )
    return new.select(
        "row",
        F.when(F.size("_new") > 0, rebuilt).otherwise(F.col("text")).alias("text"),
        F.filter(F.transform("_hits", lambda e: e["kind"]), lambda k: k.isNotNull()).alias("found"),
    )
