"""Small builders that turn word lists into SQL expressions.

Rule chains are long; as SQL text each chain reaches Spark in one call instead of one
call per operator.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quote(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def contains_any(text: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def is_in(value: str, options: Iterable[object]) -> str:
    return f"{value} IN ({', '.join(quote(o) for o in options)})"


def first_match(rules: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    """Value of the first rule whose condition holds."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def lookup(key: str, table: dict, default: str = "NULL") -> str:
    """`table[key]`; the default where the key is absent."""
    pairs = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {key} {pairs} ELSE {default} END"


def group(text: str, pattern: str, index: int = 1) -> str:
    """One regex group, null instead of '' when there is no match."""
    return f"nullif(regexp_extract({text}, {quote(pattern)}, {index}), '')"


def with_once(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns that are computed once per row, however many filters read them.

    Catalyst moves a filter below the projection that defines its columns and copies their
    definitions into it; through several steps of regex work the copies multiply. It copies
    nothing through a generator, and this one makes one row of each; filters on the other columns
    still move below it, down to the scan.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    row = F.struct(*[F.expr(e).alias(n) for n, e in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
