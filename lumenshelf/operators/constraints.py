"""Constraints of tables as checks that return the rows that break them.

All rules of a table that look at one row are one scan; each set of key
columns is one aggregation, each reference one anti join of distinct keys.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A condition of single rows; as in SQL, a row breaks it only where it is false, not where it is null."""

    name: str
    condition: str
    shown: tuple[str, ...]


@dataclass(frozen=True)
class NotNull:
    """Columns that may not be null."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    """Columns whose values together occur once; rows with a null among them are free."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Columns whose values together occur in another table; rows with a null among them are free."""

    name: str
    columns: tuple[str, ...]
    table: str
    target: tuple[str, ...]


Rule = Check | NotNull | Unique | Reference


def one_of(name: str, column: str, values: Iterable[str]) -> Check:
    """A column that holds one of some texts, or null."""
    return Check(name, f"{column} in ({', '.join(repr(v) for v in values)})", (column,))


def _text(columns: Iterable[str]) -> Column:
    """Values as one text: column names and values, null told apart from a text."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns))


def violations(table: DataFrame, rules: Iterable[Rule], key: tuple[str, ...], others: dict[str, DataFrame] | None = None) -> DataFrame:
    """rule, key, value, n: each row (or group of rows) of table that breaks a rule.

    `key` names the columns that tell rows apart in the report. For Check and
    NotNull n is the number of rows with this key and these values, for Unique
    the number of rows that share the values, for Reference the number that
    points nowhere; the report of the last two has the values as key. Rules
    that all rows keep give no rows, and so do no rules and empty tables.
    """
    rules = list(rules)
    parts = []
    tests = []
    for rule in rules:
        if isinstance(rule, Check):
            tests.append(F.when(~F.expr(rule.condition), F.struct(F.lit(rule.name).alias("rule"), _text(rule.shown).alias("value"))))
        elif isinstance(rule, NotNull):
            broken = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in rule.columns))
            tests.append(F.when(broken, F.struct(F.lit(rule.name).alias("rule"), _text(rule.columns).alias("value"))))
    if tests:
        found = table.select(_text(key).alias("key"), F.explode(F.array_compact(F.array(*tests))).alias("_broken"))
        parts.append(found.groupBy("_broken.rule", "key", "_broken.value").agg(F.count("*").alias("n")))
    by_columns: dict[tuple[str, ...], list[Unique]] = {}
    for rule in rules:
        if isinstance(rule, Unique):
            by_columns.setdefault(tuple(sorted(rule.columns)), []).append(rule)
    for same in by_columns.values():
        columns = same[0].columns
        full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
        repeated = table.where(full).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
        names = F.explode(F.array(*(F.lit(r.name) for r in same)))
        parts.append(repeated.select(names.alias("rule"), _text(columns).alias("key"), F.lit("repeated").alias("value"), "n"))
    for rule in rules:
        if isinstance(rule, Reference):
            full = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in rule.columns))
            wanted = table.where(full).groupBy(*rule.columns).agg(F.count("*").alias("n"))
            there = (others or {})[rule.table].select(*(F.col(t).alias(c) for c, t in zip(rule.columns, rule.target))).distinct()
            orphans = wanted.join(there, list(rule.columns), "left_anti")
            parts.append(orphans.select(F.lit(rule.name).alias("rule"), _text(rule.columns).alias("key"), F.lit(f"not in {rule.table}").alias("value"), "n"))
    if not parts:
        return table.sparkSession.createDataFrame([], "rule string, key string, value string, n long")
    return reduce(DataFrame.unionByName, (p.select("rule", "key", "value", "n") for p in parts))


# --- fixed values: the constraints of the recommendation tables --------------
SHELF = [
    one_of("shelf_status", "status", ("wishlist", "reading", "finished")),
    one_of("shelf_rating", "rating", ("good", "bad")),
    Check("wishlist_no_rating", "status <> 'wishlist' or rating is null", ("status", "rating")),
    Unique("shelf_user_book", ("user_id", "book_id")),
    Reference("shelf_book", ("book_id",), "books", ("book_id",)),
]
IMPRESSIONS = [
    one_of("impression_source", "source", ("home_recommend", "similar", "curation", "search")),
    one_of("impression_action", "action", ("clicked", "saved", "liked", "disliked", "ignored")),
    NotNull("impression_required", ("user_id", "book_id", "position", "source")),
]
VECTORS = [
    one_of("vector_source_tier", "source_tier", ("rich", "kakao_desc", "minimal")),
    NotNull("vector_required", ("book_id", "source_tier")),
    Unique("vector_book", ("book_id",)),
]
# ----------------------------------------------------------------------------
