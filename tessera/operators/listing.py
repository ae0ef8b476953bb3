"""Filters, pages and picks per group, shared by all lists."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import contains_any


def where(
    df: DataFrame,
    search: str | None = None,
    search_in: Sequence[str] = (),
    equal: dict[str, object] | None = None,
    among: dict[str, Sequence[object]] | None = None,
    at_least: dict[str, object] | None = None,
    at_most: dict[str, object] | None = None,
    has_all: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """The rows that pass every filter given; a value of None gives no filter."""
    tests: list[Column] = []
    if search:
        tests.append(contains_any([F.col(c) for c in search_in], search))
    tests += [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    tests += [F.col(c).isin(list(v)) for c, v in (among or {}).items() if v]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    tests += [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    tests += [F.array_contains(c, v) for c, values in (has_all or {}).items() for v in values]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 25) -> DataFrame:
    """Page ``number`` (from 1) of rows in a total order."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_facts(total: int, number: int, size: int) -> dict[str, int]:
    pages = max(1, math.ceil(total / size))
    start = (number - 1) * size + 1 if total else 0
    return {"pages": pages, "start": start, "end": min(number * size, total)}


def clamp_page(number: object, size: object, most: int = 100, default: int = 25) -> tuple[int, int]:
    """A page number of at least 1 and a size of 1 to ``most`` from untrusted values."""

    def whole(value: object, other: int) -> int:
        try:
            return int(str(value))
        except ValueError:
            return other

    return max(1, whole(number, 1)), min(most, max(1, whole(size, default)))


def cursor_of(created: datetime, key: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([created.isoformat(), key]).encode()).decode().rstrip("=")


def read_cursor(cursor: str | None) -> tuple[datetime, int] | None:
    """The position in a cursor; None for none. Anything else than ``cursor_of`` makes is an error."""
    if not cursor:
        return None
    if len(cursor) > 512:
        raise ValueError("the cursor is too long")
    try:
        created, key = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return datetime.fromisoformat(created), int(key)
    except (ValueError, TypeError) as error:
        raise ValueError("the cursor is not valid") from error


def after_cursor(df: DataFrame, created: str, key: str, position: tuple[datetime, int] | None, size: int) -> DataFrame:
    """Newest first from the position on, one row more than ``size`` so that more can be seen."""
    time = F.coalesce(F.col(created), F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"))
    if position:
        at = F.lit(position[0]).cast("timestamp_ntz")
        df = df.filter((time < at) | ((time == at) & (F.col(key) < position[1])))
    return df.orderBy(time.desc(), F.col(key).desc()).limit(size + 1)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], quota: int | Column) -> DataFrame:
    """The first ``quota`` rows of each group, with their rank."""
    return ranked(df, group, order).filter(F.col("rank") <= quota)


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return top_per_group(df, key, order, 1).drop("rank")


def with_backfill(df: DataFrame, group: str, order: Sequence[Column], quotas: dict[str, int] | int, total: int) -> DataFrame:
    """Each group's quota (one for all, or by group), then the best of what is left over all groups up to ``total``.

    Adds rank (in the group), tier (0 by quota, 1 as fill) and place (1 to ``total``). The
    overflow of all groups is cut to ``total`` rows before it is ordered as one.
    """
    each = quotas.items() if isinstance(quotas, dict) else ()
    quota = reduce(lambda out, item: F.when(F.col(group) == item[0], item[1]).otherwise(out), each, F.lit(0 if isinstance(quotas, dict) else quotas))
    all_ranked = ranked(df, [group], order)
    own = all_ranked.filter(F.col("rank") <= quota).withColumn("tier", F.lit(0))
    spare = all_ranked.filter(F.col("rank") > quota).orderBy(*order).limit(total).withColumn("tier", F.lit(1))
    both = own.unionByName(spare).orderBy("tier", *order).limit(total)
    return both.withColumn("place", F.row_number().over(Window.orderBy("tier", *order)))


def round_robin(df: DataFrame, group: str, order: Sequence[Column], wanted: Column, success: str, attempts: int = 30) -> DataFrame:
    """Visits the best of every group, then the second best ..., until a group has what is ``wanted``.

    ``success`` is a boolean column. Returns the rows visited, with turn (in the group) and visit.
    """
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turns = ranked(df, [group], order, "turn").filter(F.col("turn") <= attempts)
    had = F.coalesce(F.sum(F.col(success).cast("int")).over(before), F.lit(0))
    visited = turns.withColumn("_had", had).filter(F.col("_had") < wanted).drop("_had")
    first = visited.orderBy("turn", group).limit(attempts)
    return first.withColumn("visit", F.row_number().over(Window.orderBy("turn", group)))


def forward_filled(df: DataFrame, column: str, group: Sequence[str], order: Sequence[Column], name: str | None = None) -> DataFrame:
    """Nulls take the last value before them."""
    past = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name or column, F.last(column, ignorenulls=True).over(past))


def latched(df: DataFrame, group: Sequence[str], order: Sequence[Column], state: str, final: Sequence[str], name: str = "latched") -> DataFrame:
    """The state, held from the first of the ``final`` states on."""
    past = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first_final = F.first(F.when(F.col(state).isin(list(final)), F.col(state)), ignorenulls=True).over(past)
    return df.withColumn(name, F.coalesce(first_final, F.col(state)))


def drift(made: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks (counting repeats), with side made or stored."""
    extra = made.exceptAll(stored).withColumn("side", F.lit("made"))
    return extra.unionByName(stored.exceptAll(made).withColumn("side", F.lit("stored")))
