"""Array and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_items(items: Column, most: int = 180) -> Column:
    """The last ``most`` items, all of them if there are fewer."""
    return F.slice(items, F.greatest(F.size(items) - most + 1, F.lit(1)), most)


def appended(items: Column, item: Column, most: int = 180) -> Column:
    """A bounded log with one item more."""
    return last_items(F.array_append(items, item), most)


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def same_items(a: Column, b: Column) -> Column:
    """Equal also in how often each item stands."""
    return F.array_sort(a) == F.array_sort(b)


def all_different(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def scope_applies(scopes: Column, wanted: Column) -> Column:
    """No scope or All fits everything; else one must hold the wanted name or be held by it."""
    low = F.lower(F.trim(wanted))
    fits = lambda s: (F.lower(F.trim(s)) == "all") | low.contains(F.lower(F.trim(s))) | F.lower(F.trim(s)).contains(low)
    return (F.size(F.coalesce(scopes, F.array().cast("array<string>"))) == 0) | F.exists(scopes, fits)


def json_length(json: Column) -> Column:
    """Items of a JSON array; 0 for anything else."""
    return F.coalesce(F.json_array_length(json), F.lit(0))


def first_json(json: Column, paths: list[str]) -> Column:
    """The first of the paths that holds something."""
    return F.coalesce(*(F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths))


def chart(name: Column, value: Column, title: str, kind: str = "bar") -> Column:
    """An aggregate: the JSON of a chart, its points by name."""
    points = F.array_sort(F.collect_list(F.struct(name.alias("name"), value.alias("value"))))
    return F.to_json(F.struct(F.lit(kind).alias("type"), points.alias("data"), F.lit(title).alias("title")))


def packed_paragraphs(text: Column, most: int = 3000, whole: int = 3500) -> Column:
    """A text of more than ``whole`` characters as chunks of paragraphs, ``most`` characters each.

    Paragraphs stay in order and whole, also one that is longer.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit("\n\n"), part))
        fits = F.length(joined) <= most
        closed = F.when(fits | (state["open"] == ""), state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return F.struct(closed.alias("done"), F.when(fits, joined).otherwise(part).alias("open"))

    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"]))
    chunks = F.aggregate(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != ""), start, step, end)
    return F.when(F.length(text) <= whole, F.array(text)).otherwise(chunks)
