"""Containers of a row as arrays and maps: sets, maps, stacks, queues, packed arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_insert(items: Column, value: Column) -> Column:
    """A set keeps one of each."""
    return F.when(F.array_contains(items, value), items).otherwise(F.array_append(items, value))


def map_insert(m: Column, key: Column, value: Column) -> Column:
    """An insert leaves a key that is there as it is."""
    return F.when(F.map_contains_key(m, key), m).otherwise(F.map_concat(m, F.create_map(key, value)))


def map_assign(m: Column, key: Column, value: Column) -> Column:
    """An assignment replaces."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def map_erase(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def push(items: Column, value: Column, most: int | None = None) -> Column:
    """At the end; a bounded buffer loses its oldest."""
    out = F.array_append(items, value)
    return F.slice(out, F.greatest(F.size(out) - most + 1, F.lit(1)), F.lit(most)) if most else out


def push_front(items: Column, value: Column) -> Column:
    return F.array_prepend(items, value)


def top(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def front(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def pop(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def dequeue(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def insert_at(items: Column, at: int, value: Column) -> Column:
    """Before the element at a place from 0."""
    return F.array_insert(items, at + 1, value)


def erase_at(items: Column, at: int) -> Column:
    return F.filter(items, lambda _, i: i != at)


def resize(items: Column, n: int, fill: Column) -> Column:
    kept = F.slice(items, F.lit(1), F.lit(n))
    return F.concat(kept, F.array_repeat(fill, F.greatest(F.lit(n) - F.size(items), F.lit(0))))


def packed_words(values: Column, width: int) -> Column:
    """Array of BIGINT words of 32 bits, lowest first; values saturate at the width."""
    per = 32 // width
    top_ = (1 << width) - 1
    kept = F.transform(values, lambda v: F.least(F.greatest(v.cast("long"), F.lit(0)), F.lit(top_)))
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / per).cast("int") - 1, F.lit(0)))

    def word(w: Column) -> Column:
        part = F.slice(kept, w * per + 1, F.lit(per))
        return F.aggregate(F.transform(part, lambda v, i: F.call_function("shiftleft", v, i * width)), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))

    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(words, word))


def unpacked(words: Column, width: int, n: Column) -> Column:
    per, mask = 32 // width, (1 << width) - 1
    each = lambda w: F.transform(F.lit(list(range(0, per * width, width))), lambda s: F.call_function("shiftrightunsigned", w, s).bitwiseAND(mask))
    return F.slice(F.flatten(F.transform(words, each)), F.lit(1), n)


def repacked(words: Column, width: int, to: int, n: Column) -> Column:
    """The same values at another width, saturated."""
    return packed_words(unpacked(words, width, n), to)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
