"""Text and array helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fifty digits of node tags, letters without 'l' and 'I'; and the roots' letters, which begin anew after the last.
DIGITS = "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNOPQRSTUVWXYZ"
ROOTS = "αβγδεζηθικλμνξοπρςστυφχψω"
#: Digits of the largest 64-bit number.
PLACES = 12
#: What a solver's summary gives extrema of.
EXTREMA = ("Cost", "Penalty", "Trials", "Time")


def handle(name: Column) -> Column:
    """A handle from a name: a leading !x! goes, lower case, blanks become underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^![^!]*!", "")), " ", "_")


def node_tag(n: Column) -> Column:
    """A terminal's number in base 50, a root's Greek letter."""
    # Whole-number division, as doubles would lose the last digits of large numbers.
    digits, rest = [], n
    for _ in range(PLACES):
        digits.append(F.when(rest > 0, F.substr(F.lit(DIGITS), (rest % 50).cast("int") + 1, F.lit(1))).otherwise(""))
        rest = F.call_function("div", rest, F.lit(50))
    tag = F.when(n == 0, DIGITS[0]).otherwise(F.concat(*reversed(digits)))
    return F.when(n < 0, F.substr(F.lit(ROOTS), ((-n - 1) % len(ROOTS)).cast("int") + 1, F.lit(1))).otherwise(tag)


def node_of(tag: Column) -> Column:
    """The number that `node_tag` names (of roots, the first of that letter)."""
    digits = F.split(tag, "")
    value = F.aggregate(F.filter(digits, lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a * 50 + F.instr(F.lit(DIGITS), c) - 1)
    root = F.instr(F.lit(ROOTS), tag)
    return F.when((F.length(tag) == 1) & (root > 0), -root.cast("long")).otherwise(value)


def named(**columns: Column) -> Column:
    """A struct of named columns."""
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def summary_extrema(text: Column) -> list[Column]:
    """The least and the largest of each of `EXTREMA` in a solver's summary, null where it says nothing."""
    found = lambda k, e: F.nullif(F.regexp_extract(text, rf"{k}\.{e} = (-?[0-9.]*[0-9])", 1), F.lit("")).cast("double").alias(f"{k.lower()}_{e}")
    return [found(k, e) for k in EXTREMA for e in ("min", "max")]


def node_list(ids: Column, sep: str = ", ") -> Column:
    """The tags of an array of nodes, joined."""
    return F.array_join(F.transform(ids, lambda n: node_tag(n)), sep)


def without(ids: Column, n: Column) -> Column:
    return F.array_remove(ids, n)


def turned_to(ids: Column, head: Column) -> Column:
    """A path so that it begins at `head`, if either end is that."""
    return F.when(F.element_at(ids, -1) == head, F.reverse(ids)).otherwise(ids)


def options_json(options: Column, drop: list[str]) -> Column:
    """A map as JSON in the order of keys, some keys left out."""
    kept = F.map_filter(options, lambda k, _: ~k.isin(drop))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))
