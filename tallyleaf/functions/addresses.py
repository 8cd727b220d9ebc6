"""Addresses of values in documents: arrays of steps, which join, group and sort as they are.

A step is "k" and a key, "i" and an index of ten digits, or "j" and the label of an array element
that has no partner ("jp2"). So the order of arrays is reading order, keys never equal indices, and
labels never equal either. In a node key every index is "i" alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY, INDEX, LABEL = "k", "i", "j"
Address = tuple[str, ...]


def key_step(name: str) -> str:
    return KEY + name


def index_step(i: int) -> str:
    return f"{INDEX}{i:010d}"


def is_index(step: Column) -> Column:
    """Whether a step is an index or a label."""
    return step.startswith(INDEX) | step.startswith(LABEL)


def node_key(address: Column) -> Column:
    """The address with indices and labels left blank: the place in the schema."""
    return F.transform(address, lambda s: F.when(is_index(s), F.lit(INDEX)).otherwise(s))


def _index_text(step: Column) -> Column:
    return F.when(step.startswith(LABEL), F.substring(step, 2, 1 << 30)).otherwise(F.substring(step, 2, 1 << 30).try_cast("bigint").cast("string"))


def _joined(address: Column, key, index) -> Column:
    text = F.array_join(F.transform(address, lambda s: F.when(is_index(s), F.concat(F.lit("["), index(s), F.lit("]"))).otherwise(F.concat(F.lit("."), key(F.substring(s, 2, 1 << 30))))), "")
    return F.when(F.size(address) == 0, F.lit("<root>")).otherwise(F.when(text.startswith("."), F.substring(text, 2, 1 << 30)).otherwise(text))


def show(address: Column) -> Column:
    """Like ``holdings[0].issuer``; ``<root>`` for the empty address."""
    return _joined(address, lambda name: name, _index_text)


def format_node(node: Column) -> Column:
    """Like ``books[*].chapters``; keys with a dot or bracket are quoted, so that no two nodes look alike."""

    def quoted(name: Column) -> Column:
        escaped = F.replace(name, F.lit("\\"), F.lit("\\\\"))
        apostrophe, quote = F.contains(name, F.lit("'")), F.contains(name, F.lit('"'))
        text = F.when(apostrophe & ~quote, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
        return F.when(name.rlike(r"[.\[\]]"), text).otherwise(name)

    return _joined(node, quoted, lambda _: F.lit("*"))


def array_prefixes(address: Column) -> Column:
    """What stands before each index step, outermost first."""
    places = F.filter(F.sequence(F.lit(1), F.size(address)), lambda i: is_index(F.get(address, i - 1)))
    return F.when(F.size(address) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(places, lambda i: F.slice(address, F.lit(1), i - 1)))


def index_place(address: Column, nth: int) -> Column:
    """1-based place of the nth index step, or null."""
    places = F.filter(F.transform(address, lambda s, i: F.when(is_index(s), i + 1)), lambda i: i.isNotNull())
    return F.get(places, F.lit(nth - 1))


def index_count(address: Column) -> Column:
    return F.size(F.filter(address, is_index))
