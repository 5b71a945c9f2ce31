"""Hybrid logical clocks and vector clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hlc(wall_ms: Column, counter: Column, node: Column) -> Column:
    """Structs compare field by field, which is the clock's order."""
    return F.struct(wall_ms.alias("wall_ms"), counter.alias("counter"), node.alias("node"))


def pack(wall_ms: Column, counter: Column, node: Column) -> Column:
    return F.concat(F.lpad(wall_ms.cast("string"), 13, "0"), F.lit("."), F.lpad(counter.cast("string"), 5, "0"), F.lit("."), node)


def parse(packed: Column) -> Column:
    p = F.split(packed, r"\.", 3)
    return F.struct(p[0].cast("long").alias("wall_ms"), p[1].cast("int").alias("counter"), p[2].alias("node"))


def dominates(a: Column, b: Column) -> Column:
    return a > b


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def vclock_merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(_zero(x), _zero(y)))


def vclock_tick(a: Column, node: Column) -> Column:
    one = F.map_from_arrays(F.array(node), F.array(F.lit(1)))
    return F.map_zip_with(a, one, lambda k, x, y: _zero(x) + _zero(y))


def vclock_compare(a: Column, b: Column) -> Column:
    """before, after, concurrent or equal."""
    both = F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.struct(_zero(x).alias("x"), _zero(y).alias("y"))))
    less, more = F.exists(both, lambda p: p["x"] < p["y"]), F.exists(both, lambda p: p["x"] > p["y"])
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")


def vclock_deliverable(seen: Column, incoming: Column, sender: Column) -> Column:
    """The next one from its sender, with no dependency unseen."""
    both = F.map_entries(F.map_zip_with(seen, incoming, lambda k, x, y: F.struct(_zero(x).alias("x"), _zero(y).alias("y"))))
    return F.forall(both, lambda e: F.when(e["key"] == sender, e["value"]["y"] == e["value"]["x"] + 1).otherwise(e["value"]["y"] <= e["value"]["x"]))
