"""Choice among overlapping candidates: the first recogniser, then the longest, then the leftmost claims its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import text as T


def _claimed(candidates: Column, none: Column) -> Column:
    """The candidates that claim their place, in order of start."""
    rank = F.array_sort(F.transform(candidates, lambda c: F.struct(c["priority"].alias("a"), (-c["len"]).alias("b"), c["start"].alias("s"), c.alias("c"))))

    def add(kept: Column, r: Column) -> Column:
        c = r["c"]
        free = ~F.exists(kept, lambda k: (k["start"] < c["start"] + c["len"]) & (c["start"] < k["start"] + k["len"]))
        return F.when(free, F.concat(kept, F.array(c))).otherwise(kept)

    return _by_start(F.aggregate(rank, none, add))


def _by_start(candidates: Column) -> Column:
    return F.transform(F.array_sort(F.transform(candidates, lambda c: F.struct(c["start"].alias("s"), c.alias("c")))), lambda x: x["c"])


def resolved(candidates: Column, none: Column) -> Column:
    """An array of candidate structs (priority, start, len, ...) without overlaps, in order of start; none: an empty one.

    In order of start, a candidate that begins where all before it have ended
    begins a new run.  Runs do not touch each other, so each is resolved by a
    fold of its own, inside the row: no shuffle, and a text of many entities
    takes time in proportion.
    """

    def runs(c: Column) -> Column:
        ends = T.scanned(F.transform(c, lambda x: x["start"] + x["len"]), F.lit(0), lambda x, y: F.greatest(x, y))

        def cut(end: Column) -> Column:
            first = F.filter(F.transform(c, lambda x, i: F.when(x["start"] >= F.get(end, i), i)), lambda i: i.isNotNull())

            def each(begin: Column) -> Column:
                def run(b: Column, k: Column) -> Column:
                    n = F.coalesce(F.get(begin, k + 1), F.size(c)) - b
                    return F.when(n == 1, F.array(F.get(c, b))).otherwise(_claimed(F.slice(c, b + 1, n), none))

                return F.flatten(F.transform(begin, run))

            return T.let(first, each)

        return T.let(ends, cut)

    return T.let(_by_start(candidates), runs)
