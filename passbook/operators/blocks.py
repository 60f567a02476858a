"""Ordered steps over long documents: every document is cut into blocks of its order, and blocks are joined by what they carry.

A window over a document runs in one task, however long the document. Here each block
is a group of its own; what the blocks before it leave is worked out from one row a
block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import let

#: Places of the order in a block.
SIZE = 512
Step = Callable[[Column, Column], Column]


def transducer(rows: DataFrame, key: str, order: str, states: int, step: Step, sums: Mapping[str, Step] | None = None, lasts: Mapping[str, tuple[str, Step]] | None = None, start: int = 0, size: int = SIZE) -> DataFrame:
    """``rows`` run through a finite automaton, document by document in ``order`` (whole numbers from 0, unique in a document).

    ``step`` gives the state (0 to ``states`` - 1) after a row from the state before and
    the row; ``sums`` whole numbers that are added up, ``lasts`` (type and value) values
    of which the last known one counts. Added are ``before``, the state in front of the
    row, and the sums and lasts up to and with it.

    A block is a function of the state it begins in, given by a table with the state,
    sums and lasts at its end for each; the tables of a document are applied one after
    another, then each block runs from what it begins with.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    names = [*sums, *lasts]
    others = [c for c in rows.columns if c not in (key, order)]
    packed = rows.withColumn("__block", F.floor(F.col(order) / size).cast("long")).where(F.col(key).isNotNull() & F.col("__block").isNotNull()).groupBy(key, "__block").agg(F.array_sort(F.collect_list(F.struct(order, *others))).alias("__rows"))
    # One shuffle of the packed rows serves both the tables and the walk: else all that made the rows would run for each.
    # Rows without key or place go first, as the join below would drop them on one of its sides only, and the two would differ.
    packed = packed.repartition(key, "__block")

    def zero(s: Column) -> Column:
        return F.struct(s.cast("int").alias("s"), *[F.lit(0).cast("long").alias(c) for c in sums], *[F.lit(None).cast(kind).alias(c) for c, (kind, _) in lasts.items()])

    def after(e: Column, r: Column) -> Column:
        return F.struct(step(e["s"], r).cast("int").alias("s"), *[(e[c] + f(e["s"], r)).cast("long").alias(c) for c, f in sums.items()], *[F.coalesce(f(e["s"], r), e[c]).cast(kind).alias(c) for c, (kind, f) in lasts.items()])

    def joined(e: Column, t: Column) -> Column:
        return F.struct(t["s"].alias("s"), *[(e[c] + t[c]).alias(c) for c in sums], *[F.coalesce(t[c], e[c]).alias(c) for c in lasts])

    # Block 0 begins a document if there is one: it is run from the start only.
    table = F.transform(F.when(F.col("__block") == 0, F.array(F.lit(start))).otherwise(F.array(*map(F.lit, range(states)))), lambda s: F.aggregate("__rows", zero(s), after))
    kinds = "s:int" + "".join(f",{c}:bigint" for c in sums) + "".join(f",{c}:{kind}" for c, (kind, _) in lasts.items())
    begun = F.struct(zero(F.lit(start)).alias("e"), F.array().cast(f"array<struct<__block:bigint,__e:struct<{kinds}>>>").alias("out"))
    chained = F.aggregate(F.array_sort(F.collect_list(F.struct("__block", "__table"))), begun, lambda acc, b: F.struct(joined(acc["e"], F.get(b["__table"], F.when(b["__block"] == 0, 0).otherwise(acc["e"]["s"]))).alias("e"), F.array_append(acc["out"], F.struct(b["__block"], acc["e"].alias("__e"))).alias("out")))
    starts = packed.select(key, "__block", table.alias("__table")).groupBy(key).agg(chained["out"].alias("out")).select(key, F.inline("out"))

    told = f"array<struct<{kinds.replace('s:int', 'before:int', 1)}>>"
    state = F.struct(F.col("__e").alias("e"), F.array().cast(told).alias("out"))
    walked = F.aggregate("__rows", state, lambda acc, r: let(after(acc["e"], r), lambda e: F.struct(e.alias("e"), F.array_append(acc["out"], F.struct(acc["e"]["s"].alias("before"), *[e[c].alias(c) for c in names])).alias("out"))))["out"]
    zipped = packed.join(starts, [key, "__block"]).select(key, "__rows", walked.alias("__told")).select(key, F.explode(F.arrays_zip("__rows", "__told")).alias("__z"))
    row, told = F.col("__z")["__rows"], F.col("__z")["__told"]
    return zipped.select(key, row[order].alias(order), *[row[c].alias(c) for c in others if c not in names], told["before"].alias("before"), *[told[c].alias(c) for c in names])
