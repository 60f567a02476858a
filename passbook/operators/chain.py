"""Sources asked one after another: each sees only what earlier ones left without an answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stashed import stash


def staged(docs: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], key: str = "doc_id") -> DataFrame:
    """Rows of the first stage that has any for a key, with ``level``: its name.

    ``docs`` has all rows of the keys (pages, tokens, lines); a stage gets those of the
    keys that are left and returns rows with the key, all stages the same columns.
    What a stage found is stashed: it is both output and what later ones leave out, and is made once.
    """
    left, out = docs, None
    for k, (level, stage) in enumerate(stages, 1):
        found = stage(left).withColumn("level", F.lit(level))
        if k < len(stages):
            found, _ = stash(found)
            left = left.join(found.select(key).distinct(), key, "left_anti")
        out = found if out is None else out.unionByName(found)
    return out
