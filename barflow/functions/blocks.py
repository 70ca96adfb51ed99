"""Long series over many tasks: blocks of a series with the rows around them that their results depend on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from barflow.functions.ranks import ranked

#: Rows of a block. Recursive averages forget what is this many rows back: of decays up to 0.93 less than a double's precision stays.
SIZE, FORGOTTEN = 1 << 20, 600


def in_blocks(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], before: int = FORGOTTEN, after: int = 0, size: int = SIZE, key: str = "symbol", order: str = "ts") -> DataFrame:
    """``compute(rows)`` for series of any length, if a row's result depends on no more than ``before`` rows of its ``key`` before it and ``after``
    behind it.

    Rows are numbered without a window over a series (``ranks.ranked``) and cut into blocks; the rows before and behind a block are given
    to it too and left out of the result. ``compute`` sees each block as a key of its own, so that a hot series is as many keys as
    it has blocks. It must keep ``key`` and the columns of ``rows``; ``order`` has no repeats within a key. Null keys are one series.
    """
    if size < max(before, after):
        raise ValueError("a block must be longer than what lies around it")
    numbered = ranked(rows.withColumns({"value": F.col(order), "c": F.lit(1).cast("long")}), [key]).drop("value", "c", "n")
    at = F.col("upto") - 1
    own, place = F.floor(at / size), at % size
    blocks = F.array_compact(F.array(own, F.when(place >= size - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    dealt = numbered.withColumn("_in_own", own).withColumn("_in_block", F.explode(blocks))
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("\x00")), F.lit("\x01"), F.col("_in_block").cast("string"))
    found = compute(dealt.withColumns({"_in_series": F.col(key), key: name}).drop("upto"))
    return found.where("_in_own = _in_block").withColumn(key, F.col("_in_series")).drop("_in_own", "_in_block", "_in_series")
