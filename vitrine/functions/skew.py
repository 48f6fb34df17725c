"""Join that spreads hot keys of the left side over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import sizing

HOT_ROWS = 1_000_000


def join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str,
    spread: list[str],
    counts: DataFrame | None = None,
    check_small: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``left JOIN right`` (inner or left) where a key may hold most of ``left``.

    Keys with more than ``hot_rows`` left rows are salted by the ``spread``
    columns, which must tell the left rows of one key apart, with as many salts
    as the key's rows need; only the right rows of those keys are repeated. The
    hot keys are measured, and broadcast only if they are small. A caller that
    counts the left keys anyway passes ``counts`` (keys and ``count``). With
    ``check_small`` the right side is computed and measured first, and simply
    broadcast if it is small.
    """
    if check_small:
        right, small = sizing.settle(right)
        if small:
            return left.join(F.broadcast(right), keys, how)
    counted = left.groupBy(*keys).count() if counts is None else counts
    salts = F.ceil(F.col("count") / F.lit(hot_rows)).cast("int")
    hot = sizing.small_side(counted.filter(F.col("count") > hot_rows).select(*keys, salts.alias("_salts")))
    spread_salt = F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")
    salted_left = left.join(hot, keys, "left").withColumn("_salt", F.coalesce(spread_salt, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.drop("_salts").join(salted_right, [*keys, "_salt"], how).drop("_salt")
