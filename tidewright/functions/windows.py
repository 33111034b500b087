"""Windows over long series of few instruments.

A window partitioned by instrument alone would put a whole series into one task. ``numbered`` gives
rows their place in a series by a two-level count, and ``with_halo`` cuts a series into blocks of
rows, each preceded by a copy of the rows that its frames look back to, so that windows are
partitioned by (instrument, block) and scale with the length of a series. Exponential
means (``ewm``) look back without end, but only so far that it matters. Running sums, maxima and
carried values have two levels: blocks, and rows inside one.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Rows of a block; frames look back less than this.
BLOCK = 4_096
#: Rows of a block with exponential means, bounded so that the powers of their decay stay finite.
EWM_BLOCK = 1_024


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all executors share: the one in ``spark.checkpoint.dir``.

    A temporary folder is taken only where none is set on a local master, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewright-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from a checkpoint by all that follows: what is used several times isn't planned again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, keys: list[str], order: list[str], unit: str = "month", name: str = "rn") -> DataFrame:
    """Adds the 1-based place of a row in its series, ordered by ``order`` (a timestamp first).

    Counts per (series, calendar unit) give the offset of a unit; rows are numbered inside units.
    """
    marked = df.withColumn("_unit", F.date_trunc(unit, F.col(order[0])))
    before = Window.partitionBy(*keys).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.groupBy(*keys, "_unit").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_unit").orderBy(*order)
    return marked.join(offsets, [*keys, "_unit"]).withColumn(name, (F.col("_offset") + F.row_number().over(inside)).cast("long")).drop("_unit", "_offset")


class Frames:
    """Row frames inside the blocks of a series."""

    def __init__(self, keys: list[str], order: str):
        self.base = Window.partitionBy(*keys).orderBy(order)

    def __call__(self, first: int, last: int = 0) -> WindowSpec:
        return self.base.rowsBetween(first, last)

    def lag(self, column: str | Column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.base)

    def full(self, aggregate: Callable[[Column], Column], column: str | Column, n: int) -> Column:
        """``aggregate`` over the last n rows; null unless all n are there and not null."""
        c = F.col(column) if isinstance(column, str) else column
        return F.when(F.count(c).over(self(1 - n)) == n, aggregate(c).over(self(1 - n)))


def with_halo(df: DataFrame, keys: list[str], halo: int, build: Callable[[DataFrame, Frames], DataFrame], ahead: int = 0, rows: int = BLOCK) -> DataFrame:
    """``build(rows, frames)`` over blocks; frames reach ``halo`` rows back and ``ahead`` rows on at most.

    ``df`` has a column ``rn`` (see ``numbered``).
    """
    place = F.col("rn") - 1
    own = F.floor(place / rows)
    dealt = df.withColumn("_own", own).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.greatest(place - ahead, F.lit(0)) / rows), F.floor((place + halo) / rows)))
    )
    return build(dealt, Frames([*keys, "_block"], "rn")).where("_own = _block").drop("_own", "_block")


def carried(df: DataFrame, keys: list[str], column: str, name: str, rows: int = BLOCK) -> DataFrame:
    """Adds the last non-null value of ``column`` up to this row, over a series of any length.

    Two levels: the last value of each block, carried over blocks, and the last value inside one.
    """
    marked = df.withColumn("_block", F.floor((F.col("rn") - 1) / rows))
    ends = marked.groupBy(*keys, "_block").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col("rn"))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = Window.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return marked.join(carry, [*keys, "_block"]).withColumn(name, F.coalesce(F.last(column, ignorenulls=True).over(inside), "_carry")).drop("_block", "_carry")


def running_sum(df: DataFrame, keys: list[str], columns: dict[str, str], rows: int = BLOCK) -> DataFrame:
    """Adds running sums (name: column) over a series of any length, by sums of blocks."""
    marked = df.withColumn("_block", F.floor((F.col("rn") - 1) / rows))
    sums = marked.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in columns.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_block", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in columns))
    inside = Window.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(carry, [*keys, "_block"])
    for n, c in columns.items():
        out = out.withColumn(n, F.col(f"_c_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("_block", *(f"_c_{n}" for n in columns))


def running_max(df: DataFrame, keys: list[str], columns: dict[str, str], rows: int = BLOCK) -> DataFrame:
    """Adds running maxima (name: column) over a series of any length, by maxima of blocks."""
    marked = df.withColumn("_block", F.floor((F.col("rn") - 1) / rows))
    tops = marked.groupBy(*keys, "_block").agg(*(F.max(c).alias(f"_s_{n}") for n, c in columns.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, "_block", *(F.max(f"_s_{n}").over(before).alias(f"_c_{n}") for n in columns))
    inside = Window.partitionBy(*keys, "_block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(carry, [*keys, "_block"])
    for n, c in columns.items():
        out = out.withColumn(n, F.greatest(F.col(f"_c_{n}"), F.max(c).over(inside)))
    return out.drop("_block", *(f"_c_{n}" for n in columns))


def reach(*alphas: float) -> int:
    """Rows that nested exponential means look back to: what lies before weighs less than 2e-16."""
    return sum(math.ceil(36 / -math.log(1 - a)) for a in alphas)


def ewm(d: DataFrame, w: Frames, columns: dict[str, tuple[str, float]]) -> DataFrame:
    """Adds exponential means (name: (column, alpha)) inside the blocks of ``with_halo``.

    y = k y_before + (1 - k) x, from the first value of a series on, with k = (1 - alpha)^g /
    ((1 - alpha)^g + alpha) after a gap of g rows since the last value, which is 1 - alpha for
    neighbours. Nulls repeat the last mean. With K the running sum of ln k, y is exp(K) times the
    running sum of (1 - k) x exp(-K); blocks are short enough for these powers, and their halo long
    enough for the start not to matter.
    """
    so_far = w(Window.unboundedPreceding)
    d = d.withColumn("_from", F.min("rn").over(so_far))
    for name, (column, alpha) in columns.items():
        known = F.col(column).isNotNull()
        d = d.withColumn("_gap", F.col("rn") - F.last(F.when(known, F.col("rn")), ignorenulls=True).over(w(Window.unboundedPreceding, -1)))
        old = F.pow(F.lit(1 - alpha), F.coalesce("_gap", F.lit(1)))
        d = d.withColumn("_keep", old / (old + alpha))
        d = d.withColumn("_log", F.sum(F.when(known, F.log("_keep")).otherwise(0.0)).over(so_far))
        weight = F.when(F.col("_gap").isNull() & (F.col("_from") == 1), 1.0).otherwise(1 - F.col("_keep"))
        d = d.withColumn(name, F.sum(weight * F.col(column) * F.exp(-F.col("_log"))).over(so_far) * F.exp("_log"))
    return d.drop("_from", "_gap", "_keep", "_log")


def erf(x: Column) -> Column:
    """The error function by a rational approximation with an error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, through ``erf``."""
    return 0.5 * (1 + erf(x / F.lit(2**0.5)))


#: Coefficients of a rational approximation of the normal quantile (relative error below 1.2e-9), for the middle and for the tails.
QUANTILE_MIDDLE = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
QUANTILE_TAIL = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
QUANTILE_EDGE = 0.02425


def _poly(coefficients: tuple, x: Column) -> Column:
    """A polynomial, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability between 0 and 1, exclusive; null outside."""
    q = p - 0.5
    middle = q * _poly(QUANTILE_MIDDLE[0], q * q) / _poly(QUANTILE_MIDDLE[1], q * q)
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(QUANTILE_TAIL[0], t) / _poly(QUANTILE_TAIL[1], t)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (F.abs(q) <= 0.5 - QUANTILE_EDGE), middle).when(inside, F.when(q < 0, tail).otherwise(-tail))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """``df`` with every double rounded, and no negative zeros."""
    return df.select(*((F.round(F.col(n), places) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))
