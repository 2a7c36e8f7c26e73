"""First or random rows of every group, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


#: Levels a halving of the draw: a bound lets at most about a twelfth of rows too many through.
LEVELS = 8
SALTS = 16


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not use, whatever the case of its own."""
    used = {c.lower() for c in df.columns}
    longest = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))
    return [name if name.lower() not in used else longest + name for name in names]


def first_n_per_group(
    df: DataFrame, keys: list[str], order: list[str | Column], n: int, salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of each group in the given (total) order. Exact.

    Spark limits each group inside every scan task before the shuffle. What a hot group
    still sends (``n`` rows per task) is first reduced in ``salts`` slices, by the task
    it came from, then once more over at most ``n * salts`` rows. The slice of a row does
    not change the result. The limit before the shuffle applies up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) rows per group.
    """
    part, rank = fresh(df, "_slice", "_rank")
    sliced = df.withColumn(part, F.spark_partition_id() % salts)
    first = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))
    final = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    reduced = sliced.withColumn(rank, first).where(F.col(rank) <= n).drop(rank, part)
    return reduced.withColumn(rank, final).where(F.col(rank) <= n).drop(rank)


def draw_at_least(df: DataFrame, keys: list[str], share: Column, n: int) -> DataFrame:
    """Rows of each group that surely hold the ``n`` smallest by ``share``, and hardly more than ``n``.

    ``share`` is in [0, 1), about uniform in a group, and never null. Rows are counted by group and level, a
    step of the logarithm of the share: at most a few hundred counts a group, added up before the shuffle. The
    smallest levels that hold ``n`` rows together bound the group. A group of fewer rows stays whole. The bounds
    are joined back, each in ``SALTS`` copies, so that a hot group's rows do not meet in one task even where
    the bounds are too many for Spark to broadcast.
    """
    level, salt, bound = fresh(df, "_level", "_salt", "_bound")
    leveled = df.withColumn(level, F.floor(-F.log2(share + F.lit(2.0**-60)) * LEVELS).cast("int"))
    counts = leveled.groupBy(*keys, level).agg(F.count(F.lit(1)).alias(salt))
    upward = Window.partitionBy(*keys).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(salt).over(upward), F.lit(0))
    bounds = (
        counts.withColumn(bound, before).where(F.col(bound) < n)
        .groupBy(*[F.col(f"`{c}`").alias(f"{bound}{i}") for i, c in enumerate(keys)]).agg(F.min(level).alias(bound))
        .withColumn(f"{bound}{salt}", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    low_bits = F.floor(share * 2.0**40)  # a retried task gives a row the same salt
    salted = leveled.withColumn(salt, F.pmod(low_bits, F.lit(SALTS)).cast("int"))
    same = F.col(salt) == F.col(f"{bound}{salt}")
    for i, c in enumerate(keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"{bound}{i}"))
    kept = salted.join(bounds, same).where(F.col(level) >= F.col(bound))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def shuffle_key(seed: int = SEED, row_id: str = "row_id") -> Column:
    """Reproducible random order: the same on any engine, partitioning and run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))


def random_n_per_group(
    df: DataFrame, keys: list[str], n: int, seed: int = SEED, row_id: str = "row_id"
) -> DataFrame:
    """The ``n`` rows of each group that come first in the random order of ``shuffle_key``. Exact for any
    ``n``: a bound on the order, worked out from counts, leaves little more than ``n`` rows a group to rank."""
    key, rank = fresh(df, "_key", "_rank")
    keyed = df.withColumn(key, shuffle_key(seed, row_id))
    share = F.conv(F.substr(F.col(key), F.lit(1), F.lit(13)), 16, 10).cast("double") / 2.0**52
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(key, row_id))
    drawn = draw_at_least(keyed, keys, share, n)
    return drawn.withColumn(rank, nth).where(F.col(rank) <= n).drop(rank, key)


def count_entities(df: DataFrame, entity: str = "Town") -> int:
    """One number, from a pre-aggregated distinct. Sample sizes depend on it, and the
    limit before the shuffle needs them as literals."""
    return df.select(entity).distinct().count()


def stratified_first(
    df: DataFrame, per_entity: int = 100, entity: str = "Town", polarity: str = "Polarity"
) -> DataFrame:
    """First ``per_entity // 5`` (at least one) rows per (entity, polarity) in row order."""
    return first_n_per_group(df, [entity, polarity], ["row_id"], max(1, per_entity // 5))


def stratified_corpus(
    df: DataFrame,
    size: int = 8000,
    n_entities: int | None = None,
    seed: int = SEED,
    entity: str = "Town",
    polarity: str = "Polarity",
) -> DataFrame:
    """Random rows per (entity, polarity), about ``size`` in all."""
    n_entities = n_entities or count_entities(df, entity)
    n = max(1, size // max(1, n_entities) // 5)
    return random_n_per_group(df, [entity, polarity], n, seed)


def evaluation_set(
    df: DataFrame,
    size: int = 800,
    n_entities: int | None = None,
    entity: str = "Town",
    polarity: str = "Polarity",
) -> DataFrame:
    """First rows per (entity, polarity). These rows are also among the first ones that
    make the profiles, so ranking them is not leave-one-out; see ``exclude_rows``."""
    n_entities = n_entities or count_entities(df, entity)
    return stratified_first(df, max(1, size // max(1, n_entities)), entity, polarity)


def exclude_rows(df: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows not in ``rows``, for profiles that have not seen the evaluation set."""
    return df.join(rows.select(row_id), row_id, "left_anti")


def balanced_sample(
    df: DataFrame, per_entity: int = 200, seed: int = SEED, entity: str = "Town"
) -> DataFrame:
    return random_n_per_group(df, [entity], per_entity, seed)
