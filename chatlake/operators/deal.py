"""Dealing rows out: staged tables, joins with a size-checked side, and blocks for joins of all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlake.session import ensure_checkpoint_dir

#: Rows of a staged side that is sent to every task; a larger one is joined by a shuffle.
SENT_ROWS = 200_000


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: read many times, worked out once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(side: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """``side`` (staged, short rows) marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(side) if side.count() <= most else side


def block_of(column: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(column), blocks)


def every_block(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))


def cells(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str,
          left_blocks: Column, right_blocks: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns ``l_block`` and ``r_block``: every two rows with equal ``on`` meet in just one cell.

    ``left_blocks`` and ``right_blocks`` give the number of blocks of a key from ``n``, its rows on that
    side; a row goes to the block that its id's hash names, once for each block of the other side.  Keys
    that only one side has go.
    """
    count = lambda side, blocks, name: side.groupBy(*on).agg(F.count("*").alias("n")).select(*on, F.greatest(F.lit(1).cast("long"), F.ceil(blocks).cast("long")).alias(name))
    sizes = sized(staged(count(left, left_blocks, "l_blocks").join(count(right, right_blocks, "r_blocks"), on)))
    left = left.join(sizes, on).withColumn("l_block", block_of(F.col(left_id), F.col("l_blocks"))) \
        .withColumn("r_block", every_block(F.col("r_blocks"))).drop("l_blocks", "r_blocks")
    right = right.join(sizes, on).withColumn("r_block", block_of(F.col(right_id), F.col("r_blocks"))) \
        .withColumn("l_block", every_block(F.col("l_blocks"))).drop("l_blocks", "r_blocks")
    # New names of the same columns: both sides may come from one table, and a cogroup must tell them apart.
    return left, right.select(*[F.col(c).alias(c) for c in right.columns])


def join_dealt(rows: DataFrame, side: DataFrame, on: list[str], spread: str, shares: int = 16, most: int = SENT_ROWS) -> DataFrame:
    """``rows`` joined with a staged ``side`` that has one row a key.

    A side of at most ``most`` rows is sent to all tasks.  Beyond that, every key's rows are dealt into
    ``shares`` shares by a hash of column ``spread``, and the side goes to each share, so that a key of
    a third of all rows has no task to itself.
    """
    if side.count() <= most:
        return rows.join(F.broadcast(side), on)
    rows = rows.withColumn("_share", block_of(F.col(spread), F.lit(shares).cast("long")))
    return rows.join(side.withColumn("_share", every_block(F.lit(shares).cast("long"))), [*on, "_share"]).drop("_share")
