"""Joins whose output grows with the product of both sides, at any size.

``salted_join`` splits keys by the *work* they cause: the join rows of a key are
its rows on one side times its rows on the other. A key above a task's fair share
of all join rows is split into as many salt groups as it has shares; the rows of
the first side are dealt to the groups and those of the second copied to each.
Fewer keys than tasks can be above the fair share, which bounds the broadcast table
of split keys by the number of shuffle partitions, whatever the data.

``Grid`` serves joins that are aggregated at once by a row key of one side and a
column key of the other. Row keys are hashed into blocks of rows, column keys into
blocks of columns, and every pair of blocks is a cell with a task of its own: rows
of the first side are copied along their row of cells, those of the second down
their column. All contributions to a (row key, column key) group meet in one cell,
so the joined rows, which outnumber both sides by far, are aggregated, filtered and
named where they arise and never shuffled. A join key that everybody has is split
both ways. The shape follows from the sizes of the sides alone.

``listed_join`` serves joins whose joined rows are grouped by keys of both sides and hardly
get fewer by it, so that every step behind the join moves as many rows as the result has. The
rows of one side travel as lists, past one exchange, and become rows again behind it.

Tables passed in should be stored ones: their keys are counted before the join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

CELL = "_cell"
ROWS_PER_CELL = 1_000_000    # joined rows a cell is sized for
INPUT_PER_CELL = 1_000_000   # rows of either side a cell is sized for
ROWS_PER_LIST = 1024         # rows of one side that travel together
SHARE = "_share"             # the share of a ``by`` whose rows are too many for one task


def fanout_partitions(df: DataFrame) -> int:
    """Partition count for a join whose output is much larger than its input."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks(df: DataFrame) -> int:
    """Tasks for steps that each read a whole table: two per core."""
    return 2 * df.sparkSession.sparkContext.defaultParallelism


def beside(parts: DataFrame, at: str, values: list[int], whole: DataFrame, times: int = 1) -> DataFrame:
    """``times`` partitions per value of ``at``: the rows of ``parts`` that have it and all rows of ``whole``, in no
    certain order (as a rule ``whole`` first). Both are stored tables of the same columns, ``parts`` in folders by ``at``: each task
    reads its folder and the whole other table, so neither is exchanged, and what is read grows with the number of partitions."""
    each = [whole.union(parts.filter(F.col(at) == v)).coalesce(1) for v in values for _ in range(times)]
    # a union of single partitions alone would be one partition: a scan of no folder stands beside them
    each.append(parts.filter(F.col(at).isNull()))
    while len(each) > 1:
        each = [a.union(b) for a, b in zip(each[::2], each[1::2])] + each[len(each) & ~1:]
    return each[0]


def hot_keys(big: DataFrame, other: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """Keys above 1/``partitions`` of the join's rows, with the number of salt groups
    each: its shares of the work, and no more than its rows on ``big``."""
    mine = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    theirs = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("_other"))
    work = mine.join(theirs, keys, "left").withColumn(
        "_work", F.col("_rows").cast("double") * F.coalesce(F.col("_other"), F.lit(1)))
    fair = work.agg(F.sum("_work") / F.lit(partitions)).scalar()
    return (work.filter(F.col("_work") > fair)
            .select(*keys, F.least(F.ceil(F.col("_work") / fair), F.col("_rows")).cast("int").alias("_salts")))


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], salt_by: list[str],
                how: str = "inner", partitions: int | None = None) -> DataFrame:
    """``big.join(other, keys, how)`` with hot keys split by ``salt_by``.

    ``salt_by`` are columns of ``big`` that spread a hot key's rows (for example
    the customer id when the key is a product). ``how`` is ``inner`` or ``left``
    (rows of ``big`` are never copied, so a left join stays exact).
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    n = partitions or fanout_partitions(big)
    hot = F.broadcast(hot_keys(big, other, keys, n))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    big_s = (big.join(hot, keys, "left")
             .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), salts).cast("int"))
             .drop("_salts"))
    other_s = (other.join(hot, keys, "left")
               .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
               .drop("_salts"))
    on = [*keys, "_salt"]
    # the inputs are small next to the output: partitioned explicitly, or adaptive
    # execution would merge them into few tasks that produce the whole fan-out
    return big_s.repartition(n, *on).join(other_s.repartition(n, *on), on, how).drop("_salt")


def listed_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], upwards: tuple[str, str] | None = None,
                per_task: int = ROWS_PER_CELL) -> DataFrame:
    """``left.join(right, on)`` with the rows of a value of ``by`` (columns of ``left``, never null together
    with ``on``) in one partition, or in one per ``SHARE`` (a column of the result) where they are more than
    ``per_task``: group by ``by``, ``SHARE`` and columns of ``right`` without another exchange. Of ``right``,
    lists of about ``ROWS_PER_LIST`` rows are moved. ``upwards`` (a column of left, one of right) keeps
    the rows in which the second is not below the first."""
    mine, theirs = [c for c in left.columns if c not in on or c in by], [c for c in right.columns if c not in on]
    count = F.count(F.lit(1))
    per_key = right.groupBy(*on).agg(count.alias("_n"))
    work = left.join(per_key, on).groupBy(*by).agg(F.sum("_n").alias("_work"))
    total = work.agg(F.sum("_work")).first()[0] or 0
    n = max(fanout_partitions(left), math.ceil(total / per_task))
    # fewer than total / per_task keys have more than a task's rows
    hot = work.filter(F.col("_work") > per_task).select(*by, F.ceil(F.col("_work") / per_task).cast("int").alias("_shares"))
    lists = F.ceil(count.over(Window.partitionBy(*on)) / ROWS_PER_LIST)
    packed = (right.withColumn("_list", F.pmod(F.xxhash64(*theirs), lists))
              .groupBy(*on, "_list").agg(F.collect_list(F.struct(*theirs)).alias("_rows")).drop("_list"))
    j = salted_join(left, packed, on, salt_by=by).select(*mine, "_rows").join(F.broadcast(hot), by, "left")
    j = j.withColumn(SHARE, F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)))
    rows = F.when(F.col("_shares").isNull(), F.col("_rows")).otherwise(
        F.filter("_rows", lambda x: F.pmod(F.xxhash64(x), F.col("_shares")) == F.col(SHARE)))
    if upwards:
        rows = F.filter(rows, lambda x: x[upwards[1]] >= F.col(upwards[0]))
    j = j.withColumn("_rows", rows).filter(F.size("_rows") > 0)
    # a list per column: half of what a list of structs takes
    j = j.select(*mine, SHARE, *[F.col("_rows")[c].alias(c) for c in theirs]).repartition(n, *by, SHARE)
    return j.select(*mine, SHARE, F.explode(F.arrays_zip(*theirs)).alias("_row")).select(*mine, SHARE, "_row.*")


@dataclass(frozen=True)
class Grid:
    """``rows`` x ``cols`` cells, each a partition."""

    rows: int
    cols: int

    @staticmethod
    def sized(df: DataFrame, left_rows: int, right_rows: int, joined_rows: float,
              per_cell: int = ROWS_PER_CELL) -> "Grid":
        """The grid for sides and a join of about these sizes: enough cells for the
        joined rows and for the sides, shaped so that both sides are copied about
        equally (left x cols = right x rows, the least total)."""
        left_rows, right_rows = max(1, left_rows), max(1, right_rows)
        n = max(fanout_partitions(df), math.ceil(joined_rows / per_cell),
                math.ceil(left_rows * right_rows / INPUT_PER_CELL ** 2))
        rows = min(n, max(1, round(math.sqrt(n * left_rows / right_rows))))
        return Grid(rows, math.ceil(n / rows))

    def _block(self, key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def _placed(self, df: DataFrame, row, col) -> DataFrame:
        placed = df.withColumn("_g", row).withColumn("_h", col)
        placed = placed.withColumn(CELL, F.col("_g") * self.cols + F.col("_h")).drop("_g", "_h")
        # hashed when joined: a sort-merge join would sort the far larger joined rows
        return placed.repartitionById(self.rows * self.cols, F.col(CELL)).hint("shuffle_hash")

    def along_rows(self, df: DataFrame, row_key: str) -> DataFrame:
        """``df`` copied to every cell of its row of cells."""
        return self._placed(df, self._block(row_key, self.rows), F.explode(F.sequence(F.lit(0), F.lit(self.cols - 1))))

    def along_cols(self, df: DataFrame, col_key: str) -> DataFrame:
        """``df`` copied to every cell of its column of cells."""
        return self._placed(df, F.explode(F.sequence(F.lit(0), F.lit(self.rows - 1))), self._block(col_key, self.cols))

    def in_cell(self, df: DataFrame, row_key: str, col_key: str) -> DataFrame:
        """``df``, each row in the one cell of its two keys."""
        return self._placed(df, self._block(row_key, self.rows), self._block(col_key, self.cols))

    def join(self, left: DataFrame, right: DataFrame, on: list[str], row_key: str, col_key: str) -> DataFrame:
        """``left.join(right, on)`` with the cell of (``row_key`` of left, ``col_key`` of
        right) in the column ``CELL``; group and join by ``CELL`` and further keys
        without another exchange."""
        return self.along_rows(left, row_key).join(self.along_cols(right, col_key), [CELL, *on])
