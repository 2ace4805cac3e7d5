"""Order at any size: rows dealt by ranges of their keys, written once, and counted range by range."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the folder that spark.checkpoint.dir names.

    Only in local mode a folder is made where none is named; a cluster must name one it shares.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


MOST_PARTS = 20_000


def placed(df: DataFrame, keys: list[str], rows_a_part: int = 1 << 17) -> DataFrame:
    """df, written once, with part_: the number of its range of keys. Ranges are in proportion to rows, up to MOST_PARTS.

    Rows with equal keys share a range, so the keys must tell apart what may be frequent.
    """
    parts = max(1, min(MOST_PARTS, -(-df.count() // rows_a_part)))
    return checkpointed(df.repartitionByRange(parts, *(F.col(k).asc_nulls_first() for k in keys)).withColumn("part_", F.spark_partition_id()))


def ranks(df: DataFrame, group: list[str], order: list[str], name: str = "rank", rows_a_part: int = 1 << 17) -> DataFrame:
    """df with name: the number of rows of its group (null is a group) before it in order, nulls first.

    A group is counted by the ranges it lies in, so none is one task. Only the first group of a
    range can have begun in an earlier one: a number for each range is all that is sent to tasks.
    """
    rows = placed(df, [*group, *order], rows_a_part)
    by_group = [F.col(g) for g in group]
    counts = rows.groupBy("part_", *group).agg(F.count("*").alias("n_"))
    earlier = Window.partitionBy(*(by_group or [F.lit(0)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    before = counts.select(F.col("part_").alias("p_"), *(F.col(g).alias(f"{g}_g") for g in group), F.sum("n_").over(earlier).alias("before_")).where("before_ > 0")
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"{g}_g")) for g in group), F.col("part_") == F.col("p_"))
    own = F.row_number().over(Window.partitionBy("part_", *group).orderBy(*(F.col(o).asc_nulls_first() for o in order))) - 1
    made = rows.withColumn("own_", own).join(F.broadcast(before), same, "left")  # a row a range, MOST_PARTS at most
    return made.withColumn(name, (F.col("own_") + F.coalesce("before_", F.lit(0))).cast("long")).select(*df.columns, name)
