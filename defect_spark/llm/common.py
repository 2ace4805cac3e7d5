"""What the text operators share: table reads, lineage cuts and the folder all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate files. One is made only in local mode; a cluster must name its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def pairs_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names: other columns can't clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def text_key(text: Column) -> Column:
    """With doc_id this names a row; rows equal in both are repeats of one document."""
    return F.xxhash64(text)


def same(*names: str):
    """A join condition on equally named columns of aliases a and b, null equal to null."""
    out = F.col(f"a.{names[0]}").eqNullSafe(F.col(f"b.{names[0]}"))
    for n in names[1:]:
        out = out & F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}"))
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once even where the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
