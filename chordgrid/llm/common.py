"""What several operators share: reading tables, shared storage, and small column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chordgrid.operators.storage import stored

#: White space as every contract here means it: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Names that this process makes up, so that none is a name of the caller's columns.
_TAG = uuid.uuid4().hex


def own_name(name: str) -> str:
    return f"__{name}_{_TAG}"


#: The column of row numbers.
RID = own_name("rid")
#: Files up to which their numbers, one short row each, are broadcast; more are joined.
BROADCAST_FILES = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def is_table(df: DataFrame) -> bool:
    """Whether ``df`` is rows of Parquet files, each file once, that are at most filtered or projected by fixed expressions."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        df.select(df.metadataColumn("_metadata").file_path, df.metadataColumn("_metadata").row_index)
    except AnalysisException:
        return False
    files = list(plan.relation().location().inputFiles())
    return len(set(files)) == len(files)


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with the column RID: the number of each row's file in order of paths, and the row's place in that file.

    However later scans cut the files into partitions, each row keeps its number, so scans can be joined by it. What is
    not a plain table is stored first. One row for each file is broadcast, or joined where there are over BROADCAST_FILES.
    Columns of any name may be there, ``_metadata`` too; none of the caller's is taken for a number.
    """
    if RID in df.columns:
        return df
    if not is_table(df):
        df = stored(df, "numbered")
    file, number, place = own_name("file"), own_name("number"), own_name("place")
    path = df.metadataColumn("_metadata").file_path.alias(file)
    order = (F.row_number().over(Window.orderBy(file)) - 1).cast("long").alias(number)
    files = stored(df.select(path).distinct().select(file, order), "files")
    if len(df.inputFiles()) <= BROADCAST_FILES:
        files = F.broadcast(files)
    own = df.select("*", path, df.metadataColumn("_metadata").row_index.alias(place)).join(files, file)
    return own.withColumn(RID, F.shiftleft(number, 40) + F.col(place)).drop(file, number, place)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
