"""A training corpus from raw documents, in five stages of this library's operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and
returns a DataFrame, which is written as Parquet in the shared checkpoint folder and read again
as the next stage's docs. A run that failed goes on after its last finished stage if it is given
its folder again; without one each run has a folder of its own. Texts go to Python workers in batches of 8 MB, a setting that
stays in the session. What stands there belongs to the input files (their
names, sizes and times) and the stages' names: with others a run starts anew. ``forget`` removes a folder.

Defined results: what the stages' operators define. Rows without text or letters go in the first two
stages; repeated rows and rows without ids are documents like others, of which dedup keeps one; empty
tables give an empty result; other columns of documents are carried along up to packing.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import language, mixing, near, packing, quality
from gridloom.llm.common import shared_folder, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that trusted text doesn't predict."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or of doubtful language."""
    small_batches(spark)
    return language.keep_confident(docs, language.train(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, likeness 0.8 or more)."""
    small_batches(spark)
    return near.keep_one(docs, width=5, likeness=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's weight asks for."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in training sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("dedup", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def finished(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written all of path."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def state_of(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the input files and the stages."""
    found = [name for name, _ in STAGES]
    for name in ("documents", "labels"):
        for file in sorted(table(spark, sf_dir, name).inputFiles()):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
            found.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:32]


def forget(spark: SparkSession, folder: str) -> None:
    """Removes the results of a run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents, with their results in ``folder``; what stands finished there for the same input is not done again."""
    folder = f"{folder}/{state_of(spark, sf_dir)}" if folder else f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        if not finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
