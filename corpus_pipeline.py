"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and all but the last return the columns of ``documents``. ``run`` writes
each stage's rows as Parquet to the shared folder and reads them again.

Defined results, for all stages: null texts count as empty, very long texts are
worked whole; an empty table gives an empty one; extra columns pass through the
filters, whatever their names; of repeated rows the classifier keeps all or none, line dedup
counts them as one document, near-duplicate removal keeps one, decontamination
all or none. Rows are removed by id and text together, so neither a null id nor an id that
several texts share makes a row go or stay with another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseframe.llm import decontam, linededup, minhash, packing, quality
from phaseframe.llm.common import Scratch, bitmap_filter, without_ids
from phaseframe.llm.queries import tokenizer_path


#: Column that names a row by its id and text while a stage works.
ROW = "__pipeline_row"


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with that column, under a name that none of theirs has."""
    name = ROW
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.withColumn(name, F.xxhash64("doc_id", F.coalesce("text", F.lit("")))), name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_documents(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which every line stands elsewhere."""
    out = linededup.dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.col("text") == "")
    return out.where(~emptied).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the smallest id (null last), then text hash; of equal rows any one."""
    scratch = Scratch(spark, "near")
    rows, row = _named(docs)
    classes = minhash.near_duplicates(rows, id_col=row).where("class_size > 1")
    members = classes.select(F.col("doc_id").alias(row), "class_id").groupBy(row, "class_id").agg(F.count("*").alias("rows"))
    ids = bitmap_filter(rows.select(row, "doc_id"), row, members.select(row)).distinct()
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row)
    members = scratch.write(members.join(ids, row).withColumn("place", place), "members")
    stays = members.groupBy("class_id").agg(F.min("place").alias("stay"))
    members = scratch.write(members.join(stays, "class_id").select(row, "rows", (F.col("place") == F.col("stay")).alias("stays")), "placed")
    left = without_ids(rows, row, members.where("NOT stays OR rows > 1").select(row), scratch)
    again = members.where("stays AND rows > 1").select(row)
    again = bitmap_filter(rows, row, again).join(again, row).dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in rows.columns])
    return left.unionByName(again).select(*_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go."""
    rows, row = _named(docs)
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return without_ids(rows, row, found.select(F.col("doc_id").alias(row)), Scratch(spark, "leaks")).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack(docs, tokenizer_path(), block_pieces=4096)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: The fitted classifier, signatures and packing have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return docs
