"""The corpus pipeline over ``documents``.

Stages, each written as Parquet and read again by the next:

1. language: documents without a letter, or of no learned language with some certainty, go;
2. lines: cross-site boilerplate lines are cut out of the texts;
3. near duplicates: of each group of linked documents one row, of the smallest id, stays;
4. packing: what is left becomes full windows of tokens; returns the pieces.

Stages 1 to 3 return the columns of their input.  Rows without an id are treated like any
other row, and stay if no row of their group has one; different texts under one id are
different documents; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import langid, line_dedup, ngram_join, packing
from vigil.llm.common import Stored

MIN_LANGUAGE_SCORE = 0.5


def _free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    report = _free_name(docs, "language_report")
    seen = docs.withColumn(report, langid.prediction(docs["text"], langid.train(docs)))
    return seen.where((F.col(f"{report}.lang_pred") != F.lit(langid.UNDETERMINED))
                      & (F.col(f"{report}.score") >= F.lit(MIN_LANGUAGE_SCORE))).drop(report)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    report = _free_name(docs, "line_report")
    cleaned = line_dedup.dedup_lines(docs, report_col=report)
    if "n_chars" in docs.columns:
        length = F.when(F.col(f"{report}.n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are what is compared and removed, by a number of their own; ids only decide which one stays."""
    row = _free_name(docs, "row_number")
    rows = Stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows").df  # the numbers stay as they are
    linked = ngram_join.link_documents(rows.select(F.col(row).alias("doc_id"), "text")).where("n_shingles > 0") \
        .select(F.col("doc_id").alias("_row"), "component_id")
    owner = rows.select(F.col(row).alias("_of"), F.col("doc_id").cast("long").alias("_id"))
    known = Stored(linked.join(owner, F.col("_row") == F.col("_of")).select("_row", "component_id", "_id"), "pipeline-linked").df
    groups = known.groupBy(F.col("component_id").alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_best")) \
        .where("_n > 1").select("_group", F.col("_best._row").alias("_stays"))
    gone = Stored(known.join(groups, F.col("component_id") == F.col("_group")).where("_row <> _stays").select(F.col("_row").alias("_gone")), "pipeline-copies").df
    return rows.join(gone.hint("merge"), rows[row] == gone["_gone"], "left_anti").drop(row)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("ids")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", windows)]

# learned language models, exact overlaps of whole texts and token ids are beyond SQL: see tests/llm/test_pipeline.py
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Stored(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
