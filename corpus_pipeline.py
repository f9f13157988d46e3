"""A corpus pipeline in stages; each works on all that the stage before it kept.

Every stage takes and returns whole rows: null ids, null, empty and very long texts, ties and repeated rows have the result that
the stage's docstring names, an empty table gives an empty one, and columns beyond those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic.llm.common import cut, table
from fieldmosaic.llm.jaccard_join import jaccard_components
from fieldmosaic.llm.mixing import mix_sources, word_count
from fieldmosaic.llm.packing import pack
from fieldmosaic.llm.suffix_dedup import remove_repeats
from fieldmosaic.llm.toxicity import score, train

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL expresses the learned models, the sort or the packing; tests/llm/test_pipeline.py compares the stages with plain loops.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the chain's last model calls toxic; junk stays. Null and empty texts stay; equal texts have one verdict."""
    chain = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score(docs.select(*COLUMNS), chain, COLUMNS).where(~F.col("toxic")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles, one row stays: the one with the smallest id (null first), then the smallest hash.

    Rows are told apart by id and content, so another text under the id of a copy stays. Of rows equal in all columns one
    stays, if they have words. Texts without words (null, empty) are in no group and all stay.
    """
    row = F.struct("doc_id", F.xxhash64(*COLUMNS).alias("h")).alias("row")
    groups = cut(jaccard_components(docs.select(row, "text"), "row", width=5, num=80, den=100, count_links=False), "groups")
    gone = groups.where("n_shingles > 0 AND component_id < row").select("row").distinct()
    again = groups.where("n_shingles > 0").groupBy("row").count().where("count > 1").select("row")
    kept = docs.select(*COLUMNS, row).join(gone, "row", "left_anti")
    once = kept.join(again, "row", "left_anti").unionByName(kept.join(again, "row", "left_semi").dropDuplicates(["row"]))
    return once.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated strings of 100 bytes out of the texts; documents of which nothing but blanks is left go. A text from which nothing is taken, null or empty ones too, stays; a null one as an empty one."""
    done = remove_repeats(docs.select(*COLUMNS), with_text=True, keep=("lang", "source"))
    left = done.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each time a document is taken. Where a source's last pass ends within a document, it is taken whole if at least half of it is in.

    Documents without words (null, empty) add no words to any source, so the mix takes none of them.
    """
    held = docs.select(*COLUMNS, word_count().alias("size"))
    mixed = mix_sources(held, ["doc_id", "source"])
    times = F.size(F.filter("parts", lambda p: p["words"] * 2 >= F.col("size")))
    return mixed.withColumn("__time", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in windows of 2048 tokens: a row for each piece. A document that the mix takes twice is packed twice."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
