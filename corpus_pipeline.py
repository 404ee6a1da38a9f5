"""The corpus pipeline: five stages over documents, each written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, settle, small, table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.exact_dedup import exact_dedup
from millrace.llm.mixing import mix_documents
from millrace.llm.near_dedup import near_dedup
from millrace.llm.quality import resample

# What all stages have in common. Decisions are made on rows, not on ids: null ids, repeated rows and an id with several
# texts are decided each by its own text. Null and empty texts have no words: the classifier rejects them, equal ones are
# copies of each other, they are near copies of nothing, leak nothing, and the mix takes nothing of them. Texts of any length are read whole. An empty table stays
# empty. Columns of any names are carried along; only `taken` is replaced, by the last stage.


def _keyed(docs: DataFrame, nulls: str) -> tuple[DataFrame, str]:
    """docs with a key of each row's own that rises with doc_id, and the key's name; rows without id come `nulls`, first or last.

    Where ids are unique and none is null, that is the id itself and nothing moves. Elsewhere rows are sorted, numbered and written once.
    """
    (key,) = fresh(docs, "row_key")
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    ids = F.col("doc_id").asc_nulls_first() if nulls == "first" else F.col("doc_id").asc_nulls_last()
    return settle(docs.orderBy(ids, F.sha2("text", 256)).withColumn(key, F.monotonically_increasing_id())), key


def _without(keyed: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """keyed without the rows of `dropped`, and without the key. Texts move only if these are too many to broadcast."""
    rows = small(settle(dropped.select(key)))
    return keyed.join(rows, key, "left_anti").select([f"`{c}`" for c in keyed.columns if c != key])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the classifier's rejects go, and documents without words. A label holds for all rows of its id."""
    keyed, key = _keyed(docs, "last")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").join(keyed.select("doc_id", key), "doc_id")
    return _without(keyed, key, resample(keyed, labels, id_col=key).where(~F.col("kept")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id, one with an id if any has it."""
    keyed, key = _keyed(docs, "first")
    return _without(keyed, key, exact_dedup(keyed, id_col=key).where(~F.col("kept")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, one with an id if any has it: five-word shingles, a similarity of 0.8 or more."""
    keyed, key = _keyed(docs, "last")
    return _without(keyed, key, near_dedup(keyed, id_col=key, words=5, percent=80).where(~F.col("kept")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    keyed, key = _keyed(docs, "last")
    return _without(keyed, key, decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `taken`, the words it takes of each, repeats counted. Rows with one id, or none, share a hash."""
    return mix_documents(docs)


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix)]

#: SQL can express neither the classifier nor components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; lineage is cut between them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
