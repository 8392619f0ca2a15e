"""A training corpus from raw documents: language, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each as Parquet in the shared folder and reads it again as the next one's docs.
All but the last keep the columns of documents.

Defined results: a stage keeps null ids, null languages and repeated rows as
its operator does; the near-duplicate stage keeps one row of each component,
that of its smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, packing, toxicity
from tidemark.llm.common import materialise, plain, table
from tidemark.session import prepare


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told and whose text is as near to it as labelled rows are."""
    return language.told(docs, language.train(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are not predicted to be toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near duplicates."""
    found = jaccard.components(docs)
    # Ids that go: usually few, so that the join needs no shuffle of the texts.
    gone = found.filter("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    kept = jaccard.without(docs, materialise(gone, "gone"))
    twice = found.filter("doc_id is not null and component_id = doc_id").groupBy("doc_id").count().filter("count > 1")
    twice = materialise(twice.select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    # Of repeated rows of one id the least stays.
    again = kept.join(twice, "doc_id", "left_semi")
    # By a hash, as not all types can be compared; map columns have none.
    names = docs.columns
    whole = F.struct(*[plain(c) for c in names])
    mark = F.xxhash64(*[plain(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = again.groupBy("doc_id").agg(F.min_by(whole, mark).alias("one")).select("one.*").select(*map(plain, names))
    return jaccard.without(kept, twice).select(*map(plain, names)).unionByName(one)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of every piece of the documents in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: Classifiers and best-fit packing are not SQL: tests compare each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
