"""Corpus pipeline: documents to token records in five stages, each one training-data operator.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``, and its result is
written as Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``:

1. ``language_id``: documents without a recognised language (no text, no letter, or no language
   with a mean probability of 0.3) go.
2. ``jaccard_join``: of each group of near duplicates (five-word shingles, Jaccard 0.8 or
   more) the document with the smallest id stays, once. A row without an id stays.
3. ``decontaminate``: documents that hold 0.8 of the five-word shingles of a benchmark item go.
4. ``mix_sources``: documents are sampled by their raked rate (tempered source, language and topic shares).
5. ``token_output``: the ids of what is left as Simple-8b records, and per document its position,
   length and checksum, decoded from the records.

An empty table passes all stages. Null and empty texts go with stage 1; texts of any length are worked on whole; other
columns, whatever their names, stay until stage 5. ``run(spark, sf_dir)`` applies the stages to ``documents``.
Scratch tables of a stage are deleted when the next one starts, as its result is written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.llm import decontaminate, jaccard_join, langid, mixing, token_output
from linkweave.llm.queries import END_ID, tokenizer_file
from linkweave.llm.tables import ship_package, table
from linkweave.session import materialize, release_scratch, scratch_path, scratch_tables


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard_join.jaccard_classes(docs, k=5, num=80, den=100)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    name = "pipeline_nth"
    while name in docs.columns:
        name += "_"
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    once = docs.join(first, "doc_id", "left_semi").withColumn(name, nth).where(F.col(name) == 1)
    return once.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def write_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pipeline-tokens")
    token_output.write_tokens(docs, path, tokenizer_file(), END_ID)
    return token_output.digests(spark.read.parquet(path))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_DONE: dict[str, list[str]] = {}


def _tidy(stage: Stage) -> Stage:
    """The stage, with the scratch tables of the stage before it deleted first."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        app = spark.sparkContext.applicationId
        release_scratch(spark, _DONE.pop(app, []))
        before = set(scratch_tables(spark))
        out = stage(spark, docs, sf_dir)
        _DONE[app] = [p for p in scratch_tables(spark) if p not in before]
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _tidy(identify_language)),
    ("jaccard_join", _tidy(drop_near_duplicates)),
    ("decontaminate", _tidy(drop_contaminated)),
    ("mix_sources", _tidy(mix_sources)),
    ("token_output", _tidy(write_token_records)),
]

# The first stage is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a written table of the shared scratch folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
