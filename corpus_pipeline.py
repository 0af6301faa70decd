"""A training corpus from raw documents: five stages, each a job over all that the one before kept.

1. language: rows without a recognizable language go, a null lang becomes the language found;
2. near_duplicates: of each group of similar texts the document with the least id stays;
3. repeated_passages: words of passages that repeat elsewhere in what is left go from the texts;
4. benchmark: documents that hold a benchmark item of two words or more go (a single word is wording of any text, and
   tests/llm/test_edge_cases.py keeps it; op8 reports such items too);
5. mix: the documents that the mixture takes, with how many words of each (size, source_size, target and taken; columns
   of documents with these names are replaced).

Each stage's result is written as Parquet in the shared folder and read again, so a lost executor repeats tasks of one
stage only. A stage keeps columns that it does not know.

Edge cases: null and empty texts and those without letters go in the first stage; where no row has a lang, all texts
with letters stay; rows that repeat an id with other texts are documents of their own in all stages, rows that repeat id
and text are one from the second stage on; a null id counts as the least; a text that loses all its words in the third
stage stays, empty, and the last one leaves it out; an empty table gives an empty corpus; texts of any length are worked
on whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, stored
from trialspark.llm.decontaminate import without_leaks
from trialspark.llm.jaccard import one_of_each_group
from trialspark.llm.language import with_language
from trialspark.llm.mixing import mix_documents
from trialspark.llm.substring import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = documents(spark, sf_dir, "benchmark")
    return without_leaks(docs, items.filter(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")) > 1))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("mix", mix),
]

#: The language model's decisions can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
