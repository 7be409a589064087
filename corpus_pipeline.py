"""The corpus pipeline: STAGES in order over ``documents``, each stage written and reread.

Documents in no learned language go; lines that are boilerplate on their site
go; one document of each near-duplicate group stays; word spans that an earlier
document has go; what is left is packed into training sequences. All stages but
the last return the columns of ``documents``, with ``n_chars`` brought up to date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outletiq.llm import lang_id, line_dedup, packing, simhash, substring_dedup
from outletiq.llm.common import documents, save
from outletiq.llm.queries import LINE_PAGES, LINE_RATIO, PACK_END, PACK_TOKENS, WORD_BPE, tokenizer_file


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents themselves; unrecognised documents go."""
    return lang_id.keep_recognised(docs, lang_id.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many pages of their source go; every document stays."""
    return _counted(line_dedup.drop_boilerplate(docs, LINE_RATIO, LINE_PAGES).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of 3-word SimHash neighbours (2 bits or fewer) stays."""
    return simhash.keep_first(docs, n=3, d=2)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows of an earlier document go; every document stays."""
    return _counted(substring_dedup.drop_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place."""
    return packing.pack_documents(docs, tokenizer_file(WORD_BPE), PACK_END, PACK_TOKENS)


STAGES = [("language_id", language_id), ("line_dedup", lines), ("simhash", near_duplicates),
          ("substring_dedup", substrings), ("best_fit_packing", pack)]

#: Character models, SimHash and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
