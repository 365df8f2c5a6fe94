"""The training-data pipeline: each stage calls one operator and hands its rows to the next.

Quality rules reject documents, SimHash keeps one of each group of near-copies, repeated passages and
secrets leave the texts, and what remains is packed into windows of token ids. All stages but the last
return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import packing, quality, repeats, secret_scan, simhash
from panelweave.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SECRET_MARK = "<secret>"
#: SQL can't state the stages: a trained model, XXH64 fingerprints and a tokenizer.
ORACLE_SQL = None


def _rest(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c != "text"]


def _with_text(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from the struct ``row``, with another text."""
    columns: dict[str, Column] = {c: F.col(f"row.`{c}`") for c in _rest(docs)} | {"text": F.col(text)}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail the base rules or the n-gram model go."""
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return _with_text(quality.judge(docs, model, carry=_rest(docs)).filter("kept"), docs, "text")


def simhash_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return simhash.without_near_duplicates(docs, shingle=3, max_bits=3)


def suffix_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of 200 bytes or more that stand elsewhere too leave the texts; documents stay, even if nothing is left of them."""
    return _with_text(repeats.remove_repeats(docs, with_text=True, carry=_rest(docs)), docs, "kept")


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    found = secret_scan.scan(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, mask=SECRET_MARK, carry=_rest(docs))
    return _with_text(found, docs, "masked")


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces with their token ids and their places in windows."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secrets", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``. Each result is written out once, as later stages read it several times."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
