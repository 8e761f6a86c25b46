"""The corpus pipeline: quality, near-duplicates, mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one
gets it written and read again. All but the last return the columns of
`documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowline.llm.common import cut, remove, settled, table
from sparrowline.llm.pfair import mix
from sparrowline.llm.quality import fit_quality, held_out, quality_score
from sparrowline.llm.setsketch import one_of_each
from sparrowline.llm.spm import encode_decode


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go. It is
    fitted on the labels that are not held out."""
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return docs.where(quality_score(docs, model) >= 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least doc_id."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the Pfair schedule. Readers of more
    than one file don't keep that order; the last stage's `mix_position` does."""
    return mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document and
    mix_position, its place in the schedule of the mixing stage. The schedule
    follows from the rows alone, so it is told again here on the small rows of
    the result, by the hashes of the whole rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.withColumns({"mix_row_hash": F.xxhash64(row), "mix_row_source": F.col("source")})
    encoded = cut(encode_decode(keyed, public_tokenizers.path("piece_bpe_32k.model"), keep=["mix_row_hash", "mix_row_source"]), "pipeline-encoded")
    placed = mix(encoded, source_col="mix_row_source", hash_col="mix_row_hash")
    return placed.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mix_position")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("sentencepiece", sentencepiece_stage)]

#: SQL can't express the classifier; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage has read is deleted once its
    own table is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
