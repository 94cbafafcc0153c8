"""From raw documents to token ids: language, near-duplicates, secrets, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's rows
are written as Parquet and read again before the next one.  So when a stage
begins, the tables that the one before it made on its way are no longer read,
and go.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.bpe import tokenize_digests
from tidelog.llm.common import SPACE_FREE, cut, hint_small, release, table, unused
from tidelog.llm.language import accepted_documents
from tidelog.llm.minhash import near_duplicates
from tidelog.llm.mixing import repeat_documents
from tidelog.llm.secrets import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: list[str] = []


def staged(stage: Stage) -> Stage:
    """The stage, after the tables of the one before it have been deleted; what docs still reads stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _before, docs)
        start = len(common.made)
        out = stage(spark, docs, sf_dir)
        _before[:] = common.made[start:]
        return out

    return run_stage


@staged
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no language go, null and wordless ones too; lang is the fused verdict.

    Repeated rows are judged one by one; columns of any name stay; an empty table stays empty.
    """
    return accepted_documents(docs)


@staged
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest id; of rows that share it, that of the least text.

    Wordless texts and rows without an id stay, columns of any name too; an empty table stays empty.
    """
    told = cut(near_duplicates(docs))
    gone = cut(told.where("not kept").select("doc_id").distinct())
    stay = docs.join(hint_small(gone, 1_000_000), "doc_id", "left_anti").select(*docs.columns)
    again = cut(told.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return stay
    # Ids that several texts share: one row of each is chosen while it is aggregated, so a frequent id is no large task.
    held = hint_small(again, 1_000_000)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    worded = F.coalesce(F.col("text").rlike(SPACE_FREE), F.lit(False))
    met = stay.join(held, "doc_id", "left_semi").select(*docs.columns).withColumn(unused(docs, "_worded")[0], worded)
    mark = unused(docs, "_worded")[0]
    one = met.where(mark).groupBy(F.col("doc_id").alias(unused(docs, "_id")[0])).agg(F.min_by(row, F.struct(F.xxhash64("text"), F.col("text"))).alias("row"))
    rest = stay.join(held, "doc_id", "left_anti").select(*docs.columns)
    return rest.unionByName(met.where(~F.col(mark)).select(*docs.columns)).unionByName(one.select("row.*"))


@staged
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked in the texts; all documents stay, null and empty texts and repeated rows as they are.

    Columns of any name stay; an empty table stays empty.
    """
    return redact(docs)


@staged
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every time the mix takes it; wordless texts are not taken.

    Repeated ids are taken together; columns of any name stay; an empty table stays empty.
    """
    return repeat_documents(docs)


@staged
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix; null texts are empty and have no tokens.

    Repeated rows come back repeated; other columns are not read; an empty table gives an empty result.
    """
    return tokenize_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix),
    ("bpe", encode),
]

#: The stages use sketches, trained likelihoods and a tokenizer that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs, own = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            # The rows of the stage before are written anew by now.
            release(spark, own)
            own = common.made[-1:]
    return docs
