"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .fingerprint import op9_document_fingerprints
from .language import op4_language_id
from .licenses import op1_license_scan
from .minhash import op3_minhash_near_dedup
from .mixing import op5_source_mixing
from .personal import op10_personal_data
from .secrets import op7_secret_scan
from .suffixes import op8_suffix_array_dedup
from .vectors import op6_embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_bpe,
        op3_minhash_near_dedup,
        op4_language_id,
        op5_source_mixing,
        op6_embedding_near_dedup,
        op7_secret_scan,
        op8_suffix_array_dedup,
        op9_document_fingerprints,
        op10_personal_data,
    )
} | {"pipeline": corpus_pipeline.run}

#: Queries without SQL are tested against brute force in tests/llm.
SQL: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
