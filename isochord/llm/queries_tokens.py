"""The query of token counts; no SQL has the merges."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from isochord.llm.rows import table
from isochord.llm.token_counts import counted

LIMIT = 2048


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counted(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                  limit=LIMIT)
    return out.select("row.doc_id", "n_bytes", "n_tokens", "over_limit")
