"""The query of packing; no SQL has the tokenizer, and fewest sequences are no single answer."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.packing import pieces, placed
from isochord.llm.rows import table

LIMIT = 2048


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                 LIMIT, end_id=0)
    digests = cut.select("row.doc_id", "piece", "start", "length",
                         F.crc32("ids").alias("ids_crc32"))
    return placed(digests, LIMIT).select("piece.*", "sequence_id", "offset")
