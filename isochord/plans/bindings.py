"""How the operators' inputs are read from the given tables.

A *slot* is a slice of the embedding that plays the part of one space: a model, one of
its layers, or one subject's view of it. ``w`` is the window index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from isochord.session import inline

K = 5
ALPHA = 0.05

# (side, layer, subject, first element, length)
PLAIN = [("a", 0, "s0", 1, 32), ("b", 0, "s0", 33, 32)]
# the whole vector as one space, as two layers, and as seen by eight subjects
WHOLE = [("a", 0, "s0", 1, 64)]
HALVES = [("a", 0, "s0", 1, 32), ("a", 1, "s0", 33, 32)]
EIGHTHS = [("a", 0, f"s{n}", 8 * n + 1, 8) for n in range(8)]
LAYERED = [("a", 0, "s0", 1, 16), ("a", 1, "s0", 17, 16),
           ("b", 0, "s0", 33, 16), ("b", 1, "s0", 49, 16)]
SUBJECTS = ([("a", 0, f"s{n}", 8 * n + 1, 8) for n in range(4)]
            + [("b", 0, f"s{n}", 8 * n + 33, 8) for n in range(4)])

# (model, family, size rank, first element, length): families of 3, 3 and 2 sizes
MODELS = [("m0", "f0", 0, 1, 8), ("m1", "f0", 1, 9, 8), ("m2", "f0", 2, 17, 8),
          ("m3", "f1", 0, 25, 8), ("m4", "f1", 1, 33, 8), ("m5", "f1", 2, 41, 8),
          ("m6", "f2", 0, 49, 8), ("m7", "f2", 1, 57, 8)]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is looked up in the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("w"), "embedding", "label")


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a given table; footers answer without reading data."""
    return table(spark, sf_dir, name).count()


def window_count(spark: SparkSession, sf_dir: str) -> int:
    """Windows of the recording: one more than the largest id, whether or not all are there."""
    last = embeddings(spark, sf_dir).agg(F.max("w")).first()[0]
    return 0 if last is None else last + 1


def side(spark: SparkSession, sf_dir: str, which: str, slots=PLAIN,
         layer_name: str | None = None) -> DataFrame:
    """(grid, layer, subject, w, vec) of one side in a single pass over the table."""
    mine = [s for s in slots if s[0] == which]
    parts = F.array(*[
        F.struct(F.lit(layer).alias("layer"), F.lit(subject).alias("subject"),
                 F.slice("embedding", first, size).alias("vec"))
        for _, layer, subject, first, size in mine])
    return (embeddings(spark, sf_dir).select("w", F.explode(parts).alias("s"))
            .select(F.lit("base").alias("grid"),
                    F.col("s.layer").alias(layer_name or "layer"), "s.subject", "w", "s.vec"))


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid, model, w, vec) of all models in a single pass over the table."""
    parts = F.array(*[
        F.struct(F.lit(m).alias("model"), F.slice("embedding", first, size).alias("vec"))
        for m, _, _, first, size in MODELS])
    return (embeddings(spark, sf_dir).select("w", F.explode(parts).alias("s"))
            .select(F.lit("base").alias("grid"), "s.model", "w", "s.vec"))


def model_dim(spark: SparkSession) -> DataFrame:
    return inline(spark, [(m, f, r) for m, f, r, _, _ in MODELS],
                  ["model", "family", "size_rank"])


def model_pairs(spark: SparkSession) -> DataFrame:
    """Unordered pairs of models, families attached."""
    rows = [("base", a[0], b[0], a[1], b[1], a[2], b[2])
            for a in MODELS for b in MODELS if a[0] < b[0]]
    return inline(spark, rows, ["grid", "model_a", "model_b", "family_a", "family_b",
                                "rank_a", "rank_b"])


def slot_pairs(spark: SparkSession, slots, with_subject: bool = False) -> DataFrame:
    """Layer pairs (within a subject where asked) as a small table."""
    rows = sorted({("base", sa[2], sa[1], sb[1]) for sa in slots for sb in slots
                   if sa[0] == "a" and sb[0] == "b" and sa[2] == sb[2]})
    df = inline(spark, rows, ["grid", "subject", "la", "lb"])
    return df if with_subject else df.drop("subject")
