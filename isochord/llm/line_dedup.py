"""Lines that many documents share are dropped from all of them, by DataFrame functions only.

Lines are exploded with their positions and hashed to 128 bits; the documents of a hash are
counted after each document has named it once, so partial counts meet before the shuffle. The
positions of lines over the threshold return to their document, which is put together again
from the positions that stay. Line texts are never shuffled by line: one shuffle carries
hashes to be counted, one carries them to the frequent ones (a broadcast where these are few),
and one brings the positions to their documents. A line that a third of all documents hold is
one row of counts; the join on it is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochord.llm.rows import ascii_lower, digest128, packed
from isochord.session import written

#: Stripped from both ends of a line (a line holds no \n).
ENDS = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    """Lines of a text; NULL and empty are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line: ends stripped, A-Z lowered."""
    return F.transform(text_lines(ascii_lower(text)), lambda x: F.btrim(x, F.lit(ENDS)))


def _hashes(keys: Column) -> Column:
    def one(key: Column) -> Column:
        h1, h2 = digest128(key)
        return F.struct(h1.alias("h1"), h2.alias("h2"))
    return F.transform(keys, one)


def frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10,
                   min_chars: int = 1) -> DataFrame:
    """(h1, h2, n_docs) of line keys of at least ``min_chars`` found in ``min_docs`` rows."""
    keys = F.filter(line_keys(F.col(f"`{text_col}`")), lambda x: F.char_length(x) >= min_chars)
    # once for each document, before anything is hashed or moved
    h = docs.select(F.explode(_hashes(F.array_distinct(keys))).alias("h"))
    return (h.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n_docs"))
            .filter(F.col("n_docs") >= min_docs))


def drop_repeated_lines(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                        min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) for each row of ``docs``.

    ``row`` holds all columns of ``docs``, whatever their names. A row is a document: rows that
    repeat count each, also with the same id. A NULL text is one empty line and keeps NULL as
    ``kept_text``; an empty key is dropped only if ``min_chars`` is 0. A document that loses all
    its lines has an empty text. Other columns may be NULL. An empty table gives no rows.
    """
    text = F.col(f"`{text_col}`")
    me = digest128(F.col(f"`{id_col}`"), text)
    # written, so that its size is known: few frequent lines are broadcast and no line moves
    frequent = written(frequent_lines(docs, text_col, min_docs, min_chars).select("h1", "h2"),
                       "frequent")
    places = docs.select(me[0].alias("k1"), me[1].alias("k2"),
                         F.posexplode(_hashes(line_keys(text))).alias("pos", "h"))
    gone = (places.select("k1", "k2", "pos", "h.h1", "h.h2").join(frequent, ["h1", "h2"], "left_semi")
            .groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone")))
    rows = packed(docs).select("row", F.col(f"row.`{text_col}`").alias("text"),
                               F.col(f"row.`{id_col}`").alias("id"))
    k1, k2 = digest128(F.col("id"), F.col("text"))
    lines = text_lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    return (rows.select("row", "text", k1.alias("k1"), k2.alias("k2"))
            .join(gone, ["k1", "k2"], "left")
            .select("row", "text", "gone", lines.alias("lines"))
            .select("row", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
                    .alias("kept_text")))
