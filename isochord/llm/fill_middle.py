"""Fill-in-the-middle: documents cut at two unit borders, the middle moved to the end.

Units are matched on UTF-8 bytes (white space is ASCII), cuts are stated in code points. Both
meet in a sparse index that knows only the characters of more than one byte: their positions and
the bytes they have in excess. A cut is converted by one binary search among these exceptions,
and by a sum; text without exceptions needs no table at all. Every document is transformed where
it lies: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochord.llm.rows import flat_utf8, packed
from isochord.llm.words import NOT_SPACE, word_spans

SLICE_BYTES = 1 << 20
MARKERS = ("<P>", "<S>", "<M>")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


class ExceptionIndex:
    """Code points and bytes of a flat UTF-8 array, by its characters beyond ASCII alone."""

    def __init__(self, data: np.ndarray):
        #: bytes at which characters of more than one byte begin, and the same in code points
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        #: excess bytes of the first i exceptions
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(excess)))
        self.at_point = self.at_byte - self.before[:-1]

    def to_points(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte position, which is where a character begins."""
        return byte - self.before[np.searchsorted(self.at_byte, byte, "left")]

    def to_bytes(self, point: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return point + self.before[np.searchsorted(self.at_point, point, "left")]


def unit_cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut) of each text; cuts are bytes of the flat array.

    A unit is a word with the white space before it; white space at the end is a unit of its own.
    """
    _, ends, doc = word_spans(data, offsets, NOT_SPACE)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    head = np.cumsum(words) - words
    full = offsets[1:] > offsets[:-1]
    units = words.astype(np.int64)
    units[full] += ~NOT_SPACE[data[offsets[1:][full] - 1]]
    ends = np.append(ends, 0)

    def cut(taken):
        at = np.where(taken > words, offsets[1:], offsets[:-1])
        inside = (taken > 0) & (taken <= words)
        at[inside] = ends[(head + taken - 1)[inside]]
        return at
    x, y = h1 % (units + 1), h2 % (units + 1)
    return units, cut(np.minimum(x, y)), cut(np.maximum(x, y))


def rearranged(text: bytes, first: int, second: int, form: str, markers: Sequence[bytes]) -> bytes:
    """The text with its middle at the end, cut before the bytes ``first`` and ``second``."""
    p, s, m = markers
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def transformed(data: np.ndarray, offsets: np.ndarray, draws: Sequence[np.ndarray], rate: int,
                spm_share: int, markers: Sequence[bytes]) -> pa.StructArray:
    """The struct RESULT of each text; ``draws`` are h1 to h4."""
    h1, h2, h3, h4 = draws
    units, first, second = unit_cuts(data, offsets, h1, h2)
    index = ExceptionIndex(data)
    begin = index.to_points(offsets[:-1])
    cut1, cut2 = index.to_points(first), index.to_points(second)
    raw = data.tobytes()
    # outputs are assembled from the cuts in code points, which are what a reader is told
    to1, to2 = index.to_bytes(cut1) - offsets[:-1], index.to_bytes(cut2) - offsets[:-1]
    forms, outputs = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        text = raw[a:b]
        form = "spm" if h4[i] % 100 < spm_share else "psm"
        if not text or h3[i] % 100 >= rate or any(m in text for m in markers):
            form = "plain"
        else:
            text = rearranged(text, int(to1[i]), int(to2[i]), form, markers)
        forms.append(form)
        outputs.append(text)
    plain = np.array([f == "plain" for f in forms], bool)
    kind = pa.large_string() if sum(map(len, outputs)) >= 1 << 31 else pa.string()
    return pa.StructArray.from_arrays(
        [pa.array(units), pa.array(forms, pa.string()),
         pa.array(cut1 - begin, mask=plain), pa.array(cut2 - cut1, mask=plain),
         pa.array(outputs, pa.binary()).cast(kind)],
        ["n", "form", "prefix_chars", "middle_chars", "output"])


def _transform(rate: int, spm_share: int, markers: Sequence[str]):
    coded = [m.encode() for m in markers]

    @F.arrow_udf(RESULT)
    def transform(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array
                  ) -> pa.Array:
        data, offsets = flat_utf8(texts)
        draws = [h.to_numpy(zero_copy_only=False) for h in (h1, h2, h3, h4)]
        out, at = [], 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            out.append(transformed(data[offsets[at]:offsets[to]],
                                   offsets[at:to + 1] - offsets[at],
                                   [h[at:to] for h in draws], rate, spm_share, coded))
            at = to
        return pa.concat_arrays(out) if out else transformed(
            data, offsets, draws, rate, spm_share, coded)
    return transform


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:id``; a NULL id is empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def filled_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = 42,
                  rate: int = 50, spm_share: int = 80, markers: Sequence[str] = MARKERS
                  ) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    ``rate`` of a hundred documents are transformed, ``spm_share`` of a hundred of these with the
    suffix first. n counts units; the two lengths are in code points and NULL for ``plain``
    documents, whose output is the text. A NULL or empty text is plain, with n = 0 and an empty
    output, and so is a text that holds a marker. Draws hang on the id alone, so rows that repeat
    an id share them (cuts follow each text's own units). ``row`` holds all columns of ``docs``.
    An empty table gives no rows.
    """
    for m in markers:
        if any(m.endswith(o[:k]) for o in markers for k in range(1, len(o) + (o is not m))
               if (o, k) != (m, len(m))):
            raise ValueError("markers must not overlap one another")
    rows = packed(docs).select("row", F.col(f"row.`{text_col}`").alias("text"),
                               *[h.alias(f"h{i}") for i, h in
                                 enumerate(draws(F.col(f"row.`{id_col}`"), seed), 1)])
    made = _transform(rate, spm_share, markers)("text", "h1", "h2", "h3", "h4")
    return rows.select("row", made.alias("made")).select("row", "made.*")


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text again, from an output and its form alone; exact, since no text that was cut holds
    a marker and markers do not overlap."""
    p, s, m = markers
    middle = F.substring_index(output, m, -1)
    front = F.substring_index(output, m, 1)

    def of(first, second):
        return (F.substring(F.substring_index(front, second, 1), len(first) + 1, 1 << 30),
                F.substring_index(front, second, -1))
    (prefix, suffix), (suffix2, prefix2) = of(p, s), of(s, p)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix2, middle, suffix2)).otherwise(output))
