"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer file.

Two deterministic transducers stand in a row.

- *Splitting.* Six states cut normalised text into words. Texts of a batch are laid end to
  end and cut into chunks; each chunk's map from state to state is taken for all states at once,
  maps compose by a parallel prefix scan, and each chunk is then run from the state it is
  entered in, which emits the word boundaries.
- *Merging.* A token sequence is what the merges give exactly if each two neighbours are what
  the merges give for the two alone. So the last token of every prefix of a word is known from
  the last tokens of shorter prefixes, of which only those matter from which a vocabulary entry
  can still go on. These, with their counts relative to the present one, are the state; its
  transitions are annotated with the change of the count. States are finite and are determined
  when first met; words met before are remembered. Both tables start anew at a fixed size, so
  that the memory of a task is bounded whatever the corpus.

Only the tokenizer's file reaches the tasks. Its own library is asked for the class and the lower
case of characters that this Python's character tables don't know, and for nothing else.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isochord.llm.rows import flat_utf8, packed

SLICE_BYTES = 1 << 20
CHUNK = 256
#: Sizes at which the tables of words and of states start anew.
MOST_WORDS, MOST_STATES = 400_000, 100_000

# Symbols of the splitting transducer. Letters that can follow an apostrophe in 's 't 'm 'd,
# 're 've and 'll have symbols of their own; REST is a continuation byte.
SPACE, LETTER, DIGIT, OTHER, QUOTE, STMD, RV, E, L, REST, UNKNOWN = range(11)
LETTERS = (LETTER, STMD, RV, E, L)
# States: between words, in letters, in others, after a word's first apostrophe, and after 'r
# or 'v, and 'l.
START, IN_LETTERS, IN_OTHERS, AFTER_QUOTE, AFTER_RV, AFTER_L = range(6)
N_STATES = 6
#: Emitted at a byte: a word begins here, or began one byte before.
HERE, BEFORE = 1, 2
#: White space as the tokenizer's patterns have it (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
         0x202F, 0x205F, 0x3000]


def _split_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission, at [state * 10 + symbol]."""
    move, emit = np.zeros((N_STATES, 10), np.uint8), np.zeros((N_STATES, 10), np.uint8)

    def begin(state, symbol, extra=0):
        to = {SPACE: START, DIGIT: START, OTHER: IN_OTHERS, QUOTE: AFTER_QUOTE}
        move[state, symbol] = to.get(symbol, IN_LETTERS)
        emit[state, symbol] = extra | (HERE if symbol != SPACE else 0)

    def keep(state, symbol, to, what=0):
        move[state, symbol], emit[state, symbol] = to, what
    for state in range(N_STATES):
        # an undecided letter after the apostrophe turns out to begin a word
        extra = BEFORE if state in (AFTER_RV, AFTER_L) else 0
        for symbol in range(REST):
            begin(state, symbol, extra)
        keep(state, REST, state)
    for symbol in LETTERS:
        keep(IN_LETTERS, symbol, IN_LETTERS)
        keep(AFTER_RV, symbol, IN_LETTERS, BEFORE)
        keep(AFTER_L, symbol, IN_LETTERS, BEFORE)
    for state in (IN_OTHERS, AFTER_QUOTE):
        keep(state, OTHER, IN_OTHERS)
        keep(state, QUOTE, IN_OTHERS)
    keep(AFTER_QUOTE, STMD, START)
    keep(AFTER_QUOTE, RV, AFTER_RV)
    keep(AFTER_QUOTE, L, AFTER_L)
    keep(AFTER_RV, E, START)
    keep(AFTER_L, L, START)
    return move.ravel(), emit.ravel()


MOVE, EMIT = _split_tables()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The symbol of every code point; UNKNOWN where Python's tables have none."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        out[cp] = {"L": LETTER, "N": DIGIT}.get(kind[0], UNKNOWN if kind == "Cn" else OTHER)
    out[WHITE] = SPACE
    for letters, symbol in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(c) for c in letters]] = symbol
    return out


def state_maps(symbols: np.ndarray) -> np.ndarray:
    """[chunk, state]: the state after each chunk, from each state before it; symbols is
    [position, chunk]."""
    states = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], symbols.shape[1], axis=1)
    for row in symbols:
        states = MOVE[states * np.uint8(10) + row]
    return states.T


def entry_states(maps: np.ndarray) -> np.ndarray:
    """The state in which each chunk is entered: maps composed by a parallel prefix scan."""
    scan, step = maps.copy(), 1
    while step < len(scan):
        later = np.take_along_axis(scan[step:], scan[:-step].astype(np.intp), axis=1)
        scan[step:] = later
        step *= 2
    return np.concatenate(([START], scan[:-1, START])).astype(np.uint8)


def word_bounds(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in a flat array of symbols that ends in white space."""
    n = len(symbols)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, SPACE, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    states, emitted = entry_states(state_maps(grid)), np.empty_like(grid)
    for i, row in enumerate(grid):
        at = states * np.uint8(10) + row
        emitted[i], states = EMIT[at], MOVE[at]
    emitted = np.ascontiguousarray(emitted.T).ravel()[:n]
    begins = (emitted & HERE) > 0
    begins[np.flatnonzero(emitted & BEFORE) - 1] = True
    cuts = np.flatnonzero(begins | (symbols == SPACE))
    words = np.flatnonzero(begins[cuts])
    return cuts[words], cuts[words + 1]


class MergeTransducer:
    """Counts the tokens of words of bytes; deterministic, states made when first met."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, most_states: int):
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        self.letters, self.suffix, self.most_states = letters, suffix, most_states
        self.rank = {(tuple(m) if not isinstance(m, str) else tuple(m.split(" "))): i
                     for i, m in enumerate(merges)}
        # a trie over the bytes of the vocabulary; entries that end a word are marked apart
        self.child: dict[int, int] = {}
        self.inner: dict[int, str] = {}
        self.final: dict[int, str] = {}
        n = 1
        for token in vocab:
            text, ends = (token[:-len(suffix)], True) if token.endswith(suffix) else (token, False)
            if not text or any(c not in back for c in text):
                continue
            node = 0
            for c in text:
                key = node << 8 | back[c]
                if key not in self.child:
                    self.child[key] = n
                    n += 1
                node = self.child[key]
            (self.final if ends else self.inner)[node] = token
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: of each state: (trie node, last token or "", relative count) of its open places
        self.states: list[tuple] = [((0, "", 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """What the merges make of symbols: the lowest rank first, leftmost among equals."""
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2:]]
        return symbols

    def stands(self, last: str, token: str) -> bool:
        """Whether the merges leave these two (or the token alone) as they are."""
        key = (last, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4 * self.most_states:
                self.pairs.clear()
            known = self.merged(self._symbols(last) + self._symbols(token)) == [
                t for t in key if t]
            self.pairs[key] = known
        return known

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[:-len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        open_, gain, last = [], None, ""
        for node, before, count in self.states[state]:
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            open_.append((to, before, count))
            token = self.inner.get(to)
            if gain is None and token is not None and self.stands(before, token):
                gain, last = count + 1, token
        if gain is None:
            raise ValueError("the vocabulary lacks a byte")
        made = (*((node, before, count - gain) for node, before, count in open_), (0, last, 0))
        to = self.number.get(made)
        if to is None:
            to = self.number[made] = len(self.states)
            self.states.append(made)
        return to, gain

    def _end(self, state: int, byte: int) -> int:
        for node, before, count in self.states[state]:
            token = self.final.get(self.child.get(node << 8 | byte, -1))
            if token is not None and self.stands(before, token):
                return count + 1
        raise ValueError("the vocabulary lacks a byte that ends a word")

    def count(self, word: bytes) -> int:
        if len(self.states) > self.most_states:
            self.reset()
        state = total = 0
        moves = self.moves
        for byte in word[:-1]:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._step(state, byte)
            state = move[0]
            total += move[1]
        key = state << 8 | word[-1]
        end = self.ends.get(key)
        if end is None:
            end = self.ends[key] = self._end(state, word[-1])
        return total + end


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if
    Latin-1 prints it, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Counter(dict):
    """Counts of words by the transducer; a word met before is looked up."""

    def __init__(self, transducer: MergeTransducer, most: int):
        super().__init__()
        self.transducer, self.most = transducer, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.transducer.count(word)
        return n


class Tokenizer:
    """The compiled form of one tokenizer file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing BPE files with word ends are compiled")
        self.source, self.library = source, None
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.classes, self.lowered = _classes().copy(), {}
        model = spec["model"]
        self.words = Counter(MergeTransducer(model["vocab"], model["merges"],
                                             model["end_of_word_suffix"], MOST_STATES), MOST_WORDS)

    def _learn(self, unknown: set[str]) -> None:
        """Classes and lower case of characters beyond Python's tables."""
        if self.library is None:
            from tokenizers import Tokenizer as Library
            self.library = Library.from_str(self.source)
        todo = list(unknown)
        for c in todo:
            pieces = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{c}{c}a"))
            self.classes[ord(c)] = (LETTER, SPACE, OTHER, DIGIT)[pieces - 1]
            low = self.library.normalizer.normalize_str(c)
            if low != c:
                self.lowered[ord(c)] = low
                todo += [x for x in low if self.classes[ord(x)] == UNKNOWN]

    def normalised(self, text: str) -> tuple[str, int]:
        """(text, special tokens in it): special strings become white space, the rest is composed
        and lowered character by character."""
        special = 0
        if "<|" in text:
            for s in self.special:
                special += text.count(s)
                text = text.replace(s, " ")
        if text.isascii():
            return text.lower(), special
        text = unicodedata.normalize("NFC", text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if (self.classes[points] == UNKNOWN).any():
            self._learn({c for c in set(text) if self.classes[ord(c)] == UNKNOWN})
        # a sigma at the end of a word has its own lower case in words only
        text = text.replace("Σ", "σ").lower()
        return (text.translate(self.lowered) if self.lowered else text), special

    def symbols(self, text: str, data: np.ndarray) -> np.ndarray:
        if len(text) == len(data):
            return self.classes[data]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        out = np.full(len(data), REST, np.uint8)
        out[np.cumsum(size) - size] = self.classes[points]
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        parts = [self.normalised(t) for t in texts]
        joined = "\n".join([*(p[0] for p in parts), ""])
        raw = joined.encode()
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_bounds(self.symbols(joined, data))
        known = self.words
        n = np.fromiter((known[raw[a:b]] for a, b in zip(starts.tolist(), ends.tolist())),
                        np.int64, len(starts))
        length = np.fromiter((len(p[0]) if p[0].isascii() else len(p[0].encode())
                              for p in parts), np.int64, len(parts)) + 1
        owner = np.searchsorted(np.cumsum(length), starts, "right")
        return (np.bincount(owner, n, minlength=len(texts)).astype(np.int64)
                + np.array([p[1] for p in parts], np.int64))


@lru_cache(2)
def _compiled(source: str) -> Tokenizer:
    return Tokenizer(source)


def token_count(spark: SparkSession, path: str):
    """A column function: tokens of a text by the tokenizer file at ``path``.

    Read once on the driver, so that tasks need no file; its size is that of the vocabulary.
    NULL and empty texts have none; special strings in a text count as one token each.
    """
    with open(path, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own = _compiled(source.value)
        _, offsets = flat_utf8(texts)
        out, at = [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
            to = min(max(to, at + 1), len(texts))
            out.append(own.counts([t or "" for t in texts.slice(at, to - at).to_pylist()]))
            at = to
        return pa.array(np.concatenate(out))

    def of(text: Column) -> Column:
        return count(text)
    return of


def counted(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(row, n_bytes, n_tokens, over_limit) for each row of ``docs``.

    A NULL text is empty: no bytes, no tokens. Rows that repeat are counted alike. ``row`` holds
    all columns of ``docs``, of which others may be NULL. An empty table gives no rows.
    """
    count = token_count(docs.sparkSession, path)
    rows = packed(docs).select("row", F.col(f"row.`{text_col}`").alias("text"))
    return (rows.select("row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
                        .alias("n_bytes"), count(F.col("text")).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
