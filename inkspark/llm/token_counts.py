"""Token counts by a finite-state compilation of a byte-level BPE tokenizer with word ends.

The tokenizer file is compiled into two deterministic transducers:

* the pre-tokenizer: a table over a few character classes whose transitions say whether a word starts at the character. It
  runs over a whole batch at once: the characters are cut into chunks, every chunk computes the map from each entry
  state to its exit state and the number of words started on the way, the maps are composed by a parallel prefix scan, and
  with the entry states known the chunks emit their word starts. A text may therefore be cut anywhere;
* the word transducer: a state is what the merge rules can still change, and each transition, on a byte or on a byte that
  ends the word, carries the change of the number of tokens. Its states are compiled when they are first met. It reads a word once from
  left to right, whatever its length.

Why the second one is finite and exact: a split of a word into tokens is the one that the merge rules give if and only if no
merge crosses any border between neighbouring tokens (``WordTransducer.fits``), so the tokens of a prefix of a word end
with the one token t of the vocabulary that is a suffix of the prefix and fits what the prefix without t ends with. The next byte
therefore depends only on the suffixes that begin a token of the vocabulary: for each, its place in the tree of tokens, the
last token before it, and how many tokens there were then. That tuple is the state.

Equal words of a slice of text are counted once; they are found by Arrow's dictionary encoding of their bytes.

Counts are those of the library without begin, end or added special tokens; special strings inside a text are
one token each, and split it, as is the library's default.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows stay repeated.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from inkspark.llm.store import source
from inkspark.llm.words import slices

CHUNK = 512
SLICE = 2 << 20
LIMIT = 2048
STATES = 100_000  # compiled states of the word transducer that a worker keeps

# character classes of the pre-tokenizer
SPACE, LETTER, NUMBER, OTHER, QUOTE, L_S, L_T, L_R, L_E, L_V, L_M, L_L, L_D, CUT = range(14)
N_CLASSES = 14
# states: what the word that goes on is
(S_NONE, S_LETTERS, S_OTHER, S_QUOTE, S_Q_R, S_Q_V, S_Q_L) = range(7)
N_STATES = 7


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        out[[ord(c) for c in regex.findall(pattern, everything)]] = cls
    out[ord("'")] = QUOTE
    for c, cls in zip("strevmld", (L_S, L_T, L_R, L_E, L_V, L_M, L_L, L_D)):
        out[ord(c)] = cls
    return out


@lru_cache(1)
def _table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class. Emission 1: a word starts here. 2: it starts one character earlier too,
    since an apostrophe turned out to stand alone and a letter starts the next word. 3: it starts at this character and at
    the one before (apostrophe, then the letter that began an unfinished contraction)."""
    letters = {LETTER, L_S, L_T, L_R, L_E, L_V, L_M, L_L, L_D}
    nxt, emit = np.zeros((N_STATES, N_CLASSES), np.uint8), np.zeros((N_STATES, N_CLASSES), np.uint8)

    def fresh(c: int) -> tuple[int, int]:
        if c in letters:
            return S_LETTERS, 1
        return {SPACE: (S_NONE, 0), CUT: (S_NONE, 0), NUMBER: (S_NONE, 1), OTHER: (S_OTHER, 1), QUOTE: (S_QUOTE, 1)}[c]

    for s in range(N_STATES):
        for c in range(N_CLASSES):
            to, e = fresh(c)
            if s == S_LETTERS and c in letters:
                to, e = S_LETTERS, 0
            elif s == S_OTHER and c in (OTHER, QUOTE):
                to, e = S_OTHER, 0
            elif s == S_QUOTE:  # an apostrophe that starts a word
                if c in (L_S, L_T, L_M, L_D):
                    to, e = S_NONE, 0
                elif c in (L_R, L_V, L_L):
                    to, e = {L_R: S_Q_R, L_V: S_Q_V, L_L: S_Q_L}[c], 0
                elif c in (OTHER, QUOTE):
                    to, e = S_OTHER, 0
            elif s in (S_Q_R, S_Q_V, S_Q_L):  # 're 've 'll end here; else the letter before starts a word of its own
                if c == {S_Q_R: L_E, S_Q_V: L_E, S_Q_L: L_L}[s]:
                    to, e = S_NONE, 0
                elif c in letters:
                    to, e = S_LETTERS, 2
                else:
                    e += 2
            nxt[s, c], emit[s, c] = to, e
    return nxt, emit


def word_starts(classes: np.ndarray) -> tuple[np.ndarray, int]:
    """(which characters start a word, how many), by chunk maps of (exit state, words started) and a prefix scan over them."""
    nxt, emit = _table()
    n = len(classes)
    chunks = max(1, -(-n // CHUNK))
    padded = np.full(chunks * CHUNK + 1, CUT, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded[:-1].reshape(chunks, CHUNK).T)
    # each chunk's map from entry state to exit state, and the words started on the way
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (chunks, 1))
    started = np.zeros((chunks, N_STATES), np.int32)
    flat, flat_emit = nxt.reshape(-1), emit.reshape(-1)
    words = np.array([0, 1, 1, 2], np.uint8)[flat_emit]
    for row in grid:
        at = maps * np.uint8(N_CLASSES) + row[:, None]
        started += words[at]
        maps = flat[at]
    # inclusive prefix scan under composition: the exit states of the left are the entry states of the right
    step = 1
    while step < chunks:
        left = maps[:-step].copy()
        started[step:] = started[:-step] + np.take_along_axis(started[step:], left, 1)
        maps[step:] = np.take_along_axis(maps[step:], left, 1)
        step *= 2
    state = np.r_[np.uint8(S_NONE), maps[:-1, S_NONE]]
    out = np.zeros((CHUNK + 1, chunks), np.uint8)
    for i, row in enumerate(grid):
        at = state * np.uint8(N_CLASSES) + row
        out[i], state = flat_emit[at], flat[at]
    marks = np.ascontiguousarray(out[:CHUNK].T).reshape(-1)
    starts = (marks & 1).astype(bool)
    late = np.flatnonzero(marks & 2) - 1  # the character before starts a word
    starts[late] = True
    return starts[:n], int(started[-1, S_NONE])


class WordTransducer:
    """The merge rules over the bytes of a word, as a deterministic transducer that is compiled while it runs.

    Symbols 0 to 255 are bytes inside a word, 256 to 511 bytes that end one.
    """

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str):
        chars = _byte_chars()
        base = {c: b for b, c in enumerate(chars)} | {c + end: 256 + b for b, c in enumerate(chars)}
        if any(c not in vocab for c in base):
            raise ValueError("the vocabulary lacks some byte")
        number, spelled = dict(base), [(i,) for i in range(512)]
        self.halves: list[tuple[int, int]] = [(-1, -1)] * 512
        self.made = [-1] * 512  # the rank of the merge that makes a token
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y = number[a], number[b]
            if a + b not in number:
                number[a + b] = len(spelled)
                spelled.append(spelled[x] + spelled[y])
                self.halves.append((x, y))
                self.made.append(r)
            self.rank[x, y] = r
        # the tree of the tokens that the rules make of their own bytes
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        own = [True] * len(spelled)
        for t, symbols in enumerate(spelled):
            x, y = self.halves[t]
            if x >= 0 and not (own[x] and own[y] and self.fits(x, y, self.made[t])):
                own[t] = False
                continue
            node = 0
            for c in symbols:
                self.inner[node] = True
                key = node << 9 | c
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = t
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: dict[int, tuple[int, int]] = {}
        self._restart()

    def _restart(self) -> None:
        self.pairs.clear()
        self.steps.clear()
        self.states[:] = [((0, -1, 0),)]
        self.known.clear()
        self.known[self.states[0]] = 0

    def fits(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether no merge of a lower rank than ``limit`` crosses the border of two neighbouring tokens.

        The merges that made them are undone, the latest first. A merge across the border happens if its rank is lower than that of
        the merge undone last (or equal to it, on the right: of equal pairs the left one is merged first).
        """
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            made_a, made_b = self.made[a], self.made[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                limit, a = min(limit, made_a), self.halves[a][1]
            else:
                limit, b = min(limit, made_b + 1), self.halves[b][0]

    def _compiled(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the number of tokens) of a transition."""
        kept, last, change = [], -1, 0
        for node, before, count in self.states[state]:
            child = self.child.get(node << 9 | symbol)
            if child is None:
                continue
            t = self.token[child]
            if t >= 0 and last < 0:
                good = before < 0 or self.pairs.get((before, t))
                if good is None:
                    good = self.pairs[before, t] = self.fits(before, t)
                if good:
                    last, change = t, count + 1
            if self.inner[child]:
                kept.append((child, before, count))
        key = (*((n, b, c - change) for n, b, c in kept), (0, last, 0))
        to = self.known.get(key)
        if to is None:
            if len(self.states) >= STATES:
                self._restart()
                to = self.known[key] = len(self.states)
                self.states.append(key)
                return to, change
            to = self.known[key] = len(self.states)
            self.states.append(key)
        step = self.steps[state << 9 | symbol] = (to, change)
        return step

    def count(self, word: bytes) -> int:
        """Tokens of a word: the sum of what its transitions carry."""
        steps, state, total = self.steps, 0, 0
        for b in word[:-1]:
            step = steps.get(state << 9 | b)
            if step is None:
                step = self._compiled(state, b)
            state, change = step
            total += change
        last = 256 | word[-1]
        return total + (steps.get(state << 9 | last) or self._compiled(state, last))[1]


class Tokenizer:
    """A compiled tokenizer file: byte-level BPE with word ends, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = WordTransducer(merges, model["vocab"], model["end_of_word_suffix"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


@lru_cache(4)
def tokenizer(path: str) -> Tokenizer:
    """One compiled tokenizer per worker and file."""
    return Tokenizer(path)


def normal(text: str) -> str:
    """NFC, and lower case a character at a time (a final capital sigma isn't special)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """The number of tokens of each text."""
    tok = tokenizer(path)
    total = np.zeros(len(texts), np.int64)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        if "<|" in text:
            special = len(tok.special.findall(text))
            total[i] += special
            parts = tok.special.split(text) if special else [text]
        else:
            parts = [text]
        for part in parts:
            if part:
                pieces.append(normal(part))
                owner.append(i)
    if not pieces:
        return total
    lens = np.array([len(p) for p in pieces]) + 1
    joined = "\n".join(pieces) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[points]
    ends = np.cumsum(lens)
    cls[ends - 1] = CUT
    starts, n_words = word_starts(cls)
    if not n_words:
        return total
    # without white space the words follow each other: their bytes are one Arrow array
    full = (cls != SPACE) & (cls != CUT)
    letters = points[full]
    width = 1 + (letters >= 0x80).astype(np.int32) + (letters >= 0x800) + (letters >= 0x10000)
    at = np.r_[0, np.cumsum(width)]
    begin = np.flatnonzero(starts[full])
    offsets = at[np.r_[begin, len(letters)]].astype(np.int32)
    data = letters.tobytes().decode("utf-32-le").encode("utf-8")
    words = pa.Array.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    counts = np.array([tok.words.count(w) for w in words.dictionary.to_pylist()], np.int64)
    # the tokens of a text are the difference of two prefix sums over the words
    summed = np.r_[0, np.cumsum(counts[words.indices.to_numpy(zero_copy_only=False)])]
    piece = np.searchsorted(np.flatnonzero(starts), np.r_[0, ends])
    np.add.at(total, np.array(owner), np.diff(summed[piece]))
    return total


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            text = batch.column("text").fill_null("")
            n = count_tokens(text.to_pylist(), path)
            size = pc.binary_length(text).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text; ``path`` is a tokenizer file that workers can read."""
    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(
        partial(_counted, path=path, limit=limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op8_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all of ``documents`` under word_bpe_49k."""
    import public_tokenizers

    return token_counts(source(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
