"""Words and pieces of whole texts where the separators are ASCII characters: one look-up by byte, no regular expressions.

UTF-8 keeps ASCII bytes out of longer characters, so that a table of 256 classes splits texts of any language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD, GAP, BREAK = 0, 1, 2


def byte_classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte value: bytes of ``gaps`` part words, those of ``breaks`` part words and end a piece."""
    out = np.zeros(256, np.uint8)
    out[list(gaps)] = GAP
    out[list(breaks)] = BREAK
    return out


def byte_words(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text of each word, piece of each word, words) with A-Z lower-cased; nulls have none, and no piece spans two texts."""
    texts = pc.ascii_lower(texts.cast(pa.string()).fill_null(""))
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    octets = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = classes[octets]
    inside = kind == WORD
    edge = np.zeros(len(octets) + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False] if len(inside) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum((kind == BREAK).astype(np.int32), dtype=np.int64)[starts] + owner if len(octets) else owner
    spans = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(spans.tobytes()), pa.py_buffer(octets[inside].tobytes())])
    return owner, piece, words


def runs(owner: np.ndarray, words: pa.Array, length: int) -> tuple[np.ndarray, pa.Array]:
    """(owner, words joined by one space) of all runs of so many consecutive words with one owner."""
    if length == 1:
        return owner, words
    last = len(owner) - length + 1
    if last <= 0:
        return owner[:0], words[:0]
    whole = np.flatnonzero(owner[:last] == owner[length - 1 :])
    parts = [words.take(pa.array(whole + i)) for i in range(length)]
    return owner[whole], pc.binary_join_element_wise(*parts, " ")
