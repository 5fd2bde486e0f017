"""Tokens of whole Arrow columns, by arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from thicket.functions.text import MARKED, PLAIN

#: Bytes of text that are taken at once; a longer text stands alone.
PIECE = 1 << 16


@lru_cache(None)
def _folded(size: int) -> np.ndarray:
    """What each code point below ``size`` becomes in an index token; 0 where it ends one."""
    plain = np.zeros(size, np.uint32 if size > 256 else np.uint8)
    for c in range(size):
        if unicodedata.category(chr(c))[0] in "LN" or chr(c) in "_$":
            plain[c] = c
    for a, b in zip(MARKED, PLAIN):
        if ord(a) < size:
            plain[ord(a)] = ord(b)
    return plain


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, where each row begins and the last one ends) of some rows after another. Nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
        own, at = data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        if len(own) and own.max() > 127:
            at = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[at]
            own = np.frombuffer(own.tobytes().decode().encode("utf-32-le"), np.uint32)
        yield own, at
        first = last


def _starts(on: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the runs of ``on`` begin; none goes on from one row to the next."""
    first = on.copy()
    first[1:] &= ~on[:-1]
    heads = at[:-1][at[:-1] < len(on)]
    first[heads] = on[heads]
    return np.flatnonzero(first)


def _strings(kept: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings that begin at ``at`` in the code points ``kept`` and end where the next begins."""
    at = np.append(at, len(kept))
    if kept.dtype != np.uint8:
        at = np.concatenate([[0], np.cumsum(1 + (kept > 0x7F) + (kept > 0x7FF) + (kept > 0xFFFF), dtype=np.int64)])[at]
        kept = kept.tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(kept))


def index_tokens(low: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(how many each row has, the tokens of all rows) of lower-cased texts, as ``text.index_tokens`` has them."""
    sizes, tokens = [np.zeros(0, np.int64)], [pa.array([], pa.string())]
    for codes, at in _pieces(low):
        folded = _folded(256 if codes.dtype == np.uint8 else 0x110000)[codes]
        on = folded != 0
        starts = _starts(on, at)
        sizes.append(np.diff(np.searchsorted(starts, at)))
        tokens.append(_strings(folded[on], np.cumsum(on)[starts] - 1))
    return np.concatenate(sizes), pa.concat_arrays(tokens)
