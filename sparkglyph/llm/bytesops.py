"""Vectorised work on the UTF-8 bytes of a column of texts.

Every function sees an Arrow string array whose texts were each ended with one
line feed (:func:`closed`), so no word or line runs across two documents.  Words
are ``[^\\x20\\x09-\\x0D]+``; nulls count as empty texts.  Batches are cut at
document boundaries to about ``SLICE`` bytes, which bounds the arrays made for
them; a longer document is worked on whole, in a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18

#: Odd 64-bit constants of a polynomial hash and of its finisher.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, SLICE + (SLICE >> 2)), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
        if n > 4 * SLICE:
            return _powers.pop(base)[:n]
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; one more offset than texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def closed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`flat` with a line feed after each text."""
    return flat(pc.binary_join_element_wise(pc.fill_null(texts, ""), "\n", ""))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values; the last value must be false."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal spans have equal hashes wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(prefix))[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * MIX2)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the number of the document of every word."""
    starts, ends = runs(~SEPARATOR[data])
    per = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), per)


#: Fixed odd factors for the places of a window.
PLACE = [np.uint64(pow(BASE, 2 * k + 3, 1 << 64)) for k in range(16)]


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` neighbouring words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m] * PLACE[0]
    for k in range(1, n):
        out += words[k : k + m] * PLACE[k]
    return mixed(out)


def per_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one a byte) by document; every document has a byte at least."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    return np.add.reduceat(values, offsets[:-1], dtype=np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an equal one stands elsewhere."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an equal one stands before it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out
