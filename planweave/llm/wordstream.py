"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object a word.

Letters A to Z are lower-cased in the bytes, separators are single ASCII bytes, so words are
found by masks over the whole buffer of a block of texts. A word of up to 16 bytes is mixed from
its two 8-byte halves and its length (different words differ before the mix), a longer one goes
through XXH64. A text beyond a block's size is cut at a separator; what reaches across the cut is
the caller's to carry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

U = np.uint64
SPACES = bytes([32, 9, 10, 11, 12, 13])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mix(a * U(0x9E3779B97F4A7C15) + mix(b + U(0xD6E8FEB86659FD93)))


class Block(NamedTuple):
    """Words of some texts or of a part of one text."""

    hashes: np.ndarray  # a word each, never 0
    text: np.ndarray  # index of its text in the column
    starts: np.ndarray  # its bytes in ``raw``
    stops: np.ndarray
    raw: bytes  # lower-cased
    first: int  # texts first .. last - 1 are touched
    last: int
    ends: bool  # the last text ends here; else the next block goes on with it


def word_hashes(low: bytes, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words ``low[start:stop]``; none is 0."""
    padded = np.frombuffer(low + bytes(16), np.uint8)
    eight = np.ndarray((len(low) + 9,), "<u8", padded.data, strides=(1,))
    sizes = stops - starts

    def half(at, left):
        kept = (U(1) << (np.clip(left, 0, 7).astype(U) * U(8))) - U(1)
        return np.where(left >= 8, eight[at], eight[at] & kept)

    lead = half(starts, sizes)
    rest = half(np.minimum(starts + 8, len(low)), sizes - 8)
    out = mix(mix(lead + U(seed * 0xA0761D6478BD642F & (1 << 64) - 1)) + rest * U(0xC2B2AE3D27D4EB4F) + sizes.astype(U))
    long = np.flatnonzero(sizes > 16)
    if len(long):
        import xxhash

        digest = xxhash.xxh64_intdigest
        out[long] = np.fromiter((digest(low[s:e], seed) for s, e in zip(starts[long].tolist(), stops[long].tolist())), U, len(long))
    out[out == 0] = 1
    return out


def blocks(texts, separators: bytes = SPACES, most: int = 8 << 20, seed: int = 0) -> Iterator[Block]:
    """Blocks of about ``most`` bytes of an Arrow string array; null texts are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")
    is_gap = np.zeros(256, bool)
    is_gap[list(separators)] = True
    gap = re.compile(b"[" + b"".join(b"\\x%02x" % c for c in separators) + b"]")
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        begin, end = int(offsets[at]), int(offsets[to])
        if to > at + 1 or end - begin <= most:
            yield _block(bytes(data[begin:end]).lower(), offsets[at:to] - begin, at, to, True, is_gap, seed)
        else:  # one long text
            raw = bytes(data[begin:end]).lower()
            part = 0
            while part < len(raw) or part == 0:
                found = gap.search(raw, part + most) if len(raw) - part > most else None
                stop = found.end() if found else len(raw)
                yield _block(raw[part:stop], np.zeros(1, np.int64), at, to, stop == len(raw), is_gap, seed)
                part = stop
        at = to


def _block(low: bytes, text_starts: np.ndarray, first: int, last: int, ends: bool, is_gap: np.ndarray, seed: int) -> Block:
    gap = is_gap[np.frombuffer(low, np.uint8)]
    edge = np.zeros(len(low) + 1, bool)
    edge[text_starts] = True
    edge[len(low)] = True
    word = ~gap
    before = np.concatenate([[True], gap[:-1]]) if len(low) else gap
    after = np.concatenate([gap[1:], [True]]) if len(low) else gap
    starts = np.flatnonzero(word & (before | edge[:-1]))
    stops = np.flatnonzero(word & (after | edge[1:])) + 1
    text = np.searchsorted(text_starts, starts, "right") - 1 + first
    return Block(word_hashes(low, starts, stops, seed), text, starts, stops, low, first, last, ends)
