"""Encoding whole texts with a public tokenizer, exactly and with little repeated work.

A byte-level BPE never lets a token run across the gap before a single space that
follows a visible character, so a text is the sequence of its space-led pieces and the
ids of a text are the ids of its pieces. A token doesn't run across the end of a run of
letters either, nor across a line break between visible characters, so a piece is cut
into parts there. Arrow splits and dictionary-encodes a slice of texts, then the distinct
pieces; the library encodes each distinct part once; the ids of pieces and texts are
gathered as binary values. Texts in which white space meets a space, or that hold a
special token's string, are encoded whole by the library: for these the rule doesn't hold.
"""

from __future__ import annotations

import itertools
import json
import os
from functools import lru_cache

import numpy as np

# White space (as the tokenizer's pattern counts it), inside a character class.
SPACE = r"\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Pieces that make a text one to be encoded whole: white space at the start (unless the text
# starts there), at the end (unless it ends there), a special token or the mark used below.
STARTS, ENDS, SPECIAL = rf"^[{SPACE}]", rf"[{SPACE}]$", r"<\||\x02"

# White space inside a part, or nothing after its space: encoded on its own.
INNER = rf"^ ?$|^.[^ ]* |[{SPACE.replace(' ', '')}]"

# A run of letters after at most one space: one word of the tokenizer's own pattern.
LETTERS = r"^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"

# Where a piece is cut: around a line break between visible characters, after letters.
MARK = "\x02"
CUTS = (
    (rf"([^{SPACE}])\n([^{SPACE}])", rf"\1{MARK}" + "\n" + rf"{MARK}\2"),
    (r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])", rf"\1{MARK}\2"),
)
IDS = np.uint32


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def shared_encoder(vocabulary: str, special_is_text: bool = False) -> Encoder:
    """One encoder a worker: its pieces serve every task that the worker runs."""
    return Encoder(vocabulary, special_is_text)


class Encoder:
    """Encodes Arrow string arrays; remembers the ids of the first ``keep`` parts as two flat
    Arrow arrays, about 40 bytes a part."""

    def __init__(self, vocabulary: str, special_is_text: bool = False, keep: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = special_is_text
        self.keep = keep
        self.known = pa.array([], pa.large_string())
        self.known_ids = pa.array([], pa.large_binary())
        line = self.library.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        # Lines that are one word each need no pattern to be cut into words.
        self.usual = self.library.pre_tokenizer
        state = json.loads(self.usual.__getstate__())
        plain = state["type"] == "ByteLevel" and state["use_regex"] and not state["add_prefix_space"]
        self.by_line = Sequence([Split("\n", "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)]) if plain else self.usual

    def _by_library(self, parts):
        """Binary ids of each of ``parts`` (Arrow strings).

        Parts without inner white space go a thousand to a text, a line each: a line break
        between a visible character and anything is a token of its own, so the places of its
        id cut the ids again. That spares the library's bookkeeping for every part."""
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(parts)
        alone = np.asarray(pc.match_substring_regex(parts, INNER)) if n else np.zeros(0, bool)
        if self.line is None:
            alone = np.ones(n, bool)
        flats, sizes, order = [np.empty(0, IDS)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        words = np.asarray(pc.match_substring_regex(parts, LETTERS)) if n else alone
        for joined, cutter in ((np.flatnonzero(~alone & words), self.by_line), (np.flatnonzero(~alone & ~words), self.usual)):
            self.library.pre_tokenizer = cutter
            for at in range(0, len(joined), 50_000):
                own = joined[at : at + 50_000]
                stops = np.append(np.arange(0, len(own), 1000), len(own))
                lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(stops, pa.int64()), parts.take(pa.array(own))), pa.scalar("\n", pa.large_string())).to_pylist()
                ids = [e.ids for e in self.library.encode_batch_fast([x + "\n" for x in lines], add_special_tokens=False)]
                flat = np.fromiter(itertools.chain.from_iterable(ids), IDS)
                cut = flat == self.line
                stops = np.flatnonzero(cut)
                if len(stops) != len(own):
                    raise AssertionError("a line break was not a token of its own")
                flats.append(flat[~cut])
                sizes.append(np.diff(stops, prepend=-1) - 1)
                order.append(own)
        self.library.pre_tokenizer = self.usual
        single = np.flatnonzero(alone)
        for at in range(0, len(single), 10_000):
            own = single[at : at + 10_000]
            ids = [e.ids for e in self.library.encode_batch_fast(parts.take(pa.array(own)).to_pylist(), add_special_tokens=False)]
            flats.append(np.fromiter(itertools.chain.from_iterable(ids), IDS))
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            order.append(own)
        back = np.empty(n, np.int64)
        back[np.concatenate(order)] = np.arange(n)
        return _binary(np.concatenate(flats), np.concatenate(sizes)).take(pa.array(back))

    def _ids_of(self, parts):
        """Binary ids of each of the distinct ``parts``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(parts, value_set=self.known)
        missing = np.flatnonzero(np.asarray(at.is_null()))
        unknown = parts.take(pa.array(missing))
        fresh = self._by_library(unknown)
        where = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        where[missing] = np.arange(len(missing)) + len(self.known)
        out = pa.concat_arrays([self.known_ids, fresh]).take(pa.array(where))
        room = max(0, self.keep - len(self.known))
        if room and len(unknown):
            self.known = pa.concat_arrays([self.known, unknown.slice(0, room)])
            self.known_ids = pa.concat_arrays([self.known_ids, fresh.slice(0, room)])
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.empty(0, IDS), np.empty(0, np.int64)
        split = pc.split_pattern(texts, " ")
        words = split.values.dictionary_encode()
        offsets = np.asarray(split.offsets)
        del split
        codes = np.asarray(words.indices)[offsets[0] : offsets[-1]]
        entries = words.dictionary
        first, last = offsets[:-1] - offsets[0], offsets[1:] - offsets[0] - 1  # a text has one piece at least
        # Texts to encode whole.
        blank = np.asarray(pc.equal(entries, ""))
        flags = (np.asarray(pc.match_substring_regex(entries, STARTS)) | blank) * np.uint8(1)
        flags |= (np.asarray(pc.match_substring_regex(entries, ENDS)) | blank) * np.uint8(2)
        flags |= np.asarray(pc.match_substring_regex(entries, SPECIAL)) * np.uint8(4)
        hard = np.empty(0, np.int64)
        if flags.any():
            marks = flags[codes]
            marks[first] &= 6
            marks[last] &= 5
            odd = blank[codes[first]] & (last == first + 1) & blank[codes[last]]  # a single space
            hard = np.flatnonzero((np.maximum.reduceat(marks, first) > 0) & ~odd)
        # Distinct pieces: with their space, and without it where a text starts.
        lead, turned = np.unique(codes[first], return_inverse=True)
        codes = codes.copy()
        codes[first] = turned + len(entries)
        pieces = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), entries, pa.scalar("", pa.large_string())), entries.take(pa.array(lead))])
        for pattern, cut in CUTS:
            pieces = pc.replace_substring_regex(pieces, pattern, cut)
        cuts = pc.split_pattern(pieces, MARK)
        bounds = np.asarray(cuts.offsets)
        parts = cuts.values.dictionary_encode()
        ids = self._ids_of(parts.dictionary).take(parts.indices)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(_offsets(ids)[bounds].astype(np.int64)), ids.buffers()[2]])
        del ids, cuts, parts, pieces
        out = whole.take(pa.array(codes))
        ends = _offsets(out) // IDS().itemsize
        counts = ends[last + 1] - ends[first]
        flat = _flat(out)
        if len(hard):
            pieces = np.split(flat, ends[first[1:]])
            for k, e in zip(hard.tolist(), self.library.encode_batch_fast(texts.take(pa.array(hard)).to_pylist(), add_special_tokens=False)):
                pieces[k] = np.array(e.ids, IDS)
                counts[k] = len(pieces[k])
            flat = np.concatenate(pieces)
        return flat, counts


def _binary(flat: np.ndarray, sizes: np.ndarray):
    """Arrow binary values of ``sizes`` ids each."""
    import pyarrow as pa

    bounds = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)])


def _offsets(values) -> np.ndarray:
    return np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)


def _flat(values) -> np.ndarray:
    bounds = _offsets(values)
    return np.frombuffer(values.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(IDS) if bounds[-1] > bounds[0] else np.empty(0, IDS)


def terminated(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to each text's ids."""
    after = np.cumsum(counts)
    return np.insert(ids, after, np.uint32(end)), counts + 1


def slices(batches, text: str = "text", most: int = 8 << 20):
    """Record batches of about ``most`` bytes of text each (one row at least): small ones are put
    together, for what they have in common is encoded once, large ones are cut."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        ends = np.cumsum(sizes)
        at, n = 0, len(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + most - size, "right"))
            if to == at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - base)
            if to < n or size >= most:
                yield joined()
                held, size = [], 0
            at = to
    if held:
        yield joined()
