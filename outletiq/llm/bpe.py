"""Whole-batch encoding with a public tokenizer file, one library call per new piece.

Both vocabularies split a text into pieces that are encoded independently, so
texts are cut where such a split is certain, the library encodes each distinct
piece once, and the ids are gathered back. A piece starts

* at white space, for word-end vocabularies (``</w>`` suffix, white space dropped);
* at a space or line feed between two non-space characters, for byte-level
  vocabularies: it belongs to the piece on its right;
* at ASCII punctuation after an ASCII letter, for both.

A text that holds ``<|``, the start of special tokens, is one piece.

New pieces of a byte-level vocabulary go to the library as a few long texts, joined
where the same rules make the cut between two of them certain: a call costs more than
the merges of a short piece. Its tokens spell the text's bytes, so their lengths give
each piece's ids; a text whose tokens do not end where its pieces end is encoded piece by piece.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from outletiq.llm.common import ranges

JOINED = 1_000  # pieces in one of the library's texts
CACHE = 250_000  # pieces kept per worker process; beyond it those met only once are forgotten
_LOADED: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The worker's encoder for this file, loaded once per process."""
    if path not in _LOADED:
        _LOADED[path] = BatchEncoder(path)
    return _LOADED[path]


def _bytes(*parts: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for p in parts:
        out[p.start:p.stop] = True
    return out


SPACE = _bytes(range(9, 14), range(32, 33))
LETTER = _bytes(range(65, 91), range(97, 123))
PUNCTUATION = _bytes(range(33, 48), range(58, 65), range(91, 97), range(123, 127))
#: UTF-8 of white space beyond ASCII, by its first bytes: a cut beside one of them is not certain.
WIDE_SPACE = [c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"] + [
    chr(c).encode() for c in range(0x2000, 0x200B)]


def _lone_spaces(buf: np.ndarray) -> np.ndarray:
    """Places of spaces and line feeds with a non-space character on both sides."""
    at = np.flatnonzero((buf == 32) | (buf == 10))
    at = at[(at > 0) & (at < len(buf) - 1)]
    at = at[~SPACE[buf[at - 1]] & ~SPACE[buf[at + 1]]]
    beyond_ascii = (buf[at - 1] > 127) | (buf[at + 1] > 127)
    plain, at = at[~beyond_ascii], at[beyond_ascii]
    wide = np.zeros(len(at), bool)
    for s in WIDE_SPACE:
        n = len(s)
        near = [(at - n, at >= n), (at + 1, at + n < len(buf))]
        for begin, inside in near:
            hit = inside & (buf[np.where(inside, begin, 0)] == s[0])
            for k in range(1, n):
                if hit.any():
                    hit &= buf[np.where(inside, begin + k, 0)] == s[k]
            wide |= hit
    return np.concatenate([plain, at[~wide]])


class BatchEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = bool(self.tokenizer.model.end_of_word_suffix)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.size)]
        self.widths = np.array([0 if "<|" in t else len(t) for t in tokens])  # bytes, in a byte-level vocabulary
        self._forget()
        self._strings: pa.Array | None = None

    def _cuts(self, buf: np.ndarray) -> np.ndarray:
        """The bytes at which a piece surely starts."""
        cut = np.zeros(len(buf), bool)
        cut[1:] = PUNCTUATION[buf[1:]] & LETTER[buf[:-1]]
        if self.by_words:
            cut[1:] |= SPACE[buf[1:]] & ~SPACE[buf[:-1]]
        else:
            cut[_lone_spaces(buf)] = True
        return cut

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.asarray(pc.match_substring(texts, "<|"))
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first, last = int(at[0]), int(at[-1])
        buf, at = np.frombuffer(data or b"", np.uint8)[first:last], at - first
        cut = np.zeros(len(buf), bool)
        if len(buf):
            cut = self._cuts(buf)
            for i in np.flatnonzero(whole).tolist():
                cut[at[i]:at[i + 1]] = False
            cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.append(np.flatnonzero(cut), len(buf))
        flat = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(buf))
        return flat, np.searchsorted(starts, at)

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}  # piece -> its place in the arrays
        self.ids, self.lengths, self.uses = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_one_by_one``, for byte-level vocabularies."""
        data = [p.encode() for p in pieces]
        ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
        special = np.fromiter(("<|" in p for p in pieces), bool, len(pieces))
        first = np.ones(len(pieces), bool)  # of its text
        first[1:] = ~self._cuts(np.frombuffer(b"".join(data), np.uint8))[ends[:-1]] | special[1:] | special[:-1]
        first[::JOINED] = True
        starts = [*np.flatnonzero(first).tolist(), len(pieces)]
        found = self.tokenizer.encode_batch_fast(["".join(pieces[a:b]) for a, b in zip(starts, starts[1:])],
                                                 add_special_tokens=False)
        ids, lengths = [], []
        for a, b, e in zip(starts, starts[1:], found):
            own = np.array(e.ids, self.dtype)
            if b - a == 1:
                n = np.array([len(own)])
            else:
                want, at = ends[a:b] - (ends[a - 1] if a else 0), np.cumsum(self.widths[own])
                place = np.searchsorted(at, want)  # the token that ends where a piece ends
                n = np.diff(place, prepend=-1)
                if not (place < len(at)).all() or (at[place] != want).any() or place[-1] + 1 != len(at):
                    own, n = self._one_by_one(pieces[a:b])
            ids.append(own)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _slots(self, keys: list[str]) -> np.ndarray:
        """Each piece's place in the table of ids; pieces not met before are encoded and added."""
        slots = np.fromiter(map(self.slot.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(slots < 0)
        for a in range(0, len(missing), 20_000):
            new = [keys[i] for i in missing[a:a + 20_000].tolist()]
            ids, lengths = self._one_by_one(new) if self.by_words else self._joined(new)
            base = len(self.lengths)
            self.lengths, self.ids = np.append(self.lengths, lengths), np.append(self.ids, ids)
            slots[missing[a:a + 20_000]] = np.arange(base, base + len(new))
            self.slot.update(zip(new, range(base, base + len(new))))
        self.uses = np.append(self.uses, np.zeros(len(self.lengths) - len(self.uses), np.int64))
        return slots

    def _tidy(self) -> None:
        """Keep the cache within bounds: pieces of earlier batches stay only if met again since."""
        if len(self.slot) <= CACHE and len(self.ids) <= 16 * CACHE:
            return
        keep = self.uses > 1
        if not 0 < keep.sum() <= CACHE // 2 or self.lengths[keep].sum() > 8 * CACHE:
            return self._forget()
        names = [(k, i) for k, i in self.slot.items() if keep[i]]
        at = np.array([i for _, i in names])
        starts = np.cumsum(self.lengths) - self.lengths
        self.ids = self.ids[ranges(starts[at], self.lengths[at])]
        self.lengths, self.uses = self.lengths[at], self.uses[at] // 2
        self.slot = {k: i for i, (k, _) in enumerate(names)}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's offsets into them. Null counts as empty."""
        flat, off = self._pieces(texts)
        if not len(flat):
            return np.zeros(0, self.dtype), np.zeros(len(texts) + 1, np.int64)
        coded = flat.dictionary_encode()
        keys = coded.dictionary
        if self.by_words:  # the vocabulary is lower case and drops spaces: ' The' and 'the' have the same ids
            keys = pc.ascii_ltrim_whitespace(keys)
            plain = pc.and_(pc.string_is_ascii(keys), pc.invert(pc.match_substring(keys, "<|")))
            keys = pc.if_else(plain, pc.ascii_lower(keys), keys)
        slots = self._slots(keys.to_pylist())
        self.uses[slots] += 1
        starts = np.cumsum(self.lengths) - self.lengths
        index = slots[np.asarray(coded.indices)]
        n = self.lengths[index]
        ids = self.ids[ranges(starts[index], n)]
        self._tidy()
        return ids, np.concatenate([[0], np.cumsum(n)])[off]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of ``decode(ids, skip_special_tokens=False)`` for each run of ids."""
        if self.tokenizer.decoder is not None:
            parts = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
            return [s.encode() for s in self.tokenizer.decode_batch(parts, skip_special_tokens=False)]
        if self._strings is None:  # without a decoder the tokens are joined by spaces
            self._strings = pa.array([f"{self.tokenizer.id_to_token(i) or ''} " for i in range(self.size)],
                                     pa.large_string())
        joined = self._strings.take(pa.array(ids))
        at = np.asarray(joined.cast(pa.large_binary()).offsets if hasattr(joined, "offsets")
                        else np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1])
        data = memoryview(joined.buffers()[2] or b"")
        ends = at[offsets]
        return [bytes(data[a:max(a, b - 1)]) for a, b in zip(ends.tolist(), ends[1:].tolist())]
