"""Token ids by the tokenizers library, with a table of known pre-tokens.

A byte-level BPE works on each pre-token by itself, so a text's ids are its pre-tokens' ids put together. Pre-tokens
are found and hashed with array operations; known ones take their ids from a sorted table of bounded size, new ones
go to the library's model, which splits them. Texts with characters outside ASCII and the Latin letters, on which classes or Unicode versions
could differ, go to the library whole, and so do texts that hold an added token of the vocabulary (as <|endoftext|>),
which the library takes out before it looks for pre-tokens: ids are those of its defaults, without special tokens put
around a text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from .kernels import TABLE, prefix, ranges, span

#: Known pre-tokens, about 30 bytes each; a full table starts anew.
ENTRIES = 600_000
RECENT = 40_000
LETTERS, DIGITS, BLANK, OTHER, FOREIGN = range(5)
CLASS = np.full(256, FOREIGN, np.uint8)
CLASS[0x21:0x7F] = OTHER
CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTERS
CLASS[48:58] = DIGITS
CLASS[[0x20, 0x09, 0x0A, 0x0D]] = BLANK


def byte_letters() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones for themselves, the
    others by turn from U+0100."""
    own = np.zeros(256, bool)
    own[33:127] = own[161:173] = own[174:] = True
    return np.where(own, np.arange(256), 255 + np.cumsum(~own)).astype("<u2")


BYTE_LETTERS = byte_letters()


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of plain texts (see foreign()).

    Runs of letters, digits or other signs are pre-tokens, each with a space that precedes it; what is left of a run of
    blanks is one too, and so is a blank other than a space just before a word. An apostrophe that opens a run of signs
    without a space before it goes with s, t, m, d, re, ve or ll after it.
    """
    n = len(data)
    kind = CLASS[data]
    blank = kind == BLANK
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, np.uint8)  # class of the byte before in the same text, FOREIGN at its start
    before[1:] = kind[:-1]
    before[first[:n]] = FOREIGN
    after = np.full(n, FOREIGN, np.uint8)
    after[:-1] = kind[1:]
    after[first[1:]] = FOREIGN
    spaced = np.zeros(n, bool)
    spaced[1:] = data[:-1] == 32
    spaced &= before == BLANK
    out = np.where(blank, (before != BLANK) | (after < FOREIGN) & (after != BLANK), (kind != before) & ~spaced)
    mark = np.flatnonzero((data == 39) & (before != OTHER) & ~spaced & (after == LETTERS))
    if len(mark):
        padded = np.append(data, np.zeros(2, np.uint8))
        kinds = np.append(np.where(first[:n], 100, 0) + kind, [200, 200])
        a, b = padded[mark + 1], padded[mark + 2]
        two = (kinds[mark + 2] == LETTERS) & ((b == 101) & ((a == 114) | (a == 118)) | (a == 108) & (b == 108))
        one = np.isin(a, [115, 116, 109, 100])
        for at, size in ((mark[one], 2), (mark[two & ~one], 3)):
            out[at + 1] = False
            follows = at + size
            follows = follows[kinds[follows] == LETTERS]
            out[follows] = True
    return np.flatnonzero(out)


def foreign(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text needs the library for the whole of it."""
    odd = CLASS[data] == FOREIGN
    odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    return np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) > 0


class Encoder:
    """encode(data, offsets) gives all ids of some texts, one after another, and where each text's ids begin and end."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(vocabulary)
        self.added = [x.content.encode() for x in self.library.get_added_tokens_decoder().values() if x.content]
        # the model alone, with a copy of its own, and no cache: it is asked for new pre-tokens only
        self.model = Tokenizer.from_file(vocabulary).model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)
        split = self.library.pre_tokenizer
        known = isinstance(split, ByteLevel) and not split.add_prefix_space and getattr(split, "use_regex", True)
        #: Whether the vocabulary cuts texts in the way that boundaries() does; otherwise all go to the library whole.
        self.plain = isinstance(self.model, BPE) and known and self.library.normalizer is None
        self.clear()

    def clear(self) -> None:
        self.old, self.new = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def special(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text holds an added token, which no pre-token shows."""
        text, out = data.tobytes(), np.zeros(len(offsets) - 1, bool)
        for token in self.added:
            at = text.find(token)
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                out[k] |= at + len(token) <= offsets[k + 1]
                at = text.find(token, at + 1)
        return out

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x.ids, np.uint32) for x in self.library.encode_batch(texts, add_special_tokens=False)]

    def ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens (in byte letters), one after another, and how many each has."""
        ids, sizes, split = [], [], self.model.tokenize
        for part in parts:
            found = [x.id for x in split(part)]
            ids += found
            sizes.append(len(found))
        return np.asarray(ids, np.uint32), np.asarray(sizes, np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, size, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for table, starts, sizes in (self.old, self.new):
            if len(table):
                at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                hit = table[at] == keys
                known |= hit
                start[hit], size[hit] = starts[at[hit]], sizes[at[hit]]
        return start, size, known

    def learn(self, keys: np.ndarray, parts: list[str]) -> None:
        """keys: sorted."""
        if len(self.old[0]) + len(self.new[0]) + len(keys) > ENTRIES:
            self.clear()
        ids, sizes = self.ids_of(parts)
        starts = np.cumsum(sizes) - sizes
        while self.used + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.used : self.used + len(ids)] = ids
        starts += self.used
        self.used += len(ids)
        self.new = self.merge(self.new, (keys, starts, sizes))
        if len(self.new[0]) > RECENT:
            self.old, self.new = self.merge(self.old, self.new), (keys[:0], starts[:0], sizes[:0])

    @staticmethod
    def merge(x, y):
        at = np.searchsorted(x[0], y[0])
        return tuple(np.insert(a, at, b) for a, b in zip(x, y, strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        strange = foreign(data, offsets) | self.special(data, offsets) | (not self.plain) if len(data) else np.zeros(len(offsets) - 1, bool)
        if strange.any():
            counts, parts = [], []
            for k in range(len(offsets) - 1):
                piece = data[offsets[k] : offsets[k + 1]]
                ids = self.whole([piece.tobytes().decode("utf-8", "replace")])[0] if strange[k] else self.encode(piece, np.asarray([0, len(piece)]))[0]
                parts.append(ids)
                counts.append(len(ids))
            return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = boundaries(data, offsets)
        ends = np.append(starts[1:], len(data))
        keys, first, which = np.unique(span(prefix(TABLE[data]), starts, ends), return_index=True, return_inverse=True)
        begin, size, known = self.find(keys)
        if not known.all():
            text = BYTE_LETTERS[data].tobytes().decode("utf-16-le")
            for _ in range(2):  # a second time if the table was emptied
                fresh = first[~known]
                self.learn(keys[~known], [text[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
                begin, size, known = self.find(keys)
                if known.all():
                    break
        sizes = size[which]
        ids = self.pool[np.repeat(begin[which], sizes) + ranges(sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
