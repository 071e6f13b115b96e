"""Token ids of byte-level vocabularies by way of their words (pre-tokens).

Texts are cut into words by a few array operations over a whole block, following the
splitting pattern of such vocabularies; each distinct word is encoded once per worker
and remembered. Rows with letters beyond the Latin ones are cut by the pattern itself,
and rows with a special string or rare white space are given to the library whole.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

from burstlens.llm import blocks as B

# Words, and bytes of words, that a Python worker remembers. With more it starts
# anew, so its memory stays bounded; results don't depend on it.
CACHE_WORDS = 300_000
CACHE_BYTES = 16 << 20

#: Fixed value: how byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Kinds of characters, and of the bytes that they have.
WHITE, LETTER, NUMBER, OTHER, WIDE = range(5)
#: Characters below this have at most two bytes and are told apart by a table.
LATIN = 0x250


def _kind(code: int) -> int:
    if code < 128 and code in B.WHITE:
        return WHITE
    category = unicodedata.category(chr(code))[0]
    return {"L": LETTER, "N": NUMBER}.get(category, OTHER)


KINDS = np.array([_kind(c) for c in range(LATIN)], np.uint8)
BYTE_KINDS = np.full(256, WIDE, np.uint8)
BYTE_KINDS[:128] = KINDS[:128]
# Of a second byte by itself nothing is known; it takes the kind of its first byte.
BYTE_KINDS[0x80:0xC0] = OTHER


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; the first byte of a character beyond the table is WIDE."""
    kinds = BYTE_KINDS[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 + (LATIN >> 6)))
    lead = lead[lead + 1 < len(data)]
    of_pair = KINDS[((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)]
    kinds[lead] = of_pair
    kinds[lead + 1] = of_pair
    return kinds


def word_offsets(block: B.Block, kinds: np.ndarray) -> np.ndarray:
    """Where words begin, with the end of the block added.

    A run of letters, numbers or other characters is a word, with the blank before it
    if there is one. Of white space before it, all but the last character is a word,
    and the last too unless it is that blank. A quote and the letters of a clipped
    form are a word when no blank belongs to the quote.
    """
    data, n = block.data, len(block.data)
    if not n:
        return np.zeros(1, np.int64)
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    row_start = np.zeros(n + 1, bool)
    row_start[block.first] = True
    change |= row_start[:n]
    s = np.flatnonzero(change)
    e = np.append(s[1:], n)
    kind = kinds[s]
    followed = ~row_start[e]  # by a run of the same row
    last_blank = data[e - 1] == 0x20
    start = change.copy()
    start[s[kind != WHITE]] = True
    white = (kind == WHITE) & followed
    start[e[white] - 1] = True
    blank = np.zeros(len(s), bool)  # a blank before the run belongs to it
    blank[1:] = white[:-1] & last_blank[:-1]
    start[s[blank]] = False
    # Clipped forms: a lone quote, then s, t, m, d, re, ve or ll.
    quote = np.flatnonzero((kind == OTHER) & (e - s == 1) & (data[s] == 0x27) & ~blank & followed)
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        at, stop = s[quote] + 1, e[quote + 1]
        a = data[at]
        b = np.where(stop - at > 1, data[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, list(b"stmd"))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (
            b == ord("l")
        )
        size = np.where(one, 1, np.where(two, 2, 0))
        clipped = size > 0
        start[at[clipped]] = False
        rest = at[clipped] + size[clipped]
        start[rest[rest < stop[clipped]]] = True
    return np.append(np.flatnonzero(start), n)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte value in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others follow from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 0x100 + hidden.index(b)) for b in range(256)}


def slices(values: pa.Array) -> list[bytes]:
    """The values of an Arrow binary array (much faster than one object at a time)."""
    wide = pa.types.is_large_binary(values.type)
    ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)
    ends = ends[values.offset : values.offset + len(values) + 1].tolist()
    if not values.buffers()[2]:
        return [b""] * len(values)
    data = values.buffers()[2].to_pybytes()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _grown(array: np.ndarray, need: int) -> np.ndarray:
    if need <= len(array):
        return array
    return np.concatenate([array, np.zeros(2 * need - len(array), array.dtype)])


class WordStore:
    """Ids of words that are encoded once and remembered."""

    def __init__(self, path: str) -> None:
        # Spark's tasks use the cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            self.config = json.load(f)
        self.special = [t["content"].encode() for t in self.config["added_tokens"]]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of whole texts, without remembering any."""
        encoded = self.library.encode_batch_fast(
            [t.decode("utf-8", "replace") for t in texts], add_special_tokens=False
        )
        return [e.ids for e in encoded]

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def slots(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of words in ``first`` and ``length``, which lead to their ids."""
        if len(self.known) > CACHE_WORDS or self.known_bytes > CACHE_BYTES:
            self._forget()
        known = self.known
        missing = [p for p in dict.fromkeys(distinct) if p not in known]
        if missing:
            # Hundreds of thousands of short-lived objects, none in a cycle.
            collecting = gc.isenabled()
            gc.disable()
            ids, lengths = self._words(missing)
            base, need = len(known), len(known) + len(missing)
            known.update(zip(missing, range(base, need), strict=True))
            self.known_bytes += sum(map(len, missing))
            total = self.used + int(lengths.sum())
            self.first = _grown(self.first, need)
            self.length = _grown(self.length, need)
            self.ids = _grown(self.ids, total)
            self.length[base:need] = lengths
            self.first[base:need] = self.used + np.cumsum(lengths) - lengths
            self.ids[self.used : total] = ids
            self.used = total
            if collecting:
                gc.enable()
        return np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))

    def unusual_rows(self, block: B.Block, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows for the library, and other rows with wide characters, for the pattern."""
        data = block.data
        row = lambda at: np.searchsorted(block.first, at, "right") - 1
        wide = np.unique(row(np.flatnonzero(kinds == WIDE)))
        # U+0085 and U+00A0 are white space; so is 1C-1F to the pattern's library only.
        rare = np.flatnonzero((data >= 0x1C) & (data <= 0x1F))
        pair = np.flatnonzero(data == 0xC2)
        pair = pair[pair + 1 < len(data)]
        pair = pair[np.isin(data[pair + 1], [0x85, 0xA0])]
        hold = set(row(rare).tolist()) | set(row(pair).tolist())
        text = data.tobytes()
        for special in self.special:
            at = text.find(special)
            while at >= 0:
                hold.add(int(row(at)))
                at = text.find(special, at + 1)
        whole = np.array(sorted(hold), np.int64)
        return whole, np.setdiff1d(wide, whole)

class Encoder(WordStore):
    """Token ids of whole texts by the tokenizers library, each distinct word once.

    The library's model is asked for a word at a time, without its own cache.
    """

    def __init__(self, path: str) -> None:
        super().__init__(path)
        model = self.config["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.model = BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        self.split = regex.compile(PATTERN).findall
        self.letters = byte_letters()

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has."""
        tokenize, letters = self.model.tokenize, self.letters
        found = [[t.id for t in tokenize(w.decode("latin-1").translate(letters))] for w in words]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, lengths.sum()), lengths

    def cut(self, block: B.Block):
        """Codes of a block's words, each row's first word, the coded words, rows for the library."""
        kinds = kinds_of(block.data)
        offsets = word_offsets(block, kinds)
        codes, distinct = B.numbered(B.binary_array(block.data, offsets))
        row_first = np.searchsorted(offsets[:-1], block.first)
        words = slices(distinct)
        whole, wide = self.unusual_rows(block, kinds)
        if len(wide):
            number = {w: i for i, w in enumerate(words)}
            parts, sizes = [], np.diff(row_first)
            done = 0
            for r in wide:
                found = [w.encode() for w in self.split(block.text(r).decode("utf-8", "replace"))]
                own = [number.setdefault(w, len(number)) for w in found]
                parts += [codes[done : row_first[r]], np.array(own, codes.dtype)]
                done, sizes[r] = row_first[r + 1], len(own)
            codes = np.concatenate([*parts, codes[done:]])
            row_first = np.concatenate([[0], np.cumsum(sizes)])
            words = list(number)
        return codes, row_first, words, whole

    def ids_of(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows end to end, and where each row's begin (one more at the end)."""
        codes, row_first, words, whole = self.cut(block)
        slots = self.slots(words)[codes]
        lengths = self.length[slots]
        ids = self.ids[B.ranges(self.first[slots], lengths)]
        ends = np.zeros(len(slots) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        first = ends[row_first]
        if not len(whole):
            return ids, first
        own = dict(zip(whole.tolist(), self.encode([block.text(r) for r in whole]), strict=True))
        parts = [
            np.asarray(own[r], np.uint32) if r in own else ids[first[r] : first[r + 1]]
            for r in range(block.rows)
        ]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
