"""Byte-pair encoding and decoding for vocabularies whose words have an end mark.

Texts are lower-cased and cut into words (runs of letters, single digits, runs of other
characters, clipped forms). A word not met before by the worker is merged here: its
parts and the ranks of adjacent parts are kept as contiguous arrays, the least rank is
found by scanning, the boundary there is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. Words of the same length take each step together.
Very long words delete all boundaries of the least rank at once, which is the same,
since a merged part only takes part in later ranks.

Rows with letters beyond the Latin ones are normalised and cut by the tokenizers
library; rows with a special string are encoded by it whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from burstlens.llm import blocks as B
from burstlens.llm.places import added, prepare
from burstlens.llm.pretokens import (
    KINDS,
    LATIN,
    LETTER,
    NUMBER,
    OTHER,
    WHITE,
    WordStore,
    byte_letters,
    kinds_of,
    slices,
)

# Longer words are merged one at a time.
SHORT_WORD = 64
_NEVER = np.iinfo(np.int32).max


def _lower_table() -> np.ndarray:
    """Lower-case code points below LATIN; 0 where the result is not such a one."""
    low = [chr(c).lower() for c in range(LATIN)]
    return np.array([ord(x) if len(x) == 1 and ord(x) < LATIN else 0 for x in low], np.int64)


LOWER_LATIN = _lower_table()


def lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of Latin text in lower case, and places of letters this can't be told for."""
    out = B.LOWER[data]
    lead = np.flatnonzero((data >= 0xC2) & (data < 0xC0 + (LATIN >> 6)))
    lead = lead[lead + 1 < len(data)]
    code = ((data[lead].astype(np.int64) & 31) << 6) | (data[lead + 1] & 63)
    low = LOWER_LATIN[code]
    unknown = lead[low == 0]
    low = np.where(low == 0, code, low)
    out[lead] = 0xC0 | (low >> 6)
    out[lead + 1] = 0x80 | (low & 63)
    return out, unknown


def word_spans(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-case Latin rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = kinds_of(data)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:])
    # Every number character is a word.
    start |= (kinds == NUMBER) & ((data & 0xC0) != 0x80)
    row_start = np.zeros(n + 1, bool)
    row_start[first] = True
    start |= row_start[:n]
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    kind = kinds[s]
    # Clipped forms: a lone quote, then s, t, m, d, re, ve or ll.
    quote = np.flatnonzero((kind == OTHER) & (e - s == 1) & (data[s] == 0x27) & ~row_start[e])
    quote = quote[kind[np.minimum(quote + 1, len(kind) - 1)] == LETTER]
    if len(quote):
        at, stop = e[quote], e[quote + 1]
        a = data[at]
        b = np.where(stop - at > 1, data[np.minimum(at + 1, n - 1)], 0)
        one = np.isin(a, list(b"stmd"))
        two = (np.isin(a, list(b"rv")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        clipped = size > 0
        start[at[clipped]] = False
        rest = at[clipped] + size[clipped]
        start[rest[rest < stop[clipped]]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        kind = kinds[s]
    kept = kind != WHITE
    return s[kept], e[kept]


class WordBPE(WordStore):
    """Encodes and decodes as the vocabulary's library does."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        model = self.config["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = (left << 32) | right
        # Of a pair that is listed twice the last rank counts.
        by = np.argsort(keys, kind="stable")
        last = np.append(keys[by][1:] != keys[by][:-1], True)
        self.keys, self.ranks = keys[by][last], by[last].astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.letters = byte_letters()
        self.values = {ch: b for b, ch in self.letters.items()}
        self.inner = np.array([vocab[self.letters[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[self.letters[b] + mark] for b in range(256)], np.int32)
        names = vocab | {t["content"]: t["id"] for t in self.config["added_tokens"]}
        self.names = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name.encode()
        self.decimals = [str(i).encode() for i in range(len(self.names))]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def _merge_short(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of words with as many parts each; how many are left of each word."""
        rows, width = parts.shape
        n = np.full(rows, width)
        ranks = np.full((rows, width), _NEVER, np.int32)
        ranks[:, :-1] = self._rank(parts[:, :-1], parts[:, 1:])
        columns = np.arange(width)
        active = np.arange(rows)
        for _ in range(width - 1):
            own = ranks[active]
            at = own.argmin(axis=1)
            least = own[np.arange(len(active)), at]
            going = least < _NEVER
            active, own, at, least = active[going], own[going], at[going], least[going]
            if not len(active):
                break
            line = np.arange(len(active))
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            kept = np.take_along_axis(parts[active], moved, axis=1)
            kept[line, at] = self.merged[least]
            # The ranks behind the boundary move up; those beside the new part are new.
            moved = np.minimum(columns + (columns >= at[:, None]), width - 1)
            own = np.take_along_axis(own, moved, axis=1)
            n[active] -= 1
            last = n[active] - 1
            has_right = at < last
            own[line, at] = _NEVER
            k = np.flatnonzero(has_right)
            own[k, at[k]] = self._rank(kept[k, at[k]], kept[k, at[k] + 1])
            k = np.flatnonzero(at > 0)
            own[k, at[k] - 1] = self._rank(kept[k, at[k] - 1], kept[k, at[k]])
            own[line, last] = _NEVER
            parts[active], ranks[active] = kept, own
        return parts, n

    def _merge_long(self, parts: np.ndarray) -> np.ndarray:
        while len(parts) > 1:
            ranks = self._rank(parts[:-1], parts[1:])
            least = ranks.min()
            if least == _NEVER:
                break
            at = np.flatnonzero(ranks == least)
            # Of pairs that overlap, every other one, from the left.
            head = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            run = np.repeat(at[head], np.diff(np.append(head, len(at))))
            at = at[(at - run) % 2 == 0]
            parts[at] = self.merged[least]
            parts = np.delete(parts, at + 1)
        return parts

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[data]
        symbols[first + sizes - 1] = self.final[data[first + sizes - 1]]
        lengths = np.zeros(len(words), np.int64)
        keep = np.zeros(len(data), bool)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            at = first[own][:, None] + np.arange(size)
            if size > SHORT_WORD:
                for i, places in zip(own, at, strict=True):
                    parts = self._merge_long(symbols[places])
                    lengths[i] = len(parts)
                    symbols[places[: len(parts)]] = parts
            else:
                parts, n = self._merge_short(symbols[at])
                symbols[at], lengths[own] = parts, n
        keep[B.ranges(first, lengths)] = True
        return symbols[keep].astype(np.uint32), lengths

    def _odd_words(self, text: bytes) -> list[bytes]:
        """Words of a text as the library normalises and cuts it."""
        normal = self.library.normalizer.normalize_str(text.decode("utf-8", "replace"))
        found = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(self.values[ch] for ch in word) for word, _ in found]

    def ids_of(self, block: B.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's rows end to end, and where each row's begin (one more at the end)."""
        whole, wide = self.unusual_rows(block, kinds_of(block.data))
        data, unknown = lowered(block.data)
        more = np.searchsorted(block.first, unknown, "right") - 1
        wide = np.setdiff1d(np.union1d(wide, more), whole)
        starts, ends = word_spans(data, block.first)
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        codes, distinct = B.numbered(B.binary_array(data[B.ranges(starts, sizes)], offsets))
        slots = self.slots(slices(distinct))[codes]
        lengths = self.length[slots]
        ids = self.ids[B.ranges(self.first[slots], lengths)]
        token_first = np.concatenate([[0], np.cumsum(lengths)])
        first = token_first[np.searchsorted(starts, block.first)]
        if not len(whole) and not len(wide):
            return ids, first
        own = dict(zip(whole.tolist(), self.encode([block.text(r) for r in whole]), strict=True))
        for r in wide.tolist():
            odd = self.slots(self._odd_words(block.text(r)))
            own[r] = self.ids[B.ranges(self.first[odd], self.length[odd])]
        parts = [
            np.asarray(own[r], np.uint32) if r in own else ids[first[r] : first[r + 1]]
            for r in range(block.rows)
        ]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: list[int]) -> bytes:
        """The names of the ids with blanks between: the vocabulary has no decoder."""
        names = self.names
        return b" ".join([names[i] for i in ids])


def _store(path: str | None):
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return lambda: B.worker_cache("word_bpe", path, lambda: WordBPE(path))


def encode_texts(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int), the token ids of each whole text.

    A null or empty text has no ids. No special tokens are added; special strings in a
    text are special tokens, as is the library's default. A column ``ids`` is replaced.
    """
    store = _store(tokenizer)
    prepare(docs.sparkSession)
    plain, schema = added(docs, {"ids": "array<int>"})

    def encode(batches):
        for block in B.blocks(batches, text):
            ids, first = store().ids_of(block)
            lists = pa.ListArray.from_arrays(
                pa.array(first, pa.int32()), pa.array(ids.astype(np.int32))
            )
            names = [*block.batch.schema.names, "ids"]
            yield pa.RecordBatch.from_arrays([*block.batch.columns, lists], names)

    return plain.mapInArrow(encode, schema)


def decode_ids(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (string) to rows with token ids; null ids give an empty string."""
    store = _store(tokenizer)
    prepare(encoded.sparkSession)
    plain, schema = added(encoded, {"decoded": "string"})

    def decode(batches):
        for batch in batches:
            column = batch.column(ids).to_pylist()
            texts = [store().decode(own or []).decode("utf-8", "replace") for own in column]
            names = [*batch.schema.names, "decoded"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return plain.mapInArrow(decode, schema)


def roundtrip_digests(
    docs: DataFrame, tokenizer: str | None = None, text: str = "text"
) -> DataFrame:
    """Encodes whole texts, decodes the ids, and adds digests instead of both.

    ``n_tokens`` (long); ``ids_sha256``, of the decimal ids with a blank between;
    ``decoded_sha256``, of the decoded text in UTF-8. Columns of these names are replaced.
    """
    store = _store(tokenizer)
    prepare(docs.sparkSession)
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    plain, schema = added(docs, new)

    def digest(batches):
        for block in B.blocks(batches, text):
            bpe = store()
            ids, first = bpe.ids_of(block)
            decimals, bounds = bpe.decimals, first.tolist()
            of_ids, of_text = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = ids[a:b].tolist()
                of_ids.append(hashlib.sha256(b" ".join([decimals[i] for i in own])).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            columns = [*block.batch.columns, pa.array(np.diff(first)), pa.array(of_ids), pa.array(of_text)]
            yield pa.RecordBatch.from_arrays(columns, [*block.batch.schema.names, *new])

    return plain.mapInArrow(digest, schema)
