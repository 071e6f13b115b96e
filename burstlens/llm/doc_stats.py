"""Statistics of whole documents, computed for many documents at once."""

from __future__ import annotations

import numpy as np

from burstlens.llm import blocks as B

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the quality model, and the direction that a feature may only push its
#: score in (-1: never up, 0: either way).
FEATURES = {
    "log_words": 0,
    "chars_per_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "bangs_per_word": -1,
    "pipes_per_word": -1,
    "distinct_share": 0,
    "words_per_line": 0,
}


def _of(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_IS_SYMBOL = _of(SYMBOLS)
_IS_UPPER = _of(bytes(range(ord("A"), ord("Z") + 1)))
_IS_LETTER = _of(bytes(range(ord("a"), ord("z") + 1))) | _IS_UPPER
_IS_DIGIT = _of(b"0123456789")


def _distinct(row: np.ndarray, code: np.ndarray, rows: int) -> np.ndarray:
    """Distinct codes in each row."""
    if not len(code):
        return np.zeros(rows, np.int64)
    width = int(code.max()) + 1
    return np.bincount(np.unique(row * width + code) // width, minlength=rows)


def _duplicate_lines(block: B.Block, inside: np.ndarray):
    """Lines per row, and lines with a word that equal an earlier line of their row."""
    data = block.data
    breaks = np.flatnonzero(data == ord("\n"))
    starts = np.sort(np.concatenate([block.first[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, block.first[1:]]))
    n_lines = np.diff(np.searchsorted(breaks, block.first)) + 1
    row = np.repeat(np.arange(block.rows), n_lines)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    code, _ = B.numbered(B.binary_array(data[data != ord("\n")], offsets))
    seen = np.concatenate([[0], np.cumsum(inside)])
    worded = seen[ends] > seen[starts]
    row, code = row[worded], code[worded].astype(np.int64)
    n = np.bincount(row, minlength=block.rows)
    return n_lines, n - _distinct(row, code, block.rows)


def _repeated_words(row_first: np.ndarray, code: np.ndarray, n_codes: int) -> np.ndarray:
    """Words of each row in three-word windows that the row has twice or more."""
    n_words = np.diff(row_first)
    n_windows = np.maximum(n_words - 2, 0)
    at = B.ranges(row_first[:-1], n_windows)
    if not len(at):
        return np.zeros(len(n_words), np.int64)
    row = np.repeat(np.arange(len(n_words)), n_windows)
    code = code.astype(np.int64)
    key = code[at] * n_codes + code[at + 1]
    if n_codes >= 1 << 20:  # three codes would not fit 63 bits
        key = np.unique(key, return_inverse=True)[1]
    key = key * n_codes + code[at + 2]
    by = np.argsort(key, kind="stable")  # equal windows of a row stay together
    same = (key[by[1:]] == key[by[:-1]]) & (row[by[1:]] == row[by[:-1]])
    twice = np.zeros(len(at), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    covered = np.zeros(len(code), bool)
    for shift in range(3):
        covered[at[twice] + shift] = True
    return B.summed(covered, row_first)


def document_stats(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """``COUNTS`` (long) and ``FEATURES`` (double) of each row, a column each."""
    data, first = block.data, block.first
    inside = B.NOT_WHITE[data]
    starts, ends, code, known = B.words(block, B.NOT_WHITE)
    row_first = np.searchsorted(starts, first)
    n_words = np.diff(row_first)
    word_chars = B.summed(inside & ((data & 0xC0) != 0x80), first)
    n_symbols = B.summed(_IS_SYMBOL[data], first)
    n_lines, n_dup_lines = _duplicate_lines(block, inside)
    n_repeat = _repeated_words(row_first, code, len(known))
    counts = np.stack([n_words, word_chars, n_symbols, n_dup_lines, n_repeat], axis=1)
    words, row = np.maximum(n_words, 1), np.repeat(np.arange(block.rows), n_words)
    features = np.stack(
        [
            np.log1p(n_words),
            word_chars / words,
            n_symbols / words,
            n_dup_lines / n_lines,
            n_repeat / words,
            B.summed(_IS_UPPER[data], first) / np.maximum(B.summed(_IS_LETTER[data], first), 1),
            B.summed(_IS_DIGIT[data], first) / np.maximum(word_chars, 1),
            B.summed(data == ord("!"), first) / words,
            B.summed(data == ord("|"), first) / words,
            _distinct(row, code.astype(np.int64), block.rows) / words,
            n_words / n_lines,
        ],
        axis=1,
    )
    return counts, features
