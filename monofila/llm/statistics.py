"""Counts per text, computed for whole batches of bytes with numpy."""

from __future__ import annotations

import numpy as np

from monofila.llm.common import Words, grams, mixed

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_SHOUT = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def per_text(words: Words, flags: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[np.minimum(words.text_ends - 1, len(flags))] - total[words.text_starts]


def per_owner(words: Words, flags: np.ndarray) -> np.ndarray:
    """How many flagged words each text has."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[words.first[1:]] - total[words.first[:-1]]


def lines(text: bytes) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    full = [x for x in text.split(b"\n") if x.strip()]
    return len(full), len(full) - len(set(full))


def repeat_words(words: Words, hashes: np.ndarray, k: int = 3) -> np.ndarray:
    """Words inside ``k``-word windows that their text has twice or more, per text."""
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= k:
        inside = words.owner[k - 1 :] == words.owner[: len(hashes) - k + 1]
        at = np.flatnonzero(inside)
        key = grams(hashes, k)[at] ^ mixed(words.owner[at].astype(np.uint64))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = at[twice[spot] == key]
            for i in range(k):
                covered[hit + i] = True
    return per_owner(words, covered)


def rule_counts(batch: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(batch)
    hashes, data = words.hashes(), words.data
    found = [lines(t) for t in batch]
    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (words.owner[1:] == words.owner[:-1])
    single = words.ends - words.starts == 1
    bar = single & (data[words.starts] == ord("|")) if len(hashes) else single
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    stops = _STOP[data[words.ends - 1]] if len(hashes) else single
    return {
        "n_words": np.diff(words.first),
        "word_chars": per_text(words, words.solid & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(words, _SYMBOL[data]),
        "n_dup_lines": np.array([d for _, d in found], dtype=np.int64),
        "n_repeat_words": repeat_words(words, hashes),
        "n_lines": np.array([n for n, _ in found], dtype=np.int64),
        "n_upper": per_text(words, _UPPER[data]),
        "n_shouts": per_text(words, _SHOUT[data]),
        "n_digits": per_text(words, _DIGIT[data]),
        "n_stutters": per_owner(words, same),
        "n_bars": per_owner(words, bar),
        "n_marked": per_owner(words, symbols[words.ends] > symbols[words.starts]),
        "n_stops": per_owner(words, stops),
    }
