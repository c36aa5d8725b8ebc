"""Statistics of a text that the quality operators score."""

from __future__ import annotations

import numpy as np

#: For each byte value: upper-case ASCII, digits, ends of sentences, rule symbols, other punctuation, white space.
_SETS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?", b"#*$%&|<>", b",;:'\"()-/", b"\t\n\x0b\x0c\r ")
_MASKS = np.zeros((len(_SETS) + 2, 256))
for _k, _set in enumerate(_SETS):
    _MASKS[_k, list(_set)] = 1
_MASKS[-2, ord("!")] = 1
_MASKS[-1, 0x80:0xC0] = 1  # bytes that continue a character

#: Order of the features in features(); the first four are the base counts, scaled.
NAMES = ("word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "stop_rate", "punct_rate", "bang_rate", "distinct_rate", "top_word_rate", "adjacent_rate", "log_words", "short_line_rate")


def _ranked(ids: np.ndarray, step: int) -> np.ndarray:
    """Ranks of pairs (ids[i], ids[i + step]): equal for equal pairs only."""
    return np.unique(ids[:-step] * (ids.max() + 1) + ids[step:], return_inverse=True)[1]


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """How many words stand in a window of 8 words that the text holds twice or more. ids: equal for equal words only."""
    n, width = len(ids), 1
    while width < window:
        if n - 2 * width + 1 < 2:
            return 0
        ids = _ranked(ids, width)
        width *= 2
        if ids.max() + 1 == len(ids):  # no two are equal, so no longer ones are
            return 0
    many = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(many), 1)
    np.add.at(edge, np.flatnonzero(many) + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features by NAMES, of UTF-8 bytes."""
    words = text.split()
    n = len(words)
    of = _MASKS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(len(text) - of[-1] - of[5])
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    place = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, n)
    repeat = repeated_words(ids) if n else 0
    w, c = max(n, 1), max(chars, 1)
    top = int(np.bincount(ids).max()) if n else 0
    adjacent = int((ids[1:] == ids[:-1]).sum())
    short = sum(len(x) < 20 for x in lines)
    rates = [chars / w, of[3] / c, dup / max(len(lines), 1), repeat / w, of[0] / c, of[1] / c, of[2] / w, of[4] / w, of[-2] / w, len(place) / w**0.7, top / w, adjacent / w, np.log1p(n), short / max(len(lines), 1)]
    return [n, chars, int(of[3]), dup, repeat], [float(x) for x in rates]
