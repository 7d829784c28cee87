"""Features of a text that need no vocabulary: which kinds of bytes follow which, words and lines.

Null and empty texts have all features 0.
"""

from __future__ import annotations

import numpy as np

#: Kinds of bytes; bytes of no kind here are of a kind of their own, as are those of non-ASCII characters.
KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!", "|", "#$%&*", "'\"()[]{}", "/\\<>=_+-~^`@?"]
N = len(KINDS) + 2
SIZE = N * N + 9


def _table() -> np.ndarray:
    table = np.full(256, N - 2, np.int64)
    table[128:] = N - 1
    for i, chars in enumerate(KINDS):
        table[list(chars.encode())] = i
    return table


_KIND = _table()


def surface(text: str | None) -> np.ndarray:
    """``SIZE`` numbers of about the same scale, the square roots of shares mostly."""
    out = np.zeros(SIZE, np.float32)
    data = (text or "").encode()
    if not data:
        return out
    kind = _KIND[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kind[:-1] * N + kind[1:], minlength=N * N)
    out[: N * N] = np.sqrt(pairs / len(data))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    if words:
        sizes = [len(w) for w in words]
        different = len(set(words)) / len(words)
        out[N * N :] = (
            np.log1p(len(words)) / 8,
            sum(sizes) / len(sizes) / 10,
            min(max(sizes), 100) / 50,
            different,
            different * np.log1p(len(words)) / 8,
            len(set(lines)) / len(lines),
            1 - sum(map(len, set(lines))) / sum(map(len, lines)),
            np.log1p(len(lines)) / 5,
            np.log1p(len(data) / len(lines)) / 8,
        )
    return out
