"""Words of a batch of texts as numpy arrays of 64-bit hashes.

Words are maximal runs of ASCII letters and digits and of all non-ASCII
characters, in lower case.  A word's hash is a polynomial over its UTF-8
bytes modulo 2**64, finished by a mixing step; equal words have equal hashes
in every process.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
_IS_WORD[128:] = True
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        size = max(n, 2 * len(_POWERS), 256)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of ``texts``: ``hashes``, ``bounds`` (word range of text i is
    ``bounds[i]:bounds[i+1]``) and, on request, the bytes behind them."""

    def __init__(self, texts: list[str]):
        parts = [t.lower().encode("utf-8", "replace") for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        inside = _IS_WORD[raw]
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        stops = np.flatnonzero(edge == -1)                # the closing line feed ends the last word
        self.sizes = stops - self.starts
        at = np.flatnonzero(inside).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes   # of each word among the word bytes
        self.position = np.arange(len(at), dtype=at.dtype) - np.repeat(self.first.astype(at.dtype), self.sizes)
        self.letters = raw[at]
        if len(at):
            terms = (self.letters.astype(np.uint64) + np.uint64(1)) * _powers(int(self.position.max()) + 1)[self.position]
            self.sums = np.cumsum(terms)                  # modulo 2**64
            before = np.concatenate([np.zeros(1, np.uint64), self.sums])[self.first]
            self.hashes = mix(self.sums[self.first + self.sizes - 1] - before)
        else:
            self.sums = self.hashes = np.empty(0, np.uint64)
        self.bounds = np.concatenate([[0], np.searchsorted(self.starts, ends)]) if texts else np.zeros(1, np.int64)

    def beginnings(self, which: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the beginnings (1 to ``longest`` bytes) of the chosen
        words, flat, and how many each word has.  A whole word is its own
        last beginning if it is no longer than that."""
        n = np.minimum(self.sizes[which], longest)
        step = np.cumsum(n) - n
        first = np.repeat(self.first[which], n)
        at = first + np.arange(int(n.sum())) - np.repeat(step, n)
        before = np.where(first > 0, self.sums[np.maximum(first - 1, 0)], np.uint64(0)) if len(at) else at.astype(np.uint64)
        return mix(self.sums[at] - before), n

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)
