"""Word and hash helpers shared by the text operators (Python side, vectorised with numpy)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_RUN = re.compile(r"[^\W_]+")
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c))) + "]+")
_FULL_CACHE = 1 << 20


def fold(text: str) -> str:
    """Compatibility decomposition without combining accents, in lower case."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the folded text; none for null."""
    return _RUN.findall(fold(text)) if text else []


class WordHasher(dict):
    """64-bit hashes of words, the same in every process, remembered for words met before."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h

    def __call__(self, ws: list[str]) -> np.ndarray:
        if len(self) > _FULL_CACHE:
            self.clear()
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the runs of ``n`` consecutive words; empty when there are fewer words."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = np.zeros(k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + k] + np.uint64(i + 1))
    return np.unique(acc)
