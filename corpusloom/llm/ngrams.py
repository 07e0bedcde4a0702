"""Character n-gram naive Bayes over Arrow batches, vectorised.

The n-grams (1 to 4 characters) of all texts of a batch are hashed at once;
class sums come from one table of log probabilities. Nothing runs per character
in Python, and texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BUCKETS = 1 << 16
_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint64)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters on end, and where each text begins and ends."""
    joined = "".join(texts)
    data = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def gram_ids(data: np.ndarray, orders: Sequence[int] = (2, 3, 4)) -> list[np.ndarray]:
    """Bucket of the n-gram that ends at each character, for each order."""
    x = data.astype(np.uint64)
    out = []
    for n in orders:
        h = np.full(len(x), n, np.uint64) * np.uint64(0x2545F491)
        for k in range(n):
            moved = x if k == 0 else np.concatenate([np.zeros(min(k, len(x)), np.uint64), x[:-k]])[: len(x)]
            h = (h ^ (moved + _PRIMES[k])) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
        out.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return out


def framed(text: str) -> str:
    """A text between blanks: n-grams never reach into the text before, and a begin of text counts as that of a word."""
    return f"    {text} "


def _own(edges: np.ndarray) -> np.ndarray:
    """Which characters of framed texts count: all but the first three blanks of each."""
    out = np.ones(int(edges[-1]), bool)
    out[edges[:-1]] = False
    out[edges[:-1] + 1] = False
    out[edges[:-1] + 2] = False
    return out


class NaiveBayes:
    """log p(bucket | class) for each class; fitted on labelled texts, applied to whole batches."""

    def __init__(self, classes: list[str], table: np.ndarray) -> None:
        self.classes, self.table = classes, table

    @classmethod
    def fit(cls, labelled: dict[str, Sequence[str]], smooth: float = 0.02) -> NaiveBayes:
        classes = sorted(labelled)
        table = np.empty((BUCKETS, len(classes)), np.float32)
        for j, c in enumerate(classes):
            counts = np.full(BUCKETS, smooth)
            data, edges = code_points([framed(t) for t in labelled[c]])
            own = _own(edges)
            for ids in gram_ids(data):
                counts += np.bincount(ids[own], minlength=BUCKETS)
            table[:, j] = np.log(counts / counts.sum())
        return cls(classes, table)

    def sums(self, texts: Sequence[str], step: int = 1 << 18) -> np.ndarray:
        """Log likelihood of each text under each class; texts are taken in runs of about ``step`` characters, so memory doesn't follow the batch."""
        out = np.zeros((len(texts), len(self.classes)))
        a = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > step or i == len(texts) - 1:
                out[a : i + 1] = self._sums(texts[a : i + 1], step)
                a, held = i + 1, 0
        return out

    def _sums(self, texts: Sequence[str], step: int) -> np.ndarray:
        data, edges = code_points([framed(t) for t in texts])
        out = np.zeros((len(texts), len(self.classes)))
        inside = _own(edges)
        owner = np.repeat(np.arange(len(texts)), np.diff(edges))
        for a in range(0, len(data), step):  # a long text in slices, each with the characters before it
            z, lead = min(len(data), a + step), min(a, 3)
            keep = inside[a:z]
            score = sum(self.table[i[lead:][keep]] for i in gram_ids(data[a - lead : z]))
            own = owner[a:z][keep]
            if not len(own):
                continue
            starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
            np.add.at(out, own[starts], np.add.reduceat(score, starts, axis=0))
        return out

    def posteriors(self, texts: Sequence[str], temper: float = 1.0) -> np.ndarray:
        s = self.sums(texts) * temper
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        return p / p.sum(axis=1, keepdims=True)
