"""Problem 7: encoding a whole corpus with a public byte-level BPE.

Method: prefix-sharing trie traversal. The distinct words of a batch are the
leaves of a trie; walking it depth first, each node gets the last token of the
encoding of its prefix. That token is the one vocabulary entry that ends the
prefix and stands beside the last token of the rest without BPE wanting to
merge across the seam, so a prefix shared by many words is encoded once. The
walk is kept as a stack over the sorted words: the stack is cut back to what
two neighbours have in common, which visits the trie's nodes in order without
storing them.

No shuffle: each Arrow batch is encoded where it lies, and what a worker has
learnt about words it keeps for its next batches, up to a bound of memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public tokenizers lie; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: The pre-tokenizer's pattern, a fixed value of this tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters that one pass over a text takes, and words that a worker remembers.
SLICE, REMEMBERED = 1 << 20, 400_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes as themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words with the vocabulary and merges of ``source``, the text of a tokenizer's JSON file."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)["model"]
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.split = {i: (i, i) for i in self.ids.values()}
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = (raw(s) for s in (merge if isinstance(merge, list) else merge.split(" ")))
            pair, whole = (self.ids[left], self.ids[right]), self.ids[left + right]
            self.joined[pair] = whole
            self.split[whole] = pair
        self.size = {i: len(b) for b, i in self.ids.items()}
        lengths: dict[bytes, set[int]] = {}
        for b in self.ids:
            lengths.setdefault(b[-2:], set()).add(len(b))
        #: By the last two bytes of a prefix, the lengths of the tokens that end so, longest first.
        self.lengths = {k: sorted(v | {1}, reverse=True) for k, v in lengths.items()}
        self.seams: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.words = regex.compile(PATTERN)

    def _stays(self, left: int, right: int) -> bool:
        """Whether BPE leaves the seam between two tokens alone: undo the merges beside it, latest first, looking for an earlier one across it."""
        joined, split = self.joined, self.split
        before = len(split) + 1  # a merge across the seam counts if it is earlier than this
        while True:
            across = joined.get((left, right))
            if across is not None and across < before:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    inner = split[left][1]
                    if inner != left:
                        before, left = left, inner
                        break
                else:
                    inner = split[right][0]
                    if inner != right:
                        before, right = right + 1, inner
                        break
                undo_left = not undo_left
            else:
                return True

    def learn(self, words: Iterable[str]) -> None:
        """Walk the trie of ``words`` and remember the encoding of each."""
        ids, lengths, seams, size = self.ids, self.lengths, self.seams, self.size
        last: list[int] = [-1]
        previous = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(raw), len(previous))
            while shared < most and raw[shared] == previous[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                for n in lengths.get(raw[max(0, end - 2) : end], (1,)):
                    if n > end:
                        continue
                    token = ids.get(raw[end - n : end])
                    if token is None:
                        continue
                    if n == end:
                        break
                    seam = (last[end - n], token)
                    ok = seams.get(seam)
                    if ok is None:
                        ok = seams[seam] = self._stays(*seam)
                    if ok:
                        break
                last.append(token)
            out, at = [], len(raw)
            while at:
                out.append(last[at])
                at -= size[last[at]]
            out.reverse()
            self.known[word] = tuple(out)
            previous = raw

    def _slices(self, text: str) -> Iterator[str]:
        """Pieces of a long text, cut where white space follows something else: there the pattern always begins a new word."""
        start = 0
        while len(text) - start > SLICE:
            cut = start + SLICE
            while cut < len(text) and (text[cut - 1].isspace() or not text[cut].isspace()):
                cut += 1
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of ``texts``, as an Arrow list array holds them; null and empty texts have no ids."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.seams.clear()
        offsets, parts, total = [0], [], 0
        for group in self._groups(texts):
            words = [[w for part in self._slices(t) for w in self.words.findall(part)] if t else [] for t in group]
            self.learn(set(chain.from_iterable(words)).difference(self.known))
            parts.append(np.fromiter(chain.from_iterable(map(self.known.__getitem__, chain.from_iterable(words))), dtype=np.int32))
            for own in words:
                total += sum(map(len, map(self.known.__getitem__, own)))
                offsets.append(total)
        return np.array(offsets, dtype=np.int32), np.concatenate(parts) if parts else np.empty(0, np.int32)

    @staticmethod
    def _groups(texts: Sequence[str | None]) -> Iterator[Sequence[str | None]]:
        """Runs of texts of about SLICE characters: one walk of the trie for each."""
        start = held = 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held > SLICE:
                yield texts[start : i + 1]
                start, held = i + 1, 0
        yield texts[start:]


@cache
def encoder(source: str) -> TrieEncoder:
    """One encoder per worker and vocabulary."""
    return TrieEncoder(source)


def read_vocabulary(path: str = VOCABULARY) -> str:
    """The vocabulary's text; of fixed size (1.6 MB), read once by the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and the token ids of ``text``, one row for each row of ``df``, without special tokens.

    Null and empty texts have an empty list. Rows that repeat are encoded each
    on their own; other columns, also ones named like ``into``, are left out.
    An empty table gives an empty table. Texts of any length are encoded whole.
    """
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for b in batches:
            offsets, ids = e.encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, into])

    schema = T.StructType([df.schema[key], T.StructField(into, T.ArrayType(T.IntegerType()), True)])
    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keys: Sequence[str], text: str = "text", into: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keys`` and the number of tokens of ``text`` for each row of ``df``; null and empty texts have 0."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for b in batches:
            offsets, _ = e.encode(b.column(len(names)).to_pylist())
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), n], names=[*names, into])

    schema = T.StructType([*(df.schema[k] for k in names), T.StructField(into, T.LongType(), True)])
    return df.select(*names, text).mapInArrow(run, schema)
