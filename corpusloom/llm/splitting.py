"""Problem 4: splitting oversized items at natural boundaries.

Method: byte ranges. The text bytes are scanned in ranges of fixed size, each
with a halo of the bytes before and after it, so that characters and boundaries
that lie across an edge are seen by exactly one range. Each range yields a
table of boundaries; the tables are stitched together, prefix sums turn counts
within ranges into counts from the start of the item, and pieces are emitted by
offset. For tables the bytes are those of an Arrow batch, whatever texts lie in
it (``measure``), and pieces are cut from the stitched table of a text's own
bytes (``pieces``); for giant files each range is a task of its own and no worker loads a whole file
(``file_pieces``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.plans.materialize import materialize

#: Bytes of a range within a batch, and of its halo: no character or boundary mark is longer.
RANGE, HALO = 1 << 20, 16


@dataclass(frozen=True)
class Limits:
    """Most tokens (by the estimate max(1, round(1.3 x words)), halves to even) and code points of an item."""

    tokens: int
    chars: int

    @property
    def words(self) -> int:
        """Most words within the tokens."""
        n = int(self.tokens / 1.3) + 2
        while round(1.3 * n) > self.tokens:
            n -= 1
        return n


CHILD, PARENT = Limits(512, 4000), Limits(2048, 16000)
OVERLAP_WORDS, OVERLAP_CHARS = 40, 60

#: Ends of sentences, and signs that may follow them before the blank.
_ENDS, _CLOSERS = ".!?…。！？", "\"'”’»)]”』」"
SENTENCE, LINE, PARAGRAPH = 1, 2, 3


def blank_mask(b: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space characters; the characters are those of Python's str.isspace."""
    m = (b == 32) | ((b >= 9) & (b <= 13)) | ((b >= 28) & (b <= 31))
    n = len(b)
    if n >= 2:
        two = (b[:-1] == 0xC2) & ((b[1:] == 0x85) | (b[1:] == 0xA0))
        m[:-1] |= two
        m[1:] |= two
    if n >= 3:
        x, y, z = b[:-2], b[1:-1], b[2:]
        three = (x == 0xE2) & (((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((y == 0x81) & (z == 0x9F)))
        three |= (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
        m[:-2] |= three
        m[1:-1] |= three
        m[2:] |= three
    return m


def range_counts(data: np.ndarray, edges: np.ndarray, step: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """For texts that lie one after another in ``data`` between ``edges``: words and code points of each.

    Ranges are scanned on their own, with halos; what a range counts before
    each edge, plus the prefix sum over the ranges before it, are the counts
    from the start of the data.
    """
    words, chars = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64)
    w = c = 0
    first, last = (int(edges[0]), int(edges[-1])) if len(edges) else (0, 0)
    starts = np.unique(edges)
    for lo in range(first, last, step):
        hi = min(last, lo + step)
        left = max(first, lo - HALO)
        b = data[left : min(last, hi + HALO)]
        blank = blank_mask(b)
        before = np.empty_like(blank)
        before[1:] = blank[:-1]
        before[:1] = True
        at = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)] - left
        before[at] = True  # a text begins here
        own = slice(lo - left, hi - left)
        begins = ~blank[own] & before[own] & ((b[own] & 0xC0) != 0x80)
        sums_w = np.concatenate([[0], np.cumsum(begins)])
        sums_c = np.concatenate([[0], np.cumsum((b[own] & 0xC0) != 0x80)])
        a, z = np.searchsorted(edges, lo), np.searchsorted(edges, hi, side="right")
        words[a:z] = w + sums_w[edges[a:z] - lo]
        chars[a:z] = c + sums_c[edges[a:z] - lo]
        w += int(sums_w[-1])
        c += int(sums_c[-1])
    return np.diff(words), np.diff(chars)


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without copying the text."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    edges = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), edges


def sizes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Estimated tokens and code points of each text; 0 code points and 1 token for null and empty ones."""
    words, chars = range_counts(*_buffers(column))
    return np.maximum(1, np.rint(words * 1.3)).astype(np.int64), chars


def measure(df: DataFrame, key: str, text: str, is_parent: str, child: Limits = CHILD, parent: Limits = PARENT) -> DataFrame:
    """key, is_parent, est_tokens, n_chars and oversize for each row of ``df``.

    Null texts measure as empty ones and are never oversize; a null level counts
    as child. Repeated rows repeat; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, chars = sizes(b.column(2))
            up = np.array(b.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            over = (tokens > np.where(up, parent.tokens, child.tokens)) | (chars > np.where(up, parent.chars, child.chars))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens), pa.array(chars), pa.array(over)], names=[key, is_parent, "est_tokens", "n_chars", "oversize"])

    schema = T.StructType([df.schema[key], df.schema[is_parent], T.StructField("est_tokens", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("oversize", T.BooleanType())])
    return df.select(key, is_parent, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Table:
    """Boundaries of a text: its code points ``n``, starts and ends of its words, what ends after each word (0 nothing, else SENTENCE, LINE or PARAGRAPH), and the number of each word by white space."""

    n: int
    starts: np.ndarray
    ends: np.ndarray
    level: np.ndarray
    number: np.ndarray


_codes = lambda s: np.array([ord(c) for c in s], np.uint32)
_BLANK_CODES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_TIGHT_CODES, _END_CODES, _CLOSER_CODES = _codes("。！？"), _codes(_ENDS), _codes(_CLOSERS)
#: Code points of a halo: an end may have three signs after it, and an edge is told from its neighbours.
_AROUND = 5


def _decoded(b: np.ndarray) -> np.ndarray:
    return np.frombuffer(b.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _range_edges(b: np.ndarray, lo: int, hi: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Boundary table of the bytes from ``lo`` to ``hi`` (starts of characters), read with a halo on both sides.

    Code points and line ends of the range; and for each edge between a blank
    and a word, or two words, the code point it lies before, whether blanks
    follow, whether a sentence ends there, and the line ends before it.
    """
    left, right = b[max(0, lo - 4 * _AROUND) : lo], b[hi : hi + 4 * _AROUND]
    left = left[next((i for i in range(min(4, len(left))) if left[i] & 0xC0 != 0x80), 0) :]
    whole = np.flatnonzero((right & 0xC0) != 0x80)
    right = right[: whole[-1]] if len(whole) and hi + 4 * _AROUND < len(b) else right
    before, own, after = _decoded(left), _decoded(b[lo:hi]), _decoded(right)
    data, lead = np.concatenate([before, own, after]), len(before)
    blank = np.isin(data, _BLANK_CODES)
    tight = np.isin(data, _TIGHT_CODES)
    tight[1:] |= np.isin(data[1:], _CLOSER_CODES) & tight[:-1]
    edge = np.ones(len(data), bool)
    edge[1:] = (blank[1:] != blank[:-1]) | (tight[:-1] & ~tight[1:])
    edge[0] = lo == 0 or edge[0] and not lead
    at = np.flatnonzero(edge[lead : lead + len(own)]) + lead
    # The sign that ends what lies before an edge, behind at most three closing ones of the same word.
    last = at - 1
    since = np.maximum.accumulate(np.where(edge, np.arange(len(data)), -_AROUND))
    for _ in range(3):
        here = np.maximum(last, 0)
        last = np.where((last > 0) & np.isin(data[here], _CLOSER_CODES) & (last > since[np.maximum(at - 1, 0)]), last - 1, last)
    ends = (at > 0) & np.isin(data[np.maximum(last, 0)], _END_CODES)
    lines = np.concatenate([[0], np.cumsum(own == 10)])
    return len(own), int(lines[-1]), at - lead, blank[at], ends, lines[at - lead]


def boundary_table(data: np.ndarray, step: int = RANGE) -> Table:
    """The table of a text, of its bytes in UTF-8: ranges of ``step`` bytes are scanned on their own with halos, and their tables stitched by prefix sums.

    A text in whose run of characters there are sentence ends without blanks
    after them (as in Chinese) is cut into words there.
    """
    parts, chars, lines, lo = [], 0, 0, 0
    while lo < len(data):
        hi = min(len(data), lo + step)
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        n, n_lines, at, blank, end, before = _range_edges(data, lo, hi)
        parts.append((at + chars, blank, end, before + lines))
        chars, lines, lo = chars + n, lines + n_lines, hi
    at, blank, end, before = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), *(np.empty(0, bool),) * 2, np.empty(0, np.int64))
    word = np.flatnonzero(~blank)
    starts = at[word]
    stop = np.append(at, chars)
    ends = stop[word + 1]
    level = np.where(np.append(end, False)[word + 1], SENTENCE, 0).astype(np.int8)
    lines_at = np.append(before, lines)
    after = np.append(lines_at[word[1:]], lines) if len(word) else np.empty(0, np.int64)
    between = after - lines_at[word + 1]
    level[between == 1] = LINE
    level[between > 1] = PARAGRAPH
    if len(word) and stop[word[-1] + 1] == chars and not blank[-1]:
        level[-1] = max(level[-1], SENTENCE if _ends_sentence(data, int(ends[-1] - starts[-1])) else 0)
    lead = np.ones(len(starts), bool)
    lead[1:] = starts[1:] > ends[:-1]
    return Table(chars, starts, ends, level, np.cumsum(lead))


def _ends_sentence(data: np.ndarray, length: int) -> bool:
    """Whether the last word, of so many code points, ends a sentence."""
    word = data[-4 * _AROUND :].tobytes().decode("utf-8", "ignore")[-min(length, _AROUND) :]
    for _ in range(3):
        word = word[:-1] if len(word) > 1 and word[-1] in _CLOSERS else word
    return word[-1:] != "" and word[-1] in _ENDS


def table_of(text: str, step: int = RANGE) -> Table:
    return boundary_table(np.frombuffer(text.encode("utf-8", "surrogateescape"), np.uint8), step)


def _overlap(starts: np.ndarray, number: np.ndarray, stop: int) -> int:
    """Where the last 40 words before ``stop`` begin; ``number``: of each word, by white space."""
    w = int(np.searchsorted(starts, stop)) - 1
    return int(starts[int(np.searchsorted(number, number[w] - OVERLAP_WORDS + 1))])


def cut(t: Table, limits: Limits, segments: int = 0, new: int = 0) -> list[tuple[int, int, int]]:
    """Pieces of a text, of its table, as (start, end, start of what is new), in code points, each within ``limits``.

    A piece is cut at the last end of the highest kind in its second half (of a
    segment where those are known, a paragraph, a line, a sentence), else at the
    last such end after the overlap, else between words, else within a word that
    is over the limit itself. Each piece but the first begins with the last 40
    words of the piece before, or with its last 60 characters where there are no
    blanks. Every character of the text is in some piece. The first ``new``
    characters are the overlap with what lies before the text.
    """
    n, starts, ends, level, number = t.n, t.starts, t.ends, t.level, t.number
    if not len(starts) or ends[-1] <= new:  # nothing but blanks
        return [(a, min(n, a + limits.chars), a) for a in range(new, n, limits.chars)] or [(new, n, new)]
    spaced = number[-1] > 1
    if segments > 1 and int((level > 0).sum() + (level[-1] == 0)) == segments:
        level = np.where(level > 0, level + 4, level)  # its sentences are its segments
    out, begin = [], 0
    while True:
        first = int(np.searchsorted(ends, begin, side="right"))
        most_words = number[first] + limits.words - 1
        top = min(int(np.searchsorted(number, most_words, side="right")), int(np.searchsorted(ends, begin + limits.chars, side="right")))
        low = int(np.searchsorted(ends, new, side="right"))  # the first word that ends in what is new
        if top >= len(starts):
            out.append((begin, n if n - begin <= limits.chars else int(ends[-1]), new))
            if out[-1][1] < n:  # only blanks are left
                out += [(a, min(n, a + limits.chars), a) for a in range(out[-1][1], n, limits.chars)]
            return out
        if top <= low:  # the next word alone is over the limit
            stop = begin + limits.chars
        else:
            half = max(low, (first + top) // 2)
            best = top - 1
            for lo in (half, low):
                ends_here = level[lo:top]
                if len(ends_here) and ends_here.max() > 0:
                    best = lo + int(np.flatnonzero(ends_here == ends_here.max())[-1])
                    break
            stop = int(ends[best])
        out.append((begin, stop, new))
        new = stop
        if not spaced:
            begin = max(begin + 1, stop - OVERLAP_CHARS)
            continue
        begin = _overlap(starts, number, stop)
        if begin <= out[-1][0] or stop - begin > limits.chars // 2:  # 40 words that fill the piece: characters instead
            begin = max(out[-1][0] + 1, stop - OVERLAP_CHARS)


def covered(t: Table, ids: list[str] | None, spans: list[tuple[int, int]]) -> list[list[str] | None]:
    """The segments between each pair of offsets: exact where sentences or lines are as many as segments, else in proportion to length. The ends are looked for once per text."""
    if ids is None or len(ids) < 2:
        return [ids] * len(spans)
    for least in (SENTENCE, LINE):
        stops = t.ends[t.level >= least]
        if len(stops) and (not len(t.ends) or stops[-1] != t.ends[-1]):
            stops = np.append(stops, t.n)
        if len(stops) == len(ids):
            a, z = np.array(spans, np.int64).reshape(-1, 2).T
            lo, hi = np.searchsorted(stops, a, side="right"), np.searchsorted(stops, z, side="left")
            return [ids[x : y + 1] for x, y in zip(lo.tolist(), hi.tolist())]
    n, m = max(1, t.n), len(ids)
    return [ids[a * m // n : max(a * m // n + 1, -(-z * m // n))] for a, z in spans]


PIECE = "piece INT, piece_start INT, piece_end INT, new_start INT, est_tokens INT, piece_segment_ids ARRAY<STRING>, piece_text STRING"


def pieces(df: DataFrame, key: str = "id", text: str = "text", is_parent: str = "is_parent", segment_ids: str = "segment_ids", child: Limits = CHILD, parent: Limits = PARENT) -> DataFrame:
    """The pieces of each oversized row of ``df``; rows within the limit give none.

    ``key``, the piece's number from 0, its offsets in code points (new_start is
    where the overlap ends), its estimated tokens, the segments it covers (null
    where they are null) and its text. A narrow pass: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, chars = sizes(b.column(1))
            up = np.array(b.column(2).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            over = np.flatnonzero((tokens > np.where(up, parent.tokens, child.tokens)) | (chars > np.where(up, parent.chars, child.chars)))
            rows = []
            data, edges = _buffers(b.column(1))
            for i in over.tolist():
                t, ids = b.column(1)[i].as_py(), b.column(3)[i].as_py()
                table = boundary_table(data[edges[i] : edges[i + 1]])
                parts = cut(table, parent if up[i] else child, len(ids or ()))
                held = covered(table, ids, [(a, z) for a, z, _ in parts])
                for k, ((a, z, new), own) in enumerate(zip(parts, held)):
                    rows.append((b.column(0)[i].as_py(), k, a, z, new, max(1, round(1.3 * len(t[a:z].split()))), own, t[a:z]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), out_arrow)], schema=out_arrow)

    schema = T.StructType([df.schema[key], *T._parse_datatype_string(PIECE).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    out_arrow = to_arrow_schema(schema)
    ids = F.col(segment_ids) if segment_ids in df.columns else F.lit(None).cast("array<string>")
    return df.select(key, text, is_parent, ids.alias("ids")).mapInArrow(run, schema)


def file_ranges(spark: SparkSession, paths: list[tuple[str, int]], step: int = 64 << 20) -> DataFrame:
    """path, range and byte offsets for files given with their sizes; a range is a task's work."""
    files = spark.createDataFrame(paths, "path STRING, size LONG")
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / step)).cast("long")
    return files.withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("lo", F.col("range") * step).withColumn("hi", F.least("size", (F.col("range") + 1) * step))


def _text(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def _whole(data: bytes) -> int:
    """Offset of the first byte that begins a character."""
    return next((i for i, b in enumerate(data[:4]) if b & 0xC0 != 0x80), 0)


def _anchor(read: Callable[[int, int], bytes], at: int, size: int, window: int) -> int:
    """Where the block at ``at`` begins: the first end of the highest kind in the window from there, else the end of a word, else a character. Whoever asks gets the same."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    data = read(at, min(size, at + window))
    skip = _whole(data)
    text = _text(data[skip:])
    table = table_of(text)
    ends, level = table.ends[:-1], table.level[:-1]  # what follows the last is not seen
    return at + skip + (_bytes(text[: int(ends[int(np.argmax(level))])]) if len(ends) else 0)


def _before(read: Callable[[int, int], bytes], at: int, limits: Limits) -> str:
    """The overlap with what lies before ``at``: 40 words, or 60 characters where 40 words take half a piece or there are no blanks."""
    data = read(max(0, at - 4 * (limits.chars // 2 + 1)), at)
    text = _text(data[_whole(data) :])
    table = table_of(text)
    if len(table.number) and table.number[-1] > 1:
        begin = _overlap(table.starts, table.number, len(text))
        if len(text) - begin <= limits.chars // 2:
            return text[begin:]
    return text[max(0, len(text) - OVERLAP_CHARS) :]


def file_pieces(spark: SparkSession, paths: list[tuple[str, int]], most_chars: int, most_tokens: int = CHILD.tokens, step: int = 64 << 20) -> DataFrame:
    """Pieces of giant UTF-8 files by byte offset: path, piece, byte_start, byte_end, char_start, char_end, end_kind, overlap_byte_start, overlap_char_start.

    From byte_start to byte_end is what is new in a piece; the piece itself
    begins at overlap_byte_start, with the last 40 words (or 60 characters) of
    what lies before, and is within both limits. Each range is a task and read
    by offset in blocks of at most 1 MB. A block begins at an anchor, the best
    boundary in a halo after its edge, which both neighbours find alike, and is
    cut by ``cut`` with its halo before as overlap. Characters and pieces of
    the blocks are stitched by prefix sums. No file, and no file's table of
    boundaries, is ever in one task; each block costs one cut more.
    """
    import pyarrow.fs as fs

    limits, block = Limits(most_tokens, most_chars), min(step, RANGE)
    fields = "path STRING, block LONG, n LONG, n_pieces LONG, k LONG, a LONG, z LONG, over LONG, char_a LONG, char_z LONG, char_over LONG, end_kind INT"

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                where, name = fs.FileSystem.from_uri(r.path) if "://" in r.path or r.path.startswith("file:") else (fs.LocalFileSystem(), r.path)
                with where.open_input_file(name) as src:

                    def read(lo: int, hi: int) -> bytes:
                        src.seek(lo)
                        return src.read(hi - lo)

                    for at in range(r.lo, max(r.hi, r.lo + 1), block):
                        lo, hi = (_anchor(read, x, r.size, block // 2) for x in (at, min(at + block, r.hi)))
                        if lo >= hi and r.size:
                            continue
                        old, own = _before(read, lo, limits) if lo else "", _text(read(lo, hi))
                        text, first = old + own, lo - _bytes(old)
                        table = table_of(text)
                        parts = cut(table, limits, new=len(old))
                        ends, level = table.ends, table.level
                        spots = sorted({x for p in parts for x in p})
                        bytes_at = dict(zip(spots, np.cumsum([_bytes(text[x:y]) for x, y in zip([0, *spots], spots)]) + first))
                        kind = dict(zip(ends.tolist(), level.tolist()))
                        rows = [(r.path, at, len(own), len(parts), k, bytes_at[new], bytes_at[z], bytes_at[a], new - len(old), z - len(old), a - len(old), PARAGRAPH if bytes_at[z] == r.size else kind.get(z, 0)) for k, (a, z, new) in enumerate(parts)]
                        yield pd.DataFrame(rows, columns=[x.split()[0] for x in fields.split(", ")])

    found = materialize(file_ranges(spark, paths, step).select("path", "lo", "hi", "size").mapInPandas(scan, fields))
    totals = found.where("k = 0").select("path", "block", "n", "n_pieces")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("path", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("n", "base"), ("n_pieces", "first"))))
    return found.join(base, ["path", "block"]).select(
        "path", (F.col("first") + F.col("k")).alias("piece"), F.col("a").alias("byte_start"), F.col("z").alias("byte_end"), (F.col("base") + F.col("char_a")).alias("char_start"), (F.col("base") + F.col("char_z")).alias("char_end"), "end_kind",
        F.col("over").alias("overlap_byte_start"), (F.col("base") + F.col("char_over")).alias("overlap_char_start"))
