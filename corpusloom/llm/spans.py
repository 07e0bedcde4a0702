"""Problem 1: long exact spans shared between records.

Method: an FM-index per shard; documents are streamed through it, and backward
search over wavelet trees gives matching statistics; stretches at or above the
threshold are reported (``fmindex``).

What makes shards independent: every window of ``least`` characters is assigned
to the smallest hash of its k-grams (its minimizer). Equal windows have equal
minimizers, so windows on end with one minimizer, taken together as one string,
meet all their copies in the shard of that minimizer, wherever they stand.
Texts whose minimizers no other record has never leave their scan.

1. Scan: the minimizers of each text, vectorised; one slim row for each, written once.
2. Minimizers that stand in two records: an aggregation with partial sums.
3. The strings of those minimizers, one row per occurrence; equal strings are
   merged before anything is indexed, and keep whether several records own them.
4. Per shard: an index of its strings, and every one of them streamed through
   it, those of several records included; shared stretches of each string.
5. Per record: the union of its stretches.

A minimizer that a third of all records have costs slim rows in 2 and few
distinct strings in 3. If one has more distinct strings than a shard may hold,
its strings are taken apart again by minimizers of longer grams, up to whole
windows, of which a group has one string only; every group goes to an index in
the end. No cap, no pair of records is formed, and the same plan at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.fmindex import FMIndex
from corpusloom.plans.materialize import materialize

LEAST, GRAM = 200, 64
#: Characters that are hashed at once (arrays that stay in a core's cache), that a shard holds, and that one minimizer's strings may have in a shard.
AT_ONCE, SHARD_CHARS, HOT_CHARS = 1 << 17, 600_000, 1_500_000

_BASE = 0x9E3779B97F4A7C15
_SHIFT = np.uint64(24)


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse modulo 2^64."""
    if len(cache.get("up", ())) < n + 1:
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        cache["up"], cache["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return cache["up"], cache["down"]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k-gram that begins at each place, from differences of prefix sums."""
    n = len(data)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(77)) * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def minimizer_runs(data: np.ndarray, edges: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts on end between ``edges``: owner, start in it and length of each run of windows with one minimizer, and its hash."""
    n, w = len(data), least - k + 1
    none = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if n < least:
        return none
    h = gram_hashes(data, k)
    best = (h >> _SHIFT << _SHIFT) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= w:  # smallest of 2, 4, 8 ... on end, then of two runs that overlap
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < w:
        best = np.minimum(best[: len(best) - (w - step)], best[w - step :])
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    start = np.flatnonzero(owner[: n - least + 1] == owner[least - 1 :])
    if not len(start):
        return none
    at = (best[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    i = np.flatnonzero(new)
    length = np.diff(np.append(i, len(start))) + least - 1
    own = owner[start[i]]
    return own, start[i] - edges[own], length, h[at[i]]


def _grouped(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about AT_ONCE characters."""
    a = held = 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > AT_ONCE:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(lengths):
        yield a, len(lengths)


def runs_of_texts(texts: list[str], least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for a list of texts of any length; a giant text is taken in slices that overlap by a window."""
    parts, where, shift = [], [], []
    for i, t in enumerate(texts):
        if len(t) <= AT_ONCE:
            parts.append(t)
            where.append(i)
            shift.append(0)
        else:
            for a in range(0, len(t) - least + 1, AT_ONCE):
                parts.append(t[a : a + AT_ONCE + least - 1])
                where.append(i)
                shift.append(a)
    lengths = np.array([len(p) for p in parts], np.int64)
    where, shift = np.array(where, np.int64), np.array(shift, np.int64)
    out = []
    for a, z in _grouped(lengths):
        data = np.frombuffer("".join(parts[a:z]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        own, start, length, h = minimizer_runs(data, np.concatenate([[0], np.cumsum(lengths[a:z])]), least, k)
        out.append((where[a + own], start + shift[a + own], length, h))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _mixed(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Hashes of one level never meet those of another."""
    return (h ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)


def minimizers(df: DataFrame, least: int = LEAST, k: int = GRAM) -> DataFrame:
    """h, rec, start, length for each run of windows of each text. ``df``: rec LONG (hash of the record's id), level INT, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            own, start, length, h = runs_of_texts(texts, least, k)
            level = b.column(1).to_numpy(zero_copy_only=False)
            rec = b.column(0).to_numpy(zero_copy_only=False)
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(_mixed(h, level[own])), pa.array(rec[own]), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["h", "rec", "start", "length"])

    return df.select("rec", "level", "text").where(F.length("text") >= least).mapInArrow(run, "h LONG, rec LONG, start INT, length INT")


def shared_spans(rows: DataFrame, least: int = LEAST, k: int = GRAM, shard_chars: int = SHARD_CHARS, hot_chars: int = HOT_CHARS) -> DataFrame:
    """The maximal stretches of each record that lie in runs of at least ``least`` characters which another record of its level has verbatim.

    ``rows``: id STRING, level (a boolean or number; only records of one level
    are compared), text. Returns id, span_start, span_end in code points; they
    say how much of a text is found elsewhere (``coverage``). Rows with one id
    are one record; null, empty and short texts have no span; texts are taken
    whole, whatever their length. Records are told apart by a 64-bit hash of
    their id where candidates are found, by the id itself where spans are.
    """
    k = min(k, least)
    base = rows.where("id IS NOT NULL AND text IS NOT NULL").where(F.length("text") >= least).select("id", F.coalesce(F.col("level").cast("int"), F.lit(0)).alias("level"), "text").withColumn("rec", F.xxhash64("id"))
    found = materialize(minimizers(base, least, k))
    several = found.groupBy("h").agg(F.min("rec").alias("lo"), F.max("rec").alias("hi")).where("lo <> hi").select("h")
    wanted = found.join(several, "h", "left_semi")
    per_record = materialize(wanted.groupBy("rec").agg(F.array_sort(F.collect_set(F.struct("start", "length", "h"))).alias("runs")))
    strings = materialize(_strings(base, per_record))
    pieces = _pieces(strings.select("level", "h", "t", F.col("id").alias("lo"), F.col("id").alias("hi"), "s"), least, k, shard_chars, hot_chars)
    spans = strings.select("h", "t", "id", "start").join(pieces, ["h", "t"]).select("id", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z"))
    return united(spans)


_STRING = "level INT, h LONG, t BINARY, s STRING"


def _digest(s: str) -> bytes:
    import hashlib

    return hashlib.md5(s.encode("utf-8", "surrogatepass")).digest()


def _strings(base: DataFrame, per_record: DataFrame) -> DataFrame:
    """One row per occurrence of a candidate string: h, id, start, t (128 bits that identify the string), s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"level": [], "h": [], "id": [], "start": [], "t": [], "s": []}
            for level, i, text, runs in zip(*(b.column(c).to_pylist() for c in range(4))):
                for r in runs:
                    s = text[r["start"] : r["start"] + r["length"]]
                    for c, v in zip(out, (level, r["h"], i, r["start"], _digest(s), s)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["level"], pa.int32()), pa.array(out["h"], pa.int64()), pa.array(out["id"], pa.string()), pa.array(out["start"], pa.int32()), pa.array(out["t"], pa.binary()), pa.array(out["s"], pa.string())], names=list(out))

    return base.join(per_record, "rec").select("level", "id", "text", "runs").mapInArrow(run, "level INT, h LONG, id STRING, start INT, t BINARY, s STRING")


def _pieces(strings: DataFrame, least: int, k: int, shard_chars: int, hot_chars: int) -> DataFrame:
    """Shared stretches of each distinct string (level, h, t, lo, hi, s): h, t, a, z. Strings are compared with those of their minimizer h, whose grams have ``k`` characters."""
    distinct = materialize(strings.groupBy("level", "h", "t").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("s").alias("s")))
    sizes = materialize(distinct.groupBy("h").agg(F.sum(F.length("s")).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h", "n"))
    cool, hot = sizes.where(F.col("n") <= hot_chars).select("h"), sizes.where(F.col("n") > hot_chars).select("h")
    total, hottest = sizes.agg(F.sum(F.when(F.col("n") <= hot_chars, F.col("n"))), F.max("n")).head()
    shards = max(1, -(-int(total or 0) // shard_chars))
    out = _indexed(distinct.join(cool, "h", "left_semi").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")), least)
    if (hottest or 0) <= hot_chars or k >= least:  # a group of whole windows has one string
        return out
    longer = min(least, k + max(1, (least - k) // 2)) if least - k > 8 else least
    parts = materialize(_taken_apart(distinct.join(hot, "h", "left_semi"), least, longer))
    inner = _pieces(parts.select("level", "h", "t", "lo", "hi", "s"), least, longer, shard_chars, hot_chars)
    again = parts.select("h", "t", "of_h", "of_t", "start").join(inner, ["h", "t"])
    return out.unionByName(again.select(F.col("of_h").alias("h"), F.col("of_t").alias("t"), (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z")))


def _taken_apart(strings: DataFrame, least: int, k: int) -> DataFrame:
    """The strings of each run of windows with one minimizer of ``k`` characters, within strings: their own h, t and s, those they are part of (of_h, of_t), and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(5).to_pylist()
            own, start, length, h = runs_of_texts(texts, least, k)
            at = pa.array(own)
            parts = [texts[i][a : a + n] for i, a, n in zip(own.tolist(), start.tolist(), length.tolist())]
            level = b.column(0).to_numpy(zero_copy_only=False)
            first = [b.column(0).take(at), pa.array(_mixed(h, level[own])), pa.array([_digest(p) for p in parts], pa.binary()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays([*first, *(b.column(c).take(at) for c in (1, 2, 3, 4)), pa.array(start.astype(np.int32))], names=["level", "h", "t", "s", "of_h", "of_t", "lo", "hi", "start"])

    return strings.select("level", "h", "t", "lo", "hi", "s").mapInArrow(run, f"{_STRING}, of_h LONG, of_t BINARY, lo STRING, hi STRING, start INT")


def _indexed(strings: DataFrame, least: int) -> DataFrame:
    """Shared stretches of each distinct string, by an FM-index per level and shard: h, t, a, z. Every string of the shard is streamed through its index."""

    def run(table: pa.Table) -> pa.Table:
        s = table.column("s").to_pylist()
        lo, hi = table.column("lo").to_pylist(), table.column("hi").to_pylist()
        names: dict[str, int] = {}
        owner = np.array([-1 if a != z else names.setdefault(a, len(names)) for a, z in zip(lo, hi)], np.int64)
        which, a, z = FMIndex(s, owner).shared(np.arange(len(s)), least)
        if len(which):
            which, a, z = _union(which, a, z)
        at = pa.array(which)
        return pa.Table.from_arrays([table.column("h").take(at), table.column("t").take(at), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names=["h", "t", "a", "z"])

    return strings.select("level", "shard", "h", "t", "lo", "hi", "s").groupBy("level", "shard").applyInArrow(run, "h LONG, t BINARY, a INT, z INT")


def _union(which: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the stretches of each string."""
    o = np.lexsort((a, which))
    which, a, z = which[o], a[o], z[o]
    far = np.int64(1 << 32)
    reach = np.maximum.accumulate(which * far + z) - which * far
    new = np.concatenate([[True], (which[1:] != which[:-1]) | (a[1:] > reach[:-1])])
    i = np.flatnonzero(new)
    return which[i], a[i], reach[np.append(i[1:], len(a)) - 1]


def united(spans: DataFrame) -> DataFrame:
    """Maximal unbroken stretches of each id from stretches (id, a, z) that may overlap or touch."""
    w = Window.partitionBy("id").orderBy("a", "z")
    reach = F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = spans.distinct().withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1)))
    part = part.withColumn("part", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("id", "part").agg(F.min("a").cast("int").alias("span_start"), F.max("z").cast("int").alias("span_end")).select("id", "span_start", "span_end")


def coverage(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """id, n_chars, shared_chars and shared_share of each record, those without spans included; null texts have 0 characters and a share of 0."""
    sizes = rows.groupBy("id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n_chars"))
    held = spans.groupBy("id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    out = sizes.join(held, "id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("shared_share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
