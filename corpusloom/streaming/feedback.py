"""Streams: feedback upserts, citations in streamed answers, server-sent events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.answers import CitationScanner
from corpusloom.operators.sinks import latest

FOUND = "trace_id STRING, citation STRING, position LONG"


def upsert_stream(stream: DataFrame, path: str, keys: list[str], version: list[str], checkpoint: str, compact_every: int = 64):
    """Latest row per key of a stream as a table: each batch writes its own latest rows, and readers take the latest of all (``current``).

    A batch costs what it brings, not what the table holds. Its folder is named
    by the query (as its checkpoint knows it) and its number, so one that is run
    again writes the same rows to the same place, and a new checkpoint never
    overwrites what an old one wrote. Every so many batches the folders are
    merged into one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").head()[0])["id"]
        latest(batch, keys, version).write.mode("overwrite").parquet(f"{path}/rows/query={query}/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(spark, path, keys, version)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def _merged(spark, path: str) -> tuple[int, str | None, list[str]]:
    """Number of merges so far, the folder of the last one, and all folders it stands for."""
    fs, root = _files(spark, path)
    done = sorted(_names(fs, root(f"{path}/merges"))) if fs.exists(root(f"{path}/merges")) else []
    if not done:
        return 0, None, []
    r = spark.read.json(f"{path}/merges/{done[-1]}").head()
    return len(done), r["at"], list(r["parts"])


def _parts(spark, path: str) -> list[str]:
    """Folders of rows that count: what the last merge left, and those written after it."""
    fs, root = _files(spark, path)
    if not fs.exists(root(f"{path}/rows")):
        return []
    every = [f"{path}/rows/{q}/{b}" for q in _names(fs, root(f"{path}/rows")) for b in _names(fs, root(f"{path}/rows/{q}"))]
    _, at, gone = _merged(spark, path)
    return [*([at] if at else []), *(p for p in every if p not in set(gone))]


def _files(spark, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path
    return root(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def _names(fs, at) -> list[str]:
    return [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]


def current(spark, path: str, keys: list[str], version: list[str]) -> DataFrame:
    """The table: of each key the latest row of all folders."""
    return latest(spark.read.parquet(*_parts(spark, path)), keys, version)


def compact(spark, path: str, keys: list[str], version: list[str]) -> None:
    """Merge the folders into one. Readers go over to it when its note is written, and what it replaces is left for those that still read it."""
    parts, (done, _, gone) = _parts(spark, path), _merged(spark, path)
    at, note = f"{path}/merged/{done:010d}", f"{path}/merges/{done:010d}"
    latest(spark.read.parquet(*parts), keys, version).write.mode("overwrite").parquet(at)
    spark.createDataFrame([(at, [*gone, *(p for p in parts if "/rows/" in p)])], "at STRING, parts ARRAY<STRING>").coalesce(1).write.mode("overwrite").json(note)


def scan_citations(deltas: DataFrame) -> DataFrame:
    """trace_id, citation, position of a stream of deltas (trace_id, seq, delta, sources): each known id once, when its bracket closes. The state of an answer is its open bracket and the ids seen."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, offset, seen, known = state.get if state.exists else ("", 0, "[]", "[]")
        scanner = CitationScanner(frozenset(json.loads(known)), rest, offset, json.loads(seen))
        out = []
        for f in sorted((r for f in frames for r in f.itertuples()), key=lambda r: r.seq):
            scanner.known = scanner.known | frozenset(s.lower() for s in (f.sources if f.sources is not None else ()))
            out += [(key[0], i, p) for i, p in scanner.feed(f.delta or "")]
        state.update((scanner.rest, scanner.offset, json.dumps(scanner.seen), json.dumps(sorted(scanner.known))))
        yield pd.DataFrame(out, columns=["trace_id", "citation", "position"])

    return deltas.groupBy("trace_id").applyInPandasWithState(run, FOUND, "rest STRING, offset LONG, seen STRING, known STRING", "append", GroupStateTimeout.NoTimeout)


def parse_events(text: str) -> list[tuple[str, str]]:
    """(event, data) of server-sent events: several data lines are one, comments and empty events are skipped, an unfinished end is dropped."""
    out = []
    *blocks, _ = text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")
    for block in blocks:
        event, data = "message", []
        for line in block.split("\n"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)
        if data:
            out.append((event, "\n".join(data)))
    return out


def answer_events(sources: list[str], deltas: list[str], known: set[str]) -> list[tuple[str, object]]:
    """The events of an answer in order: what was retrieved, text and citations in turn, the end; without sources straight to the end."""
    events: list[tuple[str, object]] = [("retrieval_done", sources)]
    if not sources:
        return [*events, ("done", {"answer": "", "citations": []})]
    scanner = CitationScanner(frozenset(known))
    for d in deltas:
        events.append(("token", d))
        events += [("citation", {"id": i, "position": p}) for i, p in scanner.feed(d)]
    return [*events, ("done", {"answer": "".join(deltas), "citations": list(scanner.seen)})]


def event_log(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts and sums of a stream of events by window and kind; what comes later than the watermark is left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def retrievals(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """trace_id, query_id, sources of questions (query_id) with their hits (query_id, work, rank): the first event of an answer. A trace id is random, one per answer."""
    found = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "work"))), lambda x: x["work"]).alias("sources"))
    none = F.array().cast("array<string>")
    return questions.select("query_id").join(found, "query_id", "left").select(F.expr("uuid()").alias("trace_id"), "query_id", F.coalesce("sources", none).alias("sources"))


def answer_stream(deltas: DataFrame) -> DataFrame:
    """trace_id, event, data, seq of a stream of deltas (trace_id, seq, delta, sources, done): the events of each answer as it is written.

    An answer's first row gives ``retrieval_done`` with its sources, each delta
    a ``token`` and a ``citation`` for every known id whose bracket it closes,
    and the row marked done ``done`` with the whole of the citations. An answer
    without sources is done at once. The state of an answer is its open bracket
    and the ids seen; it is dropped when the answer is done.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, offset, seen, known, begun = state.get if state.exists else ("", 0, "[]", "[]", False)
        scanner = CitationScanner(frozenset(json.loads(known)), rest, offset, json.loads(seen))
        out, ended = [], False
        for f in sorted((r for x in frames for r in x.itertuples()), key=lambda r: r.seq):
            if not begun:
                sources = [s for s in (f.sources if f.sources is not None else ())]
                scanner.known = frozenset(s.lower() for s in sources)
                out.append(("retrieval_done", json.dumps(sources, ensure_ascii=False), f.seq))
                begun, ended = True, not sources
            elif ended:
                break
            if f.delta and not ended:
                out.append(("token", f.delta, f.seq))
                out += [("citation", json.dumps({"id": i, "position": p}), f.seq) for i, p in scanner.feed(f.delta)]
            if f.done or ended:
                out.append(("done", json.dumps({"citations": scanner.seen}), f.seq))
                ended = True
        if ended:
            state.remove()
        else:
            state.update((scanner.rest, scanner.offset, json.dumps(scanner.seen), json.dumps(sorted(scanner.known)), begun))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["trace_id", "event", "data", "seq"])

    return deltas.groupBy("trace_id").applyInPandasWithState(run, "trace_id STRING, event STRING, data STRING, seq LONG", "rest STRING, offset LONG, seen STRING, known STRING, begun BOOLEAN", "append", GroupStateTimeout.NoTimeout)
