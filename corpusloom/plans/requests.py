"""Requests at the edge: plain records that check their bounds, and the frames of queries made of them."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


def _within(name: str, value: int, lo: int, hi: int) -> None:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be within {lo} and {hi}")


@dataclass(frozen=True)
class QueryRequest:
    query: str
    top_k: int = 8
    rerank: bool | None = None
    expand_parents: bool | None = None
    source_types: tuple[str, ...] = ()
    forbidden_works: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _within("length of query", len(self.query), 1, 2000)
        _within("top_k", self.top_k, 1, 20)


@dataclass(frozen=True)
class AnswerRequest:
    query: str
    top_k: int = 5
    style: str = "auto"

    def __post_init__(self) -> None:
        _within("length of query", len(self.query), 1, 2000)
        _within("top_k", self.top_k, 1, 10)
        if self.style not in ("auto", "concise", "detailed"):
            raise ValueError("unknown style")


@dataclass(frozen=True)
class RetrieveRequest:
    query: str
    top_k: int = 20
    per_channel_limit: int = 30

    def __post_init__(self) -> None:
        _within("length of query", len(self.query), 1, 2000)
        _within("top_k", self.top_k, 1, 100)
        _within("per_channel_limit", self.per_channel_limit, 1, 200)


@dataclass(frozen=True)
class ThreadRequest:
    query: str
    top_k: int = 3
    excluded: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _within("length of query", len(self.query), 1, 2000)
        _within("top_k", self.top_k, 1, 10)


@dataclass(frozen=True)
class Feedback:
    trace_id: str
    thumb: int
    comment: str | None = None
    answer: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.thumb not in (1, -1):
            raise ValueError("thumb must be 1 or -1")
        if self.comment is not None:
            _within("length of comment", len(self.comment), 0, 2000)


def queries_frame(spark: SparkSession, requests: dict[str, QueryRequest]) -> DataFrame:
    """query_id and the fields of each request: one frame for a batch of them."""
    rows = [(i, r.query, r.top_k, list(r.source_types), list(r.forbidden_works)) for i, r in requests.items()]
    return spark.createDataFrame(rows, "query_id STRING, query STRING, top_k INT, source_types ARRAY<STRING>, forbidden_works ARRAY<STRING>")


def as_dict(request) -> dict:
    return asdict(request)
