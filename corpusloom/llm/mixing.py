"""Problem 8: a mix of documents with given shares of its size per source.

Method: iterative proportional fitting. Token weights of the cells (source,
language, topic) are raked to the marginals of source (the targets), language
and topic (those of the documents that have a target); no cell may exceed what
its documents hold times the repeats its source allows. The calibrated weight
of a cell over its tokens is the expected number of uses of each of its
documents; uses are drawn by systematic sampling along the documents of a source,
cell by cell, up and down in size by turns. What one cell leaves of a use goes on
to the next, so the total of a source comes out within a few documents' size.

Where a source can't reach its target, as it has no documents or too few even
when repeated, the others take its part in proportion to their targets, and the
report says so.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.language import label_column
from corpusloom.llm.tokenizing import VOCABULARY, count_tokens
from corpusloom.plans.materialize import materialize

ROUNDS = 200
#: Documents that one window may order; larger cells are ordered in blocks that prefix sums put in a row.
BLOCK = 50_000


def source_totals(share: dict[str, float], capacity: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source: its share of ``total``, at most its capacity; what is missing goes to the others in proportion."""
    out: dict[str, float] = {}
    open_, left = {s for s in share if capacity.get(s, 0) > 0 and share[s] > 0}, float(total)
    while open_ and left > 0:
        weight = sum(share[s] for s in open_)
        full = {s for s in open_ if left * share[s] / weight >= capacity[s]}
        if not full:
            return out | {s: left * share[s] / weight for s in open_}
        for s in full:
            out[s] = float(capacity[s])
            left -= out[s]
        open_ -= full
    return out | dict.fromkeys(open_, 0.0)


def rake(cells: list[tuple[str, str, str, float]], repeats: dict[str, int], totals: dict[str, float], rounds: int = ROUNDS) -> np.ndarray:
    """Token weight of each cell (source, language, topic, tokens), fitted to the totals per source and the marginals of language and topic."""
    tokens = np.array([c[3] for c in cells], float)
    most = tokens * np.array([repeats[c[0]] for c in cells], float)
    groups = [np.unique([c[k] for c in cells], return_inverse=True) for k in range(3)]
    size = sum(totals.values())
    goals = [np.array([totals.get(s, 0.0) for s in groups[0][0]])] + [np.bincount(g[1], weights=tokens) / max(1.0, tokens.sum()) * size for g in groups[1:]]
    w = np.minimum(most, tokens * size / max(1.0, tokens.sum()))

    def fit(w: np.ndarray, k: int, steps: int) -> np.ndarray:
        for _ in range(steps):  # what a full cell can't take, the others of its group take
            now = np.bincount(groups[k][1], weights=w, minlength=len(goals[k]))
            factor = np.divide(goals[k], now, out=np.ones_like(now), where=now > 0)
            if np.all(np.abs(factor - 1) < 1e-9):
                break
            w = np.minimum(most, w * factor[groups[k][1]])
        return w

    for _ in range(rounds):
        before = w
        for k in (2, 1, 0):
            w = fit(w, k, 8)
        if np.abs(w - before).max(initial=0.0) <= 1e-7 * max(1.0, size):
            break
    return fit(w, 0, 200)  # the targets of the sources have the last word


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, language, topic and n_tokens of each document."""
    d = documents.select("doc_id", "source", F.coalesce(label_column(F.col("lang")), F.lit("und")).alias("language"), F.coalesce("tradition_code", F.lit("")).alias("topic"), "text")
    return count_tokens(d, ["doc_id", "source", "language", "topic"], vocabulary=vocabulary)


def draw(sizes: DataFrame, targets: DataFrame, total: float | None = None, fraction: float = 0.6, seed: int = 7) -> DataFrame:
    """doc_id, source, n_tokens, uses of the documents drawn (uses at least 1).

    ``total``: the size of the mix in tokens; without it, ``fraction`` of the
    tokens that documents with a target hold. Documents without source, without
    a target for it, or without tokens are never drawn. Targets that repeat a
    source count once, the larger share. An empty table gives an empty mix.

    The driver gets one row per cell: sources are those of the targets (a small
    table), languages codes, topics domain codes; none grows with the documents.
    """
    goal = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in sorted(targets.where("source IS NOT NULL").collect(), key=lambda r: r["target_share"] or 0)}
    inside = sizes.where(F.col("source").isin(list(goal)) & (F.col("n_tokens") > 0)) if goal else sizes.where("false")
    rows = inside.groupBy("source", "language", "topic").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("m")).collect()
    rows = sorted(rows, key=lambda r: (r["source"], r["language"], r["topic"]))
    cells = [(r["source"], r["language"], r["topic"], float(r["n"])) for r in rows]
    capacity: dict[str, float] = {}
    for s, _, _, n in cells:
        capacity[s] = capacity.get(s, 0.0) + n * goal[s][1]
    size = total if total is not None else fraction * sum(c[3] for c in cells)
    totals = source_totals({s: g[0] for s, g in goal.items()}, capacity, size)
    weights = rake(cells, {s: g[1] for s, g in goal.items()}, totals) if cells else np.empty(0)
    spark = sizes.sparkSession
    turn = {}  # cells of a source in their order: every other one is walked from its largest document down
    for c in cells:
        turn.setdefault(c[0], []).append(c[:3])
    place = {c: i for own in turn.values() for i, c in enumerate(own)}
    rate = spark.createDataFrame(
        [(*c[:3], float(w / c[3]), int(-(-r["m"] // BLOCK)), place[c[:3]], goal[c[0]][1]) for c, r, w in zip(cells, rows, weights)], "source STRING, language STRING, topic STRING, rate DOUBLE, blocks INT, place INT, most INT"
    )
    placed = inside.join(rate, ["source", "language", "topic"]).where("rate > 0")
    # Along the sizes, up and down by turns: a class of size, then a block of the hash, then the hash.
    way = F.when(F.col("place") % 2 == 0, 1).otherwise(-1)
    placed = placed.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("size_class", way * F.floor(F.log2("n_tokens") * 4).cast("int")).withColumn("block", F.pmod("h", "blocks"))
    counted = placed.groupBy("source", "place", "size_class", "block").agg(F.count("*").alias("n"), F.first("rate").alias("r"))
    # What a cell leaves of a use goes on to the next cell of its source: the whole source is one walk.
    before = Window.partitionBy("source").orderBy("place", "size_class", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("r")).over(before), F.lit(0.0))).drop("n", "r")
    within = Window.partitionBy("source", "place", "size_class", "block").orderBy(way * F.col("n_tokens"), "h", "doc_id")
    ranked = placed.withColumn("i", F.row_number().over(within)).join(offsets, ["source", "place", "size_class", "block"])
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    upto = F.col("before") + F.col("rate") * F.col("i") + start + 1e-7
    # A rate that is a whole number, up to rounding, gives just that number.
    uses = F.least(F.floor(upto) - F.floor(upto - F.col("rate")), F.col("most"))
    drawn = materialize(ranked.select("doc_id", "source", "n_tokens", uses.cast("int").alias("uses"), "most", "h"))
    for part in PASSES:
        drawn = _corrected(drawn, totals, part)
    return drawn.where("uses > 0").select("doc_id", "source", "n_tokens", "uses")


#: What is left between a source's total and its draw is closed by documents of at most these parts of it, one pass after another.
PASSES = (0.25, 0.5, 1.0)


def _corrected(drawn: DataFrame, totals: dict[str, float], part: float) -> DataFrame:
    """``drawn`` with one use more, or one less, of documents in order of their hash until a source's total is met as nearly as their sizes allow. Long documents make draws miss their total; short ones close the gap."""
    got = {r["source"]: r["t"] for r in drawn.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("t")).collect()}  # sources of the targets only
    gaps = {s: totals[s] - t for s, t in got.items() if s in totals and abs(totals[s] - t) >= 1}
    if not gaps:
        return drawn
    gap = drawn.sparkSession.createDataFrame([(s, float(g)) for s, g in gaps.items()], "source STRING, gap DOUBLE")
    rows = drawn.join(gap, "source", "left")
    fits = (F.col("n_tokens") <= F.abs("gap") * part) & F.when(F.col("gap") > 0, F.col("uses") < F.col("most")).otherwise(F.col("uses") > 0)
    near = rows.where(fits).select("doc_id", "source", "n_tokens", "gap", "h")
    blocks = near.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    near = near.join(blocks, "source").withColumn("block", F.pmod(F.shiftright("h", 20), "blocks"))
    sums = near.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"))
    sums = sums.select("source", "block", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("h", "doc_id"))
    taken = near.withColumn("upto", upto).join(sums, ["source", "block"]).where(F.col("before") + F.col("upto") - F.col("n_tokens") / 2 <= F.abs("gap")).select("doc_id", F.lit(1).alias("taken"))
    out = rows.join(taken, "doc_id", "left")
    return materialize(out.select("doc_id", "source", "n_tokens", (F.col("uses") + F.coalesce("taken", F.lit(0)) * F.signum(F.coalesce("gap", F.lit(0.0))).cast("int")).alias("uses"), "most", "h"))


def shares(sizes: DataFrame, targets: DataFrame, mix: DataFrame) -> DataFrame:
    """The report: for each source of the documents or the targets its target and reached share, tokens drawn and held, documents, and most uses of one."""
    held = sizes.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("held_tokens"), F.count("*").alias("held_documents"))
    drawn = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("drawn_tokens"), F.count("*").alias("drawn_documents"), F.max("uses").alias("most_uses"))
    whole = mix.agg(F.sum(F.col("n_tokens") * F.col("uses"))).head()[0] or 1
    goal = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = goal.join(held, goal["source"].eqNullSafe(held["source"]), "full").select(F.coalesce(goal["source"], held["source"]).alias("source"), "target_share", "max_repeats", "held_tokens", "held_documents")
    out = both.join(drawn.withColumnRenamed("source", "s"), F.col("source") == F.col("s"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.col("drawn_tokens") / F.lit(whole), F.lit(0.0)).alias("reached_share"), zero("drawn_tokens"), zero("held_tokens"), zero("drawn_documents"), zero("held_documents"), zero("most_uses"), "max_repeats")


def mix_of(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mix and its report."""
    sizes = materialize(sized(documents, vocabulary))
    mix = materialize(draw(sizes, targets, total))
    return mix, shares(sizes, targets, mix)
