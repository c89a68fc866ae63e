"""Hard negatives: for each anchor and positive, the best rows of other labels whose scores lie in the positive's window.

The windows of an anchor overlap, but their upper limits cut the scores into slots that don't.  Each task keeps the best
few of a slot, a merge keeps the best few over all tasks, and a positive's negatives are the first of its own slot and all
slots below it, down to its lower limit.  Scores are integer inner products, so nothing depends on the order of sums.

Rows without id, label or vector, with null or non-finite components, or of another length than most take no part; of rows
with the same id the one with the smallest label, then vector, does.  Components too large for scores to fit a long are
taken as the largest size that isn't.  Empty tables, anchors alone in their label and anchors without other labels give no
rows.  Columns beside the named ones are not looked at."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import settle
from meshlark.llm.vector_codes import bound, common_length, usable

#: Anchors that are sent to the tasks at once; more are taken in turn.
BLOCK = 1 << 16
#: Anchors and rows whose scores are made together.
_ANCHORS, _ROWS = 512, 1024
_NONE = -(2**63) + 1


class Slots:
    """The best ``keep`` scores in each slot of some anchors: ties by the smaller id.

    ``limits`` (anchors, slots) fall; a score belongs to the lowest limit that is not below it, and to none if it is below
    ``least`` of its anchor or above all limits."""

    def __init__(self, limits: np.ndarray, least: np.ndarray, keep: int) -> None:
        self.limits, self.least, self.keep = limits, least, keep
        self.bar = np.full(limits.shape, _NONE)
        self.best = [np.zeros(0, np.int64) for _ in range(4)]  # anchor, slot, -score, id

    def add(self, scores: np.ndarray, among: np.ndarray, ids: np.ndarray) -> None:
        slot = np.full(scores.shape, -1)
        for j in range(self.limits.shape[1]):
            slot += scores <= self.limits[:, j, None]
        open_ = among & (slot >= 0) & (scores >= self.least[:, None])
        a, c = np.nonzero(open_)
        s, v = slot[a, c], scores[a, c]
        good = v >= self.bar[a, s]
        a, s, v, i = a[good], s[good], v[good], ids[c[good]]
        a, s, v, i = (np.concatenate(x) for x in zip(self.best, (a, s, -v, i)))
        order = np.lexsort((i, v, s, a))
        a, s, v, i = a[order], s[order], v[order], i[order]
        group = a * self.limits.shape[1] + s
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        self.best = [x[rank < self.keep] for x in (a, s, v, i)]
        last = rank == self.keep - 1
        self.bar[a[last], s[last]] = -v[last]


def _best(rows: DataFrame, anchors: dict[str, np.ndarray], limits: np.ndarray, least: np.ndarray, keep: int, same: bool) -> DataFrame:
    """``anchor, slot, score, other``: the best of each task for a block of anchors, among rows of the same label (but not the
    anchor itself) or of other labels."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((anchors, limits, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits, least = sent.value
        ids, vectors = anchors["id"], anchors["vector"]
        codes = {x: i for i, x in enumerate(dict.fromkeys(anchors["label"]))}
        labels = np.array([codes[x] for x in anchors["label"]], np.int64)
        parts = [slice(i, i + _ANCHORS) for i in range(0, len(ids), _ANCHORS)]
        slots = [Slots(limits[p], least[p], keep) for p in parts]
        size = int(np.abs(vectors).max(initial=0))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                other = some.column(0).to_numpy()
                label = np.array([codes.get(x, -1) for x in some.column(1).to_pylist()], np.int64)
                given = some.column(2).flatten().to_numpy().reshape(some.num_rows, -1)
                # sums of doubles are exact below 2 ** 53
                exact = size * int(np.abs(given).max(initial=0)) * given.shape[1] < 2**53
                for p, best in zip(parts, slots):
                    scores = (vectors[p].astype(float) @ given.T.astype(float)).astype(np.int64) if exact else vectors[p] @ given.T
                    alike = labels[p][:, None] == label
                    best.add(scores, alike & (ids[p][:, None] != other) if same else ~alike, other)
        for p, best in zip(parts, slots):
            a, s, v, i = best.best
            yield pa.record_batch([pa.array(x) for x in (ids[p][a], s.astype(np.int32), -v, i)], names=["anchor", "slot", "score", "other"])

    found = rows.mapInArrow(run, "anchor long, slot int, score long, other long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other")
    out = settle(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep))
    sent.destroy()
    return out


def one_row_an_id(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """``vec_id, label`` (string) ``, vector`` (integers) of the rows that take part."""
    length = common_length(rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull()), vector)
    most = float(bound(length))
    whole = F.transform(F.col(vector), lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * scale))))
    fit = rows.where(usable(vector) & (F.size(vector) == length) & F.col(vec_id).isNotNull() & F.col(label).isNotNull())
    first = fit.select(F.col(vec_id).cast("long").alias("vec_id"), F.struct(F.col(label).alias("label"), whole.alias("vector")).alias("row")).groupBy("vec_id").agg(F.min("row").alias("row"))
    return first.select("vec_id", F.col("row.label").cast("string").alias("label"), "row.vector")


def window_of(score: Column, low: int, high: int) -> tuple[Column, Column]:
    """The least and greatest integers from ``low`` to ``high`` hundredths of a score; exact."""
    part = lambda n: score.cast("decimal(20,0)") * F.lit(Decimal(n).scaleb(-2))
    return F.ceil(part(low)).cast("long"), F.floor(part(high)).cast("long")


def _block(anchors: DataFrame) -> dict[str, np.ndarray]:
    got = anchors.select("vec_id", "label", "vector").toArrow().sort_by("vec_id")
    vectors = got["vector"].combine_chunks()
    return {"id": got["vec_id"].to_numpy(), "label": got["label"].to_numpy(), "vector": vectors.flatten().to_numpy().reshape(len(got), -1) if len(got) else np.zeros((0, 0), np.int64)}


def _limits(anchors: dict[str, np.ndarray], windows: DataFrame, positives: int) -> tuple[np.ndarray, np.ndarray]:
    """The falling upper limits of each anchor's slots, and its smallest lower limit."""
    got = windows.select("anchor", "slot", "low", "high").toArrow()
    at = np.searchsorted(anchors["id"], got["anchor"].to_numpy())
    limits, least = np.full((len(anchors["id"]), positives), _NONE), np.full(len(anchors["id"]), 2**63 - 1)
    limits[at, got["slot"].to_numpy()] = got["high"].to_numpy()
    np.minimum.at(least, at, got["low"].to_numpy())
    return limits, least


def _mine(kept: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """A block of anchors against all rows: once for the positives, once for the slots between their limits."""
    sent = _block(anchors)
    n = len(sent["id"])
    own = _best(kept, sent, np.full((n, 1), 2**63 - 1), np.full(n, _NONE), positives, True)
    lower, upper = window_of(F.col("score"), low, high)
    found = own.select("anchor", F.col("other").alias("positive"), F.col("score").alias("positive_score"), lower.alias("low"), upper.alias("high")).where(F.col("low") <= F.col("high"))
    windows = settle(found.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("high"))) - 1))
    slots = _best(kept, sent, *_limits(sent, windows, positives), negatives, False)
    # the suffix of a slot falls: its first rows are the best of all that is below the limit
    falling = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "other", "slot"))).alias("found"))
    fit = F.filter("found", lambda x: (x["slot"] >= F.col("slot")) & (-x["down"] >= F.col("low")))
    ranked = windows.join(falling, "anchor").select("anchor", "positive", "positive_score", F.posexplode(F.slice(fit, 1, negatives)).alias("place", "x"))
    return ranked.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        (F.col("place") + 1).cast("int").alias("rank"),
        F.col("x.other").alias("negative_id"),
        "positive_score",
        (-F.col("x.down")).alias("negative_score"),
    )


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id ``every`` divides.  A positive is one of the ``positives`` best other rows of the
    anchor's label, its negatives the ``negatives`` best rows of other labels whose scores are from ``low`` to ``high``
    hundredths of its own; ties go to the smaller id.  About ``block`` anchors at a time are sent to the tasks that read
    the rows; what a task keeps is bounded by them."""
    kept = settle(one_row_an_id(rows, vec_id, vector, label, scale))
    anchors = kept.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-anchors.count() // block))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_mine(kept, anchors.where(part == b), positives, negatives, low, high) for b in range(blocks)])
