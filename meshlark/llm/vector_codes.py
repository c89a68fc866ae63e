"""Vectors as short codes: each part of a vector is the index of its codebook's nearest entry, found by Orchard search.

Vectors that are null, empty, or hold null or non-finite components are left out, and so are those of another length than
most have (ties: the smaller length).  Components become integers by floor(scale * x), so all results are exact; what is so
large that squared distances could leave the range of a long is taken as the largest size that can't.  A length that the
parts don't divide is filled up with zeros.  Repeated rows count each by itself; a null id comes after all ids.  Fewer rows
than entries give smaller codebooks, an empty table gives an empty one.  Columns beside the named ones are not looked at."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import settle

#: Vectors that are searched together.
_ROWS = 4096


def usable(vector: str) -> Column:
    """Whether a vector takes part: it has components, and all are finite numbers."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The length that most usable vectors have; 0 if there are none."""
    found = rows.where(usable(vector)).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def bound(length: int) -> int:
    """The largest size of integer components for which sums over a vector of products, or of squared differences, fit a long."""
    return math.isqrt((2**63 - 1) // max(1, length)) // 2


def integers(column: pa.Array, length: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column take part, and their components as integers, a row each."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(sizes == length)
    flat = column.take(pa.array(fit)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    good = np.isfinite(flat).all(axis=1)
    most = float(bound(length))
    return fit[good], np.clip(np.floor(scale * flat[good]), -most, most).astype(np.int64)


class Orchard:
    """Nearest entries by squared distance, ties to the lower index.

    Every entry has a list of all entries by their distance from it.  A search walks the list of the best entry so far and
    jumps to the list of a better one; entries that were looked at are marked and skipped.  It is over where the list goes
    beyond twice the current distance: by the triangle inequality nothing behind is as near."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.apart = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        self.near = np.argsort(self.apart, axis=1, kind="stable")
        self.start = int(self.apart.astype(float).sum(axis=1).argmin())

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry; the queries walk side by side."""
        n, m = len(queries), len(self.entries)
        best = np.full(n, self.start)
        distance = ((queries - self.entries[self.start]) ** 2).sum(axis=1)
        marked = np.zeros((n, m), bool)
        marked[:, self.start] = True
        place, live = np.zeros(n, np.int64), np.arange(n)
        while len(live):
            at = best[live]
            entry = self.near[at, place[live]]
            on = self.apart[at, entry] <= 4 * distance[live]
            live, entry = live[on], entry[on]
            place[live] += 1
            fresh = ~marked[live, entry]
            who, entry = live[fresh], entry[fresh]
            marked[who, entry] = True
            d = ((queries[who] - self.entries[entry]) ** 2).sum(axis=1)
            better = (d < distance[who]) | (d == distance[who]) & (entry < best[who])
            jump = who[better]
            best[jump], distance[jump], place[jump] = entry[better], d[better], 0
            live = live[place[live] < m]
        return best, distance


def _parts(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Vectors (n, length) as (n, parts, width)."""
    width = -(-vectors.shape[1] // parts)
    filled = np.zeros((len(vectors), parts * width), np.int64)
    filled[:, : vectors.shape[1]] = vectors
    return filled.reshape(len(vectors), parts, width)


def _assign(books: list[Orchard], vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of vectors by parts, with the indexes and squared distances of their parts."""
    for i in range(0, len(vectors), _ROWS):
        cut = _parts(vectors[i : i + _ROWS], len(books))
        found = [book.search(cut[:, p]) for p, book in enumerate(books)]
        yield cut, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def train(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> np.ndarray:
    """Codebooks (parts, entries, width), from the parts of the smallest ids on.

    A round assigns all parts and moves each entry to the componentwise floor of its parts' mean; entries without parts
    stay.  Tasks send one sum for each component of each entry; the driver sees codebooks only, whose size is given by the
    parameters."""
    length = common_length(rows, vector)
    if not length:
        return np.zeros((parts, 0, 0), np.int64)
    first = rows.where(usable(vector) & (F.size(vector) == length)).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    chosen = first.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    _, seeds = integers(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())), length, scale)
    books = _parts(seeds, parts).transpose(1, 0, 2).copy()
    m, width = books.shape[1:]
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            of = [Orchard(b) for b in books]
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for cut, index, _ in _assign(of, integers(batch.column(0), length, scale)[1]):
                    for p in range(parts):
                        np.add.at(total[p], index[:, p], cut[:, p])
                        count[p] += np.bincount(index[:, p], minlength=m)
            p, e = np.nonzero(count)
            p, e, w = np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), len(p))
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (p, e, w, count[p, e], total[p, e, w])], names=["part", "entry", "place", "n", "total"])

        found = rows.select(vector).mapInArrow(sums, "part long, entry long, place long, n long, total long")
        books = books.copy()
        for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """``vec_id, label, codes`` (binary, a byte a part) ``, error``: squared distances to the entries, summed over parts."""
    kinds = dict(rows.dtypes)
    parts, _, width = books.shape
    length = common_length(rows, vector) if width else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Orchard(b) for b in books] if length else []
        for batch in batches:
            if not length:
                continue
            who, vectors = integers(batch.column(2), length, scale)
            at = 0
            for _, index, distance in _assign(of, vectors):
                few = pa.array(who[at : at + len(index)])
                at += len(index)
                codes = index.astype(np.uint8)
                yield pa.record_batch([batch.column(0).take(few), batch.column(1).take(few), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(distance.sum(axis=1))], names=["vec_id", "label", "codes", "error"])

    if books.shape[1] > 256:
        raise ValueError("a code has one byte a part: at most 256 entries")
    some = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return some.mapInArrow(run, f"vec_id {kinds[vec_id]}, label {kinds[label]}, codes binary, error long")


def decode(coded: DataFrame, books: np.ndarray, codes: str = "codes", scale: float = 256.0) -> DataFrame:
    """Adds ``approximation``: the entries of a code one after another, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(books))
        for batch in batches:
            index = [np.frombuffer(c, np.uint8) for c in batch.column(codes).to_pylist()]
            values = [(books[at, i].ravel() / scale).tolist() for i in index]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))], names=[*batch.schema.names, "approximation"])

    given = ", ".join(f"`{n}` {t}" for n, t in coded.dtypes)
    return coded.mapInArrow(run, f"{given}, approximation array<double>")


def compress(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """``vec_id, code`` (two hex digits a part) ``, error, label_error, codebooks_sha256``.

    ``label_error`` is the error summed over equal labels, nulls together.  Codes are settled before they are summed: the
    sums are one row a label, joined back, so a label with very many rows is only ever on the side that can be split."""
    books = train(rows, vec_id, vector, parts, entries, rounds, scale)
    coded = settle(encode(rows, books, vec_id, vector, label, scale))
    summed = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    code = F.lower(F.hex("codes"))
    return coded.join(summed, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
