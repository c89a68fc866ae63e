"""Documents as tokens in sequences of one capacity, by harmonic packing.

A piece of length n belongs to the class k = floor(capacity / n): k such pieces fill a sequence, whichever they are.  So a
task counts pieces into sequences class by class and needs no other task; only the fewer than k pieces a class that it is
left with go on, are numbered over all tasks, and fill sequences by the same count.  What then remains, fewer than k pieces
a class over all documents (some thousands at any size of the corpus), is packed by best fit.

A document is cut into whole sequences and a rest.  A rest that would leave much of its class's share empty gives up a
piece of exactly the next class's share first, so that sequences are nearly full.

Null texts are empty; an empty document is its end alone.  Ids may be null or repeated: each row is a document of its own.
Strings of special tokens in a text are ordinary text.  An empty table gives an empty one; further columns are not read."""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import settle, text_or_empty

CAPACITY = 1024
#: A piece may leave empty one part in so many of its share of a sequence.
SLACK = 64
#: Ids of sequences made from leftovers begin here, by class; above all that tasks can count.
_LATER = 1 << 62


# Fixed value: the pattern by which byte-level pre-tokenizers part a text.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The tokens' bytes by id, if merging pairs in the order of ids is what the tokenizer does; else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    if not plain or model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")):
        return None
    # visible bytes stand for themselves, the others for the characters from 256 on
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*visible}))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if made != list(range(256, 256 + len(made))) or not all(set(t) <= byte.keys() for t in vocab):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}


@functools.lru_cache(1)
def encoder(tokenizer: str) -> Callable[[str], bytes]:
    """From a text to its token ids as unsigned 32-bit little-endian numbers, for the content of a tokenizer file.

    Byte-level vocabularies whose merges are in the order of ids are run by ``tiktoken``, which gives the same ids in a fifth
    of the time; all others by ``tokenizers``.  Strings of special tokens are ordinary text."""
    ranks = _ranks(json.loads(tokenizer))
    if ranks is None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(tokenizer)
        whole.encode_special_tokens = True
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    import tiktoken

    fast = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: np.frombuffer(array("i", fast(text)), "i4").astype("<u4", copy=False).tobytes()


def cuts(length: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out, rest = [capacity] * (length // capacity), length % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if (share - rest) * slack <= share:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def tokenize(docs: DataFrame, tokenizer: str, end: int = 0, capacity: int = CAPACITY, slack: int = SLACK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens``: the pieces of each document, its token ids followed by ``end``.

    ``ids`` is binary, unsigned 32-bit little-endian numbers.  ``tokenizer`` is the content of a tokenizer file, which goes
    with the tasks; its size doesn't depend on the documents."""
    kinds = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(sent.value), np.array([end], "<u4").tobytes()
        for batch in batches:
            at, start, length, ids, whole, size = [], [], [], [], [], 0
            for i, t in enumerate(batch.column(1)):
                made = encode(t.as_py()) + last
                n = len(made) // 4
                from_ = 0
                for piece in cuts(n, capacity, slack):
                    at.append(i)
                    start.append(from_)
                    length.append(piece)
                    ids.append(made[4 * from_ : 4 * (from_ + piece)])
                    whole.append(n)
                    from_ += piece
                size += len(made)
                if size > 1 << 23:
                    yield _pieces(batch, at, start, length, ids, whole)
                    at, start, length, ids, whole, size = [], [], [], [], [], 0
            yield _pieces(batch, at, start, length, ids, whole)

    some = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return some.mapInArrow(run, f"doc_id {kinds[doc_id]}, start long, length long, ids binary, doc_tokens long")


def _pieces(batch: pa.RecordBatch, at: list[int], start: list[int], length: list[int], ids: list[bytes], whole: list[int]) -> pa.RecordBatch:
    numbers = [pa.array(x, pa.int64()) for x in (start, length, whole)]
    return pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), numbers[0], numbers[1], pa.array(ids, pa.binary()), numbers[2]], names=["doc_id", "start", "length", "ids", "doc_tokens"])


def _count_in(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id, offset`` (null for what a task is left with) ``, __task, __k, __i``: class and number in it."""
    given = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, rest = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            length = t["length"].to_numpy()
            k = capacity // length
            order = np.argsort(k, kind="stable")
            k, length = k[order], length[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            size = np.diff(np.r_[first, len(k)])
            rank = np.arange(len(k)) - np.repeat(first, size)
            full = size // k[first]
            inside = rank < np.repeat(full * k[first], size)
            number = made + np.repeat(np.cumsum(full) - full, size) + rank // k
            made += int(full.sum())
            before = np.cumsum(length) - length
            offset = before - before[np.arange(len(k)) - rank % k]
            rest = t.take(pa.array(order[~inside]))
            placed = t.take(pa.array(order[inside]))
            n = placed.num_rows
            more = [(task << 32) + number[inside], offset[inside], np.full(n, task), k[inside], rank[inside]]
            yield from _with(placed, [pa.array(x.astype(np.int64)) for x in more])
        if rest is not None:
            length = rest["length"].to_numpy()
            k = capacity // length  # in order of classes
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            rank = np.arange(len(k)) - np.repeat(first, np.diff(np.r_[first, len(k)]))
            none = pa.nulls(len(k), pa.int64())
            yield from _with(rest, [none, none, *[pa.array(x.astype(np.int64)) for x in (np.full(len(k), task), k, rank)]])

    return pieces.mapInArrow(run, f"{given}, sequence_id long, offset long, __task long, __k long, __i long")


def _with(table: pa.Table, more: list[pa.Array]) -> list[pa.RecordBatch]:
    for name, values in zip(("sequence_id", "offset", "__task", "__k", "__i"), more):
        table = table.append_column(name, values)
    return table.combine_chunks().to_batches()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece: the longest first, each into the fullest sequence that has room."""
    room = np.zeros(0, np.int64)
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        fits = np.flatnonzero(room >= lengths[i])
        if not len(fits):
            room, fits = np.append(room, capacity), np.array([len(room)])
        j = fits[room[fits].argmin()]
        number[i], offset[i] = j, capacity - room[j]
        room[j] -= lengths[i]
    return number, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) and ``sequence_id, offset``: no two pieces of a
    sequence overlap, and offsets have no gaps from 0 on."""
    counted = settle(_count_in(pieces, capacity))
    columns = [F.col(f"`{c}`") for c in pieces.columns]
    left = counted.where(F.col("sequence_id").isNull()).drop("sequence_id", "offset")
    # one row a task and class
    tasks = left.groupBy("__task", "__k").agg(F.count("*").alias("n"))
    running = Window.partitionBy("__k").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = tasks.select("__task", "__k", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy("__k")).alias("__n"))
    numbered = left.join(before, ["__task", "__k"]).withColumn("__g", F.col("__before") + F.col("__i")).withColumn("__bin", F.floor(F.col("__g") / F.col("__k")))
    full = F.col("__bin") < F.floor(F.col("__n") / F.col("__k"))
    earlier = Window.partitionBy("__k", "__bin").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    second = numbered.where(full).select(*columns, (F.lit(_LATER) + F.col("__k") * (1 << 40) + F.col("__bin")).alias("sequence_id"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__k", "__g"])
        number, offset = best_fit(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"__k": pdf["__k"], "__g": pdf["__g"], "sequence_id": _LATER + number, "offset": offset})

    few = numbered.where(~full)
    # fewer than k rows of each class k
    fitted = few.select("__k", "__g", "length", F.lit(0).alias("__all")).groupBy("__all").applyInPandas(fit, "__k long, __g long, sequence_id long, offset long")
    third = few.join(fitted, ["__k", "__g"]).select(*columns, "sequence_id", "offset")
    first = counted.where(F.col("sequence_id").isNotNull()).select(*columns, "sequence_id", "offset")
    return first.unionByName(second).unionByName(third)


def sequences(packed: DataFrame, capacity: int = CAPACITY, fill: int = 0) -> DataFrame:
    """``sequence_id, input_ids, doc_starts``: token ids, and where documents' pieces begin, for masks.

    ``packed`` has ``ids``, at most ``capacity`` a sequence.  Sequences are padded with ``fill`` to ``capacity``, but for those
    whose length is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled, starts = [], []
            for row in batch.column("pieces").to_pylist():
                ids = np.frombuffer(b"".join(p["ids"] for p in row), "<u4")
                n = len(ids)
                padded = np.full(n if n & (n - 1) == 0 else capacity, fill, np.int64)
                padded[:n] = ids
                filled.append(padded)
                starts.append([p["offset"] for p in row])
            yield pa.record_batch([batch.column("sequence_id"), pa.array(filled, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], names=["sequence_id", "input_ids", "doc_starts"])

    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))
    return whole.mapInArrow(run, "sequence_id long, input_ids array<long>, doc_starts array<long>")
