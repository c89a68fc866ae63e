"""Exact substring dedup: difference-cover anchors link equal places, and links extend as far as the words agree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import settle
from meshlark.llm.textwords import PLAIN, Words, grams, mixed, words_of

#: Every residue modulo the period is a difference of two members, so for any two positions there is a shift below the
#: period that brings both onto the cover.
PERIOD, COVER = 7, (0, 1, 3)
#: A link is compared within blocks of so many words of the document that it leads to.
BLOCK = 64
#: Equal anchors are first combined within so many bytes of text.
_STRETCH = 1 << 20
_INT = pa.int64()
_LINK = "doc long, key long, pos long, m_doc long, m_key long, m_pos long"
_LINK_NAMES = [x.split()[0] for x in _LINK.split(", ")]
_REQUEST = ["m_doc", "m_key", "block"]


def _starts(words: Words, size: int) -> np.ndarray:
    """For each word whether ``size`` words of its text begin there."""
    able = np.zeros(len(words.hashes), bool)
    for b, s in zip(words.begins, words.stops):
        if s - b >= size:
            able[b : s - size + 1] = True
    return able


def _texts(words: Words) -> np.ndarray:
    """The text that each word is in."""
    return np.repeat(np.arange(len(words.begins)), words.stops - words.begins)


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Index of the first entry of the run of equal entries that each one is in."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _last_of_run(first: np.ndarray) -> np.ndarray:
    ends = np.append(np.flatnonzero(np.diff(first)), len(first) - 1)
    return np.repeat(ends, np.diff(np.append(-1, ends)))


def _batch(columns: list[np.ndarray], names: list[str], null: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
    null = null or {}
    return pa.record_batch([pa.array(c, _INT, mask=null.get(n)) for c, n in zip(columns, names)], names=names)


def anchors(own: DataFrame, window: int) -> DataFrame:
    """``h, salt, doc, key, mark, m_doc``: anchors of every text.

    An anchor is a run of ``window - PERIOD + 1`` words that begins at a cover position.  Two equal windows share an
    anchor at the same offset: some shift below the period brings both of their begins onto the cover.

    Within a stretch of texts the document with the smallest id leads: its places of an anchor go to where all of
    their hash meet (salt 0), and the others link to its first place at once.  So a hot anchor sends one document a
    stretch.  ``mark`` is twice the place, and one more for a leader that others link to.  Links have the key of the
    leader for their hash, and its place, doubled and one more, for their salt."""
    size = window - PERIOD + 1
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    names = ["h", "salt", "doc", "key", "mark", "m_doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in words_of(batch.column(2), PLAIN, _STRETCH):
                text = _texts(w)
                place = np.arange(len(text)) - w.begins[text]
                at = np.flatnonzero(_starts(w, size) & on[place % PERIOD])
                h, place, doc, key = grams(w.hashes, size, at).view(np.int64), place[at], ids[w.first + text[at]], keys[w.first + text[at]]
                order = np.lexsort((place, key, doc, h))
                h, place, doc, key = h[order], place[order], doc[order], key[order]
                first = _runs(h)
                linked = doc > doc[first]
                led = linked[_last_of_run(first)] & ~linked if len(h) else linked
                columns = [np.where(linked, key[first], h), np.where(linked, 2 * place[first] + 1, 0), doc, key, 2 * place + led, np.where(linked, doc[first], 0)]
                yield _batch(columns, names)

    return own.select("doc", "key", "text").mapInArrow(run, "h long, salt long, doc long, key long, mark long, m_doc long")


def linked_anchors(own: DataFrame, window: int) -> DataFrame:
    """Links from anchors sorted by hash.

    All leaders of a hash link to one place: its first, in the document with the smallest id.  That document's other
    places have no link and stand as witnesses, and so does the first place if others than leaders share the hash.
    So of any two documents that share a window, one links to the other, or a link of the later one fails and the
    earlier one is a witness or has a link that fails as well: then :func:`linked_windows` brings them together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the first place of the run that the batch before ended in
        for batch in batches:
            h, salt, doc, key, mark, m_doc = (batch.column(i).to_numpy() for i in range(6))
            linked = salt != 0
            if linked.any():
                yield _batch([x[linked] for x in (doc, key, mark >> 1, m_doc, h, salt >> 1)], _LINK_NAMES)
            h, doc, key, mark = (x[~linked] for x in (h, doc, key, mark))
            if not len(h):
                continue
            first, place, led = _runs(h), mark >> 1, mark & 1 == 1
            last = _last_of_run(first)
            m_doc, m_key, m_place = doc[first], key[first], place[first]
            begins = first == np.arange(len(h))
            if held and held[0] == h[0]:
                own_run = first == 0
                begins[0] = False
                m_doc, m_key, m_place = (np.where(own_run, v, x) for v, x in zip(held[1:], (m_doc, m_key, m_place)))
            held = (h[-1], m_doc[-1], m_key[-1], m_place[-1])
            link = doc > m_doc
            ends = np.flatnonzero(last == np.arange(len(h)))
            asked = ends[np.logical_or.reduceat(led, first[ends])]
            # a run at the edge of a batch may have other documents in the next one
            others = link[last] | (last == len(h) - 1) | np.isin(last, asked)
            some = link | (~begins & others)
            nobody = ~link[some]
            yield _batch([x[some] for x in (doc, key, place, m_doc, m_key, m_place)], _LINK_NAMES, dict.fromkeys(_LINK_NAMES[3:], nobody))
            none = np.ones(len(asked), bool)
            yield _batch([x[asked] for x in (m_doc, m_key, m_place) * 2], _LINK_NAMES, dict.fromkeys(_LINK_NAMES[3:], none))

    return anchors(own, window).repartition("h", "salt").sortWithinPartitions("h", "salt", "doc", "key", "mark").mapInArrow(run, _LINK)


def _excerpts(links: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """``doc, key, links``: per document the blocks that its links lead to, with their words and the linked places.

    Links on one diagonal share a block; ``at`` has a bit for each of its places.  A block has enough words on both
    sides for every window that holds a linked anchor.  Each block is cut out once, however many lead to it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, numbers, said = [], [], [], []
            for doc, key, text, blocks in zip(*[batch.column(i) for i in range(4)]):
                words = text.as_py().encode().split()
                for b in blocks.as_py():
                    docs.append(doc.as_py())
                    keys.append(key.as_py())
                    numbers.append(b)
                    said.append(b" ".join(words[max(0, b * BLOCK - PERIOD + 1) : (b + 1) * BLOCK + window]))
            yield pa.record_batch([pa.array(docs, _INT), pa.array(keys, _INT), pa.array(numbers, _INT), pa.array(said, pa.binary())], names=[*_REQUEST, "said"])

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("m_pos", F.lit(BLOCK)).cast("int"))
    block = F.floor(F.col("m_pos") / BLOCK).alias("block")
    requests = links.groupBy("doc", "key", "m_doc", "m_key", (F.col("pos") - F.col("m_pos")).alias("diagonal"), block).agg(F.bit_or(one).alias("at"))
    wanted = requests.groupBy("m_doc", "m_key").agg(F.collect_set("block").alias("blocks")).withColumnsRenamed({"m_doc": "doc", "m_key": "key"})
    blocks = texts.join(wanted, ["doc", "key"]).select("doc", "key", "text", "blocks").mapInArrow(cut, "m_doc long, m_key long, block long, said binary").dropDuplicates(_REQUEST)
    return requests.join(blocks, _REQUEST).select("doc", "key", F.struct("diagonal", "block", "at", "said").alias("link"))


def _windows(equal: int, window: int) -> int:
    """From a bit a word that is equal: a bit a place where ``window`` equal words begin."""
    out, size = equal, 1
    while size < window:
        step = min(size, window - size)
        out &= out >> step
        size += step
    return out


def _bit_runs(bits: int) -> Iterator[tuple[int, int]]:
    at = 0
    while bits:
        skip = (bits & -bits).bit_length() - 1
        bits >>= skip
        at += skip
        size = (~bits & (bits + 1)).bit_length() - 1
        yield at, at + size
        bits >>= size
        at += size


def extend(words: list[bytes], links: list[dict], window: int) -> tuple[list[tuple[int, int]], set[int]]:
    """(stretches of words that an earlier document has, begins of windows that the links leave open).

    Each link is followed to both sides for as long as the words agree.  A window that holds a linked anchor but
    doesn't agree with the linked place is open: another document may have it."""
    gone, open_, n, margin = [], set(), len(words), PERIOD - 1
    for x in links:
        origin = x["block"] * BLOCK + x["diagonal"] - margin  # the word that bit 0 stands for
        asked = 0  # begins of the windows that hold a linked anchor
        for before in range(PERIOD):
            asked |= (x["at"] & (1 << 64) - 1) << margin >> before
        whole = 0
        if x["said"] is not None:
            said = x["said"].split(b" ")
            begin = origin + max(0, margin - x["block"] * BLOCK)  # a first block has no words before it
            skip = max(0, -begin)
            own, said = words[begin + skip : begin + len(said)], said[skip:]
            if own == said:
                equal = (1 << len(own)) - 1
            else:
                equal = int("".join("1" if y else "0" for y in map(eq, own, said))[::-1] or "0", 2)
            whole = _windows(equal << (begin + skip - origin), window)
            gone += [(origin + a, origin + b - 1 + window) for a, b in _bit_runs(whole)]
        for a, b in _bit_runs(asked & ~whole):
            open_.update(range(max(0, origin + a), min(origin + b, n - window + 1)))
    return gone, open_


def _pack(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def extended(own: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """``doc, key, gone, open, w1, w2``: what the anchors' links say of each document that has any.

    ``gone`` lists begins and ends of stretches in turn; ``open`` the windows that are left open, with 128 bits of hash."""
    links = found.where(F.col("m_doc").isNotNull())
    alone = F.struct(F.col("pos").alias("diagonal"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("at"), F.lit(None).cast("binary").alias("said"))
    witnesses = found.where(F.col("m_doc").isNull()).select("doc", "key", alone.alias("link"))
    texts = own.select("doc", "key", "text")
    listed = _excerpts(links, texts, window).unionByName(witnesses).groupBy("doc", "key").agg(F.collect_list("link").alias("links"))
    names = ["doc", "key", "gone", "open", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for w in words_of(batch.column(2), PLAIN):
                for i in range(len(w.begins)):
                    said = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split()
                    gone, open_ = extend(said, batch.column(3)[w.first + i].as_py(), window)
                    at = np.array(sorted(open_), np.int64)
                    inside = w.begins[i] + at
                    hashes = (grams(w.hashes, window, inside, other).view(np.int64) for other in (False, True))
                    rows.append((docs[w.first + i], keys[w.first + i], [x for y in gone for x in y], at, *hashes))
            yield _pack(rows, [_INT, _INT, *[pa.list_(_INT)] * 4], names)

    joined = texts.join(listed, ["doc", "key"]).select("doc", "key", "text", "links")
    return joined.mapInArrow(run, "doc long, key long, gone array<long>, open array<long>, w1 array<long>, w2 array<long>")


def linked_windows(left: DataFrame) -> DataFrame:
    """Links between open windows with equal hashes: each leads to a document with a smaller id.

    Within a batch all but the first document of a window are linked at once and only pass by; firsts meet by hash."""
    names = ["w1", "w2", *_LINK_NAMES]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x) for x in batch.column(2)]
            doc, key = (np.repeat(batch.column(i).to_numpy(), sizes) for i in range(2))
            pos, w1, w2 = (batch.column(i).flatten().to_numpy() for i in (2, 3, 4))
            order = np.lexsort((doc, w2, w1))
            doc, key, pos, w1, w2 = (x[order] for x in (doc, key, pos, w1, w2))
            first = _runs(w1, w2)
            linked = doc > doc[first]
            w1 = np.where(linked, mixed(key.view(np.uint64)).view(np.int64), w1)
            columns = [w1, w2, doc, key, pos, doc[first], key[first], pos[first]]
            yield _batch(columns, names, {n: ~linked for n in names[5:]})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            w1, w2, doc, key, pos = (batch.column(i).to_numpy() for i in range(5))
            linked = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            if linked.any():
                yield batch.filter(pa.array(linked)).select(_LINK_NAMES)
            w1, w2, doc, key, pos = (x[~linked] for x in (w1, w2, doc, key, pos))
            if not len(w1):
                continue
            first = _runs(w1, w2)
            m_doc, m_key, m_pos = doc[first], key[first], pos[first]
            if held and held[:2] == (w1[0], w2[0]):
                m_doc, m_key, m_pos = (np.where(first == 0, v, x) for v, x in zip(held[2:], (m_doc, m_key, m_pos)))
            held = (w1[-1], w2[-1], m_doc[-1], m_key[-1], m_pos[-1])
            link = doc > m_doc
            yield _batch([x[link] for x in (doc, key, pos, m_doc, m_key, m_pos)], _LINK_NAMES)

    rows = left.select("doc", "key", "open", "w1", "w2").mapInArrow(spread, f"w1 long, w2 long, {_LINK}")
    return rows.repartition("w1", "w2").sortWithinPartitions("w1", "w2", "doc", "key", "pos").mapInArrow(meet, _LINK)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, kept_sha256``: one row for each row of ``docs``.

    A word goes if a window of ``window`` words that covers it also begins in a document with a smaller id, as the
    documents stand.  Kept words are joined by one space.  Null and empty texts have no words; null ids come before
    all others; rows with the same id never remove each other's words; an empty table gives an empty result; further
    columns, whatever their names, are passed over.

    Places of an anchor link to a place in an earlier document.  A link is followed in both directions as far as the words
    of both texts agree, which settles every window that both have.  Windows that hold a shared anchor but differ from what
    it links to are few; they meet once more by 128 bits of hash, and those links are compared word by word too.  So
    hashes only name candidates: no word goes that an earlier document doesn't have.  Steps are settled in the shared
    folder; texts are shuffled by both comparisons."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    given = F.col(doc_id).cast("long")
    own = docs.select(F.coalesce(given, F.lit(-(1 << 63))).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), given.alias("given")).withColumn("key", F.xxhash64("doc", "text"))
    first = settle(extended(own, settle(linked_anchors(own, window)), window))
    links = settle(linked_windows(first.where(F.size("open") > 0)))
    again = _excerpts(links, own.select("doc", "key", "text"), window).groupBy("doc", "key").agg(F.collect_list("link").alias("links"))
    gone = first.where(F.size("gone") > 0).select("doc", "key", "gone").dropDuplicates(["doc", "key"])
    names = ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for given_, text_, gone_, links_ in zip(*[batch.column(i) for i in range(4)]):
                words = (text_.as_py() or "").encode().split()
                n, removed = len(words), 0
                stretches = gone_.as_py() or []
                if links_.is_valid:
                    stretches += [x for y in extend(words, links_.as_py(), window)[0] for x in y]
                if stretches:
                    steps = np.zeros(n + 1, np.int64)
                    np.add.at(steps, stretches[::2], 1)
                    np.add.at(steps, stretches[1::2], -1)
                    cover = np.cumsum(steps[:-1]) > 0
                    removed = int(cover.sum())
                    words = [x for x, c in zip(words, cover.tolist()) if not c]
                kept = b" ".join(words)
                rows.append((given_.as_py(), n, removed, kept.decode(), hashlib.sha256(kept).hexdigest()))
            yield _pack(rows, [_INT, _INT, _INT, pa.string(), pa.string()], names)

    joined = own.join(gone, ["doc", "key"], "left").join(again, ["doc", "key"], "left").select("given", "text", "gone", "links")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
