"""Benchmark decontamination: an FM-index of each training shard, searched backward for test phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import drop_rows, settle
from meshlark.llm.textwords import FOLDED, Words, same_words, words_of

#: Words of a shard: so many bound the memory of its index (about 100 bytes a word while it is built).
SHARD_WORDS = 1 << 19


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Begins of the suffixes in order.  ``symbols`` are at least 1; smaller numbers first; ends before all.

    Ranks by three symbols, then prefix doubling over those suffixes only that still share their rank."""
    n = len(symbols)
    wide = np.zeros(n + 2, np.uint64)
    wide[:n] = symbols
    bits = np.uint64(max(1, int(symbols.max()).bit_length()))
    step = 3 if int(bits) * 3 <= 64 else 2 if int(bits) * 2 <= 64 else 1
    key = wide[:n].copy()
    for k in range(1, step):
        key = (key << bits) | wide[k : n + k]
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    sorted_ = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first
    alone = new & np.append(new[1:], True)
    open_ = order[~alone]
    while len(open_):
        after = open_ + step
        behind = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = (rank[open_].astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        group = key >> np.uint64(32)
        at = np.arange(len(open_))
        new_group = np.ones(len(open_), bool)
        new_group[1:] = group[1:] != group[:-1]
        new = np.ones(len(open_), bool)
        new[1:] = key[1:] != key[:-1]
        of_group = np.maximum.accumulate(np.where(new_group, at, 0))
        of_run = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = group.astype(np.int64) + of_run - of_group
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector a level."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        symbols = symbols.astype(np.int32)
        for level in reversed(range(self.levels)):
            bit = (symbols & np.int32(1 << level)) != 0
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([np.compress(~bit, symbols), np.compress(bit, symbols)])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its end."""
        low, high = np.zeros_like(ends), ends
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            bit = (symbols >> level & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(bit, zeros + low_ones, low - low_ones)
            high = np.where(bit, zeros + high_ones, high - high_ones)
        return high - low


class FMIndex:
    """A full-text index of texts given as word hashes.

    Each text ends in a separator of its own, smaller than any word.  Suffix positions are kept at every ``every``-th
    place and at the begins of texts."""

    def __init__(self, hashes: np.ndarray, begins: np.ndarray, every: int = 8) -> None:
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        texts = len(begins)
        lengths = np.diff(np.append(begins, len(hashes)))
        self.begins = begins + np.arange(texts)  # in the text with separators
        n = len(hashes) + texts
        ends = self.begins + lengths
        order = np.empty(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        order[inner] = word + texts + 1
        order[ends] = np.arange(1, texts + 1)
        suffixes = suffix_order(order)
        symbol = np.zeros(n, np.int64)
        symbol[inner] = word + 1
        self.last = symbol[suffixes - 1]  # position 0 wraps to the last separator
        counts = np.bincount(symbol, minlength=len(self.vocabulary) + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletMatrix(self.last)
        kept = suffixes % every == 0
        first = np.zeros(n, bool)
        first[self.begins] = True
        kept |= first[suffixes]
        self.kept, self.kept_before = kept, np.concatenate([[0], np.cumsum(kept)])
        self.samples = suffixes[kept]

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; 0 for words that the texts don't have."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, 0)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, row) for every occurrence of phrases of one length, given as an array of word hashes."""
        symbols = self.symbols(phrases.reshape(-1)).reshape(phrases.shape)
        alive = np.flatnonzero((symbols > 0).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), len(self.last), np.int64)
        for k in reversed(range(phrases.shape[1])):
            if not len(alive):
                break
            c = symbols[alive, k]
            ranks = self.tree.rank(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = self.before[c] + ranks[: len(c)], self.before[c] + ranks[len(c) :]
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
        many = high - low
        rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(alive, many), rows

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: back along the text to the next place that is kept."""
        out = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows, 0
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.samples[self.kept_before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            c = self.last[at]
            at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """The windows of test items by length, which items have each, and the words as they are written."""

    def __init__(self, items: list[str | None], texts: list[str], window: int) -> None:
        found: dict[bytes, tuple[np.ndarray, set[str]]] = {}
        words: dict[int, set[bytes]] = {}
        for w in words_of(pa.array(texts, pa.string()), FOLDED):
            said = [w.data[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
            for h, x in zip(w.hashes.tolist(), said):
                words.setdefault(h, set()).add(x)
            for i, (b, s) in enumerate(zip(w.begins.tolist(), w.stops.tolist())):
                size = min(window, s - b)
                for k in range(b, s - size + 1) if size else ():
                    owners = found.setdefault(b" ".join(said[k : k + size]), (w.hashes[k : k + size], set()))[1]
                    if items[w.first + i] is not None:
                        owners.add(items[w.first + i])
        #: Hashes in order, with a word of each; those that two words share are compared phrase by phrase.
        self.hashes = np.array(sorted(words), np.uint64)
        self.shared = np.array(sorted(h for h, x in words.items() if len(x) > 1), np.uint64)
        written = [min(words[h]) for h in self.hashes.tolist()]
        self.ends = np.cumsum([len(x) for x in written], dtype=np.int64)
        self.begins = self.ends - np.array([len(x) for x in written], np.int64)
        self.data = np.frombuffer(b"".join(written) + bytes(8), np.uint8)
        self.by_length: list[tuple[np.ndarray, list[bytes], list[set[str]]]] = []
        for size in sorted({len(x[0]) for x in found.values()}):
            own = [(x, *found[x]) for x in found if len(found[x][0]) == size]
            self.by_length.append((np.stack([x[1] for x in own]), [x[0] for x in own], [x[2] for x in own]))


def _confirmed(shard: list[Words], word: np.ndarray, which: np.ndarray, size: int, said: list[bytes], phrases: Phrases) -> np.ndarray:
    """Which of the places found by hash (``size`` words from ``word``) have the words of their phrase, byte for byte."""
    n = sum(len(w.hashes) for w in shard)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, word, 1)
    np.subtract.at(steps, word + size, 1)
    asked = np.cumsum(steps[:-1]) > 0
    other, doubtful, before = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), 0
    for w in shard:
        at = np.flatnonzero(asked[before : before + len(w.hashes)])
        if len(at):
            of = np.minimum(np.searchsorted(phrases.hashes, w.hashes[at]), len(phrases.hashes) - 1)
            other[before + at + 1] = ~same_words(w.data, w.starts[at], w.ends[at], phrases.data, phrases.begins[of], phrases.ends[of])
            doubtful[before + at + 1] = np.isin(w.hashes[at], phrases.shared)
        before += len(w.hashes)
    good = np.diff(np.cumsum(other)[np.stack([word, word + size])], axis=0)[0] == 0
    doubt = np.diff(np.cumsum(doubtful)[np.stack([word, word + size])], axis=0)[0] > 0
    firsts = np.cumsum([0, *[len(w.hashes) for w in shard]])
    for i in np.flatnonzero(doubt).tolist():
        k = int(np.searchsorted(firsts, word[i], "right")) - 1
        w, b = shard[k], int(word[i] - firsts[k])
        good[i] = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[b : b + size], w.ends[b : b + size])) == said[which[i]]
    return good


def _hits(shard: list[Words], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """For a shard: whether each word is hit, the bounds of its texts, and the items of each text.

    The index works on hashes of words; what it finds counts only if the words themselves are equal."""
    hashes = np.concatenate([w.hashes for w in shard])
    sizes = np.concatenate([w.stops - w.begins for w in shard])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    items: list[set[str]] = [set() for _ in sizes]
    steps = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) and phrases.by_length:
        index = FMIndex(hashes, bounds[:-1])
        for array, said, owners in phrases.by_length:
            which, rows = index.search(array)
            if len(rows):
                at = index.locate(rows)
                text = np.searchsorted(index.begins, at, "right") - 1
                word = at - text  # without separators
                good = _confirmed(shard, word, which, array.shape[1], said, phrases)
                which, text, word = which[good], text[good], word[good]
                np.add.at(steps, word, 1)
                np.subtract.at(steps, word + array.shape[1], 1)
                for p, t in np.unique(np.stack([which, text], axis=1), axis=0).tolist():
                    items[t].update(owners[p])
    return np.cumsum(steps[:-1]) > 0, bounds, items


_SCHEMA = "doc_id long, key long, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"
_SPAN = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))


def _search_shards(docs: DataFrame, phrases: Phrases) -> DataFrame:
    spread = docs.sparkSession.sparkContext.broadcast(phrases)

    def report(shard: list[Words], ids: list, keys: list) -> pa.RecordBatch:
        hit, bounds, items = _hits(shard, spread.value)
        starts, ends = np.concatenate([w.starts for w in shard]), np.concatenate([w.ends for w in shard])
        home = [(w, i) for w in shard for i in range(len(w.begins))]
        spans = []
        for t, (w, i) in enumerate(home):
            own = hit[bounds[t] : bounds[t + 1]]
            if not own.any():
                spans.append([])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            # merged spans, in words and in code points: bytes that don't continue a character
            lead = np.concatenate([[0], np.cumsum((w.data[w.offsets[i] : w.offsets[i + 1]] & 0xC0) != 0x80)])
            first, last = edge[::2], edge[1::2]
            begin, end = starts[bounds[t] + first] - w.offsets[i], ends[bounds[t] + last - 1] - w.offsets[i]
            spans.append([dict(first=int(a), last=int(b), start=int(lead[c]), end=int(lead[d])) for a, b, c, d in zip(first, last, begin, end)])
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(spans, _SPAN), pa.array([sorted(own) for own in items], pa.list_(pa.string()))],
            names=["doc_id", "key", "n_words", "spans", "items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, keys, size = [], [], [], 0
        for batch in batches:
            own_ids, own_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for w in words_of(batch.column(2), FOLDED):
                shard.append(w)
                ids += own_ids[w.first : w.first + len(w.begins)]
                keys += own_keys[w.first : w.first + len(w.begins)]
                size += len(w.hashes)
                if size >= SHARD_WORDS:
                    yield report(shard, ids, keys)
                    shard, ids, keys, size = [], [], [], 0
        if shard:
            yield report(shard, ids, keys)

    return docs.mapInArrow(run, _SCHEMA)


def _phrases(tests: DataFrame, window: int) -> Phrases:
    part = tests.toArrow()
    return Phrases(part["item"].to_pylist(), part["text"].to_pylist(), window)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, key, n_words, n_hit, spans, items``: one row for each row of ``docs``; ``key`` hashes id and text.

    A window is ``window`` consecutive words of a test item, or all of an item with fewer; ``spans`` are the merged
    stretches of words inside occurrences of windows (``first``..``last`` in words, ``start``..``end`` in code points,
    ends exclusive), ``items`` the items with a window that occurs, each once, as strings in order.  An item without an
    id hits words but isn't listed; items that share an id are listed once.  Null and empty texts have no words; empty
    tables give no rows or no hits; rows that share an id keep rows of their own; further columns, whatever their
    names, are passed over.

    Documents are indexed in shards where they are read, without a shuffle.  Test items are broadcast in blocks of at
    most about ``block_bytes`` of text; if there is more than one, results are merged by document."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tests = benchmark.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = tests.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = -(-int(total) // block_bytes) or 1
    if blocks == 1:
        found = _search_shards(own, _phrases(tests, window))
    else:  # each block is settled before the next is made, so one block is in memory at a time
        found = _merged([settle(_search_shards(own, _phrases(tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b), window))) for b in range(blocks)])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _merged(searched: list[DataFrame]) -> DataFrame:
    """Union of the spans and items of blocks; a document row is as often in the result as in each block."""
    every = searched[0]
    for s in searched[1:]:
        every = every.unionByName(s)
    one = every.groupBy("doc_id", "key").agg(
        F.first("n_words").alias("n_words"),
        (F.count("*") / len(searched)).cast("int").alias("copies"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )

    def join(acc, x):
        last = F.element_at(acc, -1)
        touching = (F.size(acc) > 0) & (F.when(F.size(acc) > 0, last["last"]).otherwise(F.lit(-1)) >= x["first"])
        wider = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(touching, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>")
    merged = one.withColumn("spans", F.when(F.size("s") == 0, empty).otherwise(F.aggregate("s", empty, join)))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc_id", "key", "n_words", "spans", "items")


def is_contaminated():
    """The rule for whole documents: words are hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; those with a few hits among many words stay as they are.

    Null and empty texts stay; repeated rows stay or go together; empty tables change nothing."""
    bad = contamination(docs, benchmark, doc_id, text).where(is_contaminated())
    return drop_rows(docs, bad, doc_id, text)
