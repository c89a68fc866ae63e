"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees, and their components.

The pipeline's stage takes these links first, checks them on the shingle sets, and adds by min-hashes those that differ in more bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import settle

SEED = 42
#: The fingerprint of a text without words.
NOTHING = 0


def simhash(text: str, shingle: int = 3) -> int:
    """A bit is set if it is set in more than half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return NOTHING
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    size = min(shingle, len(words))
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(line[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``doc_id, code``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([simhash(t.as_py() or "", shingle) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, code long")


class BKTree:
    """Codes in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, code: int) -> None:
        node, new = 0, len(self.codes)
        self.codes.append(code)
        self.children.append({})
        while node != new:
            node = self.children[node].setdefault((code ^ self.codes[node]).bit_count(), new)

    def within(self, code: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` away; only edges that can lead there are followed."""
        found, stack = [], [0] if self.codes else []
        codes, children = self.codes, self.children
        while stack:
            node = stack.pop()
            d = (code ^ codes[node]).bit_count()
            if d <= radius:
                found.append(node)
            below = children[node]
            if below:
                stack += [child for key, child in below.items() if d - radius <= key <= d + radius]
        return found


def _linked(codes: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Enough pairs within the radius to connect all that are connected: a spanning forest, never all pairs."""
    tree, parent = BKTree(), list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for new, code in enumerate(codes):
        for node in tree.within(code, radius):
            a, b = root(new), root(node)
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield code, codes[node]
        tree.add(code)


def _blocks(count: int, bits: list[int]) -> list[int]:
    """Masks that cut the given bits into ``count`` blocks of about equal width."""
    cuts = [round(i * len(bits) / count) for i in range(count + 1)]
    return [sum(1 << b for b in bits[cuts[i] : cuts[i + 1]]) for i in range(count)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(shards: DataFrame, radius: int, blocks: int, agree: int) -> DataFrame:
    """``code, used, shard``: rows cut by the bits that no cut has used yet.

    Those are dealt into ``blocks`` blocks; every ``agree`` of them name a shard.  Codes that differ in at most
    ``blocks - agree`` bits meet in one, so with at least ``radius`` such bits no pair is lost."""
    made: dict[int, list[int]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh64_intdigest
        for batch in batches:
            out = []
            for code, used, shard in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if used not in made:
                    free = [i for i in range(64) if not used >> i & 1]
                    made[used] = [sum(c) for c in combinations(_blocks(min(blocks, len(free)), free), agree)]
                for mask in made[used]:
                    key = b"%d %d %d" % (shard, mask, code & mask)
                    out.append((code, _signed((used | mask) & (1 << 64) - 1), _signed(of(key, SEED))))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 3, names=["code", "used", "shard"])

    return shards.select("code", "used", "shard").mapInArrow(run, "code long, used long, shard long")


def links(codes: DataFrame, radius: int = 3, shard_limit: int = 20_000) -> DataFrame:
    """``a, b``: pairs of distinct codes within the radius that connect all such pairs.

    Codes cut into b blocks agree in at least b - radius of them if they differ in at most ``radius`` bits, so every
    pair meets in the shard of some b - radius blocks.  A shard is searched with its own BK-tree.  The number of
    blocks grows with the number of codes; shards beyond ``shard_limit`` are cut again by blocks of the bits that are
    left, in the same exact way, until none is or too few bits are left to tell more codes apart than that."""
    n = codes.count()
    b = radius + 1
    while b < radius + 6 and n >> (64 * (b - radius) // b) > 64:
        b += 1
    start = codes.select("code", F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("shard"))
    keyed, done = _cut(start, radius, b, b - radius), None
    enough = F.bit_count("used") <= 64 - 2 * (radius + 1)
    while True:
        sizes = keyed.where(enough).groupBy("shard").count()
        large = settle(sizes.where(F.col("count") > shard_limit).select("shard"))
        if large.isEmpty():
            break
        small = keyed.join(large, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        keyed = settle(_cut(keyed.join(large, "shard"), radius, radius + 1, 1))
    keyed = keyed if done is None else done.unionByName(keyed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done(held: list[int]) -> list[tuple[int, int]]:
            return [(_signed(x), _signed(y)) for x, y in _linked(held, radius)] if len(held) > 1 else []

        for batch in batches:
            out = []
            for code, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != shard:
                    out += done(held)
                    shard, held = own, []
                if not held or held[-1] != code & (1 << 64) - 1:
                    held.append(code & (1 << 64) - 1)
            yield _pairs(out)
        yield _pairs(done(held))

    return keyed.select("code", "shard").repartition("shard").sortWithinPartitions("shard", "code").mapInArrow(search, "a long, b long").distinct()


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node of each node's component, by contraction.

    In a round each node points to the least node next to it, pointers are followed to their ends by doubling, and edges
    become edges between the ends; those inside of one go.  So a round's rows are the edges that are left, not all of
    them once more.  Every round is settled in the shared folder."""
    rest = settle(_between(edges))
    labels = None
    while labels is None or not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(rest.select(F.col("b").alias("node"), F.col("a").alias("other")))
        ends = settle(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
        while True:
            moved = settle(ends.join(ends.toDF("label", "further"), "label").select("node", F.col("label").alias("old"), F.col("further").alias("label")))
            ends = moved.select("node", "label")
            if moved.where(F.col("old") != F.col("label")).isEmpty():
                break
        rest = settle(_between(rest.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))))
        labels = ends if labels is None else settle(_led_on(labels, ends))
    return labels


def _between(edges: DataFrame) -> DataFrame:
    """Distinct edges of different nodes, the lesser first."""
    return edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _led_on(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``labels`` with the labels that ``further`` has for them."""
    return labels.join(further.toDF("label", "__further"), "label", "left").select("node", F.coalesce("__further", "label").alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each row of ``docs``.

    Texts are lower-cased (A-Z); shingles are ``shingle`` words, repeats included, and a text with fewer words is one
    shingle.  Texts without words (null, empty) have fingerprint zero and link like any other.  Documents whose
    fingerprints differ in at most ``radius`` bits are linked; a component's id is its smallest doc_id.  Documents
    with equal fingerprints are one node, so exact copies cost no links.  An empty table gives an empty result."""
    coded = settle(fingerprints(docs, doc_id, text, shingle))
    nodes = coded.groupBy("code").agg(F.min("doc_id").alias("first"))
    labels = components(links(nodes.select("code"), radius))
    named = nodes.join(labels.withColumnRenamed("node", "code"), "code", "left").withColumn("label", F.coalesce("label", "code"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of_code = named.join(least, "label").select("code", "component_id")
    return coded.join(of_code, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


#: Min-hashes of a text: bands of rows.  At similarity 0.8 a pair shares no band once in 300,000 pairs.
BANDS, ROWS = 32, 5
#: Min-hashes of a sketch: those of the bands, and more that make candidates surer.
HASHES = 4 * BANDS * ROWS
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, (2, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles, as in :func:`simhash`; none for a text without words."""
    words = text.encode().lower().split()
    size = min(shingle, len(words))
    of = xxhash.xxh64_intdigest
    return np.unique(np.array([of(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)] if words else [], np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, (hashes[i : i + (1 << 12), None] * _MIX[0] + _MIX[1]).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, key, node, code, sketch, bands``: equal shingle sets are one node; a code is the text's fingerprint as in
    :func:`near_duplicates`, a sketch has a byte of each min-hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh64_intdigest
        for batch in batches:
            nodes, codes, sketches, bands = [], [], [], []
            for t in batch.column(2):
                codes.append(_signed(simhash(t.as_py() or "")))
                hashes = shingle_hashes(t.as_py() or "", shingle)
                least = min_hashes(hashes)
                nodes.append(_signed(of(hashes.tobytes(), SEED)))
                sketches.append(least.astype(np.uint8).tobytes())
                bands.append([_signed(of(x.tobytes(), i)) for i, x in enumerate(least[: BANDS * ROWS].reshape(BANDS, ROWS))])
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(codes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "key", "node", "code", "sketch", "bands"])

    return docs.mapInArrow(run, "doc_id long, key long, node long, code long, sketch binary, bands array<long>")


def _shingled(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` from ``node, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(t.as_py() or "", shingle).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(hashes, pa.binary())], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes binary")


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` whose shingle sets have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) - 1e-9 else 0
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, two = shingles.toDF("a", "x"), shingles.toDF("b", "y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across(rows: DataFrame, least_equal: int, nearest: bool) -> DataFrame:
    """Pairs of nodes of one bucket and part whose labels differ and whose sketches have so many bytes in common; with
    ``nearest`` a node's likest of each other label only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def done() -> list[tuple[int, int]]:
            sketches = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(len(held), -1)
            nodes, labels = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
            band, out = held[0][4], []
            for i in [i for i, x in enumerate(held) if x[2]]:
                other = np.flatnonzero(labels != labels[i])
                alike = (sketches[other] == sketches[i]).sum(axis=1)
                near, alike = other[alike >= least_equal], alike[alike >= least_equal]
                # a pair with several buckets in common leaves in the first of them only
                agree = (sketches[near, : BANDS * ROWS] == sketches[i, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
                mine = ~agree[:, :band].any(axis=1)
                near, alike = near[mine], alike[mine]
                if nearest:
                    order = np.lexsort((nodes[near], -alike, labels[near]))
                    near = near[order[np.unique(labels[near][order], return_index=True)[1]]]
                out += [(min(nodes[i], x), max(nodes[i], x)) for x in nodes[near]]
            return out

        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for bucket, part, *row in zip(*columns):
                if (bucket, part) != shard:
                    out += done() if held else []
                    shard, held = (bucket, part), []
                held.append(row)
            yield _pairs(out)
        yield _pairs(done() if held else [])

    keys = ["bucket", "part"]
    return rows.select(*keys, "node", "label", "home", "sketch", "band").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def _near_prints(coded: DataFrame, radius: int) -> DataFrame:
    """``a, b``: pairs of nodes that connect all whose fingerprints differ in at most ``radius`` bits, as in
    :func:`near_duplicates`: each node with the first of its code, and first ones along the links of BK-trees."""
    codes = settle(coded.select("node", "code").distinct())
    first = settle(codes.groupBy("code").agg(F.min("node").alias("first")))
    same = codes.join(first, "code").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = links(first.select("code"), radius).join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return _between(same.unionByName(near))


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` after the links ``found``: only their labels are contracted, not all earlier links once more."""
    between = found.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return settle(_led_on(labels, components(between)))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, part_rows: int = 256, radius: int = 3) -> DataFrame:
    """``doc_id, component_id``: one row for each row of ``docs``.

    Documents are linked if the Jaccard similarity of their sets of ``shingle`` words is at least ``similarity``;
    every link is checked on the sets.  Candidates come first from fingerprints that differ in at most ``radius`` bits,
    found by BK-trees.  Texts of that similarity often differ in more bits (ten on average), so the others share a bucket
    (a band of min-hashes).  There each node is held against two nodes of each of its buckets: any one, and the one that
    meets most others in its buckets, which is what copies of one text have in common.  Then it is held against all nodes
    of its buckets that are not yet in its component, unless their sketches differ too much (4.5 standard deviations):
    first against the likest of each other component, which joins most of them, then against all of those that are left.
    So a group of near copies costs rows in proportion to its
    size.  Buckets of more than ``part_rows`` are searched in parts: nodes outside the bucket's smallest-labelled
    component go to every part."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    coded = settle(_sketches(own, shingle))
    nodes = settle(coded.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    prints = settle(_near_prints(coded, radius))
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    mixed = F.col("node").bitwiseXOR(F.col("bucket"))  # another centre in each bucket
    stars = members.groupBy("bucket").agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where(F.col("low") < F.col("high"))
    shared = settle(members.join(stars.select("bucket", F.col("low").bitwiseXOR(F.col("bucket")).alias("centre")), "bucket"))
    wanted = shared.select("node").unionByName(prints.select(F.explode(F.array("a", "b")).alias("node"))).distinct().join(nodes.select("node", "key"), "node")
    shingles = settle(_shingled(own.join(wanted, "key").select("node", "text"), shingle).groupBy("node").agg(F.first("hashes").alias("hashes")))
    labels = _joined(nodes.select("node", F.col("node").alias("label")), settle(_verified(prints, shingles, similarity)))

    sizes = shared.groupBy("bucket").agg(F.count("*").alias("n"))
    met = shared.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("met"))
    hubs = shared.select("bucket", "node").join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node"))["node"].alias("hub"))
    pairs = lambda df, other: df.select(F.col("node").alias("a"), F.col(other).alias("b"))
    to_centres = _between(pairs(shared, "centre").unionByName(pairs(shared.join(hubs, "bucket"), "hub")))
    to_centres = settle(to_centres.join(prints, ["a", "b"], "left_anti"))
    labels = _joined(labels, settle(_verified(to_centres, shingles, similarity)))

    parts = F.ceil(F.col("n") / part_rows).cast("int")
    at = F.pmod(F.xxhash64("node"), parts).cast("int")
    least_equal = int(HASHES * similarity - 4.5 * (HASHES * similarity * (1 - similarity)) ** 0.5)
    checked = prints.unionByName(to_centres)
    for nearest in (True, False):
        labelled = settle(shared.select("bucket", "band", "node").join(labels, "node"))
        open_ = labelled.groupBy("bucket").agg(F.min("label").alias("main"), F.max("label").alias("top"), F.count("*").alias("n")).where(F.col("main") < F.col("top")).drop("top")
        dealt = labelled.join(open_, "bucket").withColumn("at", at).withColumn("part", F.explode(F.when(F.col("label") == F.col("main"), F.array("at")).otherwise(F.sequence(F.lit(0), parts - 1))))
        dealt = dealt.withColumn("home", F.col("at") == F.col("part")).join(nodes.select("node", "sketch"), "node")
        rest = settle(_across(dealt, least_equal, nearest).join(checked, ["a", "b"], "left_anti"))
        checked = checked.unionByName(rest)
        labels = _joined(labels, settle(_verified(rest, shingles, similarity)))

    named = nodes.join(labels, "node")
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return coded.select("doc_id", "node").join(named.join(least, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component (:func:`similar_documents`): that with the smallest id, and of
    repeated ids one row."""
    found = settle(similar_documents(docs, doc_id, text))
    extra = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(extra, F.col(doc_id).cast("long").eqNullSafe(F.col("__gone")), "left_anti")
    twice = found.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias("__twice"))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__twice"))
    first = F.row_number().over(Window.partitionBy(doc_id).orderBy(text))
    repeated = kept.join(twice, same, "left_semi").withColumn("__n", first).where(F.col("__n") == 1)
    return kept.join(twice, same, "left_anti").unionByName(repeated.drop("__n")).select(*docs.columns)
