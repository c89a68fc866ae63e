"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import settle, text_or_empty

#: A paragraph is a line; a longer one is cut at the first end of a sentence after 200 characters, or after 300.
PARAGRAPH = r"[^\n]{1,200}+[^\n.!?]{0,100}+[.!?]*+"
#: A sketch has three sub-tables with so many cells each; a digest has one cell in each sub-table.
TABLES, CELLS = 3, 4
#: More rounds than any sketch of this size needs; those after the last cost nothing.
ROUNDS = 14
#: A larger sketch has a part for about so many digests of both texts.
PART = 8
_FOUND = "array<struct<s:int,d:bigint>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def digests(text: Column) -> Column:
    """Digests of the distinct paragraphs, in order of value."""
    said = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.btrim(p, F.lit(" \n\r\t"))), lambda p: p != "")
    return F.array_sort(F.array_distinct(F.transform(said, lambda p: F.xxhash64(p))))


def _entries(ds: Column, salt: int) -> Column:
    """Digests with their check sums and a bit for each of their cells."""

    def cells(d: Column) -> Column:
        h = F.xxhash64(d, F.lit(salt))
        at = [F.call_function("shiftleft", F.lit(1 << CELLS * j), F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int")) for j in range(TABLES)]
        return at[0].bitwiseOR(at[1]).bitwiseOR(at[2])

    return F.transform(ds, lambda d: F.struct(d.alias("d"), F.xxhash64(d, F.lit(-1)).alias("h"), cells(d).alias("at")))


def _in_cell(xs: Column, i: Column) -> Column:
    return F.filter(xs, lambda x: F.getbit(x["at"], i) == 1)


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.alias("k"), h.alias("h"))


def sketch(ds: Column, salt: int = 0) -> Column:
    """The cells of a sketch: count, xor of digests and xor of check sums."""
    zero = F.lit(0).cast("bigint")

    def cells(xs: Column) -> Column:
        put = lambda a, x: _cell(a["c"] + 1, a["k"].bitwiseXOR(x["d"]), a["h"].bitwiseXOR(x["h"]))
        return F.transform(F.sequence(F.lit(0), F.lit(TABLES * CELLS - 1)), lambda i: F.aggregate(_in_cell(xs, i), _cell(F.lit(0), zero, zero), put))

    return _let(_entries(ds, salt), cells)


def subtract(a: Column, b: Column) -> Column:
    """The difference of two sketches with the same salt, cell by cell: what both have is gone."""
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column, salt: int = 0) -> Column:
    """The digests in a difference, with 1 for those of the first sketch only and -1 for the other; null if it doesn't
    come apart.

    A cell with one digest (count 1 or -1 and a check sum that fits) is pure.  Each round takes the digests of all
    pure cells, each once, out of all their cells; it ends when none is pure."""
    start = F.struct(cells.alias("t"), F.array().cast(_FOUND).alias("found"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state["t"], lambda c: (F.abs(c["c"]) == 1) & (F.xxhash64(c["k"], F.lit(-1)) == c["h"]))

        def taken(own: Column) -> Column:
            at = lambda c: F.element_at(_entries(F.array(c["k"]), salt), 1)["at"]
            marked = F.transform(own, lambda c: F.struct(c["c"].alias("c"), c["k"].alias("k"), c["h"].alias("h"), at(c).alias("at")))
            out = lambda a, x: _cell(a["c"] - x["c"], a["k"].bitwiseXOR(x["k"]), a["h"].bitwiseXOR(x["h"]))
            rest = _let(marked, lambda xs: F.transform(state["t"], lambda cell, i: F.aggregate(_in_cell(xs, i), cell, out)))
            found = F.concat(state["found"], F.transform(own, lambda c: F.struct(c["c"].alias("s"), c["k"].alias("d"))))
            return F.struct(rest.alias("t"), found.alias("found"), F.lit(False).alias("done"))

        none = F.struct(state["t"].alias("t"), state["found"].alias("found"), F.lit(True).alias("done"))
        return F.when(state["done"], state).otherwise(_let(F.array_distinct(pure), lambda own: F.when(F.size(own) == 0, none).otherwise(taken(own))))

    empty = lambda t: F.forall(t, lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["h"] == 0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(empty(s["t"]), s["found"]))


def _below(ds: Column, bound: Column) -> Column:
    """How many of the ordered digests are smaller, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(F.get(ds, middle) < bound, F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    n = F.size(ds)
    return F.aggregate(F.sequence(F.lit(1), F.char_length(F.bin(n))), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])


def _parts(ds: Column, bits: Column) -> Column:
    """Ordered digests cut into 2^bits parts by their first bits."""
    parts = F.call_function("shiftleft", F.lit(1), bits)
    half = F.floor(parts / 2)
    bound = lambda g: F.call_function("shiftleft", g.cast("long") - half, 64 - bits)
    ends = F.array(F.size(ds))
    cuts = F.when(bits == 0, F.concat(F.array(F.lit(0)), ends)).otherwise(F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), lambda g: _below(ds, bound(g))), ends))
    return _let(cuts, lambda c: F.transform(F.sequence(F.lit(0), parts - 1), lambda g: F.slice(ds, F.get(c, g) + 1, F.get(c, g + 1) - F.get(c, g))))


def _resolved(a: Column, b: Column, salt: int = 1) -> Column:
    """What differs in a part, from sketches of the part; if they don't come apart, from sketches of its quarters."""
    if salt > 3:
        signed = lambda xs, s: F.transform(xs, lambda d: F.struct(F.lit(s).alias("s"), d.alias("d")))
        return F.concat(signed(F.array_except(a, b), 1), signed(F.array_except(b, a), -1)).cast(_FOUND)
    quarter = lambda ds, q: F.filter(ds, lambda d: F.pmod(F.xxhash64(d, F.lit(-salt - 1)), F.lit(4)) == q)
    quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda q: _let(F.struct(quarter(a, q).alias("a"), quarter(b, q).alias("b")), lambda p: _resolved(p["a"], p["b"], salt + 1)))
    return F.coalesce(peel(subtract(sketch(a, salt), sketch(b, salt)), salt), F.flatten(quarters))


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """The digests of one of two texts only, as :func:`peel` gives them.

    The fingerprints' sketches are subtracted and peeled.  If more differs than they hold, larger ones are made of
    the same digests: parts by the first bits of a digest, each a sketch of its own with other hashes; a part that
    doesn't come apart is cut into quarters, twice, and what is left after that (as good as never) is compared as sets."""
    share = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / PART).cast("int"))
    bits = F.char_length(F.bin(share - 1)) - F.when(share == 1, 1).otherwise(0)
    larger = F.flatten(F.zip_with(_parts(a, bits), _parts(b, bits), lambda x, y: _resolved(x, y)))
    return F.coalesce(peel(subtract(sketch_a, sketch_b)), larger)


def likeness(a: Column, b: Column, apart: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(1 - F.size(apart) / total)


def written(text: Column, ds: Column, cells: Column) -> Column:
    """The fingerprint as a string: number of paragraphs, a hash of the text, then the cells in hexadecimal."""
    said = F.transform(cells, lambda c: F.concat_ws(":", c["c"].cast("string"), F.hex(c["k"]), F.hex(c["h"])))
    return F.concat_ws(";", F.size(ds).cast("string"), F.hex(F.xxhash64(text)), F.array_join(said, ";"))


def neighbours(ids: DataFrame) -> DataFrame:
    """Adds ``next``, the (at, there, key) of the next row by descending (at, there, key); the first's after the last.

    Rows are ordered in slices by range; the last row of a slice is followed by the first of the next slice.  One row
    a slice goes through one task."""
    own = F.struct("at", "there", "key")
    order = [F.col(c).desc() for c in ("at", "there", "key")]
    sliced = settle(ids.repartitionByRange(*order).withColumn("slice", F.spark_partition_id()))
    heads = sliced.groupBy("slice").agg(F.max(own).alias("head"))
    following = Window.orderBy("slice")
    firsts = heads.select(F.col("slice"), F.coalesce(F.lead("head").over(following), F.first("head").over(following)).alias("further"))
    after = F.lead(own).over(Window.partitionBy("slice").orderBy(*order))
    return sliced.withColumn("next", after).join(firsts, "slice").withColumn("next", F.coalesce("next", "further")).drop("slice", "further")


def fingerprint_versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and how like they are.

    The edited version has the last floor(n/2) code points replaced by the first as many (or all) of the next document
    by descending id.  Likeness is 1 - d / (a + b): d digests that differ, out of a and b; ``only_text`` and
    ``only_edited`` are those recovered from text and edited version.  Texts without paragraphs are alike (1).

    Null texts count as empty; null ids come last, ties by a hash of the text; rows that are equal in id and text have
    the same next; one document is its own next; an empty table gives an empty result; further columns, whatever their
    names, are passed over.  Neighbours are found on ids.  Texts are shuffled once; what a document needs of the next
    one, its beginning and its digests, follows it."""
    given = F.col(doc_id).cast("long")
    base = docs.select(F.coalesce(given, F.lit(-(1 << 63))).alias("at"), given.isNotNull().alias("there"), text_or_empty(text).alias("text")).withColumn("key", F.xxhash64("text", "there"))
    rows = base.select("at", "there", "key", F.char_length("text").alias("n")).groupBy("at", "key").agg(F.first("there").alias("there"), F.first("n").alias("n"), F.count("*").alias("copies"))
    pairs = settle(neighbours(rows))
    texts = base.select("at", "key", "text")
    asked = pairs.select(F.col("next.at").alias("at"), F.col("next.key").alias("key"), F.col("at").alias("own_at"), F.col("key").alias("own_key"), "there", F.floor(F.col("n") / 2).cast("int").alias("half"))
    told = texts.join(asked, ["at", "key"]).select(F.col("own_at").alias("at"), F.col("own_key").alias("key"), "there", "half", F.left("text", F.col("half")).alias("head"), digests(F.col("text")).alias("nx"))
    if not pairs.where(F.col("copies") > 1).isEmpty():
        told = told.dropDuplicates(["at", "key"])
    body = F.col("text")
    n = F.char_length(body)
    edited = F.concat(F.left(body, n - F.col("half")), F.col("head"))
    d = texts.join(told, ["at", "key"]).select(F.when(F.col("there"), F.col("at")).alias("doc_id"), "text", n.cast("long").alias("n_chars"), edited.alias("edited"), digests(body).alias("own"), digests(edited).alias("ed"), "nx")
    d = d.select("*", F.transform(F.array("own", "ed", "nx"), lambda ds: sketch(ds)).alias("cells"))
    own, ed, nx = (F.get("cells", F.lit(i)) for i in range(3))
    two = F.array(*[F.struct(F.col("own").alias("a"), F.col(x).alias("b"), own.alias("x"), y.alias("y")) for x, y in (("ed", ed), ("nx", nx))])
    d = d.select("*", F.transform(two, lambda p: differing(p["a"], p["b"], p["x"], p["y"])).alias("apart"))
    to_edited, to_next = F.get("apart", F.lit(0)), F.get("apart", F.lit(1))
    side = lambda s: F.array_sort(F.transform(F.filter(to_edited, lambda x: x["s"] == s), lambda x: x["d"]))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(body, F.col("own"), own).alias("fingerprint"),
        written(F.col("edited"), F.col("ed"), ed).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("ed"), to_edited).alias("near_edited"),
        likeness(F.col("own"), F.col("nx"), to_next).alias("near_next"),
        side(1).alias("only_text"),
        side(-1).alias("only_edited"),
    )
