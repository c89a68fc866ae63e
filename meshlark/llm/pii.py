"""Personal data in texts: base patterns give seeds, seeds give lexical patterns, and those discover more identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import settle, text_or_empty
from meshlark.llm.spans import ROW, Kind, last_words, mentions, row_key, span_report

_LOCAL = "[A-Za-z0-9._%+-]"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _small_parts(hit: Column) -> Column:
    # at most 255: up to three digits after leading zeros, as a number
    part = lambda x: (F.char_length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(hit, r"\."), part)


#: A local part can only start where its run of characters starts, or right after the match before: with that and
#: possessive repeats each pattern reads a text once, however long its runs are.
BASE = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _small_parts),
    Kind("card", r"[0-9]++(?:[ -][0-9]++)*+", lambda t: t.rlike("[0-9]"), lambda h: F.char_length(_digits(h)).between(12, 19) & F.call_function("luhn_check", _digits(h))),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda h: F.char_length(_digits(h)).between(9, 15)),
)
#: Words with a digit or an @; identifiers are made of them with single spaces between.
TOKEN = Kind("token", r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", lambda t: t.rlike("[0-9@]"), context=True)
#: Seeds have no more words: a base span that is longer than a mail address has at most 19 digits, one a word at least.
SEED_WORDS = 19
#: What is less than so many letters and digits long identifies nobody by itself, but only in its place.
ALONE = 5
FOUND = "id"


def candidates(found: DataFrame) -> DataFrame:
    """``ROW, start, end, text, left, right``: words with digits or an @ and runs of them, without the marks round them.

    A run has single spaces between its words.  From each word on there are the runs of up to ``SEED_WORDS`` words, which
    is as many as a seed can have, so that none that looks like a seed is missed; a run that goes on for longer is one
    more candidate as a whole.  ``left`` are up to two words before, ``right`` is the word after, on the same line."""
    order = Window.partitionBy(*ROW).orderBy("i")
    last = lambda c: F.lag(c).over(order)
    said = F.concat_ws(" ", F.nullif(last("before"), F.lit("")), last("hit"), F.nullif(F.col("before"), F.lit("")))
    left = F.when(F.col("fresh") | last("hit").isNull(), F.col("before")).otherwise(last_words(said))
    words = found.withColumn("left", left).withColumn("run", F.sum(F.when(F.col("joined") & last("hit").isNotNull(), 0).otherwise(1)).over(order))
    run = Window.partitionBy(*ROW, "run").orderBy("i")
    ahead = F.collect_list(F.struct("hit", "end", "after")).over(run.rowsBetween(0, SEED_WORDS))
    words = words.withColumn("nth", F.row_number().over(run)).withColumn("ahead", ahead)
    of = F.explode(F.sequence(F.lit(1), F.least(F.size("ahead"), F.lit(SEED_WORDS))))
    short = words.select(*ROW, "start", "left", "ahead", of.alias("n"))
    text = F.array_join(F.transform(F.slice("ahead", 1, F.col("n")), lambda x: x["hit"]), " ")
    right = F.coalesce(F.get("ahead", F.col("n"))["hit"], F.get("ahead", F.col("n") - 1)["after"])
    short = short.select(*ROW, "start", "left", text.alias("whole"), F.get("ahead", F.col("n") - 1)["end"].alias("stop"), right.alias("right"))
    long_ = words.where((F.col("nth") == 1) & (F.size("ahead") > SEED_WORDS)).select(*ROW, "run", F.col("start").alias("from"), F.col("left").alias("led"))
    every = words.drop("ahead", "nth").join(long_, [*ROW, "run"]).groupBy(*ROW, "run").agg(F.first("from").alias("start"), F.first("led").alias("left"), F.sort_array(F.collect_list(F.struct("i", "hit"))).alias("hits"), F.max("end").alias("stop"), F.max_by("after", "i").alias("right"))
    whole = every.select(*ROW, "start", "left", F.array_join(F.transform("hits", lambda x: x["hit"]), " ").alias("whole"), "stop", "right")
    rows, text = short.unionByName(whole), F.col("whole")
    front, back = F.regexp_extract(text, r"^[^\p{L}\p{N}+]*", 0), F.regexp_extract(text, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]*$", 0)
    cut = rows.select(*ROW, (F.col("start") + F.char_length(front)).alias("start"), (F.col("stop") - F.char_length(back)).alias("end"), F.substr(text, F.char_length(front) + 1, F.char_length(text) - F.char_length(front) - F.char_length(back)).alias("text"), "left", "right")
    return cut.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def named(text: Column, left: Column, right: Column) -> Column:
    """What a candidate is the same instance as: its text wherever it stands, or, if that is short, between the same words."""
    little = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) < ALONE
    return F.when(little, F.concat_ws("\n", F.lower(text), F.lower(left), F.lower(right))).otherwise(F.lower(text))


def refused(text: Column, left: Column, right: Column) -> Column:
    """Whether a base pattern took the whole candidate, and nothing beside it, and then dropped it (a number that fails its
    check digit, parts over 255, too few digits): such a number is known not to be what it looks like."""
    alone = ~F.coalesce(left, F.lit("")).rlike(r"[0-9][^\p{L}\p{N}]*$") & ~F.coalesce(right, F.lit("")).rlike(r"^[^\p{L}\p{N}]*[0-9]")
    dropped = F.lit(False)
    for kind in BASE:
        dropped = dropped | (text.rlike(f"^(?:{kind.pattern})$") & ~kind.keep(text))
    return alone & dropped


def lexical_patterns(text: Column, left: Column, right: Column, longest: Column) -> Column:
    """The patterns that a candidate is an instance of: its shape (digits as 9, letters as a), and the words next to
    it, one or two before, one after or both, each with its rough shape (short and long runs of digits); and two words
    before it whatever its shape, of which only the longest candidate at a place is one, so that parts of it don't count
    against the pattern."""
    shape = F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "a"), "[0-9]", "9")
    rough = F.regexp_replace(F.regexp_replace(shape, "9{5,}", "N"), "9+", "n")
    one, two, after = F.lower(F.substring_index(left, " ", -1)), F.lower(left), F.lower(right)
    near = lambda name, *words: F.when(F.forall(F.array(*words), lambda w: w != ""), F.concat_ws("|", F.lit(name), *words, rough))
    return F.array_compact(F.array(F.concat(F.lit("shape|"), shape), near("1", one), F.when(F.contains(two, F.lit(" ")), near("2", two)), F.when(longest & F.contains(two, F.lit(" ")), F.concat(F.lit("said|"), two)), near("after", after), near("round", one, after)))


def score_instances(edges: DataFrame, rounds: int, least_seeds: int, sure: float) -> DataFrame:
    """``instance, score`` from the graph of patterns and instances with edges (pattern, instance, seed).

    Seeds score 1, others begin at 0.  In each round a pattern's confidence is the sum of its instances' scores over
    their number and one more, provided ``least_seeds`` of them are sure; an instance scores as its best pattern, and 1
    once that is at least ``sure``.  So instances found in one round are seeds of further patterns in the next.  Scores
    travel along edges by grouped sums."""
    edges = settle(edges)
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        seen = edges.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("support"), F.count("*").alias("n"), F.count_if(F.col("score") >= sure).alias("good"))
        confidence = seen.where(F.col("good") >= least_seeds).select("pattern", (F.col("support") / (F.col("n") + 1)).alias("confidence"))
        best = edges.join(confidence, "pattern", "left").groupBy("instance").agg(F.bool_or("seed").alias("seed"), F.max("confidence").alias("confidence"))
        scores = settle(best.select("instance", F.when(F.col("seed") | (F.col("confidence") >= sure), F.lit(1.0)).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("score")))
    return scores


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, least_seeds: int = 5, sure: float = 0.9) -> DataFrame:
    """``ROW, kind, start, end``: base spans, discovered identifiers (kind ``id``), and one row without kind a document.

    Base entities are the seeds.  Candidates are words with digits or an @ and runs of them; those that a base span has
    are its seed instances, those that overlap one otherwise are no candidates, and neither are those that a base pattern took alone and dropped.  Lexical patterns
    (:func:`lexical_patterns`) and instances form a graph over the whole corpus that :func:`score_instances` scores;
    instances that score at least ``sure`` are identifiers wherever they stand.  So what a base pattern drops because
    it ran into its neighbour is found by what other entities look like.  Of two such spans the longer one counts.

    Null and empty texts have no spans; documents that share an id, and equal rows, keep rows of their own; an empty
    table gives an empty result; further columns, whatever their names, are passed over."""
    every = settle(mentions(docs, [*BASE, TOKEN], doc_id, text))
    base = every.where(F.col("kind").isNull() | (F.col("kind") != TOKEN.name)).select(*ROW, "kind", "start", "end")
    no = F.lit(None).cast("string")
    possible = candidates(every.where(F.col("kind") == TOKEN.name)).withColumn("kind", F.lit(TOKEN.name))
    possible = possible.where(~F.coalesce(refused(F.col("text"), F.col("left"), F.col("right")), F.lit(False)))
    rows = possible.unionByName(base.where(F.col("kind").isNotNull()).select("*", no.alias("text"), no.alias("left"), no.alias("right")))
    token, order = F.col("kind") == TOKEN.name, Window.partitionBy(*ROW).orderBy("start")
    before, after = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    overlaps = (F.coalesce(F.max(F.when(~token, F.col("end"))).over(before), F.lit(0)) > F.col("start")) | (F.coalesce(F.min(F.when(~token, F.col("start"))).over(after), F.lit(1 << 60)) < F.col("end"))
    same = F.max(F.when(~token, F.lit(True))).over(Window.partitionBy(*ROW, "start", "end")).isNotNull()
    judged = rows.withColumn("seed", same).withColumn("taken", overlaps).where(token & (F.col("seed") | ~F.col("taken"))).withColumn("longest", F.col("end") == F.max("end").over(Window.partitionBy(*ROW, "start")))
    judged = settle(judged.select(*ROW, "start", "end", "seed", named(F.col("text"), F.col("left"), F.col("right")).alias("instance"), lexical_patterns(F.col("text"), F.col("left"), F.col("right"), F.col("longest")).alias("patterns")))
    edges = judged.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"))
    sure_ = score_instances(edges, rounds, least_seeds, sure).where(F.col("score") >= sure).select("instance")
    new = judged.where(~F.col("seed")).join(sure_, "instance").select(*ROW, "start", "end")
    earlier = order.rangeBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.max("end").over(earlier), F.lit(-1)) >= F.col("end")) | (F.max("end").over(before) > F.col("end"))
    outer = new.withColumn("inside", inside).where(~F.col("inside")).select(*ROW, F.lit(FOUND).alias("kind"), "start", "end")
    return base.unionByName(outer)


def pii_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return span_report(find_pii(docs, doc_id, text), [k.name for k in BASE], [FOUND])


def mask_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``length`` brought up to date.

    Overlapping spans are merged; the first names the replacement.  Documents without spans pass unchanged, null texts
    too.  Rows are told apart by id and text, so that documents that share an id are masked each by its own spans.
    Ties and repeated rows are masked alike; an empty table gives an empty result; further columns are kept, and none
    may begin with two underscores."""
    spans = find_pii(docs, doc_id, text).where(F.col("kind").isNotNull() & (F.col("row_copy") == 1))
    listed = spans.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("__spans"))
    joined = docs.join(listed, F.col(doc_id).eqNullSafe(F.col("__id")) & (row_key(doc_id, text) == F.col("__key")), "left")
    body = text_or_empty(text)

    # pieces: (text kept before, replacement) for each span, from the end of the one before
    def piece(x: Column, i: Column) -> Column:
        prior = F.aggregate(F.slice("__spans", 1, i), F.lit(0).cast("long"), lambda a, y: F.greatest(a, y["end"]))
        kept = F.substr(body, (prior + 1).cast("int"), F.greatest(x["start"] - prior, F.lit(0)).cast("int"))
        return F.when(x["start"] >= prior, F.concat(kept, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))

    last = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, y: F.greatest(a, y["end"]))
    masked = F.concat(F.array_join(F.transform("__spans", piece), ""), F.substr(body, (last + 1).cast("int")))
    some = F.col("__spans").isNotNull()
    changed = {text: F.when(some, masked).otherwise(F.col(text)), length: F.when(some, F.char_length(masked).cast("long")).otherwise(F.col(length)) if length in docs.columns else None}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])
