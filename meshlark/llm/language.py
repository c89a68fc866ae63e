"""Language ID by Bayesian evidence fusion: text, declared language, address suffix and host."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm.common import drop_rows, settle
from meshlark.llm.textwords import string_parts

UNKNOWN = "und"
#: Byte trigrams are hashed into so many buckets.
BUCKETS = 1 << 16
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
#: Bytes of a text that are scored at once.
_PIECE = 1 << 20


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Buckets of the overlapping byte trigrams of a text, A-Z lower-cased."""
    b = _FOLD[raw]
    mixed = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) if len(b) > 2 else b[:0]
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def train(labelled: DataFrame, language_rows: int = 5_000, least_rows: int = 1, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of trigrams (bucket x language) from distinct texts (text, lang) of each label.

    Every label that occurs is a language.  A label with at most ``language_rows`` distinct texts gives all of them,
    another about so many: those with the smallest hashes, the same in every run.  Counts are taken where the
    rows are and only their sums reach the driver: at most 65,536 a label, so a label costs 256 KB of the model.
    ``smoothing`` is the most that is added to a count."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = settle(labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")))
    shares = sizes.select("lang", (F.lit(float(language_rows)) / F.col("n") * (1 << 30)).alias("below"))
    drawn = labelled.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("below"))
    # copies of a text count once
    labelled = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            offsets, data = string_parts(batch.column(0))
            for i, lang in enumerate(batch.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                rows[lang] = rows.get(lang, 0) + 1
                own += np.bincount(trigrams(data[offsets[i] : offsets[i + 1]]), minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(own[at], rows[lang]))], names=["lang", "bucket", "n"])

    summed = labelled.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = settle(summed)
    languages = sorted(r["lang"] for r in summed.where((F.col("bucket") == -1) & (F.col("n") >= least_rows)).select("lang").collect())
    model = np.zeros((BUCKETS, len(languages)), np.float32)
    for at in range(0, len(languages), 16):  # so many at once on the driver
        some = languages[at : at + 16]
        own = summed.where(F.col("lang").isin(some) & (F.col("bucket") >= 0)).select("lang", "bucket", "n").toArrow()
        counts = np.zeros((BUCKETS, len(some)))
        column = np.searchsorted(np.array(some, object), np.array(own["lang"].to_pylist(), object))
        counts[own["bucket"].to_numpy(), column] += own["n"].to_numpy()
        # no more is added than there are trigrams seen: else a label of few texts would be as likely as none for any text
        counts += np.minimum(smoothing, np.count_nonzero(counts, axis=0) / BUCKETS + 1e-6)
        model[:, at : at + 16] = np.log(counts / counts.sum(axis=0, keepdims=True))
    return languages, model


def likelihoods(rows: DataFrame, model: np.ndarray, markup: bool = False) -> DataFrame:
    """Adds ``seen`` (trigrams) and ``text_ll``: log likelihoods of the whole text, the last for no known language.

    That one gives every bucket the same probability.  With ``markup``, tags are taken out first."""
    spread = rows.sparkSession.sparkContext.broadcast(model)
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            if markup:
                column = pa.array([plain_text(x.as_py() or "") for x in column], pa.large_string())
            offsets, data = string_parts(column)
            table = spread.value
            seen, out = [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                total = np.zeros(table.shape[1])
                for at in range(s, max(s, e - 2), _PIECE):
                    total += table[trigrams(data[at : min(e, at + _PIECE + 2)])].sum(axis=0, dtype=np.float64)
                n = max(0, e - s - 2)
                seen.append(n)
                out.append([*total.tolist(), -n * float(np.log(BUCKETS))])
            yield pa.record_batch([*[batch.column(batch.schema.get_field_index(c)) for c in others], pa.array(seen, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=[*others, "seen", "text_ll"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, seen long, text_ll array<double>")


_HIDDEN = re.compile(r"<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)


def plain_text(html: str) -> str:
    return _HIDDEN.sub(" ", html)


def _softmax(lls: Column) -> Column:
    top = F.array_max(lls)
    powers = F.transform(F.arrays_zip(lls.alias("x"), F.array_repeat(top, F.size(lls)).alias("t")), lambda s: F.exp(s["x"] - s["t"]))
    return F.element_at(F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y))), 1)


def identify(scored: DataFrame, languages: list[str], strength: float = 10.0, temper: float = 0.3, unknown_share: float = 0.001, least: float = 0.5) -> DataFrame:
    """Fuses evidence; ``scored`` has ``text_ll``, ``declared``, ``suffix``, ``host`` (any may be null) and more.

    Adds ``lang``, ``confidence`` and ``accepted`` (in place of columns with these names) and leaves out ``text_ll``; other
    columns stay, and none may begin with two underscores.  The posterior of a language is the tempered text likelihood times
    the probability of what the markup declares given the language, times the host's prior.  Priors are shares of
    languages by text alone, summed over all rows by host, suffix and altogether, each smoothed by ``strength`` rows
    of the level above; a missing host or suffix is a group of its own.  Neighbouring trigrams depend on each other,
    so their likelihood counts by ``temper``.  A row is rejected if no known language is most likely, or the most
    likely has less than ``least``."""
    classes = [*languages, UNKNOWN]
    n = len(classes)
    start = F.array(*[F.lit(float(np.log((1 - unknown_share) / max(1, n - 1)))) for _ in languages], F.lit(float(np.log(unknown_share))))
    told = F.when(F.col("declared").isNull(), F.lit(None)).when(F.col("declared").isin(*languages), F.col("declared")).otherwise(F.lit("other")) if languages else F.lit(None).cast("string")
    rows = scored.withColumn("__told", told.cast("string")).withColumn("__base", F.transform("text_ll", lambda x: x * temper))
    rows = rows.withColumn("__p", _softmax(F.zip_with("__base", start, lambda a, b: a + b)))
    sums = [F.sum(F.get("__p", F.lit(i))).alias(f"n{i}") for i in range(n)]
    # one aggregation over the rows; the levels above come from its small result
    by_host = rows.groupBy("host", "suffix", "__told").agg(*sums)
    by_host = settle(by_host)
    counts = [F.sum(f"n{i}").alias(f"n{i}") for i in range(n)]
    total = by_host.agg(*counts).first()
    known = [float(x or 0.0) for x in total]
    share = [(x + strength * (unknown_share if i == n - 1 else (1 - unknown_share) / max(1, n - 1))) / (sum(known) + strength) for i, x in enumerate(known)]

    # arrays, so that plans grow in proportion to the languages
    def smoothed(above: Column, of: str) -> tuple[Column, Column]:
        own = F.array(*[F.col(f"n{i}") for i in range(n)])
        all_ = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda x, y: x + strength * y).alias(of), (all_ + strength).alias("of_all")

    def prior(rows: DataFrame, keys: list[Column], above: Column, of: str) -> DataFrame:
        return rows.select(*keys, *smoothed(above, "raised")).select("*", F.transform("raised", lambda x: x / F.col("of_all")).alias(of)).drop("raised", "of_all")

    suffixes = prior(by_host.groupBy("suffix").agg(*counts), [F.col("suffix")], F.array(*map(F.lit, share)), "suffix_prior")
    hosts = by_host.groupBy("host", "suffix").agg(*counts).alias("h").join(suffixes.alias("s"), F.col("h.suffix").eqNullSafe(F.col("s.suffix")))
    hosts = prior(hosts, [F.col("host").alias("__host"), F.col("h.suffix").alias("__suffix")], F.col("suffix_prior"), "__prior")
    # P(declared | language): a small table of (languages + 1) x (languages + 2) at most
    said = {r["__told"]: [float(r[f"n{i}"] or 0) for i in range(n)] for r in by_host.where(F.col("__told").isNotNull()).groupBy("__told").agg(*counts).collect()}
    odds = [(value, [float(np.log((own[i] + 1) / (known[i] + len(said) + 1))) for i in range(n)]) for value, own in said.items()]
    declared = F.coalesce("__odds", F.array(*[F.lit(0.0)] * n))
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(odds, "__told string, __odds array<double>")), "__told", "left") if odds else rows.withColumn("__odds", F.lit(None).cast("array<double>"))
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("__host")) & F.col("suffix").eqNullSafe(F.col("__suffix")))
    ll = F.zip_with(F.zip_with("__base", declared, lambda a, b: a + b), F.transform("__prior", lambda x: F.ln(x)), lambda a, b: a + b)
    fused = joined.withColumn("__post", _softmax(ll))
    best = F.array_max("__post")
    named = fused.withColumn("confidence", best).withColumn("lang", F.get(F.array(*map(F.lit, classes)), F.array_position("__post", F.col("confidence")) - 1))
    accepted = (F.col("lang") != UNKNOWN) & (F.col("confidence") >= least) & (F.col("seen") > 0)
    return named.withColumn("accepted", accepted).drop("__told", "__odds", "__base", "__p", "__host", "__suffix", "__prior", "__post", "text_ll")


def identify_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", language_rows: int = 5_000) -> DataFrame:
    """``doc_id, key, declared, suffix, host, seen, lang, confidence, accepted``: the source stands for the host, ``key``
    hashes id and text.

    The label in ``lang`` trains the text likelihoods and is no evidence for its own row: ``declared`` is null.  Null
    and empty texts, and those in no known language, are rejected; repeated rows and ids keep rows of their own; an
    empty table gives an empty result; further columns, whatever their names, are passed over."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), key.alias("key"), F.col(text).alias("text"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col(source).alias("host"))
    languages, model = train(docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")), language_rows)
    return identify(settle(likelihoods(rows, model)), languages)


def drop_unidentified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without those that are rejected; the others stay as they are, with all their columns.

    Null and empty texts go; repeated rows stay or go together; an empty table gives an empty result."""
    found = identify_documents(docs, doc_id, text, lang, source)
    return drop_rows(docs, found.where(~F.col("accepted")), doc_id, text)


def address_parts(url: Column) -> tuple[Column, Column]:
    """Host and suffix (its last label) of an address, in lower case, null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(host, F.lit("")), F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))


def identify_all(docs: DataFrame, pages: DataFrame, language_rows: int = 5_000) -> DataFrame:
    """Documents and web pages together: ``doc_id`` or ``page_id``, then as :func:`identify_documents`.

    Trigram probabilities come from labelled documents; a page declares its language by ``lang`` of its html tag and
    has a host and a suffix by its address.  Null texts and pages are rejected; empty tables give no rows."""
    none = F.lit(None).cast("string")
    host, suffix = address_parts(F.col("url"))
    own = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"))
    said = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z]{2,3})""", 1)), F.lit(""))
    web = pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), said.alias("declared"), suffix.alias("suffix"), host.alias("host"))
    languages, model = train(docs.select("text", "lang"), language_rows)
    return identify(settle(likelihoods(own, model).unionByName(likelihoods(web, model, markup=True))), languages)
