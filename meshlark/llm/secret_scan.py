"""Secrets in texts: base patterns, and weak parts that only count when they complete each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlark.llm.common import settle
from meshlark.llm.spans import ROW, Kind, mentions, span_report

_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


def _holds(pattern: str):
    return lambda text: text.rlike(pattern)


BASE = (
    Kind("assign", _ASSIGN, _holds("[:=]"), lambda hit: F.char_length(F.regexp_extract(hit, _ASSIGN, 1)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]++", lambda text: F.contains(text, F.lit("AKIA")), lambda hit: F.char_length(hit) >= 20),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", _holds(r"[0-9a-f]{24}")),
)


def entropy(hit: Column) -> Column:
    """Bits a character, by how often each character occurs in the string itself."""
    n = F.char_length(hit)
    share = lambda c: (n - F.char_length(F.replace(hit, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(hit, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", F.lit(0.0)).otherwise(share(c) * F.log2(share(c))))


#: Weak parts: nothing alone.  Names and addresses of accounts, strings too random for words, and where to log in.
WEAK = (
    Kind("id", rf"(?<![A-Za-z0-9])(?i:access_?key_?id|client_?id|account_?id|user_?(?:name|id)?|login){_VALUE}[A-Za-z0-9@._+-]{{3,}}+", _holds("[:=]")),
    Kind("user", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda text: F.contains(text, F.lit("@"))),
    Kind("key", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+", _holds(r"[A-Za-z0-9+/_-]{20}"), lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & (entropy(hit) >= 3.3)),
    Kind(
        "endpoint",
        rf"""https?://[^\s"'<>]++|(?<![A-Za-z0-9])(?i:endpoint|host|server){_VALUE}[A-Za-z0-9.-]++(?::[0-9]++)?+|(?<![0-9.])[0-9]{{1,3}}+(?:\.[0-9]{{1,3}}+){{3}}(?::[0-9]++)?+(?![0-9.]*[0-9])""",
        _holds(r"://|[:=]|[0-9]\.[0-9]"),
    ),
)
#: Where one scope ends and the next begins: blank lines, headings of sections, rules.
BREAK = Kind("break", r"\n[ \t]*+\n\s*+|\n(?=\[[^\]\n]++\])|\n(?=---|===|#)", _holds(r"\n(?:[ \t]*+\n|\[|---|===|#)"))
#: A mail address names an account only where something else of a login stands beside it.
IDENTIFIERS, MAILS, SECRETS, PLACES = ("id", "access"), ("user",), ("key", "assign", "hex"), ("endpoint",)


def with_scopes(parts: DataFrame) -> DataFrame:
    """Adds ``scope``, the number of breaks before a part, and leaves the breaks out."""
    order = Window.partitionBy(*ROW).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("scope", F.count_if(F.col("kind") == BREAK.name).over(order)).where(F.col("kind").isNull() | (F.col("kind") != BREAK.name))


def link_parts(parts: DataFrame, reach: int) -> DataFrame:
    """The weak parts whose complement lies in the same scope, within ``reach`` code points.

    An interval join: a part stands in the stretch of ``reach`` code points where it starts; the parts it may meet are
    listed under every stretch they reach into.  Each side is keyed by document, scope and stretch, so a document with
    many parts spreads over many keys.  Identifiers need a secret, secrets an identifier, endpoints both.  A mail address
    is an identifier only beside an endpoint, or another identifier: texts are full of addresses that have nothing to do
    with the token in the next line.  A weak part that overlaps a base span is that span's, not a part of its own."""
    base = [k.name for k in BASE]
    near = F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach)))
    other = parts.where(F.col("kind").isNotNull()).select(*[F.col(c).alias(f"o_{c}") for c in (*ROW, "scope", "kind", "start", "end")], near.alias("o_stretch"))
    weak = parts.where(F.col("kind").isin(*[k.name for k in WEAK])).withColumn("stretch", F.floor(F.col("start") / reach))
    meets = (F.col("o_start") <= F.col("end") + reach) & (F.col("o_end") >= F.col("start") - reach)
    apart = (F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start"))
    has = lambda kinds: F.bool_or(apart & F.col("o_kind").isin(*kinds))
    same = F.col("doc_id").eqNullSafe(F.col("o_doc_id"))
    for c in (*ROW[1:], "scope", "stretch"):
        same &= F.col(c) == F.col(f"o_{c}")
    seen = (
        weak.join(other, same & meets)
        .groupBy(*ROW, "kind", "start", "end")
        .agg(*[has(kinds).alias(name) for name, kinds in (("with_id", IDENTIFIERS), ("with_mail", MAILS), ("with_secret", SECRETS), ("with_place", PLACES))], F.bool_or(~apart & F.col("o_kind").isin(*base)).alias("taken"))
    )
    kind = F.col("kind")
    named, secret, mail, place = (F.col(f"with_{x}") for x in ("id", "secret", "mail", "place"))
    enough = F.when(kind.isin(*IDENTIFIERS), secret).when(kind.isin(*MAILS), secret & (named | place)).when(kind.isin(*SECRETS), named | mail & place).otherwise(secret & (named | mail))
    return seen.where(enough & ~F.col("taken")).select(*ROW, "kind", "start", "end")


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 400) -> DataFrame:
    """``ROW, kind, start, end``: base spans, linked weak parts, and one row without kind a document.

    Null and empty texts have no spans; documents that share an id, and equal rows, keep rows of their own; an empty
    table gives an empty result; further columns, whatever their names, are passed over.  Whole texts are read, once;
    matches are settled in the shared folder before they are linked."""
    parts = settle(with_scopes(mentions(docs, [*BASE, *WEAK, BREAK], doc_id, text)).select(*ROW, "kind", "start", "end", "scope"))
    weak: Column = F.col("kind").isin(*[k.name for k in WEAK])
    kept = parts.where(F.col("kind").isNull() | ~weak)
    return kept.select(*ROW, "kind", "start", "end").unionByName(link_parts(parts, reach))


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 400) -> DataFrame:
    return span_report(find_secrets(docs, doc_id, text, reach), [k.name for k in BASE], [k.name for k in WEAK])
