"""Chat formatting: records of many layouts to canonical turns, a template, and back."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, by their first character.
ANGLED, BRACKETED = r"<(/?s>|</?SYS|\|)", r"\[(/?INST\])"
TURNS = "array<struct<role:string,content:string>>"


def escape(text: Column) -> Column:
    """Reversible: a backslash becomes ``\\z``; the first character of a control string ``\\l`` or ``\\s``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\z"))
    out = F.regexp_replace(out, ANGLED, r"\\l$1")
    return F.regexp_replace(out, BRACKETED, r"\\s$1")


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\s"), F.lit("["))
    return F.replace(out, F.lit("\\z"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


@dataclass(frozen=True)
class Layout:
    """A declarative mapping.

    ``fields`` is a sequence of (field, role): the field's text is a turn of that role, in this order; with ``joined``,
    neighbours of one role are one turn, a blank line between.
    Or ``items`` is (array field, role field, content field, renamed roles)."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    items: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()
    joined: bool = False

    def paths(self) -> list[tuple[str, ...]]:
        """The sets of nested field paths that records of this layout may have."""
        if self.items:
            return [tuple(sorted(f"{self.items[0]}[].{x}" for x in self.items[1:]))]
        fixed = [f for f, _ in self.fields if f not in self.optional]
        return [tuple(sorted([*fixed, *some])) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]

    def turns(self, has: set[str]) -> Column:
        if self.items:
            array, role, content = self.items

            def turn(x: Column) -> Column:
                named = F.coalesce(x[role], F.lit(""))
                out = named
                for old, new in self.roles:
                    out = F.when(named == old, F.lit(new)).otherwise(out)
                return F.struct(out.alias("role"), F.coalesce(x[content], F.lit("")).alias("content"))

            return F.transform(F.col(array), turn)
        groups: list[tuple[str, list[Column]]] = []
        for f, r in self.fields:
            if f in has:
                if self.joined and groups and groups[-1][0] == r:
                    groups[-1][1].append(F.col(f"`{f}`"))
                else:
                    groups.append((r, [F.col(f"`{f}`")]))
        parts = [F.when(F.coalesce(*xs).isNotNull(), F.struct(F.lit(r).alias("role"), F.concat_ws("\n\n", *xs).alias("content"))) for r, xs in groups]
        return F.array_compact(F.array(*parts))


#: The field names of layouts in common use.
LAYOUTS = (
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout("prompt_completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input"), joined=True),
    Layout("question_answer", fields=(("question", "user"), ("answer", "assistant"))),
)


def _paths(schema: T.StructType, known: set[str], prefix: str = "", present: Column | None = None, at: Column | None = None) -> list[Column]:
    """One column a nested field path of ``known``: the path where the row has it, else null."""
    out = []
    for field in schema.fields:
        here = F.col(f"`{field.name}`") if at is None else at[field.name]
        name, kind = prefix + field.name, field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            for inner in kind.elementType.fields:
                if f"{name}[].{inner.name}" in known:
                    out.append(F.when(here.isNotNull(), F.lit(f"{name}[].{inner.name}")))
        elif isinstance(kind, T.StructType):
            out += _paths(kind, known, name + ".", present, here)
        elif name in known:
            out.append(F.when(here.isNotNull(), F.lit(name)))
    return out


def fingerprint_of(paths: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("|".join(sorted(paths))))


def canonical_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Adds ``schema_fingerprint``, ``layout`` and ``turns`` to records of mixed layouts.

    ``records`` has the union of all layouts' fields, as ``spark.read.json`` gives it; a record has the paths whose
    values are not null.  The hash of its sorted known paths selects the mapping.  Fields no layout knows are passed
    over.  Records that no layout fits get a null layout and no turns; null roles and texts inside a list are empty.
    Columns of the records that are named like the three added ones are replaced, after they have been read as fields;
    others stay.  Equal records have equal results; an empty table gives an empty result."""
    known = {p for x in layouts for paths in x.paths() for p in paths}
    have = _paths(records.schema, known)
    paths = F.array_join(F.sort_array(F.array_compact(F.array(*have))), "|") if have else F.lit("")
    there = {c for c in records.columns} | {f"{f.name}[].{x.name}" for f in records.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) for x in f.dataType.elementType.fields}
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    print_ = F.xxhash64(paths)
    for layout in layouts:
        fits = [p for p in layout.paths() if set(p) <= there]
        if fits:
            hit = print_.isin(*[fingerprint_of(p) for p in fits]) if len(fits) > 1 else print_ == fingerprint_of(fits[0])
            name = F.when(hit, F.lit(layout.name)).otherwise(name)
            turns = F.when(hit, layout.turns(there).cast(TURNS)).otherwise(turns)
    # all three come from the records as given, also where those have columns of these names
    added = {"schema_fingerprint": F.xxhash64(paths), "layout": name, "turns": turns}
    return records.withColumns(added)


def format_chats(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Adds ``segments``, the formatted text in pieces, each with its loss flag, to rows with ``turns``.

    The text is ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn, with control strings inside roles and texts escaped;
    its loss mask covers the texts of ``loss_roles``.  No turns give no segments, null turns null ones; null roles and
    texts are empty.  A column named ``segments`` is replaced; others stay.  An empty table gives an empty result."""

    def piece(t: Column) -> Column:
        seg = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        off = F.lit(False)
        role, content = F.coalesce(t["role"], F.lit("")), F.coalesce(t["content"], F.lit(""))
        return F.array(seg(F.concat(F.lit(OPEN), _escape_role(role), F.lit("\n")), off), seg(escape(content), role.isin(*loss_roles)), seg(F.lit(CLOSE), off))

    return turns.withColumn("segments", F.flatten(F.transform("turns", piece)))


def formatted_text(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(formatted: Column) -> Column:
    """Turns parsed from a formatted text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            _unescape_role(F.substring(F.substring_index(p, "\n", 1), len(OPEN) + 1, 1 << 30)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("content"),
        ),
    )


def loss_text(segments: str = "segments") -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
