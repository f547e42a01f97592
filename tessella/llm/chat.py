"""Chat formatting by schema fingerprints; DataFrame operations only.

A record's nested field paths are hashed; the hash picks a declarative mapping (a row of
``LAYOUTS``) that says where turns, roles and texts are.  Tables are fingerprinted once by
their schema, JSON records one by one through ``schema_of_variant``.  Paths that no layout
knows are left out of the fingerprint, so extra columns and fields never change the choice.

Template: each turn is ``<|role|>`` newline, text, ``<|end|>`` newline.  Texts and roles are
escaped so that no control string can occur in them: a backslash becomes ``\\b``, ``<``
becomes ``\\l``, and in roles also ``|`` becomes ``\\p`` and ``>`` becomes ``\\g``.  An
escaped text has no ``<``, so the output splits back into its turns without ambiguity.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "<|end|>\n"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    kind "rows": one row per turn, columns (order, role, text).
    kind "list": an array of structs, fields (role, text); with ``foreign`` its role names are
    translated to the canonical ones, elsewhere a role stays as it is.
    kind "fields": a fixed sequence of (role, field); null fields are left out, and several
    fields of one role in a row are joined by an empty line.
    """

    name: str
    kind: str
    paths: tuple[str, ...]
    source: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    foreign: bool = False


LAYOUTS = (
    Layout("turn_rows", "rows", ("role", "text", "turn"), role="role", text="text", order="turn"),
    Layout("messages", "list", ("messages[].content", "messages[].role"), source="messages", role="role", text="content"),
    Layout("conversations", "list", ("conversations[].from", "conversations[].value"), source="conversations", role="from", text="value", foreign=True),
    Layout("instruction", "fields", ("instruction", "output"), parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input", "system")),
    Layout("prompt_completion", "fields", ("completion", "prompt"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt_response", "fields", ("prompt", "response"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question_answer", "fields", ("answer", "question"), parts=(("system", "system"), ("user", "question"), ("assistant", "answer")), optional=("system",)),
)
#: Role names of the layouts that have their own, and the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def _hash(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _table() -> dict[str, Layout]:
    """Every fingerprint a layout can have, with and without its optional paths."""
    found: dict[str, Layout] = {}
    for layout in LAYOUTS:
        for mask in range(1 << len(layout.optional)):
            found[_hash([*layout.paths, *(p for k, p in enumerate(layout.optional) if mask >> k & 1)])] = layout
    return found


FINGERPRINTS = _table()
KNOWN = frozenset(p for x in LAYOUTS for p in (*x.paths, *x.optional))


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a schema; arrays are marked with []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, prefix + "[]")
    return [prefix]


def schema_layout(schema: T.StructType) -> Layout:
    paths = [p for p in field_paths(schema) if p in KNOWN]
    layout = FINGERPRINTS.get(_hash(paths))
    if layout is None:  # extra columns may happen to carry a name that another layout knows
        fitting = [x for x in LAYOUTS if set(x.paths) <= set(paths)]
        if not fitting:
            raise ValueError(f"no layout for field paths {sorted(paths)}")
        layout = max(fitting, key=lambda x: len(x.paths))
    return layout


def canonical_role(role: Column, foreign: bool = True) -> Column:
    """A known foreign role name is translated; every other role stays as it is, null is ''."""
    role = F.coalesce(role, F.lit(""))
    if not foreign:
        return role
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.lower(F.trim(role))), role)


def _turns(layout: Layout, field) -> Column:
    """array<struct<role, text>> of one record; field(name) gives a column."""
    if layout.kind == "list":
        return F.transform(F.coalesce(field(layout.source), F.array()), lambda m: F.struct(canonical_role(m[layout.role], layout.foreign).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text")))
    groups: list[tuple[str, list[str]]] = []
    for role, name in layout.parts:
        if groups and groups[-1][0] == role:
            groups[-1][1].append(name)
        else:
            groups.append((role, [name]))
    made = []
    for role, names in groups:
        present = [field(n) for n in names]
        text = F.concat_ws("\n\n", *present)
        empty = F.lit(True)
        for p in present:
            empty = empty & p.isNull()
        made.append(F.when(~empty, F.struct(F.lit(role).alias("role"), text.alias("text"))))
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical_turns(df: DataFrame, id_col: str) -> DataFrame:
    """(id, turns array<struct<role, text>>) of a table whose schema has a known layout.

    Null texts and roles count as empty.  Turn rows are ordered by turn, then role and text,
    so ties and repeated rows have one order; a null turn comes first.
    """
    layout = schema_layout(df.schema)
    if layout.kind == "rows":
        turn = F.struct(F.col(layout.order).alias("turn"), canonical_role(F.col(layout.role), layout.foreign).alias("role"), F.coalesce(layout.text, F.lit("")).alias("text"))
        got = df.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
        return got.select("id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    names = set(df.columns)
    return df.select(F.col(id_col).alias("id"), _turns(layout, lambda n: F.col(n) if n in names else F.lit(None).cast("string")).alias("turns"))


def canonical_turns_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, layout, turns) of JSON records, each by its own fingerprint.

    Malformed JSON and records of no known layout have null layout and turns.
    """
    v = df.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v"))
    shape = F.schema_of_variant("v")
    # OBJECT<messages: ARRAY<OBJECT<content: STRING, role: STRING>>, x: INT> -> known paths
    has = {p: F.when(_has(shape, p), F.lit(p)) for p in sorted(KNOWN)}
    v = v.withColumn("fp", F.sha2(F.concat_ws("\n", *has.values()), 256))
    out, name = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("string")
    for fp, layout in FINGERPRINTS.items():
        if layout.kind == "rows":
            continue
        if layout.kind == "list":
            kind = f"array<struct<{layout.role}:string,{layout.text}:string>>"

            def field(n, kind=kind):
                return F.from_json(F.to_json(F.variant_get("v", f"$.{n}", "variant")), kind)
        else:

            def field(n):
                return F.try_variant_get("v", f"$.{n}", "string")

        hit = F.col("fp") == fp
        out, name = F.when(hit, _turns(layout, field)).otherwise(out), F.when(hit, F.lit(layout.name)).otherwise(name)
    return v.select("id", name.alias("layout"), out.alias("turns"))


def _has(shape: Column, path: str) -> Column:
    """Whether a variant's schema string has a path: a field, or a field of structs in an array."""
    if "[]." not in path:
        # at depth one: names inside nested objects are cut away first
        flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(shape, "^OBJECT<|>$", ""), "<[^<>]*>", ""), "<[^<>]*>", "")
        return F.concat(F.lit(", "), flat).rlike(rf", {path}: (STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL)")
    outer, inner = path.split("[].")
    return shape.rlike(rf"\b{outer}: ARRAY<OBJECT<([^<>]*, )?{inner}: [A-Z]+")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(F.replace(out, F.lit("|"), F.lit("\\p")), F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column) -> Column:
    """Each backslash starts a pair whose second character is no backslash, so the pairs can
    be replaced one kind after the other, that of the backslash itself last."""
    for pair, plain in (("\\g", ">"), ("\\p", "|"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def format_turns(turns: Column) -> Column:
    """The formatted conversation."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit("<|"), escape(t["role"], True), F.lit("|>\n"), escape(t["text"]), F.lit(END))))


def loss_spans(turns: Column, role: str = "assistant") -> Column:
    """array<struct<start, length>>: code points of the output (from 0) under the loss mask,
    the escaped texts of the given role."""
    sized = F.transform(turns, lambda t: F.struct((t["role"] == role).alias("on"), (F.length(escape(t["role"], True)) + 5).alias("head"), F.length(escape(t["text"])).alias("body")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, x):
        span = F.struct((acc["at"] + x["head"]).alias("start"), x["body"].alias("length"))
        return F.struct((acc["at"] + x["head"] + x["body"] + len(END)).alias("at"), F.when(x["on"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(sized, start, step, lambda acc: acc["spans"])


def masked_texts(formatted: Column, spans: Column) -> Column:
    """array<string>: the plain texts under a loss mask, cut from the output by its spans."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> read back from the output."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(3)), "|>\n", 1)).alias("role"),
            unescape(F.substr(x, F.instr(x, "|>\n") + 3)).alias("text"),
        ),
    )
