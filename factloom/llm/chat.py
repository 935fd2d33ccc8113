"""Chat formatting with DataFrame operations only.

Records come in many layouts: a table with a row for each turn, or JSON records with prompts, instructions or message
lists. A layout is known by its fingerprint, a hash of its nested field paths, which selects a declarative mapping to
canonical turns (role, text). A template then marks the turns; control strings inside roles and texts are escaped so that
the text comes back exactly; a run-length mask tells which characters of the output are trained on.

Rules for input: null roles and texts are empty; turns go by turn number, nulls first, then role, then text; repeated rows
are repeated turns; a conversation of any length becomes one row; an unknown layout keeps its record, with null turns (`op3_chat` makes it one
turn of the role `error`); an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Turns of a conversation whose numbers share a stretch are put together first, so that a long one is built in parts.
STRETCH = 64
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
_ANGLE, _SQUARE = r"(\|turn\|>|\|text\|>|\|end\|>|/?s>)", r"(/?INST\])"

TURN = "struct<role:string,text:string>"


def escape(text: Column) -> Column:
    """One more ! after the first character of every control string, escaped ones included; so none is left bare."""
    return F.regexp_replace(F.regexp_replace(text, "<(!*)" + _ANGLE, "<!$1$2"), r"\[(!*)" + _SQUARE, "[!$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "<!(!*)" + _ANGLE, "<$1$2"), r"\[!(!*)" + _SQUARE, "[$1$2")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def mask_turn(role: Column, text: Column, trained: str = "assistant") -> Column:
    """struct(skip, keep): characters of the turn that aren't trained on, then those that are."""
    kept = F.when(role == trained, F.length(escape(text))).otherwise(F.lit(0))
    return F.struct((F.length(format_turn(role, text)) - kept - F.when(role == trained, len(CLOSE)).otherwise(0)).cast("int").alias("skip"), kept.cast("int").alias("keep"), F.when(role == trained, len(CLOSE)).otherwise(0).cast("int").alias("rest"))


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv, n_turns, formatted string, mask array<struct<skip,keep,rest>>) from a row for each turn."""
    empty = F.lit("")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    one = F.struct(F.col("turn").isNotNull().alias("k"), "turn", "role", "text")
    part = rows.groupBy("conv", "stretch").agg(F.array_sort(F.collect_list(one)).alias("t"))
    part = part.select("conv", F.struct(F.col("stretch").isNotNull().alias("k"), "stretch", F.size("t").alias("n"), F.array_join(F.transform("t", lambda t: format_turn(t.role, t.text)), "").alias("s"), F.transform("t", lambda t: mask_turn(t.role, t.text, trained)).alias("m")).alias("p"))
    whole = part.groupBy("conv").agg(F.sum("p.n").alias("n_turns"), F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select(F.col("conv").alias(conv), "n_turns", F.array_join(F.transform("p", lambda p: p.s), "").alias("formatted"), F.flatten(F.transform("p", lambda p: p.m)).alias("mask"))


def read_back(formatted: Column) -> Column:
    """array<struct<role,text,raw>> from the formatted string: turns as they were, and the escaped text as it stands."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        cutat = F.locate(MIDDLE, x)
        raw = F.substring(x, cutat + len(MIDDLE), F.length(x))
        return F.struct(unescape(F.substring(x, F.lit(len(OPEN) + 1), cutat - len(OPEN) - 1)).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.transform(pieces, turn)


def trained_text(turns: Column, mask: Column) -> Column:
    """All text under the mask, unescaped. The mask's runs end where turns do, so each run is the end of a turn's text."""
    runs = F.zip_with(turns, mask, lambda t, m: F.when(m.keep > 0, unescape(F.substring(t.raw, F.length(t.raw) - m.keep + 1, m.keep))).otherwise(F.lit("")))
    return F.array_join(runs, "")


# Layouts: of tables with a row for each turn, and of JSON records. Each is known by the hash of its field paths.


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted nested field paths of a schema; [] stands for any element of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name))
    return paths_of(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


#: What the text of a variant's schema consists of: quoted or plain names, type heads and ends, commas, scalar types.
_PIECES = r"`(?:[^`]|``)*`: |\w+: |OBJECT<|ARRAY<|>|, |[A-Z]+(?:\([0-9,]+\))?"


#: Characters of a record above which its strings are cut to KEPT before its paths are listed: parsing into a variant takes
#: strings of up to 20 million characters only, and paths don't need them.
LONG, KEPT = 1_000_000, 40
_STRING = rf"""(?s)("(?:[^"\\]|\\u[dD][89abAB]..\\u....|\\u....|\\.){{0,{KEPT}}}+)(?:[^"\\]++|\\.)*+\""""


def outline(record: Column) -> Column:
    """A long record with all its strings cut to a few characters; other records as they are."""
    return F.when(F.length(record) > LONG, F.regexp_replace(record, _STRING, '$1"')).otherwise(record)


def json_paths(record: Column) -> Column:
    """The same paths of one JSON record: a fold over the pieces of its schema text, with a stack of open objects and lists.

    An empty list is the path of its elements, an empty object none; null or broken JSON gives no paths, as does a record
    whose outline passes the size of a variant, 16 MB (some 200,000 turns in one record).
    """
    pieces = F.regexp_extract_all(F.schema_of_variant(F.try_parse_json(outline(record))), F.lit(_PIECES), F.lit(0))
    text = F.lit("").cast("string")
    start = F.struct(F.array().cast("array<string>").alias("open"), text.alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, x: Column) -> Column:
        top = F.coalesce(F.try_element_at(acc["open"], F.lit(-1)), text)
        name = F.replace(F.regexp_replace(F.regexp_replace(x, ": $", ""), "^`|`$", ""), F.lit("``"), F.lit("`"))
        opens, closes, named = x.isin("OBJECT<", "ARRAY<"), x == ">", F.endswith(x, F.lit(": "))
        at = F.when(named, F.concat(top, F.when(top != "", ".").otherwise(""), name)).when(x == "ARRAY<", F.concat(acc["at"], F.lit("[]"))).when(closes | (x == ", "), top).otherwise(acc["at"])
        stack = F.when(opens, F.concat(acc["open"], F.array(acc["at"]))).when(closes, F.slice(acc["open"], 1, F.greatest(F.size(acc["open"]) - 1, F.lit(0)))).otherwise(acc["open"])
        scalar = ~(opens | closes | named | (x == ", ") | (acc["at"] == ""))
        return F.struct(stack.alias("open"), at.alias("at"), F.when(scalar, F.concat(acc["paths"], F.array(acc["at"]))).otherwise(acc["paths"]).alias("paths"))

    return F.array_sort(F.array_distinct(F.aggregate(F.coalesce(pieces, F.array().cast("array<string>")), start, step, lambda acc: acc["paths"])))


def fingerprint_column(paths: Column) -> Column:
    """fingerprint() of an array of paths that is sorted."""
    return F.left(F.sha2(F.array_join(paths, "\n"), 256), F.lit(16))


#: Mappings: field paths -> SQL over the parsed record r that gives array<struct<role,text>>. A mapping is data.
LAYOUTS: list[tuple[list[str], str]] = [
    (["prompt", "response"], "array(struct('user' as role, r.prompt as text), struct('assistant' as role, r.response as text))"),
    (["completion", "prompt"], "array(struct('user' as role, r.prompt as text), struct('assistant' as role, r.completion as text))"),
    (["answer", "question"], "array(struct('user' as role, r.question as text), struct('assistant' as role, r.answer as text))"),
    (["instruction", "output"], "array(struct('user' as role, r.instruction as text), struct('assistant' as role, r.output as text))"),
    (["input", "instruction", "output"], "array(struct('user' as role, concat_ws('\n\n', r.instruction, nullif(r.input, '')) as text), struct('assistant' as role, r.output as text))"),
    (["instruction", "output", "system"], "array(struct('system' as role, r.system as text), struct('user' as role, r.instruction as text), struct('assistant' as role, r.output as text))"),
    (["messages[].content", "messages[].role"], "transform(r.messages, m -> struct(m.role as role, m.content as text))"),
    (["messages[]"], "array()"),
    (["conversations[].from", "conversations[].value"], "transform(r.conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))"),
    (["conversations[]"], "array()"),
    (["role", "text"], "array(struct(r.role as role, r.text as text))"),
    (["content", "role"], "array(struct(r.role as role, r.content as text))"),
    (["message.content", "message.role"], "array(struct(r.message.role as role, r.message.content as text))"),
]


#: Mappings of tables: field paths -> SQL for conversation, turn, role and text.
TABLE_LAYOUTS: list[tuple[list[str], dict[str, str]]] = [
    (["conv_id", "role", "text", "turn"], {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    (["content", "conversation_id", "index", "role"], {"conv_id": "conversation_id", "turn": "index", "role": "role", "text": "content"}),
    (["message.content", "message.role", "position", "thread"], {"conv_id": "thread", "turn": "position", "role": "message.role", "text": "message.content"}),
]


def _filters(layouts: list[tuple[list[str], object]]) -> list[list[str]]:
    """Which paths to keep before hashing, in turn: those of any layout, then those of one layout, of many paths first."""
    return [sorted({p for paths, _ in layouts for p in paths}), *sorted((sorted(paths) for paths, _ in layouts), key=lambda x: (-len(x), x))]


def canonical_rows(table: DataFrame, layouts: list[tuple[list[str], dict[str, str]]] | None = None) -> DataFrame:
    """(conv_id, turn, role, text, layout): the table's turns under the mapping that its fingerprint selects.

    The fingerprint is the hash of the table's field paths without those that no layout has; should columns of two layouts
    be mixed, those of one layout alone are tried. A table of no known layout raises ValueError, before any job runs.
    """
    layouts = layouts or TABLE_LAYOUTS
    have, known = paths_of(table.schema), {fingerprint(paths): how for paths, how in layouts}
    marks = [fingerprint([p for p in have if p in keep]) for keep in _filters(layouts)]
    found = next((mark for mark in marks if mark in known), None)
    if found is None:
        raise ValueError(f"no mapping for a table with the fields {have}")
    return table.select(*[F.expr(sql).alias(name) for name, sql in known[found].items()], F.lit(found).alias("layout"))


def _record_type(paths: list[str]) -> T.StructType:
    """The type that holds strings at these paths, of one level of objects or lists below the top."""
    fields: dict[tuple[str, str], list[str]] = {}
    for p in paths:
        top, mark, below = p.partition("[]" if "[]" in p else ".")
        fields.setdefault((top, mark), []).extend([below.lstrip(".")] if below else [])
    s = T.StringType()

    def kind(mark: str, below: list[str]) -> T.DataType:
        inner = T.StructType([T.StructField(b, s) for b in below]) if below else s
        return T.ArrayType(inner) if mark == "[]" else inner

    return T.StructType([T.StructField(top, kind(mark, below)) for (top, mark), below in fields.items()])


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: list[tuple[list[str], str]] | None = None) -> DataFrame:
    """records plus layout (fingerprint, null if unknown) and turns array<struct<role,text>>; the same names are overwritten.

    A record's fingerprint is the hash of its field paths without those that no layout has; it is looked up among those of
    the layouts. Should fields of two layouts be mixed, those of one layout alone are hashed and looked up.
    """
    layouts = layouts or LAYOUTS
    known = F.create_map(*[F.lit(x) for paths, _ in layouts for x in (fingerprint(paths),) * 2])
    marks = lambda paths: F.coalesce(*[F.try_element_at(known, fingerprint_column(F.array_intersect(paths, F.array(*map(F.lit, keep))))) for keep in _filters(layouts)])
    # the paths are worked out once for each record
    out = records.withColumn("layout", F.get(F.transform(F.array(json_paths(F.col(record_col))), marks), 0))
    quoted = "`" + record_col.replace("`", "``") + "`"
    cases = " ".join(f"when '{fingerprint(paths)}' then element_at(transform(array(from_json({quoted}, '{_record_type(paths).simpleString()}', map('maxStringLen', '2147483647'))), r -> cast({how} as array<{TURN}>)), 1)" for paths, how in layouts)
    return out.withColumn("turns", F.expr(f"case layout {cases} end"))
