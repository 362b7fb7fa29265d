"""Chat formatting by schema fingerprints; DataFrame functions only.

A record is a struct column that may hold any of several layouts, of which a row fills one (the way Parquet keeps mixed
sources). The paths of the fields that a row fills are hashed; the hash selects a declarative mapping that gives canonical
turns. Turns are then rendered with a template whose control strings are escaped inside roles and texts, and can be read
back from the rendered text.

Defined results: a null role or text in a turn is empty; a record whose fingerprint no layout has keeps its row, with layout
and all that derives from it null and the fingerprint for inspection; an empty list of turns renders as ''; rows that repeat
give rows that repeat; columns other than the record are passed through, and ours are added under the names in ADDED, whose
clash with a passed column is an error named so.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
ADDED = ("fingerprint", "layout", "turns", "formatted", "loss")
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """Paths that must be filled and may be filled, and how they become turns.

    each: (array path, field of the role, field of the text); fixed: (role, paths whose filled texts are joined by newlines) in order.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> list[str]:
        return [digest({*self.required, *more}) for n in range(len(self.optional) + 1) for more in combinations(self.optional, n)]


LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), each=("messages", "role", "content")),
    Layout("conversations", ("conversations[]",), ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("instruction", ("instruction", "output"), ("input", "system"), fixed=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt", ("prompt", "completion"), ("system",), fixed=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", ("qa.question", "qa.answer"), (), fixed=(("user", ("qa.question",)), ("assistant", ("qa.answer",)))),
)
#: Every field that a layout of LAYOUTS names.
RECORD = (
    "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>,"
    "instruction:string,input:string,output:string,system:string,prompt:string,completion:string,qa:struct<question:string,answer:string>>"
)


def digest(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _filled(col: Column, kind: T.DataType, path: str) -> list[tuple[str, Column]]:
    """Each path at or below col, with the condition under which a row fills it."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _filled(col.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        inner = _filled(F.lit(None), kind.elementType, "") if isinstance(kind.elementType, T.StructType) else []
        out = [(f"{path}[]", col.isNotNull())]
        return out + [(f"{path}[].{name}", F.exists(col, _nth(kind.elementType, k))) for k, (name, _) in enumerate(inner)]
    return [(path, col.isNotNull())]


def _nth(kind: T.DataType, k: int):
    """The condition of the k-th path below an array's element, as a function of the element."""
    return lambda x: _filled(x, kind, "")[k][1]


def fingerprint(record: Column, schema: T.StructType, unknown: Column | None = None) -> Column:
    """Hash of the sorted paths that a row fills. unknown: names of further fields that the schema doesn't hold (of JSON)."""
    paths = sorted(_filled(record, schema, ""), key=lambda x: x[0])
    names = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(p)) for p, cond in paths]))
    if unknown is not None:
        names = F.array_sort(F.concat(names, F.coalesce(unknown, F.array().cast("array<string>"))))
    return F.sha2(F.array_join(names, "\n"), 256)


def _at(record: Column, path: str) -> Column:
    for name in path.split("."):
        record = record.getField(name)
    return record


def _turns(record: Column, layout: Layout) -> Column:
    """The canonical turns of a record that has this layout."""
    if layout.each:
        where, role, text = layout.each

        def one(x: Column) -> Column:
            said = F.coalesce(x.getField(role), F.lit(""))
            for theirs, ours in layout.roles.items():
                said = F.when(said == theirs, ours).otherwise(said)
            return F.struct(said.alias("role"), F.coalesce(x.getField(text), F.lit("")).alias("text"))

        return F.transform(_at(record, where), one)
    turns = [
        F.when(F.coalesce(*(_at(record, p) for p in paths)).isNotNull(), F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(_at(record, p) for p in paths)).alias("text")))
        for role, paths in layout.fixed
    ]
    return F.array_compact(F.array(*turns))


def to_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, unknown: str | None = None) -> DataFrame:
    """Adds fingerprint, layout and turns to each row. unknown: column with the names of fields outside the record's schema."""
    if clash := [c for c in df.columns if c in ADDED]:
        raise ValueError(f"columns {clash} are in the input already")
    kind = df.schema[record].dataType
    there = {p for p, _ in _filled(F.lit(None), kind, "")}
    usable = [x for x in layouts if {*x.required, *x.optional} <= there]
    table: dict[str, str] = {}
    for x in usable:
        for f in x.fingerprints():
            if table.setdefault(f, x.name) != x.name:
                raise ValueError(f"layouts {table[f]} and {x.name} share a fingerprint")
    df = df.withColumn("fingerprint", fingerprint(F.col(record), kind, F.col(unknown) if unknown else None))
    name = turns = None
    for x in usable:
        is_it = F.col("fingerprint").isin([f for f, n in table.items() if n == x.name])
        name = F.when(is_it, x.name) if name is None else name.when(is_it, x.name)
    df = df.withColumn("layout", F.lit(None).cast("string") if name is None else name)
    for x in usable:
        is_it, made = F.col("layout") == x.name, _turns(F.col(record), x).cast(f"array<{TURN}>")
        turns = F.when(is_it, made) if turns is None else turns.when(is_it, made)
    return df.withColumn("turns", F.lit(None).cast(f"array<{TURN}>") if turns is None else turns)


def from_json_records(df: DataFrame, text: str, record: str = "record") -> DataFrame:
    """Parses JSON texts into RECORD, with the names of top-level fields that RECORD lacks in `unknown`; broken JSON gives an empty record."""
    known = [f.name for f in T._parse_datatype_string(RECORD).fields]
    return df.withColumn(record, F.from_json(F.col(text), RECORD)).withColumn(
        "unknown", F.array_except(F.coalesce(F.json_object_keys(F.col(text)), F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    )


def escape(text: Column) -> Column:
    """Puts one more backslash into each `<`, backslashes, `|`: no control string is left, and unescape() takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Keeps a role on the one line that the template has for it."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undoes escape_role. Backslash pairs are cut out first, as a newline can't stand in a role's line; a `\\n` between them is an escaped newline."""
    parts = F.split(F.replace(unescape(role), F.lit("\\\\"), F.lit("\n")), "\n", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def render(df: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted, the turns under the template, and loss: for each turn whose role is in learn, its number from 0 and where its text
    stands in the turn's block, start to end in code points. Offsets count from the block, so that reading them back takes time in proportion
    to the text however many turns there are."""
    head = lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"))
    blocks = F.transform("turns", lambda t: F.concat(head(t), escape(t.text), F.lit(f"{END}\n")))
    spans = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), F.length(head(t)).alias("start"), (F.length(head(t)) + F.length(escape(t.text))).alias("end"), t.role.isin(*learn).alias("on")))
    kept = F.transform(F.filter(spans, lambda s: s.on), lambda s: F.struct(s.turn.alias("turn"), s.start.alias("start"), s.end.alias("end")))
    return df.withColumn("formatted", F.array_join(blocks, "")).withColumn("loss", kept)


def blocks_of(formatted: Column) -> Column:
    """The turns' blocks in a rendered text, without START."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)
    return F.slice(parts, F.lit(2), F.size(parts))


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered text."""

    def one(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        text = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks_of(formatted), one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped and joined without anything between."""
    blocks = blocks_of(formatted)
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(F.get(blocks, s.turn), s.start - len(START) + 1, s.end - s.start))), "")


def gather_turns(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One messages record for each key, of rows that hold a turn each; ties in order go by role, then text. A conversation is one record, so its
    rows meet in one task; they meet as partial lists already gathered before the shuffle."""
    rows = df.select(F.col(key).alias("key"), F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")).alias("m"))
    return rows.groupBy("key").agg(F.sort_array(F.collect_list("m")).alias("m")).select(
        "key", F.transform("m", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages")
    )
