"""Chat formatting by schema fingerprint.

The nested field paths of a table (or of one JSON record) are hashed; the hash
selects a declarative mapping that turns the layout into canonical turns, a list
of (role, text) for each conversation. One template then formats all of them:
marks around each turn, control strings inside texts escaped reversibly, and the
spans of assistant texts (the loss mask) in code points.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Strings with a meaning to chat templates and tokenizers in use.
CONTROL = [START, MIDDLE, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|begin_of_text|>", "<|end_of_text|>",
           "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
           "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>"]
TURNS = "array<struct<role:string,text:string>>"
FORMATTED = "formatted string, loss array<struct<start:int,stop:int>>"

_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\)?")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END) + "\n", re.S)

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A layout by its field paths. ``rows``: one row for each turn, with the key
    of the conversation, the order, the role and the text; ``turns``: an array
    path with role and text fields; ``fields``: (role, field) of single fields."""

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, ...] = ()
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


LAYOUTS = [
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    Layout("messages_text", ("messages[].role", "messages[].text"), turns=("messages", "role", "text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("user", "instruction+input"), ("assistant", "output"))),
    Layout("question_answer", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
]


def fingerprint(paths) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


REGISTRY = {fingerprint(x.paths): x for x in LAYOUTS}
KNOWN = {p for x in LAYOUTS for p in x.paths}


def field_paths(kind: DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a schema; [] marks the elements of an array."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def layout_of(schema: StructType) -> Layout:
    """The mapping for a table; paths that no layout knows are left out of the
    fingerprint, so that extra columns don't matter. If two layouts share the
    table, the largest whose paths are all there is taken."""
    paths = [p for p in field_paths(schema) if p in KNOWN]
    found = REGISTRY.get(fingerprint(paths))
    if found is None:
        fit = [x for x in LAYOUTS if set(x.paths) <= set(paths)]
        if not fit:
            raise ValueError(f"no layout has the field paths {sorted(paths)}")
        found = max(fit, key=lambda x: len(x.paths))
    return found


def _turn(role: Column, text: Column) -> Column:
    named = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    for had, canonical in ROLES.items():
        named = F.when(named == had, F.lit(canonical)).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(layout: Layout, col) -> Column:
    if layout.turns:
        path, role, text = layout.turns
        turns = F.transform(col(path), lambda m: _turn(m[role].cast("string"), m[text].cast("string")))
        return F.coalesce(turns, F.array().cast(TURNS))
    out = []
    for role, field in layout.fields:
        parts = [F.coalesce(col(f).cast("string"), F.lit("")) for f in field.split("+")]
        text = parts[0] if len(parts) == 1 else F.when(parts[1] == "", parts[0]).otherwise(F.concat(parts[0], F.lit("\n\n"), parts[1]))
        turn = F.array(_turn(F.lit(role), text))
        out.append(F.when(text == "", F.array().cast(TURNS)).otherwise(turn) if role == "system" else turn)
    return F.concat(*out)


def canonical_turns(df: DataFrame, key: str | None = None) -> DataFrame:
    """``key`` and turns of every conversation of a table in a known layout.

    Turn rows are gathered by conversation and sorted by turn (null first), then
    role and text, with roles as they are; a null conversation id is one
    conversation. Null roles and texts read as empty. Role names of other layouts
    are lower-cased and mapped by ROLES. A conversation's text is one string in the end, so its
    rows meet in one task; a conversation can't be larger than a task's memory.
    """
    layout = layout_of(df.schema)
    if layout.rows:
        conv, turn, role, text = layout.rows
        rows = df.groupBy(F.col(conv).alias(key or conv)).agg(F.array_sort(F.collect_list(F.struct(
            F.col(turn).isNotNull().alias("has"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")))).alias("rows"))
        return rows.select(key or conv, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    return df.select(*([F.col(f"`{key}`")] if key else []), _mapped(layout, lambda p: F.col(f"`{p}`")).alias("turns"))


# Records: single fields as above, or an array of turns with a system text beside it or not.
_FIELDS = {x.paths: x for x in LAYOUTS if x.fields}
_ARRAYS = {"messages": (("role", "content"), ("role", "text")), "conversations": (("from", "value"),)}
_SINGLE = sorted({p for paths in _FIELDS for p in paths} | {"system"})
_JSON = ", ".join([f"{a} array<string>" for a in _ARRAYS] + [f"{f} string" for f in _SINGLE])


def _print(names: Column, known) -> Column:
    """Fingerprint of those names that are known."""
    mine = F.array_intersect(F.coalesce(names, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in sorted(known)]))
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(mine)), "\n"), 256)


def _content(element: Column, field: str) -> Column:
    """The text of a field; of a list of content parts, the texts of all parts."""
    whole = F.get_json_object(element, f"$.{field}")
    parts = F.from_json(whole, "array<struct<text:string>>")
    return F.when(F.get_json_object(element, f"$.{field}[0]").isNull(), whole).otherwise(
        F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))


def _element(element: Column, maps) -> Column:
    """One turn, by the mapping that the fingerprint of the element's own fields
    selects; with the text fields of several mappings the first is taken."""
    every = {f for m in maps for f in m}
    own = _print(F.json_object_keys(element), every)
    role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for m in reversed(maps):
        mine = (own == fingerprint(m)) | ((own == fingerprint(every)) if m == maps[0] else F.lit(False)) | (own == fingerprint(m[:1]))
        role = F.when(mine, F.get_json_object(element, f"$.{m[0]}")).otherwise(role)
        text = F.when(mine, _content(element, m[1])).otherwise(text)
    return _turn(role, text)


def _turn_of(maps):
    return lambda e: _element(e, maps)


def record_turns(df: DataFrame, column: str, key: str) -> DataFrame:
    """``key``, layout and turns of one JSON record in every row.

    The fingerprint of the record's own fields selects its layout, and that of each
    element's fields the mapping of that element, so rows of a table, and turns of
    a record, may differ; fields that no layout knows don't matter. A system text
    beside an array of turns becomes the first turn, if it is not empty. A list of
    content parts is the texts of its parts. Elements that are no objects are no
    turns; a turn without a text is empty. Records of no known layout, and null
    or broken ones, have a null layout and no turns. Repeated rows are mapped
    each on its own, and an empty table gives an empty result."""
    text = F.col(f"`{column}`").cast("string")
    known = [*_ARRAYS, *_SINGLE]
    rows = df.select(F.col(f"`{key}`").alias(key), _print(F.json_object_keys(text), known).alias("print"), F.from_json(text, _JSON).alias("r"))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    system = F.coalesce(F.col("r.system"), F.lit(""))
    first = F.when(system == "", F.array().cast(TURNS)).otherwise(F.array(_turn(F.lit("system"), system)))
    found = [(x.name, (fingerprint(x.paths),), _mapped(x, lambda p: F.col("r")[p])) for x in _FIELDS.values()]
    for array, maps in _ARRAYS.items():
        items = F.filter(F.coalesce(F.col("r")[array], F.array().cast("array<string>")), lambda e: F.json_object_keys(e).isNotNull())
        found.append((array, (fingerprint([array]), fingerprint([array, "system"])), F.concat(first, F.transform(items, _turn_of(maps)))))
    for label, prints, made in found:
        mine = F.col("print").isin(*prints)
        name, turns = F.when(mine, F.lit(label)).otherwise(name), F.when(mine, made).otherwise(turns)
    return rows.select(key, name.alias("layout"), turns.alias("turns"))


def escape(text: str) -> str:
    """Doubles backslashes, and puts one behind the first character of every
    control string; no control string is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or "", text)


def format_turns(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of assistant texts in it (code points)."""
    out, loss, at = [], [], 0
    for t in turns:
        role, text = escape(t["role"]), escape(t["text"])
        head = START + role + MIDDLE
        if t["role"] == "assistant":
            loss.append((at + len(head), at + len(head) + len(text)))
        out += [head, text, END, "\n"]
        at += len(head) + len(text) + len(END) + 1
    return "".join(out), loss


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_chat(turns: DataFrame) -> DataFrame:
    """Adds formatted and loss to rows with turns; other columns stay, turns go."""
    keep = [c for c in turns.columns if c not in ("turns", "formatted", "loss")]
    schema = ", ".join([f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in keep] + [FORMATTED])
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for b in batches:
            got = [format_turns(t or []) for t in b.column("turns").to_pylist()]
            loss = pa.array([[{"start": s, "stop": e} for s, e in x] for _, x in got], span)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array([f for f, _ in got], pa.string()), loss], keep + ["formatted", "loss"])

    return turns.select(*[f"`{c}`" for c in keep], "turns").mapInArrow(run, schema)


def read_back(chats: DataFrame) -> DataFrame:
    """Adds turns and loss_text (the text under the mask, unescaped) to rows with
    formatted and loss."""
    keep = [c for c in chats.columns if c not in ("turns", "loss_text")]
    schema = ", ".join([f"`{c}` {chats.schema[c].dataType.simpleString()}" for c in keep] + [f"turns {TURNS}, loss_text string"])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            texts = b.column("formatted").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse_turns(x)] for x in texts]
            loss = ["".join(unescape(x[s["start"]:s["stop"]]) for s in spans) for x, spans in zip(texts, b.column("loss").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(turns, kind), pa.array(loss, pa.string())], keep + ["turns", "loss_text"])

    return chats.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)
