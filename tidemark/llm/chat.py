"""Chat formatting: schema fingerprints select declarative mappings to canonical turns. DataFrame operations only.

A layout is known by the hash of its nested field paths. Canonical turns are written with control strings between them;
inside texts the characters that begin a control string are escaped, so that the output can be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"

def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _list(items: Column, role: str, text: str, names: dict[str, str]) -> Column:
    """Turns of an array of objects; ``names`` has roles that are called otherwise."""

    def one(m: Column) -> Column:
        named = m[role]
        for other, ours in names.items():
            named = F.when(m[role] == other, ours).otherwise(named)
        return F.struct(named.alias("role"), m[text].alias("text"))

    return F.transform(items, one)


#: The known layouts: their field paths, and the canonical turns made of the fields that ``f`` gives by name.
MAPPINGS = {
    "turns": (["turns[].role", "turns[].text", "turns[].turn"], lambda f: _list(F.array_sort(F.transform(f("turns"), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))), "role", "text", {})),
    "messages": (["messages[].content", "messages[].role"], lambda f: _list(f("messages"), "role", "content", {})),
    "conversations": (["conversations[].from", "conversations[].value"], lambda f: _list(f("conversations"), "from", "value", {"human": "user", "gpt": "assistant"})),
    "prompt_completion": (["completion", "prompt"], lambda f: F.array(_turn("user", f("prompt")), _turn("assistant", f("completion")))),
    "prompt_response": (["prompt", "response"], lambda f: F.array(_turn("user", f("prompt")), _turn("assistant", f("response")))),
    "instruction": (["instruction", "output"], lambda f: F.array(_turn("user", f("instruction")), _turn("assistant", f("output")))),
    "instruction_input": (
        ["input", "instruction", "output"],
        lambda f: F.array(_turn("user", F.concat_ws("\n", f("instruction"), F.nullif(f("input"), F.lit("")))), _turn("assistant", f("output"))),
    ),
    "system_instruction": (
        ["instruction", "output", "system"],
        lambda f: F.array(_turn("system", f("system")), _turn("user", f("instruction")), _turn("assistant", f("output"))),
    ),
}


def fingerprint(paths: list[str]) -> str:
    """Hash of sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


KNOWN = {fingerprint(paths): name for name, (paths, _) in MAPPINGS.items()}
_FIELDS = {p.split("[")[0] for paths, _ in MAPPINGS.values() for p in paths}


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; [] stands for an array's items."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at]


def from_columns(records: DataFrame) -> DataFrame:
    """Canonical ``turns`` of records that have one layout; columns that belong to no layout are kept and don't count."""
    found = KNOWN.get(fingerprint([p for p in schema_paths(records.schema) if p.split("[")[0].split(".")[0] in _FIELDS]))
    if found is None:
        raise ValueError(f"no mapping for {records.schema.simpleString()}")
    return records.withColumn("turns", MAPPINGS[found][1](F.col).cast(TURN))


def _fields(paths: list[str]) -> dict[str, list[str]]:
    """The top fields of a layout, each with the fields of its items, if it is a list of objects."""
    out: dict[str, list[str]] = {}
    for p in sorted(paths):
        top, _, inner = p.partition("[].")
        out.setdefault(top, [])
        out[top] += [inner] * bool(inner)
    return out


def _nested(item: Column, field: str) -> Column:
    """Whether a field of a JSON object holds a list or an object, as messages of several parts do."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$.{field}", "variant"))
    return F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))


def _odd(fields: list[str]) -> Callable[[Column], Column]:
    """Whether a list's item is no object with one of the fields, or one of them is nested."""
    return lambda item: reduce(lambda a, b: a | b, [_nested(item, f) for f in fields], ~F.coalesce(F.arrays_overlap(F.json_object_keys(item), F.array(*map(F.lit, fields))), F.lit(False)))


def record_paths(record: Column) -> Column:
    """The sorted field paths of a JSON record that belong to some layout; null where it isn't an object.

    The paths of a list are those of all its items. One that isn't a list of objects with known fields of plain values has a
    path of its own, marked by ``!``, which is in no layout.
    """
    lists = {top: sorted({i for paths, _ in MAPPINGS.values() for i in _fields(paths).get(top, [])}) for top in sorted(_FIELDS)}
    keys = F.json_object_keys(record)
    found = []
    for top, inner in lists.items():
        if inner:
            raw = F.get_json_object(record, f"$.{top}")
            items = F.from_json(raw, "array<string>")
            known = F.array_intersect(F.array(*map(F.lit, inner)), F.array_distinct(F.flatten(F.transform(items, F.json_object_keys))))
            odd = F.exists(items, _odd(inner))
            paths = F.split(F.concat(F.lit(f"{top}[]."), F.array_join(known, f",{top}[].")), ",")
            one = F.when(raw.isNull() | (F.size(items) == 0), F.array(F.lit(f"{top}[]"))).when(items.isNull() | F.coalesce(odd, F.lit(True)) | (F.size(known) == 0), F.array(F.lit(f"{top}[]!"))).otherwise(paths)
            found.append(F.when(F.array_contains(keys, top), one))
        else:
            found.append(F.when(F.array_contains(keys, top), F.array(F.when(_nested(record, top), F.lit(f"{top}!")).otherwise(F.lit(top)))))
    none = F.array().cast("array<string>")
    return F.when(keys.isNotNull(), F.array_sort(F.flatten(F.array(*[F.coalesce(f, none) for f in found]))))


def from_json_text(records: DataFrame, column: str = "record") -> DataFrame:
    """``layout`` and canonical ``turns`` of JSON records of mixed layouts, chosen for each row by its fingerprint.

    Fields that belong to no layout, at the top or in the items of a list, don't count. A list without items has no turns. A
    record that is null, isn't a JSON object or has fields of no or of several layouts gets layout null and turns null; so does
    one whose list mixes items of several layouts or holds an item that is no object, or whose text is made of several parts.
    """
    print_of = F.sha2(F.array_join(record_paths(F.col(column)), "\n"), 256)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for name, (paths, made) in MAPPINGS.items():
        fields = _fields(paths)
        kinds = {top: "array<struct<" + ",".join(f"`{f}`:{'bigint' if f == 'turn' else 'string'}" for f in inner) + ">>" if inner else "string" for top, inner in fields.items()}
        same = print_of == fingerprint(paths)
        if all(fields.values()):
            same = same | (print_of == fingerprint([f"{top}[]" for top in fields]))
        got = F.from_json(F.col(column), ", ".join(f"`{k}` {v}" for k, v in kinds.items()))
        layout = F.when(same, name).otherwise(layout)
        turns = F.when(same, made(lambda field, got=got: got[field]).cast(TURN)).otherwise(turns)
    return records.withColumn("layout", layout).withColumn("turns", turns)


def from_rows(rows: DataFrame) -> DataFrame:
    """Conversations of a table with a row for each turn: conv_id, turns. Turns are ordered by turn, then role, then text."""
    each = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return from_columns(rows.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(F.collect_list(each).alias("turns")))


def escape(text: Column) -> Column:
    """Without the characters that begin control strings; ``unescape`` brings them back."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\o"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\o"), F.lit("["))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def formatted(conversations: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``, an array of (start, length) in code points over assistant texts.

    A turn is <s>[ROLE]role[/ROLE]text</s>. A null role or text is written as an empty one.
    """
    parts = F.transform("turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.concat(F.lit("<s>[ROLE]"), escape(t["role"]), F.lit("[/ROLE]")).alias("head"), escape(t["text"]).alias("body")))
    out = conversations.withColumn("_parts", parts)
    start = F.named_struct(F.lit("at"), F.lit(1), F.lit("spans"), F.array().cast("array<struct<start:int,length:int>>"))

    def step(acc: Column, p: Column) -> Column:
        begin, size = acc["at"] + F.char_length(p["head"]), F.char_length(p["body"])
        span = F.array(F.struct(begin.alias("start"), size.alias("length")))
        return F.struct((begin + size + 4).alias("at"), F.when(p["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("_parts", start, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit("</s>"))), "")
    return out.withColumn("formatted", text).withColumn("loss_mask", mask).drop("_parts")


def read_back(written: DataFrame) -> DataFrame:
    """From formatted text and mask alone: adds ``turns_read`` (role, text) and ``loss_text``."""
    pieces = F.filter(F.split("formatted", "</s>"), lambda x: x != "")
    role = lambda x: F.substring_index(F.substring_index(x, "[/ROLE]", 1), "[ROLE]", -1)
    turns = F.transform(pieces, lambda x: F.struct(unescape(role(x)).alias("role"), unescape(F.substring_index(x, "[/ROLE]", -1)).alias("text")))
    loss = F.array_join(F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"], m["length"]))), "")
    return written.withColumn("turns_read", turns).withColumn("loss_text", loss)


def digests(written: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    back = read_back(written)
    flat = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns_read").cast("bigint").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
