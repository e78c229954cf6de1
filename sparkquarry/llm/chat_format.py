"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, which a reversible template renders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template. Escaped texts contain neither "#" nor "<", so marks never occur inside them.
OPEN, CLOSE = "### ", "</turn>\n"
#: Escapes, by character: fixed values of the template.
ESCAPES = {"#": "\\h", "<": "\\l", ":": "\\c"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout by its nested field paths, and SQL over ``v`` (a variant) for its turns."""

    name: str
    paths: tuple[str, ...]
    turns: str


def _get(path: str) -> str:
    return f"try_variant_get(v, '$.{path}', 'string')"


def _pairs(*pairs: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', {role}, 'text', {text})" for role, text in pairs) + ")"


def _list(field: str, role: str, text: str, roles: str = "x.role") -> str:
    return f"transform(try_variant_get(v, '$.{field}', 'array<struct<{role}:string,{text}:string>>'), t -> named_struct('role', {roles.replace('x.role', f't.{role}')}, 'text', t.{text}))"


SHARED = "case lower(x.role) when 'human' then 'user' when 'gpt' then 'assistant' else x.role end"
EMPTY = f"cast(array() as {TURNS})"
MAPPINGS = (
    Mapping("turn_row", ("role", "text"), _pairs((_get("role"), _get("text")))),
    Mapping("messages", ("messages[].content", "messages[].role"), _list("messages", "role", "content")),
    Mapping("no_messages", ("messages",), EMPTY),
    Mapping("no_conversations", ("conversations",), EMPTY),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value", SHARED)),
    Mapping("prompt_completion", ("completion", "prompt"), _pairs(("'user'", _get("prompt")), ("'assistant'", _get("completion")))),
    Mapping("prompt_response", ("prompt", "response"), _pairs(("'user'", _get("prompt")), ("'assistant'", _get("response")))),
    Mapping("instruction", ("instruction", "output"), _pairs(("'user'", _get("instruction")), ("'assistant'", _get("output")))),
    Mapping(
        "instruction_input",
        ("input", "instruction", "output"),
        _pairs(("'user'", f"concat_ws('\\n\\n', {_get('instruction')}, nullif({_get('input')}, ''))"), ("'assistant'", _get("output"))),
    ),
    Mapping("question_answer", ("answer", "question"), _pairs(("'user'", _get("question")), ("'assistant'", _get("answer")))),
)


#: Names of fields in the text of a schema, and types without fields.
NAME, PLAIN_TYPE = r"(`[^`]*`|[^\s<>,:\[\]]+)", r"[A-Z][A-Za-z0-9_]*(?:\([0-9, ]*\))?"


def shape_of(variant: Column) -> Column:
    """Array of the nested field paths of a variant object, in order; types don't count, ``[]`` is an element of an array of objects.

    Objects in fields and arrays in elements count as one field, and arrays of anything but objects (empty ones too) as well.
    """
    text = F.schema_of_variant(variant)
    # from the inside: objects in objects, arrays of other things, arrays of objects in other objects
    for _ in range(3):
        text = F.regexp_replace(text, rf"{NAME}: OBJECT<[^<>]*>", "$1: X")
        text = F.regexp_replace(text, rf"ARRAY<{PLAIN_TYPE}>", "X")
        text = F.regexp_replace(text, rf"(: (?:ARRAY<)?OBJECT<[^<>]*?){NAME}: ARRAY<OBJECT<[^<>]*>>", "$1$2: X")
    # what is left: "OBJECT<a: ARRAY<OBJECT<b: STRING, c: VOID>>, d: BIGINT>"
    flat = F.regexp_replace(text, rf"{NAME}: ARRAY<OBJECT<([^<>]*)>>", "$1[$2]")
    flat = F.regexp_replace(F.regexp_replace(flat, r"^OBJECT<(.*)>$", "$1"), rf": {PLAIN_TYPE}", "")
    inner = lambda part: F.split(F.regexp_extract(part, r"\[(.*)\]", 1), ", ")
    head = lambda part: F.regexp_extract(part, r"^([^\[]*)", 1)
    parts = F.regexp_extract_all(flat, F.lit(r"[^,\[\] ]+(\[[^\]]*\])?"), 0)
    paths = F.flatten(F.transform(parts, lambda p: F.when(p.contains("["), F.transform(inner(p), lambda q: F.concat(head(p), F.lit("[]."), q))).otherwise(F.array(p))))
    return F.array_sort(paths)


def fingerprint(paths: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Hash of those paths that some mapping knows: a field that none of them reads, as an id or a date, makes no difference."""
    known = sorted({p for m in mappings for p in m.paths})
    return F.xxhash64(F.array_join(F.array_intersect(paths, F.array(*map(F.lit, known))), ","))


def canonical_turns(records: DataFrame, variant_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """records with fingerprint (long), layout (string) and turns (array of role, text) of each row's variant.

    Roles are as read, but for the two that a layout names otherwise. Fields that no mapping knows make no difference. Rows
    whose fingerprint no mapping has, also null variants, stay, with a null layout and null turns, so that they can be counted;
    an empty list of messages has no turns. Columns of these three names are replaced; repeated rows and an empty table stay so.
    """
    spark = records.sparkSession
    shapes = spark.range(1).select(*(fingerprint(F.array(*map(F.lit, sorted(m.paths))), mappings).alias(m.name) for m in mappings)).first()
    df = records.withColumn("fingerprint", fingerprint(shape_of(F.col(variant_col)), mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        here = F.col("fingerprint") == F.lit(shapes[m.name])
        layout = F.when(here, m.name).otherwise(layout)
        turns = F.when(here, F.expr(m.turns.replace("(v,", f"(`{variant_col}`,")).cast(TURNS)).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """Inverse of escape: every backslash run of an escaped text starts an escape, so pairs are backslashes."""

    def codes(part: Column) -> Column:
        for char, code in ESCAPES.items():
            part = F.replace(part, F.lit(code), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", order_cols: tuple[str, ...] = ("turn",), role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv, formatted, loss_mask) of each conversation: its turns in order, in the template.

    ``loss_mask`` is an array of (turn, start, end): code points of ``formatted`` that a loss covers, the escaped texts
    of the turns whose role is ``trained``, letter by letter. Null text is empty, null role is "". Turns of equal order go by role, then text; repeated
    rows are turns of their own. Rows of null conversation form one. Extra columns are ignored; no rows give no rows.
    A conversation is one output row, so its turns meet in one task; nothing larger is gathered.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), escape(F.coalesce(text_col, F.lit("")))
    rows = turns.select(
        F.col(conv_col).alias("conv"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)), role.alias("role"),
        F.concat(F.lit(OPEN), escape(role), F.lit(": ")).alias("head"), text.alias("body"),
    )
    order = Window.partitionBy("conv").orderBy(*(f"o{i}" for i in range(len(order_cols))), "role", "body")
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = rows.select(
        "conv", "role", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.row_number().over(order).alias("turn"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)).cast("long").alias("end"), F.length("body").alias("n"),
    )
    span = F.when(F.col("role") == trained, F.struct("turn", (F.col("end") - F.col("n")).alias("start"), "end"))
    chats = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.array_sort(F.collect_list(span)).alias("loss_mask"))
    return chats.select(F.col("conv").alias(conv_col), F.array_join("pieces.piece", "").alias("formatted"), "loss_mask")


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    head = rf"(?s)^{OPEN}([^:]*): (.*)$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")))


def loss_texts(formatted: Column, loss_mask: Column) -> Column:
    """Array of the unescaped texts under the mask. Each is the tail, of the mask's length, of its turn."""
    parts = F.split(formatted, CLOSE)
    return F.transform(loss_mask, lambda m: unescape(F.when(m["end"] > m["start"], F.substr(F.element_at(parts, m["turn"]), -(m["end"] - m["start"]).cast("int"))).otherwise("")))


def chat_digests(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, all read back from ``formatted`` and ``loss_mask``; a row a row, no rows for none."""
    read = chats.select(conv_col, "formatted", parse_turns(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
