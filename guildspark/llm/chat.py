"""Chat formatting with mappings chosen by a fingerprint of the record's nested field paths.

A record is a JSON text. Its fingerprint is the hash of its sorted field paths (`messages[].role`), so
records of one layout meet whatever their values are. A table of declarative mappings, looked up by
fingerprint, turns each layout into canonical turns (role, text); a record whose fingerprint has no
mapping gets null turns and null output, and its fingerprint is reported. DataFrame functions only.

The template writes `<|im_start|>role\\ntext<|im_end|>\\n` per turn. Inside roles and texts a backslash
becomes two and `<|` becomes `<\\|`, so no text can open or close a turn; a line feed inside a role is
written `<|nl|>`, which an escaped role cannot hold. The loss mask is a list of [start, end) spans in
code points of the output, one for each assistant text (escaped form).

Defined results: a null text or role is empty; turns are ordered by turn number (null first), then role
and text, and repeated rows stay; a null conversation id is a conversation; an empty table has no rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths. items: the list of turns with its role and text fields; else
    turns: (role, fields) in order, a turn being its non-empty fields joined by a blank line, left out if
    there are none and it is optional."""

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None
    turns: tuple[tuple[str, tuple[str, ...], bool], ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    @property
    def fingerprint(self) -> str:
        return "\n".join(sorted(self.paths))


#: The layouts in common use.
LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), ("messages", "role", "content")),
    Layout("empty messages", ("messages",), ("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), ("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("empty conversations", ("conversations",), ("conversations", "from", "value")),
    Layout("instruction", ("input", "instruction", "output"), turns=(("user", ("instruction", "input"), False), ("assistant", ("output",), False))),
    Layout("short instruction", ("instruction", "output"), turns=(("user", ("instruction",), False), ("assistant", ("output",), False))),
    Layout("prompt and completion", ("completion", "prompt"), turns=(("user", ("prompt",), False), ("assistant", ("completion",), False))),
    Layout("system prompt and response", ("prompt", "response", "system"), turns=(("system", ("system",), True), ("user", ("prompt",), False), ("assistant", ("response",), False))),
)


def field_paths(record: Column) -> Column:
    """Sorted distinct field paths of a JSON object, to two levels, over all elements of its lists."""

    def below(k: Column) -> Column:
        value = F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit("']")))
        items = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull())
        listed = F.transform(F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")))), lambda x: F.concat(k, F.lit("[]."), x))
        nested = F.transform(F.json_object_keys(value), lambda x: F.concat(k, F.lit("."), x))
        none = F.array().cast("array<string>")
        return F.concat(F.array(k), F.when(F.substring(value, 1, 1) == "[", F.coalesce(listed, none)).when(F.substring(value, 1, 1) == "{", F.coalesce(nested, none)).otherwise(none))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.json_object_keys(record), below))))


def fingerprint(record: Column) -> Column:
    return F.xxhash64(F.array_join(field_paths(record), "\n"))


def _mapped(record: Column, layout: Layout) -> Column:
    if layout.items:
        name, role, text = layout.items
        parsed = F.from_json(F.get_json_object(record, f"$.{name}"), f"array<struct<`{role}`:string,`{text}`:string>>")

        def turn(x: Column) -> Column:
            own = F.coalesce(x[role], F.lit(""))
            for a, b in layout.roles.items():
                own = F.when(x[role] == a, b).otherwise(own)
            return F.struct(own.alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))

        return F.transform(parsed, turn)
    made = []
    for role, fields, optional in layout.turns:
        values = [F.get_json_object(record, f"$.{f}") for f in fields]
        text = F.concat_ws("\n\n", *[F.when(v != "", v) for v in values])
        one = F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))
        made.append(F.when(text == "", F.array().cast(TURNS)).otherwise(one) if optional else one)
    return F.concat(*made)


def canonical_turns(records: DataFrame, conv_id: str = "conv_id", record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Rows (id, layout fingerprint, turns): turns is null where no mapping has the fingerprint."""
    own = records.select(F.col(conv_id).alias("id"), F.col(record).alias("record")).withColumn("fingerprint", fingerprint(F.col("record")))
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        turns = F.when(F.col("fingerprint") == F.xxhash64(F.lit(x.fingerprint)), _mapped(F.col("record"), x)).otherwise(turns)
    return own.select("id", "fingerprint", turns.alias("turns"))


def records_of(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (id, record): the conversations of a table of turns as JSON messages."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = rows.select(F.col(conv_id).alias("id"), one.alias("m")).groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return grouped.select("id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    """In an escaped text every backslash opens a pair, which stands for its second character."""
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_turns(canonical: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rows (id, formatted, loss array<struct<start,end>>) from rows (id, turns).

    Places are running sums over the exploded turns of a conversation, so long ones stay linear; rows are
    already dealt by id, and no further exchange is needed."""
    parts = canonical.select("id", F.posexplode_outer("turns").alias("k", "t"), F.col("turns").isNull().alias("unknown"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("t.role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    parts = parts.select("id", "unknown", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce(head, F.lit("")).alias("head"), F.coalesce(escape(F.col("t.text")), F.lit("")).alias("body"), F.col("t.role").alias("role"), F.col("t").isNotNull().alias("real"))
    parts = parts.withColumn("tail", F.when(F.col("real"), f"{END}\n").otherwise(""))
    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("head") + F.length("body") + F.length("tail")).over(w), F.lit(0)) + F.length("head")
    span = F.struct(at.cast("long").alias("start"), (at + F.length("body")).cast("long").alias("end"))
    placed = parts.select("id", "unknown", "k", F.concat("head", "body", "tail").alias("piece"), F.when(F.col("role") == loss_role, span).alias("span"))
    joined = placed.groupBy("id").agg(F.first("unknown").alias("unknown"), F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("p"), F.sort_array(F.collect_list("span")).alias("loss"))
    text = F.when(~F.col("unknown"), F.array_join(F.transform("p", lambda x: x["piece"]), ""))
    return joined.select("id", text.alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (id, turns, loss_texts) from the output alone: turns by the control strings, loss texts by the mask."""
    pieces = F.filter(F.split("formatted", F.concat(F.lit(r"\Q"), F.lit(START), F.lit(r"\E"))), lambda x: x != "")

    def turn(x: Column) -> Column:
        line = F.instr(x, "\n")
        role = x.substr(F.lit(1), line - 1)
        text = x.substr(line + 1, F.length(x) - line - F.lit(len(END) + 1))
        return F.struct(unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    masked = F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("id", "formatted", F.transform(pieces, turn).alias("turns"), masked.alias("loss_texts"))
