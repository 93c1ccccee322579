"""Chat formatting with schema fingerprints, in DataFrame functions only.

A record's nested field paths that hold something (of lists: in any message), as
far as any mapping knows them, are sorted, joined and hashed; the hash selects a
declarative mapping that turns prompt, instruction and message layouts into
canonical turns (role, text).  Records of different layouts may share a table.
The template marks turns with control strings; inside roles and texts these are
escaped reversibly, so that the formatted string can be read back exactly.

Defined results: null text or role counts as empty; a record whose fingerprint
no mapping has gives null turns, and an empty list of messages no turns; an empty
text stays a turn; texts may be as long as a JVM string; turns with equal
numbers are ordered by role, then text; fields and columns that no mapping
names are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

START, END = "<|im_start|>", "<|im_end|>"

#: Lists of messages: path of the list, field of the role, field of the text.
LISTS = (("messages", "role", "content"), ("conversations", "from", "value"), ("turns", "role", "text"), ("dialogue", "speaker", "utterance"))
#: Flat layouts: the fields of the record in turn order, with the role each stands for; several fields of one role join by an empty line.
FLAT = (
    (("prompt", "user"), ("response", "assistant")),
    (("prompt", "user"), ("completion", "assistant")),
    (("system", "system"), ("prompt", "user"), ("response", "assistant")),
    (("instruction", "user"), ("output", "assistant")),
    (("instruction", "user"), ("input", "user"), ("output", "assistant")),
    (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")),
    (("question", "user"), ("answer", "assistant")),
)
#: Names that some layouts use for the three roles; in the others a role is as it is given.
RENAMED = ("conversations", "dialogue")
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _list_kind(role: str, text: str) -> str:
    return f"array<struct<`{role}`: string, `{text}`: string>>"


#: Fields of the flat layouts, and the record that holds every layout's fields.
FIELDS = sorted({f for layout in FLAT for f, _ in layout})
RECORD = ", ".join([*(f"`{f}`: string" for f in FIELDS), *(f"`{path}`: {_list_kind(role, text)}" for path, role, text in LISTS)])
#: The parser's limit on the length of a string, lifted to that of a JVM array.
PARSER = {"maxStringLen": str((1 << 31) - 1)}


def parsed(record: Column) -> Column:
    """The fields of a JSON record that some mapping knows, in one parse; put it in a column of its own before use."""
    return F.from_json(record, f"struct<{RECORD}>", PARSER)


def field_paths(record: Column) -> Column:
    """The sorted nested field paths of a record (a struct of RECORD's fields) that hold something."""
    def there(value: Column, path: str) -> Column:
        return F.when(value.isNotNull(), F.lit(path))

    def has(field: str):
        return lambda m: m[field].isNotNull()

    paths = [there(record[f], f) for f in FIELDS]
    for path, role, text in LISTS:
        paths.append(there(record[path], path))
        paths += [F.when(F.exists(record[path], has(f)), F.lit(f"{path}[].{f}")) for f in (role, text)]
    return F.sort_array(F.array_compact(F.array(*paths)))


def fingerprint(record: Column) -> Column:
    return F.sha2(F.array_join(field_paths(record), "\n"), 256)


def _of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def mappings() -> dict[str, int]:
    """Number of the mapping of each known fingerprint: the flat layouts first, then the lists (whose messages may lack a field)."""
    out = {_of([f for f, _ in layout]): k for k, layout in enumerate(FLAT)}
    for k, (path, role, text) in enumerate(LISTS, len(FLAT)):
        for some in ([], [role], [text], [role, text]):
            out[_of([path, *(f"{path}[].{f}" for f in some)])] = k
    return out


def with_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``turns``, array<struct<role, text>>, of the records in a column of JSON strings or of structs with some of RECORD's
    fields; null where no mapping has the fingerprint."""
    kind = records.schema[record].dataType
    if isinstance(kind, StringType):
        out = records.withColumn("_record", parsed(F.col(record)))
    else:
        known = {f.name: f for f in kind.fields}
        fields = [F.col(record)[f].alias(f) if f in known else F.lit(None).cast("string").alias(f) for f in FIELDS]
        for path, role, text in LISTS:
            empty = F.lit(None).cast(_list_kind(role, text))
            fields.append((F.col(record)[path].cast(_list_kind(role, text)) if path in known else empty).alias(path))
        out = records.withColumn("_record", F.when(F.col(record).isNotNull(), F.struct(*fields)))
    numbers = F.create_map(*[F.lit(x) for pair in mappings().items() for x in pair])
    out = out.withColumn("_mapping", F.when(F.col("_record").isNotNull(), numbers[fingerprint(F.col("_record"))]))
    renamed = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])

    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def message(path: str, role: str, text: str):
        return lambda m: turn(F.coalesce(renamed[m[role]], m[role]) if path in RENAMED else m[role], m[text])

    row = F.col("_record")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for k, layout in enumerate(FLAT):
        fields = {r: [row[f] for f, x in layout if x == r] for _, r in layout}
        texts = [F.concat_ws("\n\n", *[F.nullif(f, F.lit("")) for f in fs]) if len(fs) > 1 else fs[0] for fs in fields.values()]
        turns = F.when(F.col("_mapping") == k, F.array(*[turn(F.lit(r), t) for r, t in zip(fields, texts, strict=True)])).otherwise(turns)
    for k, (path, role, text) in enumerate(LISTS, len(FLAT)):
        turns = F.when(F.col("_mapping") == k, F.transform(row[path], message(path, role, text))).otherwise(turns)
    return out.withColumn("turns", turns).drop("_record", "_mapping")


def escape(text: Column) -> Column:
    """Doubles backslashes, then breaks every control opener with one: no control string is left, and nothing is lost."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), _escape_role(turn["role"]), F.lit("\n"))


def format_turns(turns: Column) -> Column:
    """The formatted conversation."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), escape(t["text"]), F.lit(END + "\n"))), "")


def loss_mask(turns: Column) -> Column:
    """Spans (start from 0, length; code points) of the assistant's texts in the formatted conversation."""
    sizes = F.transform(
        turns,
        lambda t: F.struct(
            F.char_length(_head(t)).cast("long").alias("head"),
            F.char_length(escape(t["text"])).cast("long").alias("body"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        span = F.struct((acc["at"] + t["head"]).alias("start"), t["body"].alias("length"))
        return F.struct(
            (acc["at"] + t["head"] + t["body"] + F.lit(len(END) + 1)).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(sizes, start, step, lambda acc: acc["spans"])


def read_turns(formatted: Column) -> Column:
    """The turns, read back from the formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def one(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(role) + 2)
        return F.struct(_unescape_role(F.substr(role, F.lit(len(START) + 1))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def gather(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record for each conversation given by rows, as a struct, so that texts of any length stay as they are.

    A question and its answer, with a system text or without, make a prompt record; all others are lists of messages.
    """
    message = F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    # A conversation is one record in any case, so its turns meet in one row.
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), message.alias("m"))))
    told = rows.groupBy(F.col(conv).alias(conv)).agg(ordered.alias("_turns")).withColumn("_turns", F.transform("_turns", lambda x: x["m"]))
    told = told.withColumn("_roles", F.array_join(F.transform("_turns", lambda m: F.replace(m["role"], F.lit("/"), F.lit("//"))), "/"))
    short = F.col("_roles").isin("user/assistant", "system/user/assistant")

    def at(place: int) -> Column:
        return F.when(short, F.element_at("_turns", place)["content"])

    first = F.when(F.col("_roles") == "system/user/assistant", F.element_at("_turns", 1)["content"])
    record = F.struct(first.alias("system"), at(-2).alias("prompt"), at(-1).alias("response"), F.when(~short, F.col("_turns")).alias("messages"))
    return told.select(conv, record.alias("record"))


def format_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds turns, formatted and loss_spans."""
    return with_turns(records, record).withColumn("formatted", format_turns(F.col("turns"))).withColumn("loss_spans", loss_mask(F.col("turns")))
