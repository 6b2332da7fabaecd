"""Chat formatting: layouts told apart by a fingerprint, canonical turns, one training text.

Records come as JSON in different layouts (lists of messages, prompt and response,
instruction and input and output). The nested field paths of each record are hashed; the hash
selects a declarative mapping to canonical turns. The training text marks turns with control
strings; control strings in the data are escaped so that the turns can be read back exactly.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"
#: Role names of other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """An example record (its field paths are the fingerprint) and where the turns are.

    Either ``messages`` (path of the list) with the names of its role and text fields, or
    ``turns``: (role, path) in order; a turn whose field is null is left out.
    """

    name: str
    example: str
    messages: str = ""
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, str], ...] = field(default=())


LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"a","content":"b"}]}', messages="$.messages"),
    Layout("conversations", '{"conversations":[{"from":"a","value":"b"}]}', messages="$.conversations", role="from", text="value"),
    Layout("prompt", '{"prompt":"a","response":"b"}', turns=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("completion", '{"prompt":"a","completion":"b"}', turns=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("question", '{"question":"a","answer":"b"}', turns=(("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", '{"instruction":"a","output":"b"}', turns=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout(
        "instruction-input",
        '{"instruction":"a","input":"b","output":"c"}',
        turns=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")),
    ),
)

#: A record of fewer bytes never fails by its size: it has no string of 20,000,000 characters,
#: and its variant, at most a few bytes for each of its own, stays below 128 MiB.
SMALL_BYTES = 16_000_000
#: What from_json parses with instead of the limit of 20,000,000 characters a string.
_NO_LIMIT = {"maxStringLen": "2147483647", "columnNameOfCorruptRecord": "_bad"}

_TYPE = r"(: )?\b(VOID|STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\([0-9, ]+\))(?=[,>]|$)"


def fingerprint(variant: Column) -> Column:
    """Hash of the nested field paths of a record, in the order of names, without types."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(variant), _TYPE, ""))


def _skeleton(record: Column) -> Column:
    """The record with empty string values, and one of each run of equal flat objects in a list.

    It has the same field paths.
    """
    body = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
    emptied = F.regexp_replace(record, f'(?s)("{body}"\\s*+:)|("){body}(")', "$1$2$3")
    return F.regexp_replace(emptied, r"(\{[^{}]*+\})(?:\s*+,\s*+\1)++", "$1")


def _given(value: Column, body) -> Column:
    """The body with a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long_turns(record: Column, layout: Layout) -> Column:
    """The turns of a record of any size; null where it is no JSON."""
    if layout.messages:
        fields = f"`{layout.messages[2:]}`:{_messages_kind(layout)}"
    else:
        fields = ",".join(f"`{path[2:]}`:string" for _, path in layout.turns)
    parsed = F.from_json(record, f"struct<{fields},_bad:string>", _NO_LIMIT)
    return _given(parsed, lambda x: F.when(x["_bad"].isNull(), F.coalesce(_turns(lambda path, _: x[path[2:]], layout), F.array())))


def _messages_kind(layout: Layout) -> str:
    return f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"


def _turns(get, layout: Layout) -> Column:
    if layout.messages:
        found = get(layout.messages, _messages_kind(layout))
        return F.transform(found, lambda m: F.struct(_role(m[layout.role]).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text")))
    each = [(role, get(path, "string")) for role, path in layout.turns]
    return F.filter(F.array(*[F.when(text.isNotNull(), F.struct(F.lit(role).alias("role"), text.alias("text"))) for role, text in each]), lambda t: t.isNotNull())


def _role(role: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(known[role], role, F.lit(""))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The input with layout (its name) and turns (array of role and text) instead of the record.

    Records of an unknown layout, null ones and invalid JSON keep their row, with a null layout
    and no turns. Null texts count as empty, null roles as an empty name. Input columns named
    layout or turns are replaced. No rows in, no rows out.

    Records that a variant cannot hold (a string of more than 20,000,000 characters, or more
    than 128 MiB) are told apart by their skeleton and read by from_json. It is an error if
    even the skeleton is of such a size.
    """
    kept = [c for c in records.columns if c.lower() not in ("layout", "turns", record.lower())]
    read = records.select(*kept, F.col(record).cast("string").alias("_record")).withColumn("_variant", F.try_parse_json("_record"))
    large = F.col("_variant").isNull() & (F.octet_length("_record") >= SMALL_BYTES)
    read = read.select(*kept, "_record", "_variant", large.alias("_large"), F.when(large, _skeleton(F.col("_record"))).alias("_skeleton"))
    shape = F.when(F.col("_large"), F.try_parse_json("_skeleton")).otherwise(F.col("_variant"))
    read = read.withColumn("_shape", shape)
    lost = F.col("_large") & F.col("_shape").isNull() & (F.octet_length("_skeleton") >= SMALL_BYTES)
    told = F.when(lost, F.raise_error(F.lit("a record is too large for its layout to be told"))).otherwise(fingerprint(F.col("_shape")))
    read = read.select(*kept, "_record", "_variant", "_large", told.alias("_print"))
    name, turns = F.lit(None).cast("string"), F.array().cast("array<struct<role:string,text:string>>")
    for x in layouts:
        same = F.col("_print") == fingerprint(F.try_parse_json(F.lit(x.example)))
        name = F.when(same, x.name).otherwise(name)
        small = F.coalesce(_turns(lambda path, kind: F.try_variant_get("_variant", path, kind), x), F.array())
        turns = F.when(same & F.col("_large"), _long_turns(F.col("_record"), x)).when(same, small).otherwise(turns)
    read = read.select(*kept, name.alias("_layout"), turns.alias("_turns"))
    return read.select(*kept, F.when(F.col("_turns").isNotNull(), F.col("_layout")).alias("layout"), F.coalesce("_turns", F.array()).alias("turns"))


def escape(text: Column) -> Column:
    """Breaks every control string: a backslash is doubled, and ``\\_`` follows each < and [.

    All control strings begin with one of these two, so none can begin inside a text.
    """
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("<\\_")), F.lit("["), F.lit("[\\_"))


def unescape(text: Column) -> Column:
    """Undoes ``escape``, from left to right in one pass."""
    return F.regexp_replace(text, r"\\(?:(\\)|_)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # A line feed is an escape of its own here, so backslash pairs are set aside first.
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\_"), F.lit(""))), "\\")


#: Lengths that are summed one by one; longer lists are summed by blocks of so many.
_BLOCK = 64


def _begins(lengths: Column, levels: int = 3) -> Column:
    """The sum of all lengths before each.

    Appending copies the list, so only lists of up to _BLOCK are built that way.
    """

    def few(x, first):
        start = F.struct(first.alias("n"), F.array().cast("array<bigint>").alias("all"))
        step = lambda a, n: F.struct((a["n"] + n).alias("n"), F.array_append(a["all"], a["n"]).alias("all"))
        return F.aggregate(x, start, step, lambda a: a["all"])

    def many(x):
        starts = F.sequence(F.lit(1), F.size(x), F.lit(_BLOCK))
        return _given(F.transform(starts, lambda k: F.slice(x, k, _BLOCK)), of_blocks)

    def of_blocks(blocks):
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, n: a + n))
        return F.flatten(F.zip_with(blocks, _begins(sums, levels - 1), few))

    zero = F.lit(0).cast("long")
    return _given(lengths, lambda x: F.when(F.size(x) <= _BLOCK, few(x, zero)).otherwise(many(x)) if levels else few(x, zero))


def format_turns(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """The input with formatted (the training text) and loss_spans instead of its turns.

    loss_spans are the places of assistant texts: start and end in characters, start_byte and
    end_byte in UTF-8 bytes, ends exclusive. They hold the escaped text of each assistant
    turn and nothing else. No turns give an empty text. Columns of these names are replaced.
    """
    kept = [c for c in conversations.columns if c.lower() not in ("formatted", "loss_spans", turns.lower())]
    pieces = F.transform(
        F.coalesce(F.col(turns), F.array()),
        lambda t: F.struct(
            F.concat(F.lit(TURN), _escape_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("head"),
            escape(F.coalesce(t["text"], F.lit(""))).alias("body"),
            F.coalesce(t["role"] == LEARNED_ROLE, F.lit(False)).alias("learned"),
        ),
    )
    cut = conversations.select(*kept, pieces.alias("_pieces"))
    size = lambda f: F.transform("_pieces", lambda p: (f(p["head"]) + f(p["body"]) + len(END)).cast("long"))
    placed = cut.select(*kept, "_pieces", _begins(size(F.length)).alias("_chars"), _begins(size(F.octet_length)).alias("_bytes"))

    def span(p, i):
        start, byte = F.get("_chars", i) + F.length(p["head"]), F.get("_bytes", i) + F.octet_length(p["head"])
        place = F.struct(
            start.alias("start"), (start + F.length(p["body"])).alias("end"), byte.alias("start_byte"), (byte + F.octet_length(p["body"])).alias("end_byte")
        )
        return F.when(p["learned"], place)

    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return placed.select(*kept, text.alias("formatted"), F.filter(F.transform("_pieces", span), lambda x: x.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a training text, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    whole = r"(?s)^([^\n]*)\n(.*)<\|im_end\|>\n$"
    return F.transform(
        parts, lambda p: F.struct(_unescape_role(F.regexp_extract(p, whole, 1)).alias("role"), unescape(F.regexp_extract(p, whole, 2)).alias("text"))
    )


def learned_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""

    def pieces(data):
        return F.transform(
            loss_spans,
            lambda s: unescape(F.substring(data, (s["start_byte"] + 1).cast("int"), (s["end_byte"] - s["start_byte"]).cast("int")).cast("string")),
        )

    # The cast copies the text.
    return F.array_join(_given(formatted.cast("binary"), pieces), "")
