"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records of several layouts (message lists, prompt and response, instruction,
input and output) come as one struct column whose fields may be null. The
paths of the fields that a record really fills are hashed; the hash selects a
declarative mapping from MAPPINGS, which makes canonical turns
(role, text). Turns are then rendered with a template whose control
strings can't occur inside texts, and can be parsed back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm._common import table

TURNS = "array<struct<role:string,text:string>>"

#: Marks before and after a turn's text, by role. Other roles are written out in OTHER.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|role:", "|>", "<|/role|>")
#: What follows the first character of any control string.
_TAILS = r"(?=</?SYS>>|/?INST\]|/?s>|\|/?role)"
_FIRST = r"([<\[])"

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
SHARE = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
#: The layouts that are known, as one struct: a record fills the fields of its own layout.
RECORD = T.StructType(
    [
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("conversations", T.ArrayType(SHARE)),
        T.StructField("system", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("output", T.StringType()),
    ]
)


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; array elements add []."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, at + "[]")
    return [at]


def fingerprint_of(names: list[str]) -> Column:
    """The fingerprint of a fixed list of paths."""
    return F.xxhash64(F.lit("\n".join(sorted(names))))


def fingerprint(record: str, schema: T.StructType = RECORD) -> Column:
    """The hash of the field paths that a record fills.

    A field counts as filled if it is not null; an array is judged as a whole,
    so that a null text inside a message doesn't change the layout.
    """
    filled = [F.when(F.col(record)[f.name].isNotNull(), F.array(*map(F.lit, paths(f.dataType, f.name)))).otherwise(F.array().cast("array<string>")) for f in schema]
    return F.xxhash64(F.array_join(F.array_sort(F.flatten(F.array(*filled))), "\n"))


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), text.alias("text"))


def _listed(field: str, role: str, text: str, names: dict[str, str] | None = None):
    def of(r: Column) -> Column:
        def one(m: Column) -> Column:
            said = m[role]
            for old, new in (names or {}).items():
                said = F.when(m[role] == old, new).otherwise(said)
            return _turn(said, m[text])

        return F.transform(r[field], one)

    return of


def _fields(*turns: tuple[str, tuple[str, ...]]):
    return lambda r: F.array(*[_turn(role, F.concat_ws("\n\n", *[r[f] for f in fields]) if len(fields) > 1 else r[fields[0]]) for role, fields in turns])


#: Fields of a layout, and how they become turns. New layouts are new entries.
MAPPINGS = [
    (("messages",), _listed("messages", "role", "content")),
    (("conversations",), _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    (("prompt", "response"), _fields(("user", ("prompt",)), ("assistant", ("response",)))),
    (("system", "prompt", "response"), _fields(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    (("instruction", "output"), _fields(("user", ("instruction",)), ("assistant", ("output",)))),
    (("instruction", "input", "output"), _fields(("user", ("instruction", "input")), ("assistant", ("output",)))),
    (("system", "instruction", "output"), _fields(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
]


def canonical_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """df with layout (the fingerprint) and turns (null for an unknown layout)."""
    by_name = {f.name: f for f in RECORD}
    made = F.lit(None).cast(TURNS)
    for fields, mapping in MAPPINGS:
        names = [p for f in fields for p in paths(by_name[f].dataType, f)]
        made = F.when(F.col("layout") == fingerprint_of(names), mapping(F.col(record)).cast(TURNS)).otherwise(made)
    return df.withColumn("layout", fingerprint(record)).withColumn("turns", made)


def escape(text: Column) -> Column:
    r"""Put a backslash after the first character of each control string.

    Where backslashes stand there already, one is added, so unescape() is exact.
    """
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _TAILS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _TAILS, "$1$2")


def _role_out(role: Column) -> Column:
    # '%', '|' and '>' inside a role's name are written as '%25', '%7C' and '%3E'; null is '%00'
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(role, "%", "%25"), r"\|", "%7C"), ">", "%3E")
    return F.coalesce(name, F.lit("%00"))


def _role_in(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "%3E", ">"), "%7C", "|"), "%25", "%")
    return F.when(name == "%00", F.lit(None)).otherwise(plain)


def _marks(turn: Column) -> tuple[Column, Column]:
    before, after = F.concat(F.lit(OTHER[0]), _role_out(turn["role"]), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, (a, b) in MARKS.items():
        before, after = F.when(turn["role"] == role, a).otherwise(before), F.when(turn["role"] == role, b).otherwise(after)
    return before, after


def render(df: DataFrame, turns: str = "turns") -> DataFrame:
    """df with formatted (a string) and loss_spans (code point ranges of assistant texts)."""

    def piece(t: Column) -> Column:
        before, after = _marks(t)
        text = escape(F.coalesce(t["text"], F.lit("")))
        return F.struct(F.concat(before, text, after).alias("s"), F.length(before).alias("skip"), F.length(text).alias("n"), F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss"))

    df = df.withColumn("_pieces", F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), piece))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = (acc["at"] + p["skip"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), (begin + p["n"]).cast("long").alias("stop")))
        spans = F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(p["s"])).cast("long").alias("at"), spans.alias("spans"))

    df = df.withColumn("formatted", F.concat_ws("", F.transform("_pieces", lambda p: p["s"])))
    return df.withColumn("loss_spans", F.aggregate("_pieces", start, step)["spans"]).drop("_pieces")


def parse(formatted: Column) -> Column:
    """The turns of a rendered string, texts unescaped."""
    opens = r"<<SYS>>|\[INST\]|<s>|<\|role:[^|]*\|>"
    closes = r"<</SYS>>|\[/INST\]|</s>|<\|/role\|>"
    # The first alternative that is reached ends a text: no control string stands inside one.
    whole = F.regexp_extract_all(formatted, F.lit(rf"(?s)(?:{opens}).*?(?:{closes})"), F.lit(0))

    def one(s: Column) -> Column:
        mark = F.regexp_extract(s, rf"^(?:{opens})", 0)
        end = F.regexp_extract(s, rf"(?:{closes})$", 0)
        body = F.substring(s, F.length(mark) + 1, F.length(s) - F.length(mark) - F.length(end))
        role = _role_in(F.regexp_extract(mark, r"^<\|role:([^|]*)\|>$", 1))
        for name, (a, _) in MARKS.items():
            role = F.when(mark == a, F.lit(name)).otherwise(role)
        return _turn(role, unescape(body))

    return F.transform(whole, one)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))))


def records_of(conversations: DataFrame) -> DataFrame:
    """Conversation rows as message-list records, turns in order (ties by role, then text)."""
    row = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD if f.name != "messages"]
    return conversations.groupBy("conv_id").agg(listed.alias("m")).select("conv_id", F.struct(F.col("m").alias("messages"), *rest).cast(RECORD).alias("record"))


def format_chats(records: DataFrame) -> DataFrame:
    """Records (any columns and record) rendered: adds layout, formatted, loss_spans.

    Null texts are empty. A record with no known layout gets an empty string and
    no spans; an empty table gives an empty table.
    """
    return render(canonical_turns(records)).drop("turns")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.struct(*[(F.lit(tricky) if f.name in ("prompt", "response") else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD]).cast(RECORD).alias("record"),
    )
    out = format_chats(records_of(rows).unionByName(own)).withColumn("turns", parse(F.col("formatted")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))))
    under = loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"),
        F.sha2(under.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# The template adds 15 code points to a system turn, 13 to a user's, 7 to an assistant's.
_BROKEN = r"([<\[])(\\*)(</?SYS>>|/?INST\]|/?s>|\|/?role)"
ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 18 + coalesce(length(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '>', '%3E')), 3) END
    + length(text) + len(regexp_extract_all(text, '{_BROKEN}')) AS n FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
