"""Chat formatting: layouts recognised by schema fingerprints, canonical turns, a
reversible template with a loss mask.

Records come as JSON in many layouts (prompt and response, instruction and output, lists
of messages). The fingerprint of a record is the hash of its nested field paths, without
the types of its values; it selects a declarative mapping that turns the record into
canonical turns (role, text). The template marks every turn and escapes its own control
strings in the texts, so the turns can be read back from the formatted text exactly.
DataFrame functions only.

Defined results: a null role or text counts as empty, a conversation without turns is
formatted as the empty text, turns of equal number are ordered by role and text, a null
conversation id is a conversation of its own, and a record of an unknown layout, or one
that is no JSON, gets null turns, so that the caller sees it. Further columns are carried along; those
named like a result (fingerprint, layout, turns, formatted, loss) are replaced. The turns
of a conversation are gathered in one row, which is the result's definition. Texts and
records have no limit of size but the row's: rows by turn bring their field paths along, and
a JSON record too large for a variant is told by ``large_paths``, or raises an error if it is
of no known layout.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, table

TURNS = "array<struct<role:string,text:string>>"
#: Raises the parser's limits, by default 20,000,000 characters a text.
UNLIMITED = {"maxStringLen": "2147483647", "maxNumLen": "2147483647"}
#: Bytes from which on a record may exceed a limit of the variant parser.
LARGE = 16_000_000


@dataclass(frozen=True)
class Layout:
    """``paths``: the nested field paths (fields by name). Either ``turns``: (role, field)
    in order, a field that is null or empty being left out if ``skip_empty``, or ``items``:
    (list field, role field, text field), with ``roles``: the layout's names of roles."""

    name: str
    paths: str
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)
    skip_empty: bool = False

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.paths.encode()).hexdigest()

    def read(self, record: Column) -> Column:
        """Canonical turns of a record of this layout."""
        if self.items:
            top, role, text = self.items
            schema = f"struct<`{top}`:array<struct<`{role}`:string,`{text}`:string>>>"
            parsed = F.coalesce(F.from_json(record, schema, UNLIMITED).getField(top), F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>"))

            def one(x: Column) -> Column:
                name = F.coalesce(x.getField(role), F.lit(""))
                for theirs, ours in self.roles.items():
                    name = F.when(x.getField(role) == theirs, ours).otherwise(name)
                return F.struct(name.alias("role"), F.coalesce(x.getField(text), F.lit("")).alias("text"))

            return F.transform(parsed, one).cast(TURNS)
        parsed = F.from_json(record, "struct<" + ",".join(f"`{f}`:string" for _, f in self.turns) + ">", UNLIMITED)
        turns = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(parsed.getField(f), F.lit("")).alias("text"))
                          for r, f in self.turns])
        return (F.filter(turns, lambda t: t["text"] != "") if self.skip_empty else turns).cast(TURNS)

    def fits(self, record: Column) -> Column:
        """Whether a record, read without a variant, has this layout's field paths."""
        def part(name: str, kind: str) -> Column:
            return F.from_json(record, f"struct<`{name}`:{kind}>", UNLIMITED).getField(name)

        def are(keys: Column, names: list[str]) -> Column:
            return F.sort_array(keys) == F.array(*[F.lit(n) for n in sorted(names)])

        top = F.map_keys(F.from_json(record, "map<string,string>", UNLIMITED))
        if self.items:
            name, *fields = self.items
            items = part(name, "array<map<string,string>>")
            some = F.array_distinct(F.flatten(F.transform(items, lambda x: F.map_keys(x))))
            objects = F.size(items) > 0 if self.paths.endswith("OBJECT<" + ": *, ".join(sorted(fields)) + ": *>>>") else F.lit(False)
            inner = are(some, fields) & ~F.exists(items, lambda x: x.isNull()) & objects
            for kind in ("map<string,string>", "array<string>"):
                for f in fields:
                    inner = inner & ~F.coalesce(F.exists(part(name, f"array<struct<`{f}`:{kind}>>"), lambda x: x.getField(f).isNotNull()), F.lit(False))
            return F.coalesce(are(top, [name]) & inner, F.lit(False))
        nested = F.lit(False)
        for _, f in self.turns:
            nested = nested | part(f, "map<string,string>").isNotNull() | part(f, "array<string>").isNotNull()
        return F.coalesce(are(top, [f for _, f in self.turns]) & ~nested, F.lit(False))


SHARE_ROLES = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content: *, role: *>>>", items=("messages", "role", "content")),
    Layout("messages, none", "OBJECT<messages: ARRAY<*>>", items=("messages", "role", "content")),
    Layout("from and value", "OBJECT<conversations: ARRAY<OBJECT<from: *, value: *>>>",
           items=("conversations", "from", "value"), roles=SHARE_ROLES),
    Layout("from and value, none", "OBJECT<conversations: ARRAY<*>>", items=("conversations", "from", "value")),
    Layout("prompt and response", "OBJECT<prompt: *, response: *>", turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("system, prompt and response", "OBJECT<prompt: *, response: *, system: *>",
           turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction and output", "OBJECT<instruction: *, output: *>",
           turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction, input and output", "OBJECT<input: *, instruction: *, output: *>", skip_empty=True,
           turns=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
)

SCALAR = (r"(?<=: |ARRAY<|^)(?:DECIMAL\(\d+,\s*\d+\)|STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|VOID|BINARY|DATE|"
          r"TIMESTAMP|TIMESTAMP_NTZ|UUID|VARIANT)(?=[,>]|$)")


def field_paths(record: Column) -> Column:
    """Nested field paths of a JSON record, fields sorted by name; null if it is no JSON."""
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), SCALAR, "*")


def large_paths(record: Column, layouts: tuple[Layout, ...]) -> Column:
    """Field paths of a record that is too large for a variant: those of the layout that it
    fits. Null if it is no JSON object; an error if it is one of no known layout."""
    paths = F.lit(None).cast("string")
    for x in reversed(layouts):
        paths = F.when(x.fits(record), x.paths).otherwise(paths)
    unknown = F.from_json(record, "map<string,string>", UNLIMITED).isNotNull()
    error = F.concat(F.lit("a record of "), F.octet_length(record).cast("string"), F.lit(" bytes is too large to tell its field paths"))
    return F.coalesce(paths, F.when(unknown, F.raise_error(error).cast("string")))


def canonical_turns(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS,
                    paths_col: str | None = None) -> DataFrame:
    """The input with ``fingerprint``, ``layout`` and ``turns`` (null for an unknown layout).
    ``paths_col``: a column of the records' field paths, where they are known."""
    record = col(record_col)
    if paths_col is None:
        large = F.when(F.octet_length(record) >= LARGE, large_paths(record, layouts))
        paths = F.coalesce(field_paths(record), large)
    else:
        paths = col(paths_col)
    out = records.withColumn("fingerprint", F.sha2(paths, 256))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        here = F.col("fingerprint") == x.fingerprint
        name, turns = F.when(here, x.name).otherwise(name), F.when(here, x.read(col(record_col))).otherwise(turns)
    return out.withColumns({"layout": name, "turns": turns})


# The template: "### <role>: <text>\n</turn>\n" for each turn. Inside roles and texts the
# backslash is doubled and the control strings are broken by "\e", "\h" and "\c".
HEAD, TAIL = "### ", "\n</turn>\n"
ESCAPES = (("\\", "\\\\"), ("</turn>", "\\e/turn>"), ("### ", "\\h## "))


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    """The inverse: between doubled backslashes, which are cut off from the left, every
    remaining backslash begins a broken control string."""
    def part(x: Column) -> Column:
        for a, b in (("\\e", "<"), ("\\h", "#"), ("\\c", ":")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_turns(df: DataFrame, turns_col: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """The input with ``formatted`` and ``loss``: the spans (start, length; code points)
    of the texts to learn from, those of ``loss_role``."""
    parts = F.transform(col(turns_col), lambda t: F.struct(
        (t["role"] == loss_role).alias("learn"),
        F.concat(F.lit(HEAD), F.replace(escape(t["role"]), F.lit(": "), F.lit("\\c ")), F.lit(": ")).alias("head"),
        escape(t["text"]).alias("body")))
    out = df.withColumn("_parts", parts)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(start.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))
        return F.struct((start + F.length(p["body"]) + len(TAIL)).cast("long").alias("at"),
                        F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(TAIL))), "")
    return out.withColumns({"formatted": text, "loss": F.aggregate("_parts", zero, step, lambda acc: acc["spans"])}).drop("_parts")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(formatted, TAIL, -1)

    def one(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(HEAD) + 1))
        role = F.substring_index(rest, ": ", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(rest, F.length(role) + 3)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), one)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def as_records(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one JSON record for each conversation, in the layout that holds
    it: prompt and response, system, prompt and response, or, by turns, one of the lists.
    ``paths``: the record's field paths, which follow from the layout."""
    rows = turns.select(col(key).alias("key"), F.struct(
        col(order).alias("o"), F.coalesce(col(role), F.lit("")).alias("role"), F.coalesce(col(text), F.lit("")).alias("text")).alias("t"))
    got = rows.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    pair, triple = F.array(F.lit("user"), F.lit("assistant")), F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    texts = F.transform("t", lambda x: x["text"])
    theirs = F.transform("t", lambda x: F.struct(
        F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"),
        x["text"].alias("value")))
    ours = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    renamed = F.exists("t", lambda x: x["role"].isin(*SHARE_ROLES))
    odd = F.coalesce(F.xxhash64("key") % 2 != 0, F.lit(False))
    by_name = {x.name: x.paths for x in LAYOUTS}
    forms = [((roles == pair) & odd, "prompt and response", F.struct(
                 F.get(texts, F.lit(0)).alias("prompt"), F.get(texts, F.lit(1)).alias("response"))),
             (roles == pair, "instruction and output", F.struct(
                 F.get(texts, F.lit(0)).alias("instruction"), F.get(texts, F.lit(1)).alias("output"))),
             (roles == triple, "system, prompt and response", F.struct(
                 F.get(texts, F.lit(0)).alias("system"), F.get(texts, F.lit(1)).alias("prompt"), F.get(texts, F.lit(2)).alias("response"))),
             (odd & ~renamed, "from and value", F.struct(theirs.alias("conversations"))),
             (F.lit(True), "messages", F.struct(ours.alias("messages")))]
    record, paths = F.lit(None).cast("string"), F.lit(None).cast("string")
    for here, name, form in reversed(forms):
        record, paths = F.when(here, F.to_json(form)).otherwise(record), F.when(here, by_name[name]).otherwise(paths)
    return got.select(F.col("key").alias(key), record.alias("record"), paths.alias("paths"))


#: The added conversation, whose texts hold control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op6(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    out = format_turns(canonical_turns(as_records(rows)))
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                      read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '\e/turn>'), '### ', '\h## ') AS body,
             replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e/turn>'), '### ', '\h## '), ': ', '\c ') AS name FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(4 + length(name) + 2 + length(body) + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
