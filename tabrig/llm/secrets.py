"""Secret scan with multipart credential linking.

A scan of every whole text yields strong findings (an assigned secret, an access id, a
long hex string), which are always reported, and weak parts: identifiers (a user or
client id being set), random-looking strings, and endpoints (a URL, a host being set).
A weak part says little by itself. It is reported only where complementary parts lie
within ``reach`` code points of it (None: anywhere, as in op2) in the same scope (a
paragraph: lines up to a blank one): a random string with an identifier, an identifier with a secret, an endpoint with both.

The parts are joined as intervals: inside a scope, sorted by start, the nearest end
before a part and the nearest start behind it, for each class of parts, decide; no pairs
are formed, so a text with very many parts costs no more than their sorting.

Defined results: a null text counts as empty and has no findings; rows of equal or null
id are scanned one by one; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import col, materialise, table

#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
SECRET, IDENTIFIER, ENDPOINT = "secret", "identifier", "endpoint"
CLASS = {0: SECRET, 1: IDENTIFIER, 2: SECRET, 3: IDENTIFIER, 4: SECRET, 5: ENDPOINT}

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
SETS_ID = re.compile(r"""(?ai:(?<![A-Z0-9])(?:user(?:_?name)?|login|account|client_?id|key_?id|access_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACE = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+|(?ai:(?<![A-Z0-9])(?:host|server|endpoint))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::\d+)?""")
BREAK = re.compile(r"\n[ \t\r]*\n")

SPAN = StructType([StructField("start", IntegerType()), StructField("kind", IntegerType()),
                   StructField("end", IntegerType()), StructField("scope", IntegerType())])


def strong(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong findings."""
    found = []
    lower = text.lower()
    if any(n in lower for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def looks_random(s: str) -> bool:
    """Letters and digits, at over 3.5 bits a character."""
    n = len(s)
    return (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
            and -sum(c / n * math.log2(c / n) for c in Counter(s).values()) > 3.5)


def weak(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the weak parts that no strong finding overlaps; none where
    the text has no identifier, as each link needs one."""
    ids = [(m.start(), 3, m.end()) for m in SETS_ID.finditer(text)] if ":" in text or "=" in text else []
    if not ids and not any(k == 1 for _, k, _ in base):
        return []
    found = ids + [(m.start(), 5, m.end()) for m in PLACE.finditer(text)]
    apart = free_of(base)
    found = [x for x in found if apart(x)]
    free = free_of(base + found)
    return found + [x for m in RANDOM.finditer(text) if free(x := (m.start(), 4, m.end())) and looks_random(m[0])]


def free_of(spans: list[tuple[int, int, int]]):
    """Tells whether a span overlaps none of these."""
    starts, ends, furthest = [], [], 0
    for a, b in sorted((a, b) for a, _, b in spans):
        furthest = max(furthest, b)
        starts.append(a)
        ends.append(furthest)

    def free(span: tuple[int, int, int]) -> bool:
        k = bisect(starts, span[2] - 1)
        return not k or ends[k - 1] <= span[0]

    return free


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``base`` and ``weak`` (arrays of start, kind, end, scope) of every row."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("base", ArrayType(SPAN)),
                         StructField("weak", ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f, pa.int32()) for f in ("start", "kind", "end", "scope")]))
        for batch in batches:
            out: list[list] = [[], []]
            for text in batch.column(1).to_pylist():
                base = strong(text or "")
                parts = weak(text, base) if text else []
                breaks = [m.start() for m in BREAK.finditer(text)] if parts else []
                for rows, to in ((base, out[0]), (parts, out[1])):
                    to.append([{"start": a, "kind": k, "end": b, "scope": bisect(breaks, a)} for a, k, b in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x in out)], schema.names)

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, schema)


def link(parts: DataFrame, reach: int | None = 200) -> DataFrame:
    """The weak parts of ``parts`` (row, start, kind, end, scope) that have complementary
    parts within reach (None: anywhere) in their scope."""
    cls = F.create_map(*[F.lit(x) for kv in CLASS.items() for x in kv])
    rows = parts.withColumn("cls", cls[F.col("kind")])
    order = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(1, Window.unboundedFollowing)

    def near(c: str) -> Column:
        here = F.col("cls") == c
        if reach is None:  # parts of two classes are two parts, so the own one does not count
            return F.max(here).over(Window.partitionBy("row", "scope"))
        return (F.coalesce(F.col("start") - F.max(F.when(here, F.col("end"))).over(before) <= reach, F.lit(False))
                | F.coalesce(F.min(F.when(here, F.col("start"))).over(behind) - F.col("end") <= reach, F.lit(False)))

    rows = rows.withColumns({"by_secret": near(SECRET), "by_id": near(IDENTIFIER)})
    return rows.where(((F.col("kind") == 3) & F.col("by_secret")) | ((F.col("kind") == 4) & F.col("by_id"))
                      | ((F.col("kind") == 5) & F.col("by_secret") & F.col("by_id")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = 200) -> DataFrame:
    """One row per document: ``id``, ``base`` and ``spans``, the strong findings and these
    with the linked weak parts, sorted by start and kind."""
    # written once: the row numbers stay the same for all uses
    scanned = materialise(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    parts = scanned.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("p"))
    linked = link(parts.select("row", "p.*"), reach)
    linked = linked.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "scope")).alias("linked"))
    out = scanned.join(linked, "row", "left")
    none = F.array().cast(ArrayType(SPAN))
    return out.select("id", F.array_sort("base").alias("base"),
                      F.array_sort(F.concat("base", F.coalesce("linked", none))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def op2(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), reach=None)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in range(3)], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.col("spans")).alias("spans"))
