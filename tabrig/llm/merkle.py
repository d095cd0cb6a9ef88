"""Merkle manifest of a dataset, with a witness for every row, by incremental witnesses.

Every row is a leaf, the hash of its fields. Per group (language) the leaves ascend by id, and
every two consecutive nodes become their hash, level by level; a last one alone is hashed
alone. The groups' roots, in order, make the top tree in the same way.

A tree grows by streaming aligned append (``Appender``): the open subtrees have sizes of
falling powers of two; an appended leaf closes those that it completes, and whenever two
siblings complete, each one's digest extends the partial witnesses that are attached to the other's
rows. Spark appends in aligned blocks of ``BLOCK`` leaves, each block in a task of its own; the
block roots are further appends to the same tree, again in blocks, until a group has one root; the groups'
roots are the appends of the top tree. A row's witness is its block's part, then that of
its block root, and so on: the parts are joined by block, so no group passes through one
task, and a group with a third of all rows is as many blocks as any other rows.

Positions come from a range partitioning by group, id, leaf and row number, with the row counts of each
partition and group summed up.

Defined results: a null field is ``-``; groups are ordered null first, then by UTF-8 bytes;
null ids come first in their group; rows of equal id are ordered by their leaf (equal
rows have equal leaves, so their order tells nothing); an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, sql_crc32, sql_crc_table, table

BITS = 10
BLOCK = 1 << BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    """The hash of the parts' hex texts."""
    return sha256("".join(p.hex() for p in parts).encode()).digest()


def levels_of(n: int) -> int:
    return (n - 1).bit_length()


class Appender:
    """An aligned subtree that grows by appended digests. ``open`` holds (level, first row,
    digest) of the complete subtrees without a sibling; ``witness`` the siblings seen so far
    of every row, by level."""

    def __init__(self, size: int, levels: int):
        self.open: list[tuple[int, int, bytes]] = []
        self.rows = 0
        self.witness = np.zeros((size, levels, 32), np.uint8)

    def _join(self) -> None:
        level, mid, right = self.open.pop()
        _, first, left = self.open.pop()
        self.witness[first:mid, level] = np.frombuffer(right, np.uint8)
        self.witness[mid:self.rows, level] = np.frombuffer(left, np.uint8)
        self.open.append((level + 1, first, digest(left, right)))

    def _complete(self) -> bool:
        return len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]

    def append(self, leaf: bytes) -> None:
        self.open.append((0, self.rows, leaf))
        self.rows += 1
        while self._complete():
            self._join()

    def close(self, levels: int) -> bytes:
        """The root after the last append, ``levels`` above the leaves: nodes without a
        sibling are hashed alone."""
        while len(self.open) > 1 or self.open[-1][0] < levels:
            if self._complete():
                self._join()
            else:
                level, first, node = self.open.pop()
                self.open.append((level + 1, first, digest(node)))
        return self.open[0][2]


def path(pos: int, n: int, witness: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(side, sibling) from the leaf up: side 1 if the node is the right one of its run; no
    sibling for a node alone in it."""
    for level in range(levels_of(n)):
        at, last = pos >> level, (n - 1) >> level
        alone = at == last and not at & 1
        yield at & 1, None if alone else witness[32 * level:32 * level + 32]


def fold(leaf: bytes, steps: list[tuple[int, bytes | None]]) -> bytes:
    """The root that follows from a leaf and its path."""
    for side, other in steps:
        leaf = digest(leaf) if other is None else digest(other, leaf) if side else digest(leaf, other)
    return leaf


def _leaf(fields: list[Column]) -> Column:
    texts = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
           forged_col: str = "n_chars", forge_every: int = 7) -> DataFrame:
    """``id``, ``grp``, ``leaf`` of every row, and ``forged``: the leaf after 1 is added to
    ``forged_col``, where ``forge_every`` divides the crc32 of the id (else null)."""
    plain = _leaf([col(c) for c in fields])
    changed = _leaf([col(c) + 1 if c == forged_col else col(c) for c in fields])
    hit = F.crc32(col(id_col).cast("string").cast("binary")) % forge_every == 0
    return docs.select(col(id_col).alias("id"), col(group_col).cast("string").alias("grp"), plain.alias("leaf"),
                       F.when(hit, changed).alias("forged"), F.monotonically_increasing_id().alias("seq"))


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` range partitioned and sorted by group and order, with the partition ``part`` and the
    place ``at`` of each row within its partition and group."""
    keys = [F.col(c).asc_nulls_first() for c in [group, *order]]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), (), 0
        for batch in parts:
            places = []
            for g in batch.column(group).to_pylist():
                at = at + 1 if last == (g,) else 0
                last = (g,)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(places, pa.int64())],
                                             [*batch.schema.names, "part", "at"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialise(ranged.mapInArrow(number, fields + ", part int, at long"), "merkle-order")


def _offsets(numbered: DataFrame, group: str) -> DataFrame:
    """For each partition and group: the group's rows ``before`` it, and its size ``n``."""
    counts = numbered.groupBy("part", group).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy(group)
    before = F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("part", group, F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(w).alias("n"))


def placed(rows: DataFrame) -> DataFrame:
    """The leaves with ``pos`` in their group, the group's size ``n``, and the group's rank ``g``
    among ``groups``."""
    numbered = _numbered(rows, "grp", ["id", "leaf", "seq"]).drop("seq")
    offsets = materialise(_offsets(numbered, "grp"), "merkle-offsets")
    names = offsets.select("grp").distinct().withColumn("all", F.lit(0))
    ranked = _numbered(names, "all", ["grp"])
    first = _offsets(ranked, "all").select("part", "before", F.col("n").alias("groups"))
    ranks = ranked.join(first, "part").select(F.col("grp").alias("name"), (F.col("before") + F.col("at")).alias("g"), "groups")
    offsets = offsets.join(ranks, F.col("grp").eqNullSafe(F.col("name"))).select(
        F.col("part").alias("p"), F.col("grp").alias("name"), "before", "n", "g", "groups")
    same = (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("name"))
    return numbered.join(offsets, same).select("id", "grp", "leaf", "forged", (F.col("before") + F.col("at")).alias("pos"), "n", "g", "groups")


def _append_block(rows: pa.Table) -> pa.Table:
    """One block of appends: every row's part of the witness, and the block's root in its first row."""
    rows = rows.sort_by("pos")
    n = rows["n"][0].as_py()
    levels = BITS if n > BLOCK else levels_of(n)
    tree = Appender(len(rows), levels)
    for leaf in rows["digest"].to_pylist():
        tree.append(leaf)
    root = tree.close(levels)
    raw, step = tree.witness.tobytes(), 32 * levels
    rows = rows.append_column("witness", pa.array([raw[i * step:(i + 1) * step] for i in range(len(rows))], pa.binary()))
    return rows.append_column("root", pa.array([root] + [None] * (len(rows) - 1), pa.binary()))


def witnessed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (``g``, ``pos``, ``n``, ``digest`` and further columns) with the ``witness`` of
    each below its tree's root; and (``g``, ``root``) of every tree."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    block = F.shiftright("pos", BITS)
    stage = nodes.groupBy("g", block.alias("block")).applyInArrow(_append_block, fields + ", witness binary, root binary")
    stage = materialise(stage, "merkle-blocks")
    blocks = stage.where("root IS NOT NULL").select(
        "g", block.alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("root").alias("digest"))
    if blocks.where("n > 1").isEmpty():
        return stage.drop("root"), blocks.select("g", F.col("digest").alias("root"))
    above, roots = witnessed(blocks)
    above = above.select(F.col("g"), F.col("pos").alias("block"), F.col("witness").alias("above"))
    stage = stage.drop("root").withColumn("block", block).join(above, ["g", "block"])
    return stage.withColumn("witness", F.concat("witness", "above")).drop("block", "above"), roots


def manifest(rows: DataFrame) -> tuple[DataFrame, bytes | None]:
    """The leaves with ``pos``, ``n``, ``g``, ``groups``, their ``witness`` to the group's root
    ``subroot``, and the group's witness ``top_witness`` to the root, which comes beside (None
    without rows). ``rows``: as of ``leaves``."""
    nodes = placed(materialise(rows, "merkle-leaves")).withColumnRenamed("leaf", "digest")
    below, subroots = witnessed(nodes)
    sizes = nodes.select("g", "groups").distinct()
    tops = subroots.join(sizes, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"),
                                            F.col("groups").alias("n"), F.col("root").alias("digest"))
    above, root = witnessed(tops)
    got = root.select("root").collect()  # one row
    above = above.select(F.col("pos").alias("g"), F.col("digest").alias("subroot"), F.col("witness").alias("top_witness"))
    out = below.withColumnRenamed("digest", "leaf").join(above, "g")
    return out, bytes(got[0]["root"]) if got else None


def proofs(entries: DataFrame, root: bytes | None) -> DataFrame:
    """``id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (the hash of all siblings, upwards),
    ``folded_root`` (from the forged leaf where there is one) and ``verified``, digests as hex."""
    want = root or b""

    def fold_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = ["leaf", "forged", "pos", "n", "witness", "g", "groups", "top_witness", "subroot"]
            hexes, proof, folded = [], [], []
            for leaf, forged, pos, n, witness, g, groups, top, subroot in zip(*[part.column(c).to_pylist() for c in names]):
                steps = [*path(pos, n, witness), *path(g, groups, top)]
                hexes.append((leaf.hex(), subroot.hex()))
                proof.append(digest(*[s for _, s in steps if s is not None]).hex())
                folded.append(fold(leaf if forged is None else forged, steps).hex())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([h[0] for h in hexes], pa.string()), pa.array([h[1] for h in hexes], pa.string()),
                 pa.array([want.hex()] * len(part), pa.string()), pa.array(proof, pa.string()), pa.array(folded, pa.string()),
                 pa.array([f == want.hex() for f in folded], pa.bool_())],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = entries.schema["id"].dataType.simpleString()
    return entries.mapInArrow(fold_all, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12(spark, sf_dir: str) -> DataFrame:
    out = proofs(*manifest(leaves(table(spark, sf_dir, "documents"))))
    return out.withColumnRenamed("id", "doc_id")


def _op12_sql(levels: int = 24, top_levels: int = 10) -> str:
    """The trees level by level, in plain SQL: up to 2 ** levels rows a group."""
    def field(name: str, value: str) -> str:
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"

    def leaf(chars: str) -> str:
        parts = [("doc_id", "CAST(doc_id AS VARCHAR)"), ("source", "source"), ("lang", "lang"), ("n_chars", f"CAST({chars} AS VARCHAR)"), ("text", "text")]
        return "sha256(" + " || ".join(field(*p) for p in parts) + ")"

    def climb(kind: str, first: str, count: int) -> tuple[list[str], str]:
        steps = [first]
        for i in range(count):
            steps.append(f"{kind}{i + 1} AS MATERIALIZED (SELECT g, pos // 2 AS pos, CASE WHEN any_value(cnt) = 1 THEN any_value(d) ELSE "
                         f"sha256(string_agg(d, '' ORDER BY pos)) END AS d, (any_value(cnt) + 1) // 2 AS cnt FROM {kind}{i} GROUP BY g, pos // 2)")
        return steps, f"{kind}{count}"

    def walk(kind: str, count: int, source: str, g: str, pos: str) -> list[str]:
        out = []
        for i in range(count):
            own, other = f"(w.{pos} >> {i})", "coalesce(s.d, '')"
            step = f"CASE WHEN o.cnt = 1 THEN cur WHEN s.d IS NULL THEN sha256(cur) WHEN {own} % 2 = 1 THEN sha256(s.d || cur) ELSE sha256(cur || s.d) END"
            out.append(f"{kind}w{i + 1} AS MATERIALIZED (SELECT w.* REPLACE (proof || {other} AS proof, {step} AS cur) FROM {source} w "
                       f"JOIN {kind}{i} o ON o.g = {g} AND o.pos = {own} LEFT JOIN {kind}{i} s ON s.g = {g} AND s.pos = xor({own}, 1))")
            source = f"{kind}w{i + 1}"
        return out

    nodes, last = climb("a", "a0 AS MATERIALIZED (SELECT rank AS g, pos, leaf AS d, cnt FROM placed)", levels)
    tops, top = climb("b", f"b0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, d, count(*) OVER () AS cnt FROM {last})", top_levels)
    walks = walk("a", levels, "start", "w.rank", "pos")
    walks += walk("b", top_levels, f"aw{levels}", "0", "rank")
    parts = [f"crc AS MATERIALIZED ({sql_crc_table()})",
             f"leaves AS MATERIALIZED (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN {sql_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 "
             f"THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS used FROM documents, crc)",
             "placed AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, "
             "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS cnt FROM leaves)",
             *nodes, *tops, "start AS MATERIALIZED (SELECT doc_id, leaf, rank, pos, used AS cur, '' AS proof FROM placed)", *walks]
    return (f"WITH {', '.join(parts)} SELECT w.doc_id, w.leaf, n.d AS subroot, t.d AS root, sha256(w.proof) AS proof_sha256, "
            f"w.cur AS folded_root, w.cur = t.d AS verified FROM bw{top_levels} w JOIN {last} n ON n.g = w.rank JOIN {top} t ON t.g = 0")


OP12_SQL = _op12_sql()
