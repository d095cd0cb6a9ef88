"""MinHash near-duplicates by tensored banding.

Two small collections of hash groups, A and B, are computed for each text. The key of
table (i, j) combines group i of A with group j of B, so ``groups`` ** 2 tables need only
2 * ``groups`` * ``rows`` minhashes. Texts of equal shingle sets are one class from the start, and
only groups that classes share are combined.

Links are verified in two rounds. In the first, the least class of each bucket is
compared with the bucket's others, and every class is confirmed against the most similar
of these; the confirmed links make components. In the second, buckets that still hold
several components are searched for links between these. Sketches of all cross pairs that share a bucket are compared,
in blocks of ``block`` members, each class once for each component whose buckets it is in. At first
only the most similar partner of each class is confirmed, and the components are contracted, as long as this finds links; then
all pairs that may reach the threshold and still lie in different components are confirmed. Pairs inside one component need no
comparison, so thousands of near copies cost a few for each. Confirmation compares the full shingle sets
(64-bit hashes) and nothing is capped.

A pair at the threshold of 0.85 shares no key with a probability of 5e-6 (at 0.8: 7e-5)
with the default 10 groups of 2 rows. The sketches (one permutation, 256 ranges, and 2,048 before pairs are confirmed at last) only drop
pairs over six standard deviations below the threshold, with a probability of about 1e-9.

Defined results: an empty or null text has an empty set and is linked with nothing; a
text with fewer words than a shingle has its whole word sequence as its only shingle; rows of equal or null id
are documents of their own; the component's id is its least id, nulls last; of each
component the row of the least id (then of the least row number) is kept; an empty table
gives no rows. Further columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import col, materialise, packed, table, unpacked
from .components import components

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> MIX[2])) * MIX[1]
    return x ^ (x >> MIX[2])


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII blanks (9 to 13, 32) part words
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    one = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(one, words), np.uint64, n)
    k = min(size, n)
    x = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        x = _mix(x * MIX[0] + h[i:n - k + 1 + i])
    return np.unique(x)


class Hashes:
    """The two collections: ``groups`` groups of ``rows`` minhashes each."""

    def __init__(self, groups: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        m = 2 * groups * rows
        self.groups, self.rows = 2 * groups, rows
        self.xor = rng.integers(0, 1 << 63, m, np.uint64)[:, None]
        self.by = (rng.integers(0, 1 << 63, m, np.uint64) | np.uint64(1))[:, None]
        self.salt = rng.integers(0, 1 << 63, 2 * groups, np.uint64)

    def signature(self, x: np.ndarray) -> np.ndarray:
        least = np.full(len(self.by), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(x), 4096):
            least = np.minimum(least, _mix((x[None, at:at + 4096] ^ self.xor) * self.by).min(1))
        return least

    def group_values(self, signature: np.ndarray) -> np.ndarray:
        out = self.salt.copy()
        for column in signature.reshape(self.groups, self.rows).T:
            out = _mix(out * MIX[0] + column)
        return out.view(np.int64)


def _fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, groups: int, rows: int, seed: int) -> DataFrame:
    """A row for each document: ``row``, ``id``, ``th`` (hash of the text), ``n``, ``set``
    (digest of the shingle set), ``groups`` and ``sketch`` (see there)."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("th", BinaryType()), StructField("n", LongType()),
                         StructField("set", BinaryType()), StructField("groups", ArrayType(LongType())), StructField("sketch", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(groups, rows, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out: list[list] = [[], [], [], []]
                for text in batch.column(2).to_pylist():
                    x = shingles(text or "", size)
                    if len(x):
                        s = hashes.signature(x)
                        made = (len(x), hashlib.md5(x.tobytes()).digest(), hashes.group_values(s), sketch(x))
                    else:
                        made = (0, None, None, None)
                    for to, v in zip(out, made, strict=True):
                        to.append(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                                                  pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.binary())], schema.names)

    text = F.coalesce(col(text_col), F.lit(""))
    made = docs.select(col(id_col).alias("id"), F.unhex(F.md5(text)).alias("th"), text.alias("text")).mapInArrow(run, schema)
    return materialise(made.withColumn("row", F.monotonically_increasing_id()), "neardup-fingerprints")


def _buckets(classes: DataFrame, groups: int) -> DataFrame:
    """``key``, ``least`` (the least class of the bucket), ``c`` for buckets of several
    classes. Hash groups that no two classes share are left out before they are combined."""
    one = classes.select("c", F.posexplode("groups").alias("slot", "value"))
    shared = one.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    some = one.join(shared, ["slot", "value"]).groupBy("c").agg(F.collect_list(F.struct("slot", "value")).alias("g"))
    a = F.filter("g", lambda x: x["slot"] < groups)
    b = F.filter("g", lambda x: x["slot"] >= groups)
    pairs = some.select("c", F.explode(a).alias("a"), b.alias("b")).select("c", "a", F.explode("b").alias("b"))
    keyed = pairs.select("c", F.xxhash64("a.slot", "a.value", "b.slot", "b.value").alias("key"))
    many = keyed.groupBy("key").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "least")
    return materialise(keyed.join(many, "key"), "neardup-buckets")


BINS = 256
FINE = 2048  # ranges of the sketches that decide which pairs are confirmed in the end
PAIRS = 16_384  # compared at once
PAYS = 10  # contraction goes on while one in so many of its pairs is a link


def sketch(x: np.ndarray, bins: int = BINS) -> bytes:
    """A byte (not 0) of the least hash of each of as many ranges of hashes (a power of two), 0 for an empty
    range. ``x`` is sorted."""
    out = np.zeros(bins, np.uint8)
    at, first = np.unique(x >> np.uint64(65 - bins.bit_length()), return_index=True)
    out[at.astype(np.int64)] = (x[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def _near(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the share of equal ranges among those that are not empty in both, and
    whether it lies within six standard deviations of the threshold or above. The ranges' least hashes are a random
    part of the union's (of both sets' ``sizes`` together, at the threshold), drawn without putting back."""
    used = a.shape[1] - ((a | b) == 0).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    p = percent / 100
    union = sizes / (1 + p)
    left = np.clip((union - used) / np.maximum(union - 1, 1), 0, 1)
    return equal / np.maximum(used, 1), equal >= used * p - 6 * np.sqrt(p * (1 - p) * used * left) - 1


def _confirm(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |intersection| >= percent * |union| of the full sets.
    The texts of the b's of an a are checked in units of 64 against the a's, which a
    unit holds once; units are streamed one after the other."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).alias("units"))
    units = pairs.join(counts, "a").withColumn("unit", F.pmod(F.xxhash64("b"), "units"))
    of = classes.select("c", "th")
    asked = units.select("a", "unit", F.col("b").alias("c"), F.lit(1).alias("side")).union(
        units.select("a", "unit", F.col("a").alias("c"), F.lit(0).alias("side")).distinct())
    rows = asked.join(of, "c").join(texts, "th").select("a", "unit", "side", "c", "text")
    rows = rows.repartition("a", "unit").sortWithinPartitions("a", "unit", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            found: list[list[int]] = [[], []]
            for i, side, c, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                x = shingles(text, size)
                if not side:
                    held = x
                    continue
                both = len(np.intersect1d(held, x, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(x) - both):
                    found[0].append(i)
                    found[1].append(c)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["a", "b"])

    return materialise(rows.mapInArrow(run, "a long, b long"), "neardup-links")


def _cross_pairs(buckets: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, block: int,
                 best: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of different components that share a bucket and may be links by their sizes and sketches; with
    ``best`` only the most similar one of each class outside the main component. And the rows (``key``, ``c``) that stand for the
    buckets from here on: each component with its hosts and guests, as components only ever grow together.

    A bucket belongs to its largest component. That component's members in such buckets are its hosts, all other
    classes of these buckets its guests, each once whatever the number of shared buckets; guests
    are tested against hosts and against other guests, where the two share a bucket."""
    rows = buckets.select("key", "c").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    parts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mains = parts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "label")).alias("most"))
    mains = mains.where("kinds > 1").select("key", F.col("most.label").alias("main"))
    placed = materialise(rows.join(mains, "key").select("main", "c", "label").distinct(), "neardup-guests")
    is_main = F.col("label") == F.col("main")
    facts = placed.groupBy("main").agg(F.ceil(F.count_if(is_main) / block).cast("int").alias("mains"),
                                       F.ceil(F.count_if(~is_main) / block).cast("int").alias("others"))
    prints = classes.select("c", "n", "groups", "sketch", F.lit(None).cast("binary").alias("fine")) if best else \
        _fine_sketches(placed, classes, texts, size)
    open_rows = placed.join(facts, "main").join(prints, "c")
    mine = F.pmod(F.xxhash64("c"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    # tasks: (host block, guest block) and (guest block, later guest block)
    hosts = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(1).alias("side")))
    later = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(
        (-1 - F.least(mine, j)).alias("i"), F.greatest(mine, j).alias("j"), F.when(mine <= j, 0).otherwise(1).alias("side")))
    theirs = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(0).alias("side")))
    tasks = open_rows.withColumn("t", F.explode(F.when(is_main, theirs).otherwise(F.concat(hosts, later))))
    tasks = tasks.select("main", "t.*", "c", "label", "n", "groups", "sketch", "fine")

    # units are streamed in sorted order; the pairs of many small units are tested at once
    sorted_units = tasks.repartition("main", "i", "j").sortWithinPartitions("main", "i", "j", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            new = _group_starts(held)
            # the last unit may go on in the next batch
            yield from _group_pairs(held.slice(0, new[-1]), new[:-1], percent, best)
            held = held.slice(new[-1])
        if held is not None:
            yield from _group_pairs(held, _group_starts(held), percent, best)

    return sorted_units.mapInArrow(run, "a long, b long").distinct(), placed.select(F.col("main").alias("key"), "c")


def _fine_sketches(placed: DataFrame, classes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The classes that are left, with sketches of ``FINE`` ranges."""
    rows = classes.join(placed.select("c").distinct(), "c", "left_semi").join(texts, "th").select("c", "n", "groups", "sketch", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                fine = [sketch(shingles(t.as_py(), size), FINE) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(fine, pa.binary())], ["c", "n", "groups", "sketch", "fine"])

    return materialise(rows.mapInArrow(run, "c long, n long, groups array<long>, sketch binary, fine binary"), "neardup-fine")


def _group_starts(batch: pa.RecordBatch) -> np.ndarray:
    """The first row of every run of equal (main, i, j)."""
    cols = [batch.column(c).to_numpy() for c in range(3)]
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.nonzero(change)[0] if batch.num_rows else np.zeros(1, np.int64)


def _share_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, whether two classes share a bucket: a group of A and a group of B."""
    equal = a == b
    half = equal.shape[1] // 2
    return equal[:, :half].any(1) & equal[:, half:].any(1)


def _group_pairs(batch: pa.RecordBatch, starts: np.ndarray, percent: int, best: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a batch of whole units that may be links: rows of side 0 against
    those of side 1, or, in a block against itself, rows against later ones. With ``best``, every guest's most similar one."""
    n = batch.num_rows
    if not n:
        return
    i, j, side, c, label, size = (batch.column(k).to_numpy() for k in range(1, 7))
    groups = batch.column(7).flatten().to_numpy().reshape(n, -1)
    sketches = _rows_of_bytes(batch.column(8), BINS)
    group = np.zeros(n, np.int64)
    group[starts[1:]] = 1
    group = np.cumsum(group)
    end = np.append(starts[1:], n)[group]
    own = (i < 0) & (-1 - i == j)
    zeros = np.add.reduceat((side == 0).astype(np.int64), starts)
    begin = np.where(own, np.arange(n) + 1, (starts + zeros)[group])
    left = np.nonzero(own | (side == 0))[0]
    counts = (end - begin)[left]
    ends = np.cumsum(counts)
    fine = None if best else _rows_of_bytes(batch.column(9), FINE)
    top, partner = np.full(n, -1.0), np.zeros(n, np.int64)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        some, many = left[at:to], counts[at:to]
        a = np.repeat(some, many)
        b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[some], many)
        least, most = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        fit = (label[a] != label[b]) & (100 * least >= percent * most)
        a, b = a[fit], b[fit]
        fit = _share_table(groups[a], groups[b])
        a, b = a[fit], b[fit]
        agree, fit = _near(sketches[a], sketches[b], size[a] + size[b], percent)
        a, b, agree = a[fit], b[fit], agree[fit]
        at = to
        if best:
            for mine, other in ((a, b), (b, a)):
                guest = (i[mine] < 0) | (side[mine] == 1)
                order = np.argsort(agree[guest], kind="stable")
                mine, other, s = mine[guest][order], other[guest][order], agree[guest][order]
                better = s > top[mine]
                top[mine[better]], partner[mine[better]] = s[better], other[better]  # the last, so largest, one stays
            continue
        for k in range(0, len(a), PAIRS // 16):
            x, y = a[k:k + PAIRS // 16], b[k:k + PAIRS // 16]
            fit = _near(fine[x], fine[y], size[x] + size[y], percent)[1]
            yield _ordered_pairs(c[x[fit]], c[y[fit]])
    if best:
        found = np.nonzero(top >= 0)[0]
        yield _ordered_pairs(c[found], c[partner[found]])


def _rows_of_bytes(column: pa.BinaryArray, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix, without a copy."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[first:first + len(column) * width].reshape(len(column), width)


def _ordered_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, groups: int = 10, rows: int = 2, block: int = 2048,
                    seed: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n`` (size of its set), ``component`` (least id),
    ``kept`` (one row of each component), ``th`` (hash of the text) and ``row``."""
    prints = _fingerprints(docs, id_col, text_col, shingle, groups, rows, seed)
    sets = prints.where("n > 0").groupBy("set").agg(F.min("row").alias("c"))
    members = materialise(prints.select("row", "id", "th", "n", "set").join(sets, "set", "left").withColumn(
        "c", F.coalesce("c", "row")).drop("set"), "neardup-members")
    classes = prints.where("n > 0").join(sets.select("c"), F.col("row") == F.col("c"), "left_semi").withColumnRenamed("row", "c")
    classes = materialise(classes.select("c", "th", "n", "groups", "sketch"), "neardup-classes")
    buckets = _buckets(classes, groups)
    # round 1: every class against the most similar of the least classes of its buckets
    small = classes.select("c", "n", "sketch")

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series, sizes: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, BINS)
        s, near = _near(x, np.frombuffer(b"".join(b), np.uint8).reshape(-1, BINS), sizes.to_numpy(), percent)
        return pd.Series(np.where(near, s, -1.0))

    stars = buckets.where("least <> c").select("least", "c").distinct()
    stars = stars.join(small.toDF("c", "n", "sketch"), "c").join(small.toDF("least", "least_n", "least_sketch"), "least")
    stars = stars.where(100 * F.least("n", "least_n") >= percent * F.greatest("n", "least_n"))
    stars = stars.select("least", "c", share("sketch", "least_sketch", F.col("n") + F.col("least_n")).alias("agree")).where(F.col("agree") >= 0)
    first = stars.groupBy("c").agg(F.max(F.struct("agree", "least")).alias("best"))
    first = materialise(first.select(F.col("best.least").alias("a"), F.col("c").alias("b")), "neardup-first")
    # the texts of all classes that are in a bucket, once each
    wanted = buckets.select("c").distinct().join(classes.select("c", "th"), "c").select("th").distinct()
    text = F.coalesce(col(text_col), F.lit(""))
    texts = docs.select(F.unhex(F.md5(text)).alias("th"), text.alias("text")).join(wanted, "th", "left_semi")
    texts = materialise(texts.groupBy("th").agg(F.first("text").alias("text")), "neardup-texts", "zstd")
    links = _confirm(first, texts, classes, shingle, percent)
    # round 2: buckets that hold several components are contracted through every guest's most similar one, as long as
    # that pays; then all pairs that are left are confirmed
    tested, best = first, True
    while True:
        labels = components(links)
        cross, buckets = _cross_pairs(buckets, labels, classes, texts, shingle, percent, block, best)
        cross = materialise(cross.join(tested, ["a", "b"], "left_anti"), "neardup-cross")
        more = _confirm(cross, texts, classes, shingle, percent)
        tested, links = tested.union(cross), links.union(more)
        if not best:
            break
        best = more.count() * PAYS >= cross.count() > 0
    labels = components(links)
    out = members.join(labels.select(F.col("node").alias("c"), "label"), "c", "left")
    # components of one class are labelled by it, in a space of their own
    out = out.withColumn("label", F.when(F.col("label").isNull(), F.struct(F.lit(0).alias("k"), F.col("c").alias("v"))).otherwise(
        F.struct(F.lit(1).alias("k"), F.col("label").alias("v"))))
    least = out.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    out = out.join(least, "label")
    return out.select("id", "n", F.col("first.id").alias("component"), (F.col("row") == F.col("first.row")).alias("kept"), "th", "row")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with the input's columns. Rows equal in id and
    text are one document: the first of them is kept."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = near_duplicates(docs, **options).where("kept").select(F.col("id").alias("kid"), F.col("th").alias("kth")).distinct()
    rows = packed(docs, id=col(id_col), th=F.unhex(F.md5(F.coalesce(col(text_col), F.lit("")))))
    out = rows.join(kept, F.col("id").eqNullSafe(F.col("kid")) & (F.col("th") == F.col("kth")), "left_semi")
    first = Window.partitionBy("id", "th").orderBy(F.xxhash64("row"))
    out = out.withColumn("again", F.row_number().over(first)).where("again = 1")
    return unpacked(out, docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN array_to_string(ws[i:i + 2], ' ') ELSE array_to_string(ws, ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN z USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
