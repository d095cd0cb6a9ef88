"""Spelling variants: words one edit apart, found through a trie of letter counts.

A word's frequency vector counts its letters by group (``groups_of``). One inserted,
deleted or replaced code point raises at most one group's count by one and lowers at most
one by one. The words are therefore arranged in a trie whose levels are the word's length
and then the counts of the successive groups; a depth-first search walks down it with a
budget of one surplus and one deficit, and the words of the leaves that it reaches are
verified by comparing code points.

Spark deals the trie out by its top: a cell is the subtree below a length and the counts of
the first groups (``depth`` of them, as many as it takes for no subtree to hold more than
``cell_words`` words). Every word goes to its own cell as data, and as a query to those cells
that its budget reaches; the rest of the search runs inside the cells, in bounded blocks. A
pair is looked for from one side only: from the shorter word, or at equal lengths from the
one whose vector (then whose word) is less. Leaves of more than ``LEAF`` words (anagrams)
are entered by the halves of the word, one of which one edit leaves alone.

Words are pre-aggregated before they are shuffled. What a cell returns is one row for each word with
a near word there, not the pairs.

Defined results: null and empty texts have no words; a null id counts as an empty one;
rows of equal or null id and repeated rows count one by one; an empty table gives no
rows; counts of more than 255 letters are held at 255, which only widens the search.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, sql_crc32, sql_crc_table, table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Order of the trie's levels: letters from frequent to rare; the accented ones follow in
#: ACCENTED groups by code point.
LETTERS = "eantiorshdlucmpwbvgfyqkxzj"
ACCENTED = 6
GROUPS = len(LETTERS) + ACCENTED

LEAF = 8  # nodes of no more words are leaves
BLOCK = 1 << 16  # states or pairs handled at once
WIDE = 64  # longer words are compared one by one


def groups_of() -> np.ndarray:
    """The letter group of each code point below 256."""
    out = np.zeros(256, np.int64)
    for c in range(256):
        at = LETTERS.find(chr(c))
        out[c] = at if at >= 0 else len(LETTERS) + c % ACCENTED
    return out


def vectors(words: list[str]) -> np.ndarray:
    """Letter counts by group, a row for each word, held at 255."""
    raw = [w.encode("latin-1") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    at = np.repeat(np.arange(len(raw)), sizes) * GROUPS + groups_of()[np.frombuffer(b"".join(raw), np.uint8)]
    counts = np.bincount(at, minlength=len(raw) * GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(raw), GROUPS)


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = None) -> DataFrame:
    """Every letter run of every whole text, A-Z lowered. With ``typo_every``, runs whose hash
    with the document's id is divisible by it lose the code point that the hash names."""
    run = F.explode(F.regexp_extract_all(col(text_col), F.lit(RUN), F.lit(0)))
    out = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    out = out.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    if typo_every is None:
        return out.select(F.col("run").alias("word"))
    out = out.select("run", F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("run")).cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return out.select(F.when(F.col("h") % typo_every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """Distinct words with their counts ``n``."""
    counts = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= min_count)


def _with_vectors(vocab: DataFrame) -> DataFrame:
    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words = part.column("word").to_pylist()
            vecs = [v.tobytes() for v in vectors(words)]
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(map(len, words), pa.int32()),
                                              pa.array(vecs, pa.binary())], ["word", "n", "chars", "vec"])

    return vocab.mapInArrow(add, "word string, n long, chars int, vec binary")


def _cell_key(chars, prefix: np.ndarray) -> list[bytes]:
    """The length and the counts of the first groups, as bytes."""
    head = np.asarray(chars, ">u4").reshape(-1, 1).view(np.uint8)
    both = np.ascontiguousarray(np.hstack([head, prefix.astype(np.uint8)]))
    width = both.shape[1]
    raw = both.tobytes()
    return [raw[i:i + width] for i in range(0, len(raw), width)]


def _top_depth(words: DataFrame, cell_words: int) -> int:
    """The least number of groups that leaves no cell with more than ``cell_words`` words
    (all groups, if none does)."""
    for depth in range(1, GROUPS):
        cells = words.groupBy("chars", F.substring("vec", 1, depth)).count()
        if (cells.agg(F.max("count")).first()[0] or 0) <= cell_words:
            return depth
    return GROUPS


def _routes(words: DataFrame, depth: int) -> DataFrame:
    """A row for each word and cell that its budget reaches; ``home`` marks its own cell. At
    equal lengths a surplus comes before a deficit, since the other order is that of the
    pair's other side."""
    def route(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not len(part):
                continue
            chars = part.column("chars").to_numpy()
            top = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.uint8).reshape(-1, GROUPS)[:, :depth].astype(np.int64)
            everyone = np.ones(len(part), bool)
            part = part.select(["word", "n", "vec"])

            def to(reach: np.ndarray, more: int, prefix: np.ndarray, home: bool = False) -> pa.RecordBatch:
                out = part.filter(pa.array(reach))
                cells = pa.array(_cell_key(chars[reach] + more, prefix[reach]), pa.binary())
                return pa.RecordBatch.from_arrays([*out.columns, cells, pa.array(np.full(len(out), home))],
                                                  ["word", "n", "vec", "cell", "home"])

            yield to(everyone, 0, top, True)
            yield to(everyone, 1, top)
            for i in range(depth):
                up = top.copy()
                up[:, i] += 1
                fits = top[:, i] < 255
                yield to(fits, 0, up)
                yield to(fits, 1, up)
                for j in range(i + 1, depth):
                    down = up.copy()
                    down[:, j] -= 1
                    yield to(fits & (top[:, j] > 0), 0, down)

    return words.mapInArrow(route, "word string, n long, vec binary, cell binary, home boolean")


class Trie:
    """The subtree of one cell: its words' vectors in order, and for each level the keys
    (parent, count) and first words of its nodes."""

    def __init__(self, vecs: np.ndarray, depth: int):
        self.depth, self.vecs = depth, vecs
        self.levels = []
        node = np.zeros(len(vecs), np.int64)
        for level in range(depth, GROUPS):
            key = node * 256 + vecs[:, level]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.levels.append((key[first], np.r_[first, len(vecs)]))
            node = np.repeat(np.arange(len(first)), np.diff(self.levels[-1][1]))

    def search(self, vecs: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For queries of the given vectors and budgets: (query, first word, end) of the leaves."""
        everyone = np.arange(len(vecs))
        if not self.levels:  # the top alone tells all counts
            yield everyone, np.zeros(len(vecs), np.int64), np.full(len(vecs), len(self.vecs))
            return
        stack = [(0, everyone, np.zeros(len(vecs), np.int64), surplus, deficit)]
        while stack:
            level, q, node, up, down = stack.pop()
            if len(q) > BLOCK:
                half = len(q) // 2
                stack.append((level, q[half:], node[half:], up[half:], down[half:]))
                stack.append((level, q[:half], node[:half], up[:half], down[:half]))
                continue
            count = vecs[q, self.depth + level].astype(np.int64)
            more = (up > 0) & (count < 255)
            less = (down > 0) & (up == 0) & (count > 0)
            q = np.concatenate([q, q[more], q[less]])
            node = np.concatenate([node, node[more], node[less]])
            count = np.concatenate([count, count[more] + 1, count[less] - 1])
            up, down = (np.concatenate([up, up[more] - 1, up[less]]), np.concatenate([down, down[more], down[less] - 1]))
            keys, first = self.levels[level]
            key = node * 256 + count
            at = np.searchsorted(keys, key)
            found = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == key)
            q, at, up, down = q[found], at[found], up[found], down[found]
            lo, hi = first[at], first[at + 1]
            leaf = (hi - lo <= LEAF) | (level + 1 == len(self.levels))
            yield q[leaf], lo[leaf], hi[leaf]
            on = ~leaf
            if on.any():
                stack.append((level + 1, q[on], at[on], up[on], down[on]))


def one_edit(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with exactly one code point replaced or inserted."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) + 1 != len(b):
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1:]


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


class Verifier:
    """Compares queries with a cell's words, all of ``chars`` code points."""

    def __init__(self, queries: list[str], words: list[str], chars: int):
        self.queries, self.words, self.chars = queries, words, chars
        if chars <= WIDE:
            self.a, self.b = _codes(queries, chars), _codes(words, chars)
            self.sizes = np.fromiter(map(len, queries), np.int64, len(queries))

    def __call__(self, q: np.ndarray, w: np.ndarray) -> np.ndarray:
        if self.chars > WIDE:
            return np.fromiter((one_edit(self.queries[i], self.words[j]) for i, j in zip(q, w)), bool, len(q))
        a, b = self.a[q], self.b[w]
        differ = a != b
        replaced = (self.sizes[q] == self.chars) & (differ.sum(1) == 1)
        after = np.arange(self.chars - 1) >= differ.argmax(1)[:, None]
        inserted = (self.sizes[q] < self.chars) & ~((a[:, :-1] != b[:, 1:]) & after).any(1)
        return replaced | inserted


class Halves:
    """A cell's words by leaf and half: one edit leaves the first half or the last half alone."""

    def __init__(self, words: list[str], first: np.ndarray, chars: int):
        self.cut = chars // 2
        self.maps = ({}, {})
        for i, (w, leaf) in enumerate(zip(words, first.tolist())):
            for at, half in enumerate((w[:self.cut], w[self.cut:])):
                self.maps[at].setdefault((leaf, half), []).append(i)

    def find(self, word: str, chars: int, leaf: int) -> set[int]:
        rest = word[self.cut - (len(word) < chars):]
        return {*self.maps[0].get((leaf, word[:self.cut]), ()), *self.maps[1].get((leaf, rest), ())}


def _candidates(trie: Trie, words: list[str], queries: list[str], chars: int, vecs: np.ndarray,
                surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) index arrays from the leaves reached, at most about ``BLOCK`` pairs each."""
    halves = None
    for q, lo, hi in trie.search(vecs, surplus, deficit):
        sizes = hi - lo
        small = sizes <= 8 * LEAF
        for i in np.flatnonzero(~small):
            if halves is None:
                last = np.r_[True, (trie.vecs[1:] != trie.vecs[:-1]).any(1)]
                starts = np.flatnonzero(last)
                halves = Halves(words, np.repeat(starts, np.diff(np.r_[starts, len(words)])), chars)
            found = np.array(sorted(halves.find(queries[q[i]], chars, int(lo[i]))), np.int64)
            yield np.full(len(found), q[i]), found
        q, lo, sizes = q[small], lo[small], sizes[small]
        step = max(1, BLOCK // (8 * LEAF))
        for at in range(0, len(q), step):
            s = sizes[at:at + step]
            offset = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            yield np.repeat(q[at:at + step], s), np.repeat(lo[at:at + step], s) + offset


NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def near_in_cell(rows: pa.Table, depth: int) -> pa.Table:
    """The near words that one cell's words have there: ``word``, their number ``n_near``, and the
    one of largest count (``form_n``, then least ``form``)."""
    rows = rows.sort_by([("vec", "ascending"), ("word", "ascending")])
    home = np.flatnonzero(rows["home"].to_numpy())
    if not len(home):
        return NEAR.empty_table()
    queries = rows["word"].to_pylist()
    words = [queries[i] for i in home]
    chars = len(words[0])
    vecs = np.frombuffer(b"".join(rows["vec"].to_pylist()), np.uint8).reshape(-1, GROUPS)
    trie = Trie(vecs[home], depth)
    top = vecs[home[0], :depth].astype(np.int64) - vecs[:, :depth]
    longer = np.fromiter(map(len, queries), np.int64, len(queries)) < chars
    surplus = 1 - (top > 0).any(1).astype(np.int64)
    deficit = np.where(longer, 0, 1 - (top < 0).any(1).astype(np.int64))
    verify = Verifier(queries, words, chars)
    # rows are in order of vector and word: at equal lengths the row number tells the sides apart
    found_q, found_w = [], []
    for q, w in _candidates(trie, words, queries, chars, vecs, surplus, deficit):
        ahead = longer[q] | (home[w] > q)
        q, w = q[ahead], w[ahead]
        near = verify(q, w)
        found_q.append(q[near])
        found_w.append(home[w[near]])
    q, w = np.concatenate(found_q), np.concatenate(found_w)
    owner, other = np.concatenate([q, w]), np.concatenate([w, q])
    n = rows["n"].to_numpy()
    by_rank = np.lexsort((np.array(queries), -n))
    rank = np.empty(len(n), np.int64)
    rank[by_rank] = np.arange(len(n))
    order = np.lexsort((rank[other], owner))
    owner, other = owner[order], other[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    best = other[first]
    return pa.table([pa.array([queries[i] for i in owner[first]], pa.string()), np.diff(np.r_[first, len(owner)]),
                     n[best], pa.array([queries[i] for i in best], pa.string())], schema=NEAR)


def near_words(vocab: DataFrame, cell_words: int = 20_000) -> DataFrame:
    """``word``, ``n`` of the vocabulary with ``n_near``, and the near word of largest count (ties:
    the least) as ``best``, its count as ``best_n``."""
    words = materialise(_with_vectors(vocab), "variant-words")
    depth = _top_depth(words, cell_words)
    routes = _routes(words, depth)
    head = F.to_binary(F.lpad(F.hex("chars"), 8, "0"), F.lit("hex"))
    cells = words.select(F.concat(head, F.substring("vec", 1, depth)).alias("cell")).distinct()
    routes = routes.join(cells, "cell", "left_semi")

    def one(rows: pa.Table) -> pa.Table:
        return near_in_cell(rows, depth)

    parts = routes.groupBy("cell").applyInArrow(one, "word string, n_near long, form_n long, form string")
    near = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("b"))
    near = near.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.form").alias("best"))
    return words.select("word", "n").join(near, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` for rows (word, form) without cycles: each round doubles the steps
    that a row has gone, so a chain of k forms takes about log2(k) joins."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = materialise(step, "variant-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def group_variants(words: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2, cell_words: int = 20_000) -> DataFrame:
    """Groups of spelling variants from rows with a ``word``: ``word``, its ``n``, ``n_near``, its ``form`` (the
    near word of largest count, if that is ``ratio`` times the word's own or more) with ``form_n``, and
    ``root``, the last of the chain of forms."""
    near = near_words(vocabulary(words, min_chars, min_count), cell_words)
    strong = F.col("best_n") >= ratio * F.col("n")
    near = materialise(near.select("word", "n", "n_near", F.when(strong, F.col("best")).alias("form"),
                                   F.when(strong, F.col("best_n")).alias("form_n")), "variant-forms")
    ends = roots(near.where("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11(spark, sf_dir: str) -> DataFrame:
    out = group_variants(runs(table(spark, sf_dir, "documents"), typo_every=97))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED ({sql_crc_table()}),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
counted AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, count(*) AS times FROM runs GROUP BY ALL),
hashed AS (SELECT run, times, {sql_crc32("id || ':' || run")} AS h FROM counted, crc),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
gaps AS MATERIALIZED (SELECT word, n, length(word) AS chars, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT word, other FROM (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a.word, b.word FROM words a JOIN gaps b ON a.word = b.gap
  UNION ALL SELECT b.word, a.word FROM words a JOIN gaps b ON a.word = b.gap)),
best AS (SELECT word, count(*) AS n_near, max(o.n) AS best_n, min(CASE WHEN o.n = m THEN other END) AS best
  FROM (SELECT near.word, other, o.n, max(o.n) OVER (PARTITION BY near.word) AS m FROM near JOIN words o ON o.word = near.other) o GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, CAST(coalesce(b.n_near, 0) AS BIGINT) AS n_near,
    CASE WHEN best_n >= 2 * w.n THEN best END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
