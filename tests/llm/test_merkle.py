import hashlib
import zlib

import pytest

from tabrig.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = []
    for name in merkle.FIELDS:
        v = row[name]
        if v is None:
            out.append("-")
        else:
            v = str(v + more) if name == "n_chars" else str(v)
            out.append(f"{len(v.encode())}:{v}")
    return h(*out)


def climb(nodes):
    """The root, and for each first node the list of (position in its run, siblings or None if alone)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p // 2 * 2:p // 2 * 2 + 2]
            paths[i].append((p % 2, run[1 - p % 2] if len(run) == 2 else None))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [p // 2 for p in at]
    return nodes[0], paths


def fold(x, path):
    for side, other in path:
        x = h(x) if other is None else h(other, x) if side else h(x, other)
    return x


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        members = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = (members, *climb([leaf(r) for r in members]))
    root, tops = climb([trees[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        members, subroot, paths = trees[g]
        for r, path in zip(members, paths):
            full = path + top
            forged = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            x = leaf(r, 1) if forged and r["n_chars"] is not None else leaf(r)
            folded = fold(x, full)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*[s for _, s in full if s]), folded, folded == root))
    return sorted(out, key=str)


def rows_of(spark, docs):
    out = merkle.proofs(*merkle.manifest(merkle.leaves(docs)))
    return sorted((tuple(r) for r in out.collect()), key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def documents(spark, n, langs, per=None):
    rows = [(i, "s", langs[i % len(langs)], i * 3, f"text {i} ünï") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65])
def test_small_trees_equal_brute_force(spark, n):
    docs = documents(spark, n, ["en", None, "é", "zz", ""])
    assert rows_of(spark, docs) == brute(docs.collect())


def test_blocks_of_appends_equal_one_tree(spark, monkeypatch):
    """Groups of one block and of many, over three stages of block roots."""
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    nodes = [(g, p, n, hashlib.sha256(f"{g}-{p}".encode()).digest()) for g, n in enumerate([1, 3, 4, 5, 16, 17, 83]) for p in range(n)]
    at = {}
    for g, p, n, d in nodes:
        at.setdefault(g, []).append(d.hex())
    want = {g: climb(v) for g, v in at.items()}
    df, roots = witnessed_local(spark, nodes)
    assert {g: r.hex() for g, r in roots.items()} == {g: w[0] for g, w in want.items()}
    for g, p, n, witness in df:
        assert [(s, o.hex() if o else None) for s, o in merkle.path(p, n, witness)] == want[g][1][p]


def witnessed_local(spark, nodes):
    """``merkle.witnessed`` with its blocks appended here, since workers don't see a patched block size."""
    import pyarrow as pa
    out, level, above = {}, [(g, p, n, d) for g, p, n, d in nodes], []
    stages = []
    while True:
        blocks, wit = [], {}
        for g, b in sorted({(g, p >> merkle.BITS) for g, p, _, _ in level}):
            part = [x for x in level if x[0] == g and x[1] >> merkle.BITS == b]
            done = merkle._append_block(pa.table({"g": [x[0] for x in part], "pos": [x[1] for x in part], "n": [x[2] for x in part],
                                                  "digest": [x[3] for x in part]})).to_pylist()
            for r in done:
                wit[g, r["pos"]] = r["witness"]
            blocks.append((g, b, -(-part[0][2] // merkle.BLOCK), done[0]["root"]))
        stages.append(wit)
        if all(x[2] == 1 for x in blocks):
            roots = {x[0]: x[3] for x in blocks}
            break
        level = blocks
    full = []
    for g, p, n, _ in nodes:
        w = b""
        for k, wit in enumerate(stages):
            w += wit[g, p >> (k * merkle.BITS)]
        full.append((g, p, n, w))
    return full, roots


def test_many_blocks_equal_brute_force(spark):
    """One group of three blocks, one of one row."""
    docs = documents(spark, 2500, ["en"] * 624 + ["de"])
    assert rows_of(spark, docs) == brute(docs.collect())


def test_appender_grows_step_by_step():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(13)]
    for n in range(1, 14):
        tree = merkle.Appender(n, merkle.levels_of(n))
        for d in digests[:n]:
            tree.append(d)
        sizes = [1 << level for level, _, _ in tree.open]
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
        assert tree.close(merkle.levels_of(n)).hex() == climb([d.hex() for d in digests[:n]])[0]


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "s", None, 5, ""), (3, "s", "en", None, "x" * 300_000)] + \
        [(4, "s", "en", 4, "the same row")] * 40 + [(4, "s", "en", 4, "another text"), (9, "", "", 0, "\x00 |:-")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(spark, docs) == brute(docs.collect())
    clashing = docs.selectExpr("*", "1 AS g", "2 AS pos", "3 AS n", "4 AS part", "5 AS `at`", "'x' AS leaf", "0 AS seq")
    assert rows_of(spark, clashing) == rows_of(spark, docs)


def test_empty_table(spark, no_docs):
    assert rows_of(spark, no_docs) == []


def test_a_changed_row_fails_and_only_it(spark):
    docs = documents(spark, 300, ["en", "de"])
    for r in merkle.proofs(*merkle.manifest(merkle.leaves(docs))).collect():
        assert r["verified"] == (zlib.crc32(str(r["id"]).encode()) % 7 != 0)
