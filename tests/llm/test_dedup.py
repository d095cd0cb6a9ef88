import itertools
import random

import pytest
from pyspark.sql import functions as F

from tabrig.llm import components, linededup, neardup
from tabrig.llm.common import materialise


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        e = [i + 1]
        for j, y in enumerate(b):
            e.append(min(d[j + 1] + 1, e[j] + 1, d[j] + (x != y)))
        d = e
    return d[-1]


def classes(pairs, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def test_components_equal_brute_force(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(300)] + [(rnd.randint(400, 700), rnd.randint(400, 700)) for _ in range(200)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    want = classes(pairs, nodes)
    assert set(got) == nodes
    assert {frozenset(n for n in nodes if want[n] == c) for c in set(want.values())} == \
        {frozenset(n for n in nodes if got[n] == c) for c in set(got.values())}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_automaton(spark, edits):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        a = "".join(rnd.choice("abé😀 ") for _ in range(rnd.randint(0, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            p, r = rnd.randint(0, len(b)), rnd.random()
            if r < .35:
                b.insert(p, rnd.choice("abé😀 "))
            elif p < len(b):
                b[p:p + 1] = [] if r < .7 else [rnd.choice("abé😀 ")]
        rows.append((i, a, "".join(b)))
    df = spark.createDataFrame(rows, "i int, a string, b string")

    def judged(pairs):
        cut = materialise(pairs.select("i", linededup.characters("a").alias("x"), linededup.characters("b").alias("y")), "test-pairs")
        return {r.i: r.w for r in cut.select("i", linededup.within_edits(F.col("x"), F.col("y"), edits).alias("w")).collect()}

    got = judged(df)
    want = {i: distance(a, b) <= edits for i, a, b in rows}
    assert got == want
    assert judged(linededup.trimmed(df)) == want


@pytest.mark.parametrize("edits", [1, 2])
def test_line_links_equal_brute_force(spark, edits):
    rnd = random.Random(4)
    base = [f"the quick brown fox jumps {i}" for i in range(0, 60, 7)] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(16, 19))) for _ in range(150)]
    lines = list(dict.fromkeys(base + [b[:5] + "x" + b[6:] for b in base[:60]] + [b + "y" for b in base[:50]] + [b[1:] for b in base[:50]]))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = linededup._lines(docs, "doc_id", "text", 12)
    facts = rows.select("h1", "h2", linededup.letter_counts(F.col("line")).alias("letters"), linededup.keys(edits, F.col("line"), F.col("n")).alias("keys"))
    want = sum(distance(a, b) <= edits for a, b in itertools.combinations([x for x in lines if len(x) >= 12], 2))
    assert linededup.line_links(facts, rows, edits).count() == want > 50


@pytest.mark.parametrize("percent", [2, 3, 5])
def test_links_of_scaled_edits_equal_brute_force(spark, percent):
    rnd = random.Random(6)
    words = ["the", "quick", "brown", "fox", "é", "jumpsoveralazydogandfurtheraway", "😀", "x" * 60, "to", "a"]
    lines = []
    for n in [15, 16, 17, 20, 33, 39, 40, 41, 59, 60, 97, 98, 99, 100, 101, 102, 149, 150, 151, 199, 200, 201, 300, 420] * 2:
        base = "".join(rnd.choice("abcd ") for _ in range(n)) if rnd.random() < .5 else " ".join(rnd.choice(words) for _ in range(n))[:n]
        most = max(1, n * percent // 100)
        lines.append(base)
        for count in (1, most, most, most + 1):
            b = list(base)
            spread = rnd.random() < .5
            for i in range(count):  # edits at even distances leave the shortest runs
                at = (i + 1) * len(b) // (count + 1) if spread else rnd.randrange(len(b))
                b[at:at + 1] = rnd.choice([[], ["#"], [b[at], "#"]])
            lines.append("".join(b))
    lines = list(dict.fromkeys(lines))
    rows = linededup._lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text", 16)
    facts = rows.select("h1", "h2", "n", linededup.letter_counts(F.col("line")).alias("letters"),
                        linededup.scaled_keys(percent, F.col("line"), F.col("n")).alias("keys"))
    hashes = {(r.h1, r.h2): r.line for r in rows.collect()}
    got = {frozenset((hashes[r.a1, r.a2], hashes[r.b1, r.b2])) for r in linededup.line_links(facts, rows, 1, percent).collect()}
    want = set()
    for a, b in itertools.combinations([x for x in lines if len(x) >= 16], 2):
        most = max(1, max(len(a), len(b)) * percent // 100)
        if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
            want.add(frozenset((a, b)))
    assert got == want and sum(max(map(len, p)) >= 200 / percent for p in want) > 50


def test_a_replaced_word_is_found(spark):
    a = "a paragraph of some length, of which only one word is another in the copy, so that " * 3
    docs = spark.createDataFrame([(1, a + "all remains"), (2, a.replace("only", "just", 1) + "all remains")], "doc_id long, text string")
    assert [r["doc_id"] for r in linededup.dedup_lines(docs, percent=linededup.PERCENT).collect()] == [1]
    assert linededup.dedup_lines(docs).count() == 2


def test_equal_short_lines_are_found(spark):
    rows = [(1, "Les.\nfirst of its kind, a long line\n\n \t\nLes."), (2, "\nLes.\nLet.\n \t\n"), (3, "Les.\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {"percent": linededup.PERCENT, "equal_chars": linededup.EQUAL_CHARS}
    got = {r["id"]: (r["removed"], r["links"]) for r in linededup.repeated_lines(docs, **whole).collect()}
    assert got == {1: ([4], 0), 2: ([1], 0), 3: ([0], 0)}  # blank lines and 'Let.', one edit away, stay
    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs, **whole).collect()} == {
        1: "Les.\nfirst of its kind, a long line\n\n \t", 2: "\nLet.\n \t\n"}
    assert linededup.repeated_lines(docs).count() == 0


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(10, "a line that is long enough\nshort\nanother line, number 12", 1), (11, "a line that is long enough\nshort\nanother line, number 13\nnew line of its own", 2),
            (12, "a line that is lon enough", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed long")
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert out == {10: rows[0][1], 11: "short\nnew line of its own"}  # all of 12's lines are known
    odd = linededup.dedup_lines(odd_docs)
    assert odd.columns == odd_docs.columns
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert len(texts) == 9 and (1, None) in texts and (2, "") in texts
    assert linededup.dedup_lines(no_docs).count() == 0 and linededup.repeated_lines(no_docs).count() == 0


def _jaccard_components(texts, size, percent):
    def grams(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        return frozenset(tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()
    g = {i: grams(t) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(g), 2)
             if g[a] and 100 * len(g[a] & g[b]) >= percent * len(g[a] | g[b])]
    return {i: len(s) for i, s in g.items()}, classes(pairs, g)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, percent):
    rnd = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for k in range(12):
        base = [rnd.choice(words) for _ in range(rnd.randint(30, 160))]
        for copy in range(rnd.randint(1, 9)):  # drifting copies: chains of links
            texts[len(texts) * 3] = " ".join(base)
            for _ in range(rnd.randint(0, 3)):
                base[rnd.randrange(len(base))] = rnd.choice(words)
    shared = " ".join(rnd.choice(words) for _ in range(25))
    for k in range(40):  # one passage in many texts that are no copies
        texts[len(texts) * 3] = shared + " " + " ".join(rnd.choice(words) for _ in range(60))
    texts |= {9000: "A B", 9001: "a b", 9002: "a", 9003: "", 9004: None, 9005: " \n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["id"]: r for r in neardup.near_duplicates(docs, size, percent, block=7).collect()}
    sizes, want = _jaccard_components(texts, size, percent)
    assert {i: r["n"] for i, r in got.items()} == sizes
    assert {i: r["component"] for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["kept"]} == set(want.values())


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    out = neardup.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2, 3, 5, 5, 7, 8]
    assert neardup.near_duplicates(no_docs).count() == 0 and neardup.keep_one(no_docs).count() == 0


CLASSES = ((8, 1), (20, 2), (33, 3), (60, 5))


def test_links_by_length_class_equal_brute_force(spark):
    """Lengths around every class border, edits at even distances and in bunches, characters of several bytes."""
    rnd = random.Random(9)

    def most(a, b):
        return max((k for start, k in CLASSES if max(len(a), len(b)) >= start), default=0)

    lines = []
    for n in [7, 8, 9, 15, 18, 19, 20, 21, 22, 29, 30, 31, 32, 33, 34, 36, 55, 56, 57, 59, 60, 61, 65, 90] * 2:
        base = "".join(rnd.choice("ab é😀") for _ in range(n))
        lines.append(base)
        for count in (1, 2, 3, 4, 5, 6):
            b = list(base)
            spread = rnd.random() < .5
            for i in range(count):
                at = (i + 1) * len(b) // (count + 1) if spread else rnd.randrange(len(b))
                b[at:at + 1] = rnd.choice([[], ["#"], [b[at], "#"]]) if len(b) > 1 else ["#"]
            lines.append("".join(b))
    lines = [x for x in dict.fromkeys(lines) if len(x) >= CLASSES[0][0]]
    rows = linededup._lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text", CLASSES[0][0])
    rows = materialise(rows.withColumn("no", F.monotonically_increasing_id()), "test-lines")
    hashes = {(r.h1, r.h2): r.line for r in rows.collect()}
    facts = rows.select("no", "h1", "h2", "n", linededup.letter_counts(F.col("line")).alias("letters"))
    found = linededup.line_links(facts, rows, 1, classes=CLASSES).collect()
    got = [frozenset((hashes[r.a1, r.a2], hashes[r.b1, r.b2])) for r in found]
    want = {frozenset(p) for p in itertools.combinations(lines, 2) if abs(len(p[0]) - len(p[1])) <= most(*p) and distance(*p) <= most(*p)}
    assert set(got) == want and len(got) == len(want) > 150
    across = [p for p in want if len({most(x, x) for x in p}) == 2]
    assert len(across) > 5 and max(distance(*p) for p in want) == 5


def test_edits_between(spark):
    rnd = random.Random(10)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 9)))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", linededup.characters("a").alias("x"), linededup.characters("b").alias("y"))
    got = {r.i: r.d for r in materialise(df, "test-between").select("i", linededup.edits_between(F.col("x"), F.col("y"), 3).alias("d")).collect()}
    assert got == {i: (d if d <= 3 else None) for i, a, b in rows for d in [distance(a, b)]}


def test_the_pipelines_rule_on_odd_rows(spark, odd_docs, no_docs):
    rule = {"classes": linededup.CLASSES, "equal_chars": linededup.EQUAL_CHARS}
    sentence = "a sentence of more than a hundred characters, in which the copy has another word or two, as copies have them at times. " * 2
    rows = [(1, f"Les.\n{sentence}\n \t\n\nLes.", 1), (2, f"Les.\n{sentence.replace('more', 'mere', 1).replace('two', 'tow', 1)}\nnew", 2), (None, "Les.", 3), (3, None, 4), (4, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed long")
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs, **rule).collect()}
    assert got == {1: f"Les.\n{sentence}\n \t\n", 2: "new", 3: None, 4: ""}
    odd = linededup.dedup_lines(odd_docs, **rule)
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert odd.columns == odd_docs.columns and (1, None) in texts and (2, "") in texts and len(texts) == 9
    assert linededup.dedup_lines(no_docs, **rule).count() == 0 and linededup.repeated_lines(no_docs, **rule).count() == 0


@pytest.mark.parametrize("n", [200_000, 2_000_000])
def test_very_long_lines(spark, n):
    docs = spark.range(3).selectExpr("id AS doc_id", f"repeat('abcdefghij', {n // 10}) || CASE WHEN id < 2 THEN '' ELSE 'x' END || 'end' AS text")
    docs = docs.unionByName(spark.range(1).selectExpr("7L AS doc_id", f"'y' || repeat('abcdefghij', {n // 10}) || 'zzzzend' AS text"))
    got = {r["doc_id"] for r in linededup.dedup_lines(docs, classes=linededup.CLASSES, equal_chars=1).select("doc_id").collect()}
    assert got == {0, 7}


@pytest.mark.parametrize("all_links", [True, False])
def test_lines_measured_from_hubs(spark, monkeypatch, all_links):
    """A group of near copies and their guests: all links, or, without those between lines of one hub, the same classes."""
    monkeypatch.setattr(linededup, "HOT", 3)
    rnd = random.Random(12)
    base = "a line of some forty letters, with copies"
    lines = [base]
    for i in range(70):
        b = list(base)
        for _ in range(1 + i % 3):
            at = rnd.randrange(len(b))
            b[at:at + 1] = rnd.choice([[], ["#"], [b[at], rnd.choice("xyz")]])
        lines.append("".join(b))
    lines = list(dict.fromkeys(lines))
    rows = spark.createDataFrame(list(enumerate(lines)), "no long, line string").select("no", "line", F.length("line").alias("n"))
    rows = materialise(rows.withColumns({"h1": F.col("no"), "h2": F.lit(0).cast("long")}), "test-lines")
    tested = []
    real = linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name, *a: tested.append((name, out := real(df, name, *a))) or out)
    got = {(r.a1, r.b1) for r in linededup.class_links(rows, ((16, 1), (30, 2)), all_links).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if distance(lines[a], lines[b]) <= 2}
    pairs = next(df for name, df in tested if name == "line-candidates").count()
    if all_links:
        assert got == want
    else:
        assert got < want and classes(got, range(len(lines))) == classes(want, range(len(lines)))
        assert pairs < len(want)


def test_edits_reach(spark):
    rnd = random.Random(13)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14))), "".join(rnd.choice("ab") for _ in range(14)), rnd.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string, most int").select(
        "i", "most", linededup.characters("a").alias("x"), linededup.characters("b").alias("y"))
    cut = materialise(df, "test-reach").select("i", linededup.edits_reach(F.col("x"), F.col("y"), 3, F.col("most")).alias("n"))
    got = {r.i: r.n for r in cut.collect()}
    for i, a, b, most in rows:
        known = [j for j in range(len(a) + 1) if min(distance(a[:j], b[:e]) for e in range(len(b) + 1)) <= most]
        assert got[i] == known[-1] if len(a) <= 10 else got[i] >= known[-1]  # the end of y is out of reach from 10 characters


@pytest.mark.parametrize("all_links,reach", [(True, 32), (False, 32), (True, 3), (False, 3)])
def test_copies_that_differ_in_other_places_do_not_meet(spark, monkeypatch, all_links, reach):
    """One word is replaced in each copy, by its own letters: lengths, letters and distances from the hub are the same."""
    monkeypatch.setattr(linededup, "HOT", 3)
    monkeypatch.setattr(linededup, "REACH", reach)
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(14)]
    base = " ".join(words)
    lines = [base] + [base[:i] + "#" + base[i + 1:] for i in range(3, 100, 12)] + [base[:i] + base[i - 1] + base[i:] for i in range(5, 100, 20)]
    for i, word in enumerate(words):
        for turned in (word[::-1], word[3:] + word[:3]):
            copy = " ".join(words[:i] + [turned] + words[i + 1:])
            lines += [copy, copy[:8 * i + 2] + "!" + copy[8 * i + 3:], copy[:50] + copy[51:]]
    lines = list(dict.fromkeys(lines))
    rows = spark.createDataFrame(list(enumerate(lines)), "no long, line string").select("no", "line", F.length("line").alias("n"))
    rows = materialise(rows.withColumns({"h1": F.col("no"), "h2": F.lit(0).cast("long")}), "test-lines")
    tested = []
    real = linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, name, *a: tested.append((name, out := real(df, name, *a))) or out)
    got = {(r.a1, r.b1) for r in linededup.class_links(rows, ((16, 1), (60, 2)), all_links).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if distance(lines[a], lines[b]) <= 2}
    assert got == want if all_links else got <= want and classes(got, range(len(lines))) == classes(want, range(len(lines)))
    assert len(want) > 100
    if reach == 32:
        pairs = next(df for name, df in tested if name == "line-candidates").count()
        assert pairs <= len(want) + 5 * len(lines), (pairs, len(want), len(lines))
