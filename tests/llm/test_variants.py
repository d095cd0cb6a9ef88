import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabrig.llm import variants

A_TO_Z = str.maketrans(variants.UPPER, variants.LOWER)


def words_of(rows, every=None):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return out


def edited(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts, ratio=2):
    """{word: (n, n_near, form, form_n, root)} by comparing all pairs."""
    out = {}
    for w, n in counts.items():
        near = [o for o in counts if o != w and abs(len(o) - len(w)) < 2 and edited(w, o)]
        best = min(near, key=lambda o: (-counts[o], o), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    full = {}
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        full[w] = (*out[w], root)
    return full


def result(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def invented(rnd, n, letters, low, high):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(n)]


@pytest.mark.parametrize("letters,cell_words", [("ab", 20_000), ("abcé", 3), ("abcdefgà÷", 1)])
def test_groups_equal_all_pairs(spark, letters, cell_words):
    """Two letters make many anagrams, so leaves are entered by halves; small cells cut the trie far down."""
    rnd = random.Random(5)
    bag = [(w,) for w in invented(rnd, 1500, letters, 1, 8) for _ in range(rnd.choice([1, 1, 2, 5, 12]))]
    got = variants.group_variants(spark.createDataFrame(bag, "word string"), min_chars=3, min_count=2, cell_words=cell_words)
    counts = Counter(w for w, in bag)
    assert result(got) == grouped({w: n for w, n in counts.items() if len(w) >= 3 and n >= 2})


def test_large_leaves_are_entered_by_halves(spark):
    """All words of two letters: up to 126 anagrams share a leaf."""
    words = ["".join(w) for k in (7, 8, 9) for w in itertools.product("ab", repeat=k)]
    counts = {w: 1 + zlib.crc32(w.encode()) % 9 for w in words}
    bag = [(w,) for w, n in counts.items() for _ in range(n)]
    assert result(variants.group_variants(spark.createDataFrame(bag, "word string"), min_count=1)) == grouped(counts)


def test_long_words_and_held_counts(spark):
    base = "ab" * 300
    words = [base, base + "a", base[:300] + "c" + base[301:], base[1:], "a" * 400, "a" * 399 + "b", "a" * 401, "b" * 400, "cc" + base]
    bag = [(w,) for k, w in enumerate(words) for _ in range(k + 1)]
    for cell_words in (1, 20_000):
        got = variants.group_variants(spark.createDataFrame(bag, "word string"), min_count=1, cell_words=cell_words)
        assert result(got) == grouped(Counter(w for w, in bag))


def test_ties_take_the_least_word(spark):
    bag = [("house",)] * 2 + [("mouse",)] * 8 + [("rouse",)] * 8 + [("houses",)] * 4
    assert result(variants.group_variants(spark.createDataFrame(bag, "word string"), min_count=1))["house"] == (2, 3, "mouse", 8, "mouse")


def test_chains_of_forms(spark):
    """abcde0 .. each twice as frequent as the one before it: the root is the last."""
    chain = ["abcdef" + "g" * i for i in range(9)]
    bag = [(w,) for i, w in enumerate(chain) for _ in range(2 ** i)]
    got = result(variants.group_variants(spark.createDataFrame(bag, "word string"), min_count=1))
    assert {v[4] for v in got.values()} == {chain[-1]}


def test_runs_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    for every in (None, 3):
        got = Counter(r["word"] for r in variants.runs(odd_docs, typo_every=every).collect())
        assert got == words_of(rows, every)
    assert variants.group_variants(variants.runs(no_docs)).collect() == []
    assert result(variants.group_variants(variants.runs(odd_docs, typo_every=97)))["paragraph"][0] > 3000


def test_query_equals_all_pairs_on_the_smallest_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(variants.group_variants(variants.runs(docs, typo_every=97)))
    assert got == grouped({w: n for w, n in words_of(rows, 97).items() if len(w) >= 5 and n >= 3})


def test_one_edit():
    rnd = random.Random(6)
    for a, b in zip(invented(rnd, 3000, "ab", 1, 5), invented(rnd, 3000, "ab", 1, 5)):
        assert variants.one_edit(a, b) == (len(b) >= len(a) and edited(a, b))


def test_vectors_count_groups():
    got = variants.vectors(["eeé", "z" * 300])
    assert got.shape == (2, variants.GROUPS) and got[0].sum() == 3 and got[1].max() == 255
    assert np.count_nonzero(got[1]) == 1
