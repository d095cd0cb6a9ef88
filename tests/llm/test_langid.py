import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrig.llm import langid


def plain_counts(text):
    """The definition, without slices or arrays of windows."""
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    text = " " + " ".join(text.split()) + " " if text.strip() else " "
    out = np.zeros(langid.DIMS, np.int64)
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            gram = text[i:i + n]
            if n == 1 and gram == " ":
                continue
            out[langid._hashed(np.array([ord(c) for c in gram], np.uint64), n)[0]] += 1
    return out


@pytest.mark.parametrize("text", ["", " ", "a", "ab", "A b", " --ab--c ", "été Ünï 12 x", "漢字 \U0001F600 x"])
def test_counts_equal_the_definition(text):
    assert (langid.gram_counts(text) == plain_counts(text)).all()


def test_slices_do_not_change_counts(monkeypatch):
    rnd = random.Random(1)
    text = "".join(rnd.choice("ab c--é\n") for _ in range(500))
    whole = langid.gram_counts(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "SLICE", size)
        assert (langid.gram_counts(text) == whole).all()


def corpus(spark, n=240):
    rnd = random.Random(2)
    words = {"aa": ["kala", "moko", "luma", "saka"], "bb": ["stern", "bricht", "wurst", "grenz"], "cc": ["ieoue", "aeiou", "yieau", "oueia"]}
    rows = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join(rnd.choice(words[lang]) for _ in range(rnd.randint(5, 40))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_rows_and_a_brute_force_search(spark):
    docs = corpus(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    known = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    df = sum((plain_counts(r["text"]) > 0).astype(int) for r in known)
    assert np.allclose(model.idf, np.log((1 + len(known)) / (1 + df)) + 1, atol=1e-5)
    got = {r["id"]: r for r in langid.identify(docs, model, reject=False).collect()}
    for r in docs.collect():
        counts = plain_counts(r["text"])
        x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * model.idf
        cosine = [float(c @ x / np.linalg.norm(x)) for c in model.centroids]
        best = int(np.argmax(cosine))
        assert got[r["doc_id"]]["lang_pred"] == model.langs[best] == r["lang"]
        assert got[r["doc_id"]]["score"] == pytest.approx(cosine[best], abs=1e-5)


def test_rejection_by_distance(spark):
    model = langid.fit(corpus(spark))
    odd = spark.createDataFrame([(1, "zzz qqq xxx jjj", 1), (2, "kala moko luma saka kala moko", 2)], "doc_id long, text string, lang int")
    got = {r["id"]: (r["lang_pred"], r["rejected"]) for r in langid.identify(odd, model).collect()}
    assert got[1] == ("und", True) and got[2] == ("aa", False)
    assert all(r["lang_pred"] != "und" for r in langid.identify(odd, model, reject=False).collect())


def test_small_clusters_of_wrong_labels_are_given_up(spark):
    docs = corpus(spark)
    wrong = docs.where("lang = 'bb'").limit(2).withColumn("lang", F.lit("aa"))
    model = langid.fit(docs.union(wrong))
    got = langid.identify(docs, model, reject=False).join(docs.withColumnRenamed("doc_id", "id"), "id")
    assert got.where("lang_pred <> lang").count() == 0


def test_spherical_means():
    rnd = np.random.default_rng(3)
    x = np.vstack([c + 0.01 * rnd.random((20, 6)) for c in np.eye(6)[:3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    means, own = langid.spherical_means(x, 3)
    assert len(means) == 3 and [len(set(own[i:i + 20])) for i in (0, 20, 40)] == [1, 1, 1]
    assert len(langid.spherical_means(np.repeat(x[:1], 9, 0), 4)[0]) == 1


def test_hot_language_and_repeated_texts_stay_within_the_sample(spark):
    rows = [(i, "kala moko luma", "aa") for i in range(3000)] + [(i, f"stern {'ab' * (i % 97)} wurst {chr(97 + i % 26) * 3}", "bb") for i in range(3000)]
    texts = spark.createDataFrame(rows, "id long, text string, lang string").select("lang", "text")
    got = {r["lang"]: r["count"] for r in langid.sampled_vectors(texts, 100).groupBy("lang").count().collect()}
    assert got["aa"] == 1 and 80 <= got["bb"] <= 260


def test_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(corpus(spark))
    got = langid.identify(odd_docs, model, reject=False).collect()
    assert len(got) == odd_docs.count()
    by_text = dict(zip([r["text"] for r in odd_docs.collect()], got))
    assert [by_text[t]["lang_pred"] for t in (None, "", " \t\n ")] == ["und"] * 3
    assert all(r["score"] == 0 and not r["rejected"] for r in got if r["lang_pred"] == "und")
    assert langid.identify(no_docs, model).collect() == []
    nothing = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    nulls = langid.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert nulls.langs == []


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 1000)
    with pytest.raises(ValueError, match="fewer clusters"):
        langid.fit(corpus(spark, 30))
