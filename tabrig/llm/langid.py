"""Language identification by nearest centroids.

A text's vector counts its letter n-grams (1 to 3 code points, lowered, any run of other
characters as one blank) hashed to ``DIMS`` numbers, weighted by 1 + log(count) and inverse document frequency, and
normalised. Each language has up to ``clusters`` centroids, from spherical k-means; a text
gets the language of the centroid of largest cosine. It is rejected if its distance from that centroid
is above the centroid's radius: the ``quantile`` of the distances of the rows that made it, widened by ``slack``.

Document frequencies cover all learning rows. The centroids are fitted, one task a language, on a bounded
sample: the ``sample`` distinct texts of least hash in each language; sketches of the distinct texts
set a hash threshold for the language first, so that no task sorts more than about one and a half times the
sample, and repeated texts fold before they are shuffled. Vectors hold at most ``DIMS`` numbers, so
a very long text costs no more memory there than any other. All tasks hold all centroids
(languages x ``clusters`` x ``DIMS`` x 4 bytes); above ``MODEL_BYTES`` fitting raises.

Defined results: a null text or one without a letter is ``und`` with score 0 and is not learned from, nor is a null
language; ties go to the least language; without anything to learn from every text is ``und``;
rows of equal or null id are judged one by one (a null id is never held out); an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialise, table

DIMS = 1 << 13
SLICE = 1 << 20  # code points handled at once
UNKNOWN = "und"
MODEL_BYTES = 256 << 20
LETTER = r"\p{L}"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter (made once in a worker)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _hashed(codes: np.ndarray, n: int) -> np.ndarray:
    """A number below ``DIMS`` for each window of ``n`` code points."""
    h = np.full(len(codes) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ codes[i:len(codes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(40)).astype(np.int64) % DIMS


def gram_counts(text: str) -> np.ndarray:
    """n-gram counts of a whole text, slice by slice; a slice starts with the two last code
    points of the one before, whose own windows are not counted again."""
    out = np.zeros(DIMS, np.int64)
    carried = np.array([32], np.uint64)
    for start in range(0, max(len(text), 1), SLICE):
        part = text[start:start + SLICE].lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(part, np.uint32)
        codes = np.where(letters()[np.minimum(codes, 0x10FFFF)], codes, 32).astype(np.uint64)
        if start + SLICE >= len(text):
            codes = np.append(codes, np.uint64(32))
        old = len(carried)
        codes = np.concatenate([carried, codes])
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        keep[:old] = True
        codes = codes[keep]
        single = codes[old:]
        out += np.bincount(_hashed(single[single != 32], 1), minlength=DIMS)
        for n in (2, 3):
            window = codes[max(old - n + 1, 0):]
            if len(window) >= n:
                out += np.bincount(_hashed(window, n), minlength=DIMS)
        carried = codes[-2:]
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (zero rows stay zero)."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    langs: list[str]  # of each centroid, in order
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid and cosine for rows of counts."""
        cosine = weighted(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0, 1)


def _per_text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(col(text_col).rlike(LETTER), F.lit(False))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each number occurs, and the number of texts: summed in the tasks
    first, ``DIMS`` numbers from each. ``texts``: a column ``text``, without nulls."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMS, np.int64), 0
        for part in parts:
            for text in part.column("text"):
                total += gram_counts(text.as_py()) > 0
                rows += 1
        if rows:
            dims = np.append(np.arange(DIMS), -1)
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(np.append(total, rows))], ["dim", "texts"])

    sums = texts.select("text").mapInArrow(count, "dim long, texts long").groupBy("dim").agg(F.sum("texts").alias("texts"))
    out, rows = np.zeros(DIMS, np.int64), 0
    for r in sums.collect():  # DIMS + 1 rows
        if r["dim"] < 0:
            rows = int(r["texts"])
        else:
            out[r["dim"]] = r["texts"]
    return out, rows


def sampled_vectors(texts: DataFrame, sample: int) -> DataFrame:
    """``lang``, ``h``, ``dims``, ``counts`` of about one and a half times ``sample`` distinct texts of
    each language (all, where there are fewer)."""
    hashed = texts.select("lang", "text", F.xxhash64(F.lit(13), "text").alias("h"))
    share = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("distinct")).collect()
    # as many languages as the centroids leave room for, so a literal map and no join of the texts
    keep = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.5 * sample / max(r["distinct"], 1)))])
    drawn = hashed.where(share < F.element_at(keep, F.col("lang"))) if sizes else hashed.limit(0)
    drawn = drawn.select("lang", "h", "text")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, h, text in zip(*[part.column(c) for c in ("lang", "h", "text")]):
                counts = gram_counts(text.as_py())
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()], pa.string()), pa.array([h.as_py()], pa.int64()),
                     pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[at]], pa.list_(pa.int64()))],
                    ["lang", "h", "dims", "counts"])

    vectors = drawn.mapInArrow(count, "lang string, h long, dims array<int>, counts array<long>")
    return vectors.dropDuplicates(["lang", "h"])


def spherical_means(x: np.ndarray, clusters: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and the row's centroid. The first is the mean of all; each further one starts
    at the row farthest from those before."""
    def unit(v):
        return v / max(np.linalg.norm(v), 1e-12)

    seeds = [unit(x.mean(0))]
    while len(seeds) < min(clusters, len(x)):
        near = (x @ np.array(seeds).T).max(1)
        if near.min() > 1 - 1e-6:
            break
        seeds.append(x[near.argmin()])
    means = np.array(seeds)
    for _ in range(rounds):
        own = (x @ means.T).argmax(1)
        new = np.array([unit(x[own == k].sum(0)) if (own == k).any() else means[k] for k in range(len(means))])
        if np.allclose(new, means, atol=1e-6):
            break
        means = new
    own = (x @ means.T).argmax(1)
    used = np.flatnonzero(np.bincount(own, minlength=len(means)))
    return means[used], np.searchsorted(used, own)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", clusters: int = 4, sample: int = 1000,
        min_share: float = 0.05, quantile: float = 0.99, slack: float = 1.25) -> Model:
    """The model of the rows with a language and a letter. Clusters of under ``min_share`` of their language's
    rows are given up: a few rows of a wrong label would else be a centroid amid another language."""
    known = docs.where(col(lang_col).isNotNull() & _per_text(docs, text_col))
    texts = known.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text"))
    room = MODEL_BYTES // (clusters * DIMS * 4)
    if texts.select("lang").distinct().limit(room + 1).count() > room:
        raise ValueError(f"Centroids of more than {room} languages exceed {MODEL_BYTES} bytes; use fewer clusters.")
    df, rows = document_frequencies(texts)
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)

    def cluster(part: pa.Table) -> pa.Table:
        part = part.sort_by("h").slice(0, sample)
        counts = np.zeros((len(part), DIMS), np.int64)
        for i, (dims, values) in enumerate(zip(part["dims"].to_pylist(), part["counts"].to_pylist())):
            counts[i, dims] = values
        x = weighted(counts, idf)
        means, own = spherical_means(x, clusters)
        distance = 1 - (x * means[own]).sum(1)
        sizes = np.bincount(own)
        kept = [k for k, n in enumerate(sizes) if n >= min(min_share * len(x), sizes.max())]
        radii = [float(np.quantile(distance[own == k], quantile)) * slack for k in kept]
        return pa.table({"lang": pa.array([part["lang"][0].as_py()] * len(kept), pa.string()),
                         "k": pa.array(kept, pa.int32()), "radius": pa.array(radii, pa.float64()),
                         "mean": pa.array([means[k].astype(np.float32).tobytes() for k in kept], pa.binary())})

    vectors = materialise(sampled_vectors(texts, sample), "langid-sample")
    got = vectors.groupBy("lang").applyInArrow(cluster, "lang string, k int, radius double, mean binary").collect()
    got = sorted(got, key=lambda r: (r["lang"].encode(), r["k"]))
    means = np.array([np.frombuffer(r["mean"], np.float32) for r in got], np.float32).reshape(len(got), DIMS)
    return Model([r["lang"] for r in got], means, np.array([r["radius"] for r in got]), idf)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """``id``, ``lang_pred``, ``score`` (the cosine) and ``rejected``; with ``reject`` a rejected text is ``und``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    judged = docs.select(col(id_col).alias("id"), F.when(_per_text(docs, text_col), col(text_col)).alias("text"))

    def predict(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in parts:
            for start in range(0, len(whole), 256):
                part = whole.slice(start, 256)
                rows = [i for i, t in enumerate(part.column("text")) if t.is_valid] if m.langs else []
                langs, scores, rejected = [UNKNOWN] * len(part), np.zeros(len(part)), [False] * len(part)
                if rows:
                    best, cosine = m.predict(np.array([gram_counts(part.column("text")[i].as_py()) for i in rows]))
                    for i, k, c in zip(rows, best, cosine):
                        rejected[i] = bool(1 - c > m.radii[k])
                        scores[i] = c
                        if not (reject and rejected[i]):
                            langs[i] = m.langs[k]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                                  pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    return judged.mapInArrow(predict, f"id {kind}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = identify(docs, model, reject=False)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "rejected")
