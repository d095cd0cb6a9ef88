"""Token ids in a compressed file format (static range asymmetric numeral system).

Documents are tokenized, put in ascending order of their id and cut into blocks of whole
documents. One frequency table, counted over all tokens, serves every block. A block is
coded by interleaved lanes (token t belongs to lane t mod lanes): each lane holds a
64-bit state and the lanes that overflow put 32-bit words on one common stream, so that
all lanes of a step are coded by vector operations. A block holds the length of each
document, the lanes' states at its start and at regular checkpoints, and a CRC-32, so
blocks, and parts of a block, are decoded independently of each other.

A token file is a folder in the shared file system: ``blocks`` (one file for each shard,
rows in order: shard, seq, tokens of the shard before it, n_docs, n_tokens, ids of the
documents, payload) and ``table``
(token, frequency). Spark's writer commits the files, so lost tasks are simply repeated.

Defined results: a null text counts as empty, and an empty document holds the end id
alone; null ids sort first; rows of equal id are ordered by their tokens; an empty table
gives no blocks. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, compress, filterfalse
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tabrig.session import shared_dir

from .common import col, materialise, table

MAGIC = b"RANSTOK1"
HEAD = struct.Struct("<8sIIIIIII")  # magic, table crc, lanes, scale bits, tokens, documents, checkpoint steps, words
LOW = 31  # a state lies in [2^31, 2^63)


class Frequencies:
    """Token frequencies scaled to 2^bits; every token that occurs keeps at least 1."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray, bits: int):
        self.bits = bits
        self.tokens = np.asarray(tokens, np.uint32)
        self.freq = np.asarray(freqs, np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(self.tokens.astype("<u4").tobytes() + self.freq.astype("<u8").tobytes())
        self.slot = np.repeat(np.arange(len(self.tokens), dtype=np.uint32), self.freq.astype(np.int64))
        self.index = np.zeros(int(self.tokens.max()) + 1 if len(self.tokens) else 1, np.uint32)
        self.index[self.tokens] = np.arange(len(self.tokens), dtype=np.uint32)

    @staticmethod
    def scaled(tokens: np.ndarray, counts: np.ndarray, bits: int) -> Frequencies:
        size = 1 << bits
        if len(tokens) > size // 2:
            raise ValueError("too many different tokens for the scale")
        total = int(counts.sum())
        freq = np.maximum(1, counts.astype(object) * size // max(total, 1)).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        left = size - int(freq.sum())
        if left > 0 and len(freq):
            freq[order[0]] += left
        while left < 0:  # take from the most frequent ones
            for k in order:
                cut = min(int(freq[k]) // 2, -left)
                freq[k] -= cut
                left += cut
                if not left:
                    break
        return Frequencies(tokens, freq, bits)


def encode_block(tokens: np.ndarray, lengths: np.ndarray, f: Frequencies, most_lanes: int = 1024, every: int = 64) -> bytes:
    n = len(tokens)
    lanes = max(1, min(most_lanes, n // 64))
    steps = -(-n // lanes)
    sym = f.index[tokens]
    freq, start = f.freq[sym], f.start[sym]
    limit = freq << np.uint64(LOW - f.bits + 32)
    state = np.full(lanes, 1 << LOW, np.uint64)
    bits, down = np.uint64(f.bits), np.uint64(32)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []  # (words emitted by later steps, states)
    emitted = 0
    for t in range(steps - 1, -1, -1):
        at, to = t * lanes, min((t + 1) * lanes, n)
        x = state[:to - at]
        full = x >= limit[at:to]
        if full.any():
            out = x[full].astype(np.uint32)
            words.append(out)
            emitted += len(out)
            x = np.where(full, x >> down, x)
        q, r = np.divmod(x, freq[at:to])
        state[:to - at] = (q << bits) + r + start[at:to]
        if t and t % every == 0:
            marks.append((emitted, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    body = [HEAD.pack(MAGIC, f.crc, lanes, f.bits, n, len(lengths), every, emitted),
            lengths.astype("<u4").tobytes(), state.astype("<u8").tobytes()]
    for later, states in marks[::-1]:
        body += [struct.pack("<I", emitted - later), states.astype("<u8").tobytes()]
    body.append(stream.astype("<u4").tobytes())
    body = b"".join(body)
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(payload: bytes, f: Frequencies, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lengths of the documents, tokens first..last of the block), beginning at the
    nearest checkpoint. A damaged block or another frequency table is an error."""
    magic, crc, lanes, bits, n, docs, every, n_words = HEAD.unpack_from(payload)
    if magic != MAGIC or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("damaged block")
    if crc != f.crc or bits != f.bits:
        raise ValueError("the block belongs to another frequency table")
    last = n if last is None else min(last, n)
    at = HEAD.size
    lengths = np.frombuffer(payload, "<u4", docs, at)
    at += 4 * docs
    steps = -(-n // lanes)
    marks = max(0, (steps - 1) // every)
    entry = 4 + 8 * lanes
    stream = np.frombuffer(payload, "<u4", n_words, at + 8 * lanes + marks * entry)
    k = min(first // lanes // every, marks)  # the checkpoint to begin at; 0: the block's start
    if k:
        here = at + 8 * lanes + (k - 1) * entry
        word = struct.unpack_from("<I", payload, here)[0]
        state = np.frombuffer(payload, "<u8", lanes, here + 4).astype(np.uint64)
    else:
        word, state = 0, np.frombuffer(payload, "<u8", lanes, at).astype(np.uint64)
    begin = k * every * lanes
    out = np.empty(max(0, min(-(-last // lanes) * lanes, n) - begin), np.uint32)
    mask, bits, up, low = np.uint64((1 << f.bits) - 1), np.uint64(f.bits), np.uint64(32), np.uint64(1 << LOW)
    for t in range(k * every, -(-last // lanes)):
        a, b = t * lanes, min((t + 1) * lanes, n)
        x = state[:b - a]
        part = x & mask
        sym = f.slot[part.astype(np.int64)]
        out[a - begin:b - begin] = sym
        x = f.freq[sym] * (x >> bits) + part - f.start[sym]
        short = x < low
        m = int(np.count_nonzero(short))
        if m:
            x[short] = (x[short] << up) | stream[word:word + m]
            word += m
        state[:b - a] = x
    return lengths, f.tokens[out[first - begin:last - begin]]


class WordIds:
    """Ids of whole texts by the tokenizers library, cached by parts between blanks (the
    tokenizer drops white space, and no token or special token holds any)."""

    def __init__(self, data: bytes, kind: np.dtype = np.dtype("<u4"), most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.cache: dict[str, bytes] = {}  # of parts
        self.words: dict[str, bytes] = {}  # of runs of letters or of others in them
        self.most = most
        self.kind = kind
        # a special token that the library cuts out of the raw text first
        self.cut = next((i, t.content) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items())
                        if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        vocabulary = self.tokenizer.get_vocab()
        if self.cut is None or not any(t.endswith("</w>") for t in vocabulary):
            raise ValueError("a tokenizer with word ends and a special token is needed")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, parts: Iterable[str]) -> dict[str, bytes]:
        """The ids of each part. Runs of letters are encoded together between blanks, as
        each ends in a token that ends a word; other parts that hold no special token
        together with one between them."""
        found = {}

        def together(group: list[str], between: str, edges, skip: int) -> None:
            ids = np.array(self.tokenizer.encode_batch_fast([between.join(group)], add_special_tokens=False)[0].ids, self.kind)
            width, ends = self.kind.itemsize, edges(ids)
            raw, ends = ids.tobytes(), (width * ends).tolist()
            found.update((p, raw[a:b]) for p, a, b in zip(group, [0, *(e + width * skip for e in ends[:-1])], ends, strict=True))

        letters = list(filter(LETTERS.fullmatch, parts))
        kinds: list[list[str]] = [letters, [], []]
        for p in set(parts).difference(letters):
            kinds[1 if "<|" not in p else 2].append(p)
        for at in range(0, len(kinds[0]), 5000):
            together(kinds[0][at:at + 5000], " ", lambda ids: np.nonzero(self.ends[ids])[0] + 1, 0)
        for at in range(0, len(kinds[1]), 1000):
            together(kinds[1][at:at + 1000], self.cut[1],
                     lambda ids: np.append(np.nonzero(ids == self.cut[0])[0], len(ids)), 1)
        if kinds[2]:
            for p, e in zip(kinds[2], self.tokenizer.encode_batch(kinds[2], add_special_tokens=False), strict=True):
                found[p] = np.array(e.ids, self.kind).tobytes()
        return found

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after the other). Arrow cuts the texts
        and finds the different parts; only those are looked up."""
        cut = pc.split_pattern(texts, " ")
        coded = cut.flatten().dictionary_encode()
        blobs = pa.array(self._blobs(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.binary())
        raw = blobs.cast(pa.large_binary()).take(coded.indices)  # the ids of all parts, one after the other
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        ends = np.frombuffer(raw.buffers()[1], np.int64)[:len(raw) + 1] // self.kind.itemsize
        ids = np.frombuffer(raw.buffers()[2] or b"", self.kind)[:ends[-1]]
        return np.diff(ends[upto]), ids

    def _blobs(self, parts: list[str]) -> list[bytes]:
        cache, words = self.cache, self.words
        if len(cache) > self.most:
            cache.clear()
        if len(words) > 2 * self.most:
            words.clear()
        new = list(filterfalse(cache.__contains__, parts))
        odd = [p for p in new if "'" in p or "<" in p or not (p.isascii() or SIMPLE.fullmatch(p))]
        apart = set(odd)
        plain = [p for p in new if p not in apart] if odd else new
        lower = " ".join(plain).lower().split(" ") if plain else []
        whole = list(map(str.isalpha, lower))  # most parts are one run
        cut = list(map(not_, whole))
        ones = list(chain(compress(lower, whole), odd))
        runs = list(map(RUNS.findall, compress(lower, cut)))
        words.update(self._ids(set(filterfalse(words.__contains__, chain(ones, chain.from_iterable(runs))))))
        get = words.__getitem__
        cache.update(zip(chain(compress(plain, whole), odd), map(get, ones), strict=True))
        cache.update((p, b"".join(map(get, ws))) for p, ws in zip(compress(plain, cut), runs, strict=True))
        return list(map(cache.__getitem__, parts))


#: Text below U+0100 is its own canonical form and is lowered letter by letter, and the
#: tokenizer cuts it wherever letters (\p{L}) meet others, but for its "'s" and such and
#: for special tokens ("<|").
LETTER = "a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
SIMPLE = re.compile("[^'<\u0100-\U0010ffff]+")
LETTERS = re.compile(f"[{LETTER}]+")
RUNS = re.compile(f"[{LETTER}]+|[^{LETTER}]+")


#: Documents whose different parts are looked up at once.
ROWS_AT_ONCE = 5000

_WORKER: dict = {}


def _once(shared, make):
    """One object per worker for a broadcast (key, data)."""
    key, data = shared.value
    if _WORKER.get(make.__name__, (None,))[0] != key:
        _WORKER[make.__name__] = (key, make(data))
    return _WORKER[make.__name__][1]


def _tokenizer(data):
    return WordIds(data[0], np.dtype(data[1]))


def _table(data):
    return Frequencies(*data)


def id_type(tokenizer: bytes, end_id: int) -> np.dtype:
    """The integer type of ids in intermediate tables."""
    from tokenizers import Tokenizer
    return np.dtype("<u2" if max(Tokenizer.from_str(tokenizer.decode()).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``n`` and ``ids`` (binary: little-endian unsigned integers of 16 bits if the
    vocabulary allows it, else of 32)."""
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("the tokenizer file is over 64 MB")
    kind = id_type(data, end_id)
    shared = docs.sparkSession.sparkContext.broadcast((zlib.crc32(data), (data, kind.str)))
    schema = StructType([StructField("id", docs.schema[id_col].dataType), StructField("n", LongType(), False),
                         StructField("ids", BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _once(shared, _tokenizer)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                sizes, ids = words.encode(pc.fill_null(batch.column(1), ""))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                offsets = np.concatenate([[0], np.cumsum(sizes + 1)]) * kind.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
                    None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes + 1), raw.cast(pa.binary())], schema.names)

    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(run, schema)


def _counts(tokens: DataFrame, kind: np.dtype) -> DataFrame:
    """Occurrences of every token: counted by task, then summed (a row for each token)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            c = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(c) > len(total):
                c[:len(total)] += total
                total = c
            else:
                total[:len(c)] += c
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["token", "c"])

    parts = tokens.select("ids").mapInArrow(run, "token long, c long")
    return parts.groupBy("token").agg(F.sum("c").alias("c"))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", block_tokens: int = 1 << 18, scale_bits: int = 20,
                 vocabulary: int = 1 << 18) -> None:
    """Writes the token file of ``docs`` to the folder ``path``. ``vocabulary`` bounds the
    number of different tokens, and so the frequency table that every task gets."""
    spark = docs.sparkSession
    tokens = materialise(tokenize(docs, tokenizer_path, end_id, id_col, text_col), "token-ids", "zstd")
    with open(tokenizer_path, "rb") as f:
        kind = id_type(f.read(), end_id)
    counted = _counts(tokens, kind).limit(vocabulary + 1).toPandas().sort_values("token")
    if len(counted) > vocabulary:
        raise ValueError("more different tokens than the vocabulary parameter allows")
    freqs = Frequencies.scaled(counted["token"].to_numpy(np.int64), counted["c"].to_numpy(np.int64), scale_bits)
    data = (freqs.tokens, freqs.freq, scale_bits)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(freqs.tokens, freqs.freq, strict=True)],
                          "token long, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((freqs.crc, data))
    schema = StructType([StructField("shard", IntegerType(), False), StructField("seq", LongType(), False),
                         StructField("before", LongType(), False), StructField("n_docs", LongType(), False), StructField("n_tokens", LongType(), False),
                         StructField("doc_ids", ArrayType(docs.schema[id_col].dataType), False),
                         StructField("payload", BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        f, shard, seq, before = _once(shared, _table), TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Scalar] = []
        held: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            lengths = np.array([len(b) // kind.itemsize for b in held], np.uint32)
            payload = encode_block(np.frombuffer(b"".join(held), kind), lengths, f)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()),
                 pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(id_kind)), pa.array([payload], pa.binary())], schema.names)

        for batch in batches:
            id_kind = batch.schema.field(0).type
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                held.append(b)
                size += len(b) // kind.itemsize
                if size >= block_tokens:
                    yield block()
                    ids, held, size, seq, before = [], [], 0, seq + 1, before + size
        if held:
            yield block()

    placed = tokens.repartitionByRange("id").sortWithinPartitions("id", "n", "ids")
    placed.select("id", "ids").mapInArrow(run, schema).write.parquet(f"{path}/blocks", compression="uncompressed")


def read_frequencies(spark: SparkSession, path: str, scale_bits: int = 20, vocabulary: int = 1 << 18):
    rows = spark.read.parquet(f"{path}/table").limit(vocabulary).toPandas().sort_values("token")
    return Frequencies(rows["token"].to_numpy(np.uint32), rows["freq"].to_numpy(np.uint64), scale_bits)


def read_tokens(spark: SparkSession, path: str, scale_bits: int = 20) -> DataFrame:
    """The documents of a token file: ``id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (binary). Each block is decoded by itself."""
    f = read_frequencies(spark, path, scale_bits)
    shared = spark.sparkContext.broadcast((f.crc, (f.tokens, f.freq, scale_bits)))
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    placed = blocks.join(shards, "shard").select((F.col("shard_start") + F.col("before")).alias("at"), "doc_ids", "payload")
    schema = StructType([StructField("id", blocks.schema["doc_ids"].dataType.elementType), StructField("start", LongType()),
                         StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _once(shared, _table)
        for batch in batches:
            for row in range(batch.num_rows):
                at, ids, payload = (c[row] for c in batch.columns)
                lengths, tokens = decode_block(payload.as_py(), f)
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths
                raw = tokens.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(at.as_py() + begins), pa.array(lengths.astype(np.int64)),
                     pa.array([raw[4 * a:4 * b] for a, b in zip(begins, ends, strict=True)], pa.binary())], schema.names)

    return placed.mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-file")
    write_tokens(table(spark, sf_dir, "documents"), path, default_tokenizer(), end_id=1)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens",
                                           F.crc32("ids").alias("ids_crc32"))
