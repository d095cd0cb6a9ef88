import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabrig.llm import pieces, tokenfiles


@pytest.fixture(scope="module")
def model():
    with open(pieces.default_model(), "rb") as f:
        return pieces.PieceModel(f.read())


def test_prefix_table_equals_the_library(model):
    rnd = random.Random(5)
    letters = "aàb eé\n\t▁ 's.,-_/<>!ß中文😀́the" + "   \n"
    for _ in range(3000):
        s = "".join(rnd.choice(letters) if rnd.random() < .5 else rnd.choice(model.piece[259:]) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(model.encode(s), np.int32).tolist() == model.library.encode(s), s


def test_pieces_of_odd_rows(spark, odd_docs, no_docs, model):
    got = pieces.encode(odd_docs, pieces.default_model()).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert len(got) == 9
    for r in got:
        if r["doc_id"] != 5:
            ids = model.library.encode(texts[r["doc_id"]], add_eos=True)
            assert (r["ids"], r["n_tokens"], r["decoded"]) == (ids, len(ids), model.library.decode(ids))
    assert pieces.encode(no_docs, pieces.default_model()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 5000, 200_000])
def test_block_round_trip_and_parts(n):
    rng = np.random.default_rng(n)
    tokens = (rng.zipf(1.3, n) % 49000).astype(np.uint32)
    seen, counts = np.unique(tokens, return_counts=True) if n else (np.array([7]), np.array([1]))
    f = tokenfiles.Frequencies.scaled(seen.astype(np.int64), counts, 20)
    assert f.freq.sum() == 1 << 20 and f.freq.min() > 0
    block = tokenfiles.encode_block(tokens, np.array([n], np.uint32), f, every=16)
    for a, b in ((0, n), (0, n // 2), (n // 3, n // 2), (max(n - 1, 0), n)):
        lengths, part = tokenfiles.decode_block(block, f, a, b)
        assert lengths.tolist() == [n] and (part == tokens[a:b]).all()
    with pytest.raises(ValueError, match="damaged"):
        tokenfiles.decode_block(block[:20] + bytes([block[20] ^ 1]) + block[21:], f)
    other = tokenfiles.Frequencies(np.array([1, 2]), np.array([1 << 19, 1 << 19]), 20)
    with pytest.raises(ValueError, match="another frequency table"):
        tokenfiles.decode_block(block, other)


def test_word_ids_equal_the_library():
    with open(tokenfiles.default_tokenizer(), "rb") as f:
        words = tokenfiles.WordIds(f.read())
    rnd = random.Random(6)
    letters = "aàb eE\n\t'sS.,-<>!ÇcK̀́ıİΣς中😀½ªµº\xa0\x85²<|endoftext|>"
    odd = [" <|endoftext|> ", "It's ", "don't.", "<|startoftext|>", "\x1c", "\xa0", "  ", "the, ", "Hello. "]
    texts = ["".join(rnd.choice(letters) if rnd.random() < .6 else rnd.choice(odd) for _ in range(rnd.randint(0, 20))) for _ in range(3000)]
    sizes, ids = words.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(sizes)
    for t, e, n, whole in zip(texts, ends, sizes, words.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[e - n:e].tolist() == whole.ids, t


def test_word_ids_are_gathered_without_a_number_for_each():
    import tracemalloc
    with open(tokenfiles.default_tokenizer(), "rb") as f:
        words = tokenfiles.WordIds(f.read(), np.dtype("<u2"))
    texts = pa.array(["The quick brown fox, it's 1999. " * 300] * 100 + ["", " "], pa.string())
    words.encode(texts)
    tracemalloc.start()
    sizes, ids = words.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes.sum() == len(ids) > 200_000 and sizes[-2:].tolist() == [0, 0]
    assert ids[:sizes[0]].tolist() == words.tokenizer.encode(texts[0].as_py(), add_special_tokens=False).ids
    assert peak < 10 * len(ids)  # before: 24
    for none in (pa.array([], pa.string()), pa.array([""], pa.string())):
        sizes, ids = words.encode(none)
        assert sizes.tolist() == [0] * len(none) and len(ids) == 0


def test_token_file_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenfiles.default_tokenizer())
    tokenfiles.write_tokens(odd_docs, str(tmp_path / "a"), tokenfiles.default_tokenizer(), 1, block_tokens=50)
    got = tokenfiles.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r["id"] for r in got] == [None, 1, 2, 3, 5, 5, 5, 7, 8]
    start = 0
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["n_tokens"] and ids[-1] == 1
        if r["id"] != 5:
            assert ids.tolist() == [*t.encode(texts[r["id"]], add_special_tokens=False).ids, 1]
            assert zlib.crc32(bytes(r["ids"])) == zlib.crc32(ids.tobytes())
    tokenfiles.write_tokens(no_docs, str(tmp_path / "b"), tokenfiles.default_tokenizer(), 1)
    assert tokenfiles.read_tokens(spark, str(tmp_path / "b")).count() == 0
