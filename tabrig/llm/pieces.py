"""SentencePiece (BPE) encoding and decoding through a merge-type prefix table.

For BPE the encoding of every prefix of a text ends in one definite token, and a row of
tokens is an encoding exactly if every two neighbours are (the encoding of the joined
strings of the two is the two tokens again). So the table of each prefix's last token
is filled from left to right: an automaton over all pieces yields the tokens that end at
a position, and the one whose start is a prefix with a compatible last token is stored.
The ids are read off backwards from the end.

Texts are cut, exactly, before each run of space marks and around line feeds (no piece
holds a mark behind another character), and each worker keeps a bounded cache of cut
parts. Characters without a piece become their byte pieces.

Defined results: a null text counts as empty, an empty text gives the end id alone. Rows
are independent: equal rows, null ids and further columns need no care. The model must
be a BPE model with identity normalisation, a dummy prefix and byte fallback.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import col, table

MARK = "▁"  # stands for a blank in pieces


class PieceModel:
    """Pieces, scores and byte pieces of a model, with the prefix-table encoder."""

    def __init__(self, model: bytes, cache: int = 300_000):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.library
        n = p.get_piece_size()
        special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i)}
        self.piece = p.id_to_piece(list(range(n)))
        score = p.get_score(list(range(n)))
        if any(p.is_unused(i) for i in range(n)) or any(MARK in self.piece[i].lstrip(MARK) for i in range(n) if i not in special):
            raise ValueError("pieces with an inner space mark and unused pieces aren't supported")
        self.id = {self.piece[i]: i for i in range(n) if i not in special}
        self.score = {s: score[i] for s, i in self.id.items()}
        self.byte = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if self.library.encode("▁ ﬁ\n", out_type=str)[:1] != [MARK * 3] and \
                self.library.encode(" ﬁ ") != self._plain(MARK * 2 + "ﬁ" + MARK):
            raise ValueError("the model's normalisation isn't the identity with a dummy prefix")
        self.length = [len(s) for s in self.piece]
        self.compatible: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.most = cache
        self.automaton = ahocorasick.Automaton()
        for s, i in self.id.items():
            if len(s) == 1 or self.merge(s) == [s]:  # else no encoding ever holds it
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def merge(self, text: str) -> list[str]:
        """The pieces by merging: again and again the best-scored neighbours, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _plain(self, text: str) -> list[int]:
        return [i for s in self.merge(text) for i in ([self.id[s]] if s in self.id else [self.byte[b] for b in s.encode()])]

    def _pair(self, a: int, b: int) -> bool:
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        x, y = self.piece[a], self.piece[b]
        self.compatible[a << 32 | b] = ok = self.merge(x + y) == [x, y]
        return ok

    def part(self, text: str) -> list[int]:
        """Ids of a part that holds whole merges: prefix table, then backwards."""
        n, length, known = len(text), self.length, self.compatible
        last = [-1] * (n + 1)  # -1: no piece ends here, the character has none
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            before = last[start]
            if start and before >= 0:
                ok = known.get(before << 32 | token)
                if not (self._pair(before, token) if ok is None else ok):
                    continue
            last[end] = token
        ids, at = [], n
        while at:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= length[token]
            else:
                at -= 1
                ids.extend(self.byte[b] for b in reversed(text[at].encode()))
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text without an end id, as 32-bit integers."""
        if not text:
            return b""
        cache, found = self.cache, []
        for part in PARTS.findall(MARK + text.replace(" ", MARK)):
            ids = cache.get(part)
            if ids is None:
                ids = np.array(self.part(part), np.int32).tobytes()
                if len(part) <= 64:
                    if len(cache) >= self.most:
                        cache.clear()
                    cache[part] = ids
            found.append(ids)
        return b"".join(found)


PARTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_MODELS: dict[int, PieceModel] = {}


def _model(shared) -> PieceModel:
    """The model of this worker, built once from the broadcast bytes."""
    if shared.value[0] not in _MODELS:
        _MODELS.clear()
        _MODELS[shared.value[0]] = PieceModel(shared.value[1])
    return _MODELS[shared.value[0]]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           end_id: int | None = 2, decode: bool = True) -> DataFrame:
    """``id_col``, ``ids`` (array of int), ``n_tokens`` and, if asked for, ``decoded``:
    the text of the ids. The model file (its size is checked) is read once and sent to
    the workers; rows stay where they are."""
    with open(model_path, "rb") as f:
        model = f.read()
    if len(model) > 64 << 20:
        raise ValueError("the model file is over 64 MB")
    shared = docs.sparkSession.sparkContext.broadcast((hash(model), model))
    end = np.array([] if end_id is None else [end_id], np.int32).tobytes()
    fields = [StructField("key", docs.schema[id_col].dataType), StructField("ids", ArrayType(IntegerType(), False), False),
              StructField("n_tokens", LongType(), False)]
    if decode:
        fields.append(StructField("decoded", StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = [m.encode(t or "") + end for t in batch.column(1).to_pylist()]
                sizes = np.array([len(r) // 4 for r in rows], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = np.frombuffer(b"".join(rows), np.int32)
                out = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes)]
                if decode:
                    out.append(pa.array([m.library.decode(np.frombuffer(r, np.int32).tolist()) for r in rows], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    picked = docs.select(col(id_col).alias("key"), col(text_col).alias("text"))
    return picked.mapInArrow(run, StructType(fields)).withColumnRenamed("key", id_col)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op3(spark, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), default_model())
    return out.select("doc_id", "n_tokens",
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
