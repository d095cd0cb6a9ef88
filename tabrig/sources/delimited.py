"""CSV records of files that many tasks read at once, line ends inside quoted fields included.

Spark's text source splits files at line ends, but a line end may lie inside a quoted field, and a
split cannot know by itself whether it begins inside one. So:

1. a first scan reduces every split to its state transition: inside or outside of a quoted
   field at its end, and how many records begin in it, for either state at its start;
2. the driver chains the transitions of each file's splits (one small row for each split, at
   most ``MAX_SPLITS``), which gives the state and the first record number of each;
3. a second scan cuts the lines of each split into records. What a split begins with of an
   earlier split's record, and a record that it leaves open, are fragments; they are joined by
   file and position, so a record may span any number of splits.

Quotes count only where they do for a reader of whole files: at the start of a field, doubled inside a quoted
one. Lines end in ``\\n`` or ``\\r\\n``; blank lines outside of quotes are skipped; a file that ends
inside a quoted field gives its last record as far as it goes.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_SPLITS = 1_000_000
RECORD, HEAD, WHOLE, OPEN = 0, 1, 2, 3  # a whole record; fragments: end of an earlier one, a split inside one, its begin


def inside_after(line: str, inside: bool, quote: str = '"', delimiter: str = ",") -> bool:
    """Whether a quoted field is still open after a line."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(quote, at):
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        at = line.find(quote, at)
        if at < 0:
            return True
        if line.startswith(quote, at + 1):
            inside, at = True, at + 2
            continue
        inside = False
        at = line.find(delimiter, at + 1) + 1
        if not at:
            return False


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are split by line feeds, with the file's hash and the split's first byte."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.xxhash64(F.input_file_name()).alias("file"), F.input_file_block_start().alias("start"))


def _by_split(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str], list[bool]]]:
    """((file, start), lines, whether each holds a quote), in the order of the task's splits."""
    for batch in parts:
        if not len(batch):
            continue
        files, starts = batch.column("file"), batch.column("start")
        f, s = files.to_numpy(), starts.to_numpy()
        ends = [*(np.flatnonzero((f[1:] != f[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), len(batch)]
        at = 0
        for end in ends:
            values = batch.column("value").slice(at, end - at)
            yield (files[at].as_py(), starts[at].as_py()), values.to_pylist(), pc.match_substring(values, '"').to_pylist()
            at = end


def _blank(line: str) -> bool:
    return line in ("", "\r")


def split_transitions(lines: DataFrame) -> DataFrame:
    """(file, start, end_out, n_out, end_in, n_in): for a split that begins outside and inside of a quoted field."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(split, state):
            return pa.RecordBatch.from_pydict({"file": [split[0]], "start": [split[1]], "end_out": [state[0]], "n_out": [state[1]],
                                               "end_in": [state[2]], "n_in": [state[3]]})

        last, state = None, None
        for split, values, quoted in _by_split(parts):
            if split != last:
                if last is not None:
                    yield done(last, state)
                last, state = split, (False, 0, True, 0)
            a, n, b, m = state
            for line, q in zip(values, quoted):
                if not (a and b) and not _blank(line):
                    n += not a
                    m += not b
                if q:
                    if a == b:
                        a = b = inside_after(line, a)
                    else:
                        a, b = inside_after(line, a), inside_after(line, b)
            state = (a, n, b, m)
        if last is not None:
            yield done(last, state)

    return lines.mapInArrow(run, "file long, start long, end_out boolean, n_out long, end_in boolean, n_in long")


def split_starts(lines: DataFrame) -> dict[tuple[int, int], tuple[bool, int]]:
    """For every split, in file order: whether it begins inside a quoted field, and the number of its first record. The
    records after the files' headers are numbered from 0; a header has the number before its file's first row."""
    rows = split_transitions(lines).limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"More than {MAX_SPLITS} splits; raise spark.sql.files.maxPartitionBytes.")
    spark = lines.sparkSession
    names = spark.createDataFrame([(p,) for p in lines.inputFiles()], "path string").select("path", F.xxhash64("path").alias("file"))
    order = {r["file"]: r["path"] for r in names.collect()}
    out, inside, n, file = {}, False, 0, None
    for r in sorted(rows, key=lambda r: (r["file"] not in order, order.get(r["file"], ""), r["file"], r["start"])):
        if r["file"] != file:
            file, inside, n = r["file"], False, n - 1  # the header is no row
        out[r["file"], r["start"]] = (inside, n)
        inside, n = (r["end_in"], n + r["n_in"]) if inside else (r["end_out"], n + r["n_out"])
    return out


def _pieces(lines: DataFrame, starts: dict[tuple[int, int], tuple[bool, int]]) -> DataFrame:
    """(file, start, kind, n, head, text) of whole records and fragments."""
    heads = {}
    for (file, _), (_, n) in starts.items():
        heads.setdefault(file, n)
    known = lines.sparkSession.sparkContext.broadcast((starts, heads))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, heads = known.value
        last, inside, n, kind, held = None, False, 0, RECORD, []

        def row(out, kind, n, text):
            for k, v in zip(out, (last[0], last[1], kind, n, kind in (RECORD, OPEN) and n == heads[last[0]], text)):
                out[k].append(v)

        def fresh():
            return {"file": [], "start": [], "kind": [], "n": [], "head": [], "text": []}

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(out["file"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["kind"], pa.int32()),
                                               pa.array(out["n"], pa.int64()), pa.array(out["head"], pa.bool_()), pa.array(out["text"], pa.string())], list(out))

        out = fresh()
        for split, values, quoted in _by_split(parts):
            if split != last:
                if held:
                    row(out, WHOLE if kind == HEAD else OPEN, n - (kind == RECORD), "\n".join(held))
                if split not in starts:
                    raise ValueError("The files are split otherwise than in the first scan.")
                last, held = split, []
                inside, n = starts[split]
                kind = HEAD if inside else RECORD
            for line, q in zip(values, quoted):
                if not inside and not held:
                    if _blank(line):
                        continue
                    kind = RECORD
                    n += 1
                held.append(line)
                if q:
                    inside = inside_after(line, inside)
                if not inside:
                    text = "\n".join(held)
                    row(out, kind, n - 1 if kind == RECORD else n, text[:-1] if text.endswith("\r") else text)
                    held = []
            yield batch(out)
            out = fresh()
        if held:
            row(out, WHOLE if kind == HEAD else OPEN, n - (kind == RECORD), "\n".join(held))
        yield batch(out)

    return lines.mapInArrow(run, "file long, start long, kind int, n long, head boolean, text string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(n, head, text): every record of the files below ``path``; rows are numbered from 0 in file order."""
    lines = physical_lines(spark, path)
    pieces = _pieces(lines, split_starts(lines))
    whole = pieces.where(F.col("kind") == RECORD).select("n", "head", "text")
    cut = pieces.where(F.col("kind") != RECORD)
    # at most two fragments a split; a record's begin opens its group
    group = F.sum((F.col("kind") == OPEN).cast("long")).over(Window.partitionBy("file").orderBy("start", "kind"))
    joined = cut.withColumn("g", group).groupBy("file", "g").agg(
        F.min(F.when(F.col("kind") == OPEN, F.col("n"))).alias("n"), F.max("head").alias("head"),
        F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    return whole.unionByName(joined.select("n", "head", text.alias("text")))


def first_record(spark: SparkSession, path: str) -> str | None:
    """The first record of the first file, from as many lines as it has."""
    files = sorted(physical_lines(spark, path).inputFiles())
    for file in files:
        take = 64
        while True:
            lines = [r["value"] for r in spark.read.option("lineSep", "\n").text(file).limit(take).collect()]
            held, inside = [], False
            for line in lines:
                if not held and _blank(line):
                    continue
                held.append(line)
                inside = inside_after(line, inside)
                if not inside:
                    return "\n".join(held).removesuffix("\r")
            if len(lines) < take:
                break
            take *= 8
        if held:
            return "\n".join(held)
    return None


def header(text: str, delimiter: str = ",") -> list[str]:
    """Column names of a header record: empty ones are numbered, repeated ones get a suffix."""
    out, used = [], set()
    for i, name in enumerate(next(csv.reader([text.removeprefix("\ufeff")], delimiter=delimiter), [])):
        name = name or f"Unnamed: {i}"
        base, k = name, 0
        while name in used:
            k += 1
            name = f"{base}.{k}"
        used.add(name)
        out.append(name)
    return out
