"""Line dedup by a segment-partition edit join. DataFrame functions only.

Lines of at least ``min_chars`` characters that are equal, or within ``edits`` edits of
each other, are one class (chains of links included); of each class the first line in the corpus, by
document id and line number, stays.

Every distinct line of length L is cut into ``edits`` + 1 segments of even length; a line
within that many edits holds one of them unchanged. Segments are indexed under (L,
segment number, text); a line probes the lengths L - edits .. L with those of its
substrings that can face a segment, shifted by no more than the edits on either side of it
allow. Lines under one key are compared by counts of common letters (every edit changes
two of them by one at most), and what is left is verified by a bit-parallel edit automaton on the
band of 2 * edits + 1 diagonals: a word for each number of edits holds the diagonals that
are reachable, and a character moves all of them at once.

Lines are told apart by two 64-bit hashes; texts of lines are only fetched for the
candidates. Shorter lines are left alone, or, from ``equal_chars`` characters on, classed
where they are equal (blank ones aside). A key's lines are never collected in one row.

With ``percent`` the edits grow with the line: of two lines the longer one's length times
``percent`` / 100, rounded down, but 1 at least. Where that is 1, segments are the index as above. Where
it is more, the edits leave a run of ``unchanged_run`` characters, and the index is the texts of fixed
length at anchors (a blank, or the beginning of a blank-free stretch), of which every such
run holds one, under classes of lengths. No line is too long and no link is missed; what
shares a key is verified by Spark's bounded ``levenshtein``.

With ``classes`` the edits grow by steps, (16 characters, 1), (100, 2), (200, 4) in the corpus pipeline: the index and the probes are the
segments above, as many as the longer line's class asks for, equal lines are folded before keys are cut, keys
that no two lines share are dropped before anything else travels with them, and pairs are verified by the automaton. Lines
under a key of many are measured from its hub and meet by the places where they differ from it, not under the key (``class_links``).

Defined results: a null text has no lines and stays; line ends are "\\n", all other
characters count; documents equal in id and text are one document (what is removed from
one is removed from all); null ids come last; an empty table gives no rows; further
columns are carried along. A document all of whose lines (blank ones aside) are removed holds nothing new: ``dedup_lines``
drops it, all other documents stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, materialise, packed, table, unpacked
from .components import components

LETTERS = " etaions"
#: Letters that are counted too where only lines that share keys are concerned.
MORE_LETTERS = ("hrdlucmf", "wypvbgkj", "qxz.,\"'-")
#: Lines under a key of more than so many are measured from hubs, up to so many edits.
HOT = 50
REACH = 32
#: Parts of a hub by which lines that differ from it meet.
PARTS = 64


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``materialise``, whose result replaces the shuffle files that led to it: these are removed as soon as it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return materialise(df, name, compression)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def segments(edits: int, length: Column) -> list[tuple[Column, Column]]:
    """(start from 0, length) of the segments of a line; the last ones are the longer ones."""
    k = edits + 1
    base, longer = F.floor(length / k).cast("int"), (length % k).cast("int")
    out = []
    for i in range(k):
        extra = F.greatest(F.lit(0), longer - (k - i))  # longer segments before this one
        out.append((base * i + extra, base + (F.lit(k - i) <= longer).cast("int")))
    return out


def keys(edits: int, line: Column, n: Column, first: int = 0) -> Column:
    """The index keys (probe: false) and probe keys of a line of ``n`` characters (a
    column, so that it is counted once); a probe that equals the line's own index key is
    left out, as the two index keys meet. Segments are numbered from ``first`` on."""
    def key(length: Column, i: int, start: Column, size: Column) -> Column:
        return F.xxhash64(length, F.lit(first + i), F.substr(line, start + 1, size))

    found = []
    for less in range(edits + 1):
        for i, (start, size) in enumerate(segments(edits, n - less)):
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(low, high + 1):
                own = not less and not shift
                inside = (start + shift >= 0) & (start + shift + size <= n) & (n - less > edits)
                found.append(F.when(inside, F.struct(key(n - less, i, start + shift, size).alias("key"), F.lit(not own).alias("probe"))))
    return F.array_compact(F.array(*found))


def allowed(n: Column, percent: int) -> Column:
    """Edits allowed for a pair of lines, the longer one of ``n`` characters."""
    return F.greatest(F.lit(1), F.floor(n * percent / 100)).cast("int")


def unchanged_run(percent: int) -> int:
    """What k >= 2 edits leave in one piece of the n characters of the longer line: they cut
    n - k characters into k + 1 runs, and n >= 100 k / percent; k = 2 leaves least."""
    return -(-2 * (100 - percent) // (3 * percent))


def scaled_keys(percent: int, line: Column, n: Column) -> Column:
    """Index and probe keys for ``allowed``: two lines within it have a key in common."""
    run = unchanged_run(percent)
    gap = run // 3 + 1  # without a blank in so many characters, the run's first one is an anchor
    size = run - gap + 1
    if not 1 <= percent <= 20:
        raise ValueError("percent must be from 1 to 20")
    anchors = F.regexp_extract_all(line, F.lit(f"(?s)(?=( .{{{size - 1}}}|[^ ]{{{gap}}}.{{{size - gap}}}))"), F.lit(1))
    # lengths of a pair differ by 1 at most on this scale, so both are in one of these classes
    scale = F.log(n.cast("double")) / F.lit(1e-6 - math.log(1 - percent / 100))
    classes = F.array_distinct(F.array(F.floor(scale / 2), F.floor((scale + 1) / 2)))
    texts = F.array_distinct(F.transform(anchors, lambda a: F.xxhash64(a)))
    many = F.flatten(F.transform(classes, lambda c: F.transform(texts, lambda t: F.struct(F.xxhash64(t, c).alias("key"), F.lit(False).alias("probe")))))
    least = -(-200 // percent)  # from here on two edits are allowed
    few = keys(1, line, n)
    return (F.when(n < least - 2, few).when(n >= least, many).otherwise(F.concat(few, many)))


def edits_of(n: Column, classes: tuple[tuple[int, int], ...]) -> Column:
    """Edits allowed for a pair of lines, the longer one of ``n`` characters, by length class."""
    out = F.lit(0)
    for start, edits in classes:
        out = F.when(n >= start, edits).otherwise(out)
    return out


LINES_PER_TASK = 5000
MAX_TASKS = 100_000
AT_ONCE = 4  # keys cut by one expression: larger ones exceed what the JVM compiles


def class_keys(lines: DataFrame, classes: tuple[tuple[int, int], ...]) -> DataFrame:
    """(r, key): index and probe keys for ``edits_of`` of rows (no, n, line); r is twice the line's number ``no``, and one more
    for a probe. The longer line of a pair sets the
    number of segments, so a line just below a class is in that class's index too. Texts are cut as
    UTF-32, in which a character's place is known without counting."""
    out = None
    for c, (start, edits) in enumerate(classes):
        end = classes[c + 1][0] if c + 1 < len(classes) else None
        # the number of characters of a segment, and how many segments are longer by one, by length of the shorter line
        cuts = {f"s{less}": F.expr(f"(n - {less}) div {edits + 1}").cast("int") for less in range(edits + 1)}
        cuts |= {f"r{less}": F.expr(f"(n - {less}) % {edits + 1}").cast("int") for less in range(edits + 1)}
        rows = lines.select("no", "n", F.encode("line", "UTF-32").alias("u"), *[v.alias(k) for k, v in cuts.items()])

        def key(less: int, i: int, shift: int) -> Column:
            begin = F.col(f"s{less}") * i + F.greatest(F.lit(0), F.col(f"r{less}") - (edits + 1 - i)) + shift
            size = F.col(f"s{less}") + F.when(F.col(f"r{less}") >= edits + 1 - i, 1).otherwise(0)
            text = F.substr("u", begin * 4 + 1, size * 4)
            hashed = F.xxhash64(F.lit(1000 * (c + 1) + i), F.col("n") - less, text)
            inside = F.lit(True) if shift == 0 and not less else (begin >= 0) & (begin + size <= F.col("n"))
            return F.when(inside, hashed)

        def cut(some: DataFrame, found: list[Column], probe: int) -> DataFrame:
            return some.select((F.col("no") * 2 + probe).alias("r"), F.explode(F.array(*found)).alias("key")).where("key IS NOT NULL")

        own = F.col("n") >= start if end is None else (F.col("n") >= start) & (F.col("n") < end)
        index = [key(0, i, 0) for i in range(edits + 1)]
        parts = [cut(rows.where(own), index, 0)]
        if c:
            parts.append(cut(rows.where((F.col("n") >= start - edits) & (F.col("n") < start)), index, 0))
        probes = [key(less, i, shift) for less in range(edits + 1) for i in range(edits + 1)
                  for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1) if less or shift]
        for at in range(0, len(probes), AT_ONCE):
            parts.append(cut(rows.where(own), probes[at:at + AT_ONCE], 1))
        for part in parts:
            out = part if out is None else out.union(part)
    return out


def letter_counts(line: Column, letters: str = LETTERS) -> Column:
    """Counts of up to eight letters, a byte for each (at most 255)."""
    total = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        n = F.least(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))), F.lit(255)).cast("long")
        total = total.bitwiseOR(F.shiftleft(n, 8 * i))
    return total


def letters_apart(a: Column, b: Column) -> Column:
    return sum((F.abs(F.shiftrightunsigned(a, 8 * i).bitwiseAND(F.lit(255).cast("long")) -
                      F.shiftrightunsigned(b, 8 * i).bitwiseAND(F.lit(255).cast("long"))) for i in range(len(LETTERS))), F.lit(0).cast("long"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two texts, by steps of halving size."""
    steps = F.array(*[F.lit(1 << i) for i in range(29, -1, -1)])
    most = F.least(F.length(a), F.length(b))

    def step(known: Column, more: Column) -> Column:
        same = (known + more <= most) & (F.substr(a, known + 1, more) == F.substr(b, known + 1, more))
        return F.when(same, known + more).otherwise(known)

    return F.aggregate(steps, F.lit(0), step)


def characters(text: str) -> Column:
    return F.when(F.col(text) == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def trimmed(pairs: DataFrame) -> DataFrame:
    """``a`` and ``b`` without their common beginning and end, which no edit distance needs."""
    pairs = pairs.withColumn("p", common_prefix(F.col("a"), F.col("b")))
    pairs = pairs.withColumns({x: F.reverse(F.substr(x, F.col("p") + 1)) for x in ("a", "b")})
    pairs = pairs.withColumn("p", common_prefix(F.col("a"), F.col("b")))
    return pairs.withColumns({x: F.substr(x, F.col("p") + 1) for x in ("a", "b")}).drop("p")


def within_edits(x: Column, y: Column, edits: int) -> Column:
    """Whether the edit distance of two texts, as columns of arrays of characters, is at most ``edits``."""
    return edits_between(x, y, edits).isNotNull()


def automaton(x: Column, y: Column, edits: int):
    """(start, step) of a bit-parallel edit automaton over ``x``. ``r[d]`` holds in bit i + edits whether d edits lead from the
    characters of ``x`` up to j to those of ``y`` up to j + i; the next character matches where
    the bit of ``equal`` is set. A step yields the new ``r[d]``, from 0 to ``edits``."""
    k, full = edits, (1 << (2 * edits + 1)) - 1

    def bits(v: int) -> Column:
        return F.lit(v).cast("int")

    def step(r: Column, j: Column) -> list[Column]:
        c = F.get(x, j)
        equal = bits(0)
        for i in range(-k, k + 1):
            equal = equal.bitwiseOR(F.when(F.coalesce(F.get(y, j + i) == c, F.lit(False)), 1 << (i + k)).otherwise(0))
        out = [r["r0"].bitwiseAND(equal)]
        for d in range(1, k + 1):
            old, more = r[f"r{d - 1}"], r[f"r{d}"]
            moved = more.bitwiseAND(equal).bitwiseOR(old)  # a match, a replacement
            moved = moved.bitwiseOR(F.shiftright(old, 1))  # a character of a only
            moved = moved.bitwiseOR(F.shiftleft(out[-1], 1).bitwiseAND(bits(full)))  # a character of b only
            out.append(moved)
        return [o.alias(f"r{d}") for d, o in enumerate(out)]

    return [bits(((1 << (d + 1)) - 1) << k).alias(f"r{d}") for d in range(k + 1)], step


def positions(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))


def edits_between(x: Column, y: Column, edits: int) -> Column:
    """The edit distance of two texts, as columns of arrays of characters, if it is at
    most ``edits``, else null."""
    k = edits
    start, step = automaton(x, y, k)
    apart = F.size(y) - F.size(x)
    at = F.greatest(F.least(apart, F.lit(k)), F.lit(-k)) + k

    def alive(r: Column, j: Column) -> Column:
        return F.when(r[f"r{k}"] == 0, r).otherwise(F.struct(*step(r, j)))  # nothing is reachable any more

    def least(end: Column) -> Column:
        return F.coalesce(*[F.when(F.getbit(end[f"r{d}"], at) == 1, d) for d in range(k + 1)])

    return F.when(F.abs(apart) <= k, F.aggregate(positions(x), F.struct(*start), alive, least))


def edits_reach(x: Column, y: Column, edits: int, most: Column) -> Column:
    """How many characters of the beginning of ``x`` are within ``most`` edits (``edits`` at most) of some beginning of ``y``; both are
    columns of arrays of characters. Places beyond the end of ``y`` count as reachable, so that it may be more, never less."""
    start, step = automaton(x, y, edits)

    def known(r: Column) -> Column:  # with the state of the last character
        return r["known"] + F.coalesce(*[F.when(most == d, (r[f"r{d}"] != 0).cast("int")) for d in range(edits + 1)], F.lit(1))

    def alive(r: Column, j: Column) -> Column:
        return F.when(r[f"r{edits}"] == 0, r).otherwise(F.struct(*step(r, j), known(r).alias("known")))

    return F.aggregate(positions(x), F.struct(*start, F.lit(0).alias("known")), alive, lambda r: known(r) - 1)


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, equal_chars: int | None = None) -> DataFrame:
    """``id``, ``th`` (hash of the text), ``pos``, ``line`` and its hashes, for lines that are
    long enough; shorter ones from ``equal_chars`` on too, if they are not blank."""
    text = col(text_col)
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    enough = F.col("n") >= min_chars
    if equal_chars is not None:
        enough = enough | ((F.col("n") >= equal_chars) & (F.trim(F.col("line"), F.lit(" \t\r")) != ""))
    rows = rows.withColumn("n", F.length("line")).where(enough)
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def line_links(distinct: DataFrame, lines: DataFrame, edits: int, percent: int | None = None,
               classes: tuple[tuple[int, int], ...] | None = None) -> DataFrame:
    """Links between distinct lines: (a1, a2, b1, b2), the hashes of two lines within
    ``edits`` edits, those ``allowed`` by ``percent`` or those of their length class. ``distinct``: h1, h2, letters, keys and, for
    ``percent``, the length n; ``lines``: h1, h2, line, n. For classes ``lines`` alone is used and has the line's number ``no`` too."""
    if classes:
        return class_links(lines, classes)
    if percent is None:
        rows = distinct.select("h1", "h2", "letters", F.lit(0).alias("n"), F.explode("keys").alias("k"))
        rows = rows.select("h1", "h2", "letters", "n", "k.key", "k.probe")
    else:
        # many keys, few of them shared: these are found by hashes alone and written first
        key = Window.partitionBy("key")
        rows = distinct.select("h1", F.explode("keys").alias("k")).select("h1", "k.key", "k.probe")
        rows = rows.withColumn("c", F.count(F.lit(1)).over(key)).withColumn("i", F.count_if(~F.col("probe")).over(key))
        rows = materialise(rows.where("c > 1 AND i > 0").drop("c", "i"), "line-keys").join(distinct.select("h1", "h2", "letters", "n"), "h1")
    a = rows.where("NOT probe").select("key", F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("letters").alias("af"), F.col("n").alias("an"))
    b = rows.select("key", F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("letters").alias("bf"), F.col("n").alias("bn"), "probe")
    longer = F.greatest("an", "bn")
    most = F.lit(edits) if percent is None else allowed(longer, percent)
    differ = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    once = F.col("probe") | (F.col("a1") < F.col("b1")) | ((F.col("a1") == F.col("b1")) & (F.col("a2") < F.col("b2")))
    near = a.join(b, (a["key"] == b["key"]) & differ & once & (letters_apart(F.col("af"), F.col("bf")) <= 2 * most)
                  & (F.abs(F.col("an") - F.col("bn")) <= most))
    near = near.select("a1", "a2", "b1", "b2")
    pairs = materialise(near.distinct(), "line-candidates")
    needed = pairs.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(pairs.select("b1", "b2")).distinct()
    # the candidates grow with the corpus, so this is a sort-merge join at every size
    texts = lines.select("h1", "h2", "line").join(needed.hint("merge"), ["h1", "h2"], "left_semi")
    texts = materialise(texts.groupBy("h1", "h2").agg(F.first("line").alias("line")), "line-texts")
    known = pairs.join(texts.toDF("a1", "a2", "a"), ["a1", "a2"]).join(texts.toDF("b1", "b2", "b"), ["b1", "b2"])
    # little data but much work: tasks of about a thousand pairs
    known = known.repartition(-(-pairs.count() // 1000) or 1, "a1", "b1")
    if percent is not None:
        known = known.withColumn("most", allowed(F.greatest(F.length("a"), F.length("b")), percent))
        known = materialise(trimmed(known), "line-pairs")
        return known.where("levenshtein(a, b, most) >= 0").select("a1", "a2", "b1", "b2")
    return verified(known.withColumn("most", F.lit(edits)), edits)


def verified(known: DataFrame, edits: int) -> DataFrame:
    """(a1, a2, b1, b2) of the pairs of texts ``a`` and ``b`` within ``most`` edits, ``edits`` at most."""
    known = trimmed(known).select("a1", "a2", "b1", "b2", "most", characters("a").alias("a"), characters("b").alias("b"))
    # written first: else the planner moves the filter below and cuts the texts anew at each step
    known = written(known, "line-pairs")
    return known.where(edits_between(F.col("a"), F.col("b"), edits) <= F.col("most")).select("a1", "a2", "b1", "b2")


def measured(pairs: DataFrame, texts: DataFrame, classes: tuple[tuple[int, int], ...], reach: int) -> DataFrame:
    """Pairs of line numbers with ``away``, their edit distance (``reach`` + 1 if it is more than ``reach``), and ``near``, whether
    the two are linked; ``xn``, ``xl``, ``yn`` and ``yl`` are lengths and texts."""
    x, y = pairs.columns
    known = pairs.join(texts.select(F.col("no").alias(x), F.col("n").alias("xn"), F.col("line").alias("xl")), x)
    known = known.join(texts.select(F.col("no").alias(y), F.col("n").alias("yn"), F.col("line").alias("yl")), y)
    away = F.expr(f"levenshtein(xl, yl, {reach})")
    known = known.repartition(-(-pairs.count() // 1000) or 1, x, y).withColumn("away", F.when(away < 0, reach + 1).otherwise(away))
    return known.withColumn("near", F.col("away") <= edits_of(F.greatest("xn", "yn"), classes))


def key_hubs(hot: DataFrame, texts: DataFrame, classes: tuple[tuple[int, int], ...]) -> DataFrame:
    """(key, hub) of the keys of rows (no, key). As hubs serve the lines that have most links to the next line under each of their
    keys, in an order by hash; a line takes the best one under its keys, a key the best one that its lines have taken."""
    following = Window.partitionBy("key").orderBy(F.xxhash64("no", "key"))
    most = max(k for _, k in classes)
    rows = hot.join(texts.select("no", "n", "letters0"), "no").select("*", F.lead(F.struct("no", "n", "letters0")).over(following).alias("next"))
    rows = rows.where((letters_apart(F.col("letters0"), F.col("next.letters0")) <= 2 * most) & (F.abs(F.col("n") - F.col("next.n")) <= most))
    some = rows.select(F.least("no", "next.no").alias("no"), F.greatest("no", "next.no").alias("other")).where("no <> other").distinct()
    linked = measured(written(some, "line-some"), texts, classes, most).where("near").select(F.explode(F.array("no", "other")).alias("no"))
    weights = written(linked.groupBy("no").agg(F.count(F.lit(1)).alias("w")), "line-weights")
    best = hot.join(weights, "no", "left").select("key", F.struct(F.coalesce("w", F.lit(0)).alias("w"), F.col("no").alias("hub")).alias("best"))
    best = hot.join(best.groupBy("key").agg(F.max("best").alias("best")), "key")
    best = hot.join(written(best.groupBy("no").agg(F.max("best").alias("best")), "line-hubs"), "no")
    return written(best.groupBy("key").agg(F.max("best").alias("best")).select("key", "best.hub"), "key-hubs")


def hub_places(spokes: DataFrame, texts: DataFrame, classes: tuple[tuple[int, int], ...]) -> DataFrame:
    """(no, hub, away, near, low, high, first, last) of rows (no, hub). ``away`` is the edit distance from the hub, ``REACH`` + 1 if it is
    more than ``REACH``, and ``near`` whether the two are linked. The rest are places in the hub's text: the line holds what is before
    ``low`` and from ``high`` on unchanged, and ``last`` (``first``) is how far the hub's text can be followed from its beginning (its end) within the
    edits that any partner of the line allows."""
    most = max(k for _, k in classes)
    known = written(measured(spokes, texts, classes, REACH).withColumn("most", edits_of(F.col("xn") + most, classes)), "line-distances")
    close = known.where(F.col("away") <= REACH)
    close = close.withColumn("low", common_prefix(F.col("xl"), F.col("yl"))).withColumns({x: F.reverse(x) for x in ("xl", "yl")})
    close = close.withColumn("same", common_prefix(F.col("xl"), F.col("yl")))
    rest = {"x1": F.reverse(F.expr("left(xl, xn - low)")), "y1": F.reverse(F.expr("left(yl, yn - low)")),
            "x2": F.expr("substr(xl, same + 1)"), "y2": F.expr("substr(yl, same + 1)")}
    apart = F.col("away") > F.col("most")
    close = close.withColumns({x: F.when(apart, v).otherwise("") for x, v in rest.items()})
    # written first, as in ``verified``
    close = written(close.select("no", "hub", "away", "near", "most", "yn", "low", "same", *[characters(x).alias(x) for x in rest]), "line-spoke-texts")
    onward = edits_reach(F.col("y1"), F.col("x1"), most, F.col("most"))
    back = edits_reach(F.col("y2"), F.col("x2"), most, F.col("most"))
    apart = F.col("away") > F.col("most")
    close = close.select("no", "hub", "away", "near", "yn", "low", (F.col("yn") - F.col("same")).alias("high"),
                         F.when(apart, F.col("yn") - F.col("same") - back).otherwise(0).alias("first"),
                         F.when(apart, F.col("low") + onward).otherwise(F.col("yn")).alias("last"))
    far = known.where(F.col("away") > REACH).select("no", "hub", "away", "near", "yn", *[F.lit(None).cast("int").alias(c) for c in ("low", "high", "first", "last")])
    return written(close.union(far), "line-places")


def hub_pairs(places: DataFrame, facts: DataFrame, may: Column, all_links: bool) -> DataFrame:
    """(a_no, b_no) of lines of one hub that may be linked, ``may`` aside from what the hub tells: their distances from it (triangle
    inequality) and where they differ from it. If b is within its edits of a, then what a leaves unchanged of the hub's
    beginning can be followed in b: b's ``last`` is not before a's ``low``, and so with the end, ``first`` and ``high``. So a's
    ``low`` .. ``high`` and b's ``first`` .. ``last`` have a place in common (``last``, if that is before ``first``) and the lines meet under its part."""
    rows = places.where(F.col("away") <= REACH).join(facts, "no")

    def parts(low: str, high: str) -> Column:
        return F.explode(F.sequence(*[F.expr(f"cast(({x} * {PARTS}L) div (yn + 1) as int)") for x in (low, high)]))

    names = [c for c in rows.columns if c != "hub"]
    a = rows.select("*", parts("low", "greatest(low, high)").alias("part")).select("hub", "part", *[F.col(c).alias("a_" + c) for c in names])
    b = rows if all_links else rows.where("NOT near")
    b = b.select("*", parts("least(first, last)", "last").alias("part"))
    b = b.select(F.col("hub").alias("b_hub"), F.col("part").alias("b_part"), *[F.col(c).alias("b_" + c) for c in names])
    meet = (F.col("hub") == F.col("b_hub")) & (F.col("part") == F.col("b_part")) & (F.col("a_no") != F.col("b_no"))
    places_meet = F.expr("a_low <= b_last AND a_high >= b_first AND b_low <= a_last AND b_high >= a_first")
    return a.join(b, meet & places_meet & may).select("a_no", "b_no")


def class_links(lines: DataFrame, classes: tuple[tuple[int, int], ...], all_links: bool = True) -> DataFrame:
    """``line_links`` of rows (no, h1, h2, n, line) for ``classes``. Without ``all_links`` those between two lines that are both
    linked to one hub may be missing, which leaves the classes as they are.

    A key of more than ``HOT`` lines has a hub, from which they are measured. Those within ``REACH`` meet by places (``hub_pairs``); under the
    key remain the others and those that are near enough to ``REACH`` to be linked to them."""
    # many keys, few of them shared: these are found by hashes alone and written first
    key = Window.partitionBy("key")
    # so many partitions that a task sorts some hundred thousand keys
    rows = class_keys(lines, classes).repartition(min(-(-lines.count() // LINES_PER_TASK) or 1, MAX_TASKS), "key")
    rows = rows.withColumn("c", F.count(F.lit(1)).over(key)).withColumn("i", F.count_if(F.col("r") % 2 == 0).over(key))
    rows = written(rows.where("c > 1 AND i > 0").select(F.expr("r div 2").alias("no"), "key", (F.col("r") % 2 == 1).alias("probe"), "c"), "line-keys")
    # texts of the lines that share keys; their number grows with the corpus, so this is a sort-merge join at every size
    texts = lines.select("no", "h1", "h2", "n", "line").join(rows.select("no").distinct().hint("merge"), "no", "left_semi")
    counts = [f"letters{i}" for i in range(1 + len(MORE_LETTERS))]
    texts = texts.withColumns({c: letter_counts(F.col("line"), x) for c, x in zip(counts, (LETTERS, *MORE_LETTERS), strict=True)})
    texts = written(texts, "line-texts", "zstd")
    hot = rows.where(F.col("c") > HOT).drop("c")
    hubs = key_hubs(hot.select("no", "key"), texts, classes)
    places = hub_places(written(hot.join(hubs, "key").select("no", "hub").distinct(), "line-spokes"), texts, classes)
    outer = places.where(F.col("away") > REACH - max(k for _, k in classes)).select("no", "hub")
    outer = written(hot.join(hubs, "key").join(outer, ["no", "hub"], "left_semi").select("no", "key", "probe"), "line-outer")
    facts = texts.select("no", "n", *counts)
    # one of the hubs that the line is linked to
    home = places.where("near").groupBy("no").agg(F.min("hub").alias("home"))
    rows = rows.where(F.col("c") <= HOT).select("no", "key", "probe").union(outer).join(facts.join(home, "no", "left"), "no")
    a = rows.where("NOT probe").select("key", *[F.col(c).alias("a_" + c) for c in ("no", "n", "home", *counts)])
    b = rows.select(F.col("key").alias("b_key"), "probe", *[F.col(c).alias("b_" + c) for c in ("no", "n", "home", *counts)])
    most = edits_of(F.greatest("a_n", "b_n"), classes)
    once = (F.col("a_no") != F.col("b_no")) & (F.col("probe") | (F.col("a_no") < F.col("b_no")))
    longer = F.abs(F.col("a_n") - F.col("b_n"))
    # an edit that makes a line longer changes the count of one letter, any other edit those of two at most
    may = (longer <= most) & (sum((letters_apart(F.col("a_" + c), F.col("b_" + c)) for c in counts), longer) <= 2 * most)
    new = F.lit(True) if all_links else ~F.coalesce(F.col("a_home") == F.col("b_home"), F.lit(False))
    pairs = a.join(b, (F.col("key") == F.col("b_key")) & once & may & new).select("a_no", "b_no")
    pairs = pairs.union(hub_pairs(places, facts, may & (F.abs(F.col("a_away") - F.col("b_away")) <= most), all_links))
    if not all_links:  # the links to the hubs, which stand for those left out
        pairs = pairs.union(places.where("near AND no <> hub").select("no", "hub"))
    # two lines of one length may meet as index and probe either way round
    pairs = written(pairs.select(F.least("a_no", "b_no").alias("a_no"), F.greatest("a_no", "b_no").alias("b_no")).distinct(), "line-candidates")
    known = pairs.join(texts.select("no", "h1", "h2", "line").toDF("a_no", "a1", "a2", "a"), "a_no")
    known = known.join(texts.select("no", "h1", "h2", "line").toDF("b_no", "b1", "b2", "b"), "b_no").drop("a_no", "b_no")
    # little data but much work: tasks of about a thousand pairs
    known = known.repartition(-(-pairs.count() // 1000) or 1, "a1", "b1")
    known = known.withColumn("most", edits_of(F.greatest(F.length("a"), F.length("b")), classes))
    return verified(known, max(k for _, k in classes))


def repeated_lines(docs: DataFrame, edits: int = 1, min_chars: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   percent: int | None = None, equal_chars: int | None = None,
                   classes: tuple[tuple[int, int], ...] | None = None, all_links: bool = True) -> DataFrame:
    """A row for each document (id and ``th``) that holds lines linked or equal to others:
    ``removed``, the numbers (from 0) of its lines that are not the first of their class, and ``links``, the
    number of links of its lines to lines that differ from them. With ``percent`` the edits
    grow with the lines (``allowed``), with ``classes`` ((length from, edits), ascending; the first length is
    ``min_chars``) by steps, and ``edits`` is not used; with ``equal_chars``
    lines shorter than ``min_chars`` count where they are equal. Without ``all_links`` (for ``classes``) links that the
    classes of lines do not need may be left out of ``links``."""
    if classes:
        min_chars = classes[0][0]
    lines = _lines(docs, id_col, text_col, min_chars, equal_chars)
    here = F.struct(F.col("id").isNull().alias("none"), "id", "pos", "th")
    near = F.col("n") >= min_chars
    letters = letter_counts(F.col("line")).alias("letters")
    common = [F.min("at").alias("at"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n")]
    if percent is None and classes is None:
        index = F.when(near, keys(edits, F.col("line"), F.col("n")))
        facts = lines.select("h1", "h2", here.alias("at"), "n", letters, index.alias("keys"))
        distinct = facts.groupBy("h1", "h2").agg(*common, F.first("letters").alias("letters"), F.first("keys").alias("keys"))
        distinct = materialise(distinct, "line-facts")
        links = line_links(distinct.where(near), lines.where(near), edits)
    else:
        # here the keys are larger than the line, so they are cut after equal lines are folded
        facts = lines.select("h1", "h2", here.alias("at"), "n", "line")
        distinct = facts.groupBy("h1", "h2").agg(*common, F.first("line").alias("line"))
        distinct = written(distinct.withColumn("no", F.monotonically_increasing_id()), "line-facts", "zstd")
        once = distinct.where(near)
        if classes:
            links = class_links(once, classes, all_links)
        else:
            links = line_links(once.select("h1", "h2", "n", letters, scaled_keys(percent, F.col("line"), F.col("n")).alias("keys")), once, edits, percent)
    links = written(links, "line-links")
    # numbers for the linked lines, then classes
    ends = links.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).union(links.select("b1", "b2"))
    nodes = materialise(ends.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("links")).withColumn(
        "node", F.monotonically_increasing_id()), "line-nodes")
    names = nodes.select("h1", "h2", "node")
    edges = links.join(names.toDF("a1", "a2", "a"), ["a1", "a2"]).join(names.toDF("b1", "b2", "b"), ["b1", "b2"]).select("a", "b")
    labelled = nodes.join(components(edges), "node").select("h1", "h2", "links", "label")
    some = distinct.select("h1", "h2", "at", "rows").join(labelled, ["h1", "h2"], "left").where("rows > 1 OR label IS NOT NULL")
    some = written(some, "line-classes")
    first = some.where("label IS NOT NULL").groupBy("label").agg(F.min("at").alias("first"))
    classes = some.join(first, "label", "left").select("h1", "h2", F.coalesce("first", "at").alias("first"), F.coalesce("links", F.lit(0)).alias("links"))
    found = lines.select("id", "th", "pos", "h1", "h2").join(classes, ["h1", "h2"])
    again = here != F.col("first")
    return found.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.when(again, F.col("pos")))).alias("removed"),
                                         F.sum("links").alias("links"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without their repeated lines, with the input's columns."""
    found = repeated_lines(docs, id_col=id_col, text_col=text_col, all_links=False, **options).select(
        F.col("id").alias("rid"), F.col("th").alias("rth"), "removed").where(F.size("removed") > 0)
    text = F.col("row").getField(text_col)
    rows = packed(docs, id=col(id_col), th=F.xxhash64(col(text_col)))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("removed", i))
    out = out.withColumn("left", F.when(F.col("removed").isNull(), text).otherwise(F.array_join(left, "\n")))
    out = out.where(F.col("removed").isNull() | (F.trim(F.col("left"), F.lit(" \t\r\n")) != ""))
    return unpacked(out.withColumn("row", F.col("row").withField("`" + text_col.replace("`", "``") + "`", F.col("left"))), docs.columns)


#: Edits in a hundred characters that leave two lines near-equal (an option beside the classes).
PERCENT = 3
#: (characters of the longer line from, edits that leave two lines near-equal), in the corpus pipeline.
CLASSES = ((16, 1), (100, 2), (200, 4))
#: Equal lines are one class there from this length on.
EQUAL_CHARS = 1


def line_report(docs: DataFrame, **options) -> DataFrame:
    found = repeated_lines(docs, **options).select(F.col("id").alias("rid"), F.col("th").alias("rth"), "removed", "links")
    base = docs.select("doc_id", F.xxhash64("text").alias("th"),
                       F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")), "left")
    numbers = F.array_join(F.col("removed").cast("array<string>"), ",")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(numbers, F.lit("")).alias("removed_lines"))


def op9(spark, sf_dir: str) -> DataFrame:
    """The rule of ``OP9_SQL``: one edit at every length."""
    return line_report(table(spark, sf_dir, "documents"))


def op9_whole(spark, sf_dir: str) -> DataFrame:
    """The rule of the corpus pipeline, which has no SQL."""
    return line_report(table(spark, sf_dir, "documents"), classes=CLASSES, equal_chars=EQUAL_CHARS)


OP9_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, pos - 1 AS pos, ls[pos] AS line FROM (
    SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) t),
x AS (SELECT line, length(line) AS n FROM l WHERE length(line) >= 16 GROUP BY line),
-- one edit at most: the first halves or the last halves (half of the shorter length) are equal
h AS (SELECT line, n, n AS m FROM x UNION ALL SELECT line, n, n - 1 FROM x),
c AS (SELECT a.line AS a, b.line AS b FROM x a JOIN h b ON a.n = b.m AND left(a.line, a.n // 2) = left(b.line, b.m // 2) WHERE a.line <> b.line
      UNION SELECT a.line, b.line FROM x a JOIN h b ON a.n = b.m AND right(a.line, a.n - a.n // 2) = right(b.line, b.m - b.m // 2) WHERE a.line <> b.line),
e AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM c UNION ALL SELECT b, a FROM c) WHERE levenshtein(a, b) <= 1),
r AS (SELECT line AS node, line AS reach FROM x WHERE line IN (SELECT a FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
f AS (SELECT line, min((doc_id, pos)) AS first FROM l WHERE length(line) >= 16 GROUP BY line),
k AS (SELECT r.node AS line, min(f.first) AS first FROM r JOIN f ON f.line = r.reach GROUP BY 1),
g AS (SELECT a AS line, count(*) AS links FROM e GROUP BY 1),
o AS (SELECT l.doc_id, l.pos, coalesce(k.first, f.first) <> (l.doc_id, l.pos) AS again, coalesce(g.links, 0) AS links
      FROM l JOIN f USING (line) LEFT JOIN k USING (line) LEFT JOIN g USING (line)),
s AS (SELECT doc_id, CAST(sum(CASE WHEN again THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, CAST(sum(links) AS BIGINT) AS n_links,
             string_agg(CASE WHEN again THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos) AS removed_lines FROM o GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_links, 0) AS n_links, coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN s USING (doc_id)
"""
