"""Line dedup by a segment-partition edit join, in DataFrame functions only.

For t edits a line is split into t + 1 segments; a line within t edits, of the same length or up to t longer, must
have one of them unchanged, shifted by at most what the edits before and after it allow. So every line is indexed by
(length, segment number, segment) and probes the index of its own length and of the t lengths below at these shifts.
Where an index entry has more than ``CROWDED`` lines, the pairs are not taken from it: for one edit, what is left of its lines
is split into segments again, and again while entries stay crowded; for more edits, ``crowded_lines`` finds the pairs.
Candidates are verified with Spark's banded edit distance.

Joins that carry texts are merge joins at every size, so that their cost in a small run tells that of a large one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.crowded_lines import crowded_pairs
from panelweave.llm.tables import fresh, stage

CROWDED = 32
#: (length, edits): lines from this length on may differ by so many edits.
TAU = ((0, 1),)


def dedup_lines(docs: DataFrame, shortest: int = 32, tau: tuple[tuple[int, int], ...] = TAU, exact: int | None = None) -> DataFrame:
    """All columns of ``docs`` with repeated lines taken out of ``text``, and ``n_lines`` and ``n_removed``.

    Lines end at line feeds and are compared without outer white space. Those of at least ``shortest`` characters are
    compared by edit distance, those of at least ``exact`` (by default ``shortest``) for equality; blank and shorter ones stay.
    An occurrence goes if the same line, or one within the edits that ``tau`` gives for the shorter of both, occurs earlier in
    the table: in order of doc_id (null first), the text's hash and the line number. What is left of a text keeps its line
    feeds. Null texts stay null with no lines, an empty text has one line; rows with equal doc_id and text are one document
    and get the same result; other columns are handed through, ``n_lines`` and ``n_removed`` replaced.
    """
    spare = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    where = removed_lines(docs, shortest, tau, exact)
    doc, version, gone = fresh(docs.columns, "_doc", "_version", "_gone")
    lost = where.groupBy("_doc", "_version").agg(F.collect_set("_line").alias("_gone")).toDF(doc, version, gone)
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(version))
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    both = docs.select(*spare).join(lost.hint("merge"), own, "left")
    return both.select(
        *[c for c in spare if c != "text"],
        F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
    )


def _edits(length: Column, tau: tuple[tuple[int, int], ...]) -> Column:
    return reduce(lambda found, step: F.when(length >= step[0], step[1]).otherwise(found), sorted(tau), F.lit(0))


def _windows(edits: int) -> list[tuple[int, int, int]]:
    """(extra, segment, shift): where a line ``extra`` longer than an indexed one may hold its segment."""
    places = range(edits + 1)
    return [(d, i, s) for d in places for i in places for s in range(max(-i, d - edits + i), min(i, d + edits - i) + 1)]


def _plan(edits: set[int]) -> Column:
    names = ("t", "d", "i", "s")
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, (t, *w), strict=True)]) for t in sorted(edits) for w in _windows(t)])


def _segment(size: Column, p: Column) -> tuple[Column, Column]:
    """First character, from 0, and length of segment p.i of an indexed text of ``size``, in a text that holds it shifted by p.s."""
    cut = lambda i: (size * i / (p["t"] + 1)).cast("int")
    return cut(p["i"]) + p["s"], cut(p["i"] + 1) - cut(p["i"])


def _without(text: Column, start: Column, size: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), F.substring(text, start + size + 1, F.char_length(text)))


def removed_lines(docs: DataFrame, shortest: int = 32, tau: tuple[tuple[int, int], ...] = TAU, exact: int | None = None) -> DataFrame:
    """(_doc, _version, _line): the line occurrences that repeat an earlier one."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_version"), "text")
    every = texts.select("_doc", "_version", F.posexplode(F.split("text", "\n", -1)).alias("_line", "line"))
    every = every.withColumn("line", F.trim(F.col("line"), F.lit(" \t\r\v\f"))).where(F.char_length("line") >= max(1, min(shortest, shortest if exact is None else exact)))
    every = every.withColumn("name", F.xxhash64("line"))
    lines = stage(every.select("_doc", "_version", "_line", "name"), "lines")
    first = F.min(F.struct("_doc", "_version", "_line")).alias("first")
    long = F.when(F.char_length("line") >= shortest, F.col("line"))
    kinds = stage(every.groupBy("name").agg(first, F.count("*").alias("times"), F.first(long).alias("line"), F.first(F.char_length(long)).alias("length")), "kinds")

    # An entry without shift or extra characters stands in the index and probes it, the others only probe.
    edits = {t for _, t in tau}
    length = F.col("length")
    fitting = F.filter(_plan(edits), lambda p: _edits(length - p["d"], tau) == p["t"])

    def entry(p: Column) -> Column:
        size = length - p["d"]
        start, wide = _segment(size, p)
        return F.struct(F.xxhash64(size, p["i"], F.substring("line", start + 1, wide)).alias("key"), p.alias("p"))

    entries = kinds.where("line is not null").select("name", F.explode(F.transform(fitting, entry)).alias("e"))
    entries = entries.select("e.key", "name", "e.p", (F.col("e.p.d") + F.abs("e.p.s") > 0).alias("probe"))
    chosen = stage(entries.join(_met(entries), "key"), "chosen")
    wanted = chosen.select("name").distinct()
    text = kinds.select("name", "line", "length").join(wanted.hint("merge"), "name", "left_semi")
    text = stage(text.withColumn("sketch", _sketch(F.col("line")) if max(edits) > 1 else F.lit(0).cast("long")), "texts")

    pairs = _pairs(chosen.where("not crowded").select("key", "name", "probe", "p.d"))
    rest = _without(F.col("line"), *_segment(length - F.col("p.d"), F.col("p")))
    crowded = chosen.where("crowded and p.t <= 1").join(text.hint("merge"), "name").select("key", "name", "probe", "p.t", "p.d", rest.alias("rest")).withColumn("size", F.char_length("rest") - F.col("d"))
    pairs = reduce(DataFrame.unionByName, _finer_pairs(crowded, edits & {0, 1}) if edits & {0, 1} else [], pairs)
    more, linked = edits - {0, 1}, None
    if more:
        others, linked = crowded_pairs(chosen.where("crowded and p.t > 1").select("key", "name", "probe", "p.t", "p.d"), text, kinds.select("name", "first"), more)
        pairs = pairs.unionByName(others)
    pairs = pairs.distinct()
    left = text.select(F.col("name").alias("a"), F.col("line").alias("line_a"), F.col("length").alias("length_a"))
    right = text.select(F.col("name").alias("b"), F.col("line").alias("line_b"), F.col("length").alias("length_b"))
    allowed = _edits(F.least("length_a", "length_b"), tau)
    near = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.call_function("levenshtein", F.col("line_a"), F.col("line_b"), allowed) >= 0)
    links = stage(near.select("a", "b"), "links")

    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = kinds.select(F.col("name").alias("b"), F.col("first").alias("other"))
    found = both.join(other, "b").select("a", "other")
    earliest = (found.unionByName(linked) if linked else found).groupBy("a").agg(F.min("other").alias("other"))
    repeated = kinds.drop("line", "length").join(earliest, kinds["name"] == earliest["a"], "left").where("times > 1 or a is not null")
    earliest = stage(repeated.select("name", F.least("first", F.coalesce("other", "first")).alias("first")), "earliest")
    spots = lines.select("_doc", "_version", "_line", "name").join(earliest.hint("merge"), "name")
    return spots.where(F.struct("_doc", "_version", "_line") > F.col("first")).select("_doc", "_version", "_line")


def _met(entries: DataFrame) -> DataFrame:
    """(key, crowded) of the keys that an indexed line shares with another entry. Written."""
    indexed = F.sum((~F.col("probe")).cast("long"))
    met = entries.groupBy("key").agg(indexed.alias("indexed"), F.count("*").alias("all")).where("indexed > 0 and all > 1")
    return stage(met.select("key", (F.col("all") > CROWDED).alias("crowded")), "met")


def _finer_pairs(crowded: DataFrame, edits: set[int]) -> list[DataFrame]:
    """Pairs of crowded entries (key, name, probe, t, d, rest, size), whose rests are split until entries are not crowded; for one edit."""
    crowded = stage(crowded, "crowded")
    pairs = []
    size = F.col("size")
    while True:
        if crowded.isEmpty():
            return pairs
        fitting = F.filter(_plan(edits), lambda p: (p["t"] == F.col("t")) & (p["d"] == F.col("d")))

        def entry(p: Column) -> Column:
            start, wide = _segment(size, p)
            key = F.xxhash64("key", p["i"], F.substring("rest", start + 1, wide))
            return F.struct(key.alias("key"), (F.col("probe") | (p["s"] != 0)).alias("probe"), _without(F.col("rest"), start, wide).alias("rest"), (size - wide).alias("size"))

        finer = crowded.select("name", "t", "d", F.explode(F.transform(fitting, entry)).alias("e")).select("e.*", "name", "t", "d")
        finer = stage(finer.join(_met(finer), "key"), "finer")
        # All entries of a key have the same t and the same indexed length of the rest.
        again = F.col("crowded") & (size > F.col("t"))
        pairs.append(_pairs(finer.where(~again).select("key", "name", "probe", "d")))
        crowded = finer.where(again).drop("crowded")


def _sketch(line: Column) -> Column:
    """64 bits, each telling whether an odd number of the line's pairs of neighbouring characters falls on it.

    An edit takes away two such pairs at most and adds two, so lines within t edits differ in 4 * t bits at most.
    """
    chars = F.split(line, "")
    bit = lambda a, b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(a, b), F.lit(64)).cast("int"))
    return F.aggregate(F.zip_with(chars, F.slice(chars, 2, F.size(chars)), bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _pairs(entries: DataFrame) -> DataFrame:
    """(a, b) of an indexed line and one that finds it, pairs of equal length once."""
    left = entries.where("not probe").select("key", F.col("name").alias("a"))
    right = entries.select("key", F.col("name").alias("b"), "d")
    return left.join(right, [left["key"] == right["key"], F.expr("a <> b and (d > 0 or a < b)")]).select("a", "b")
