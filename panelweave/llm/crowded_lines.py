"""Links among lines that share a crowded segment, without comparing all of them, in DataFrame functions only.

Lines of such a group are mostly edits of one line. Each is held by what its distinct ``GRAM``-grams deviate from those
that most of a few lines of the group have. Two lines within t edits differ in at most 2 * GRAM * t of them, so either
their deviations are no more than that together (light pairs), or they share deviations: these pairs come from a prefix
join over deviations, additions first. Light pairs are told by the place where they leave one line of the group, its centre:

* where both are within t edits by way of the centre, they are linked: a minimum for each distance says all that is needed;
* where the places are apart, a line cannot undo at one what the other does elsewhere: the edits, each with free ends,
  add up, and only pairs with at most t of them are kept;
* else both places meet in a cell of the centre, and the edits to the centre differ by t at most.

Whatever lines are chosen, no link is lost; the choice only decides how many pairs are left to verify.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.tables import attach_spread, stage

GRAM = 4
#: Lines of a group whose grams vote.
VOTES = 5
#: Characters of the centre that a place takes along on both sides, and the width of a cell.
MARGIN = 8
CELL = 8
#: Edits from the centre up to which they are counted.
FAR = 32


def _grams(line: Column) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.char_length(line) - GRAM + 1), lambda i: F.hash(F.substring(line, i, F.lit(GRAM))))
    return F.when(F.char_length(line) >= GRAM, F.array_distinct(each)).otherwise(F.array().cast("array<int>"))


def _common_start(x: Column, y: Column, most: Column, powers: int = 20) -> Column:
    """Characters, at most ``most``, that both texts begin with; by halving, so the same for lines up to 2 ** powers."""

    def longer(found: Column, step: Column) -> Column:
        return F.when((found + step <= most) & (F.substring(x, F.lit(1), found + step) == F.substring(y, F.lit(1), found + step)), found + step).otherwise(found)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(powers))]), F.lit(0), longer)


def _free_edits(line: Column, centre: Column, start: Column, end: Column, own_end: Column, edits: int) -> Column:
    """Least edits between the line's place with its margins and the centre's, whose ends move by up to ``edits``; edits + 1 if more."""
    at, until = F.greatest(start - MARGIN, F.lit(0)), F.least(end + MARGIN, F.char_length(centre))
    piece = F.substring(line, at + 1, own_end + (until - end) - at)
    moves = F.array(*[F.lit(i) for i in range(-edits, edits + 1)])

    def distance(i: Column, j: Column) -> Column:
        first = F.greatest(at + i, F.lit(0))
        found = F.call_function("levenshtein", piece, F.substring(centre, first + 1, F.greatest(until + j - first, F.lit(0))), F.lit(edits))
        return F.when(found >= 0, found).otherwise(edits + 1)

    return F.array_min(F.transform(moves, lambda i: F.array_min(F.transform(moves, lambda j: distance(i, j)))))


def _by_edits(edits: set[int], value) -> Column:  # noqa: ANN001
    """``value(t)`` of the row's own t."""
    return reduce(lambda found, t: F.when(F.col("t") == t, value(t)).otherwise(found), sorted(edits), F.lit(None))


def crowded_pairs(crowded: DataFrame, text: DataFrame, first: DataFrame, edits: set[int]) -> tuple[DataFrame, DataFrame]:
    """(a, b), pairs of lines to verify, and (a, other), the least ``first`` of lines that a is linked to by way of a centre.

    ``crowded`` has (key, name, probe, t, d), ``text`` (name, line, sketch) and ``first`` (name, first). Of a pair at least one is no probe.
    """
    members = crowded.groupBy("key", "name").agg(F.min("probe").alias("probe"), F.first("t").alias("t"), F.first("d").alias("d"))
    members = stage(members, "members")
    lines = members.select("name").distinct().join(text.hint("merge"), "name").select("name", "line", "sketch", _grams(F.col("line")).alias("grams"))
    lines = stage(lines, "grams")

    picks = F.array(*[F.min_by("name", F.xxhash64("name", F.lit(i))) for i in range(VOTES)])
    voters = members.groupBy("key").agg(picks.alias("voters"), F.count("*").alias("rows")).select("key", "rows", F.explode("voters").alias("name"))
    votes = voters.join(lines.select("name", "grams").hint("merge"), "name").groupBy("key").agg(F.first("rows").alias("rows"), F.sort_array(F.flatten(F.collect_list("grams"))).alias("all"))
    later = F.slice(F.col("all"), VOTES // 2 + 1, F.size("all"))
    usual = F.array_distinct(F.filter(F.zip_with(later, "all", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()))
    usual = stage(votes.select("key", "rows", usual.alias("usual")), "usual")
    own = stage(members.join(lines.drop("line").hint("merge"), "name"), "of-members")
    rows = attach_spread(own, usual, "key")
    more, less = F.sort_array(F.array_except("grams", "usual")), F.sort_array(F.array_except("usual", "grams"))
    deviating = rows.select("key", "name", "probe", "t", "d", "sketch", F.concat(more, less).alias("all")).withColumn("n", F.size("all"))
    most = 2 * GRAM * F.col("t")
    deviating = stage(deviating.select("key", "name", "probe", "t", "d", "sketch", "n", F.slice("all", F.lit(1), most + 1).alias("first")), "deviating")

    light, linked = _light_pairs(deviating.where(F.col("n") <= most).drop("first"), lines.select("name", "line"), first, edits)
    return _sharing_pairs(deviating).unionByName(light), linked


def _alike() -> Column:
    return F.bit_count(F.col("sketch_a").bitwiseXOR(F.col("sketch_b"))) <= 4 * F.col("t")


def _side(rows: DataFrame, side: str, key: Column, *columns: str) -> DataFrame:
    """``rows`` as one side of a join on ``key``: the line's name is called like the side, and columns end in it."""
    return rows.select(key.alias(f"key_{side}"), F.col("name").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("sketch", "n", *columns)], *(["t"] if side == "a" else []))


def _sharing_pairs(deviating: DataFrame) -> DataFrame:
    """Pairs with more deviations than light ones, which meet in the first that they share: those with enough left after it on both sides."""
    each = deviating.select("key", "name", "probe", "t", "d", "sketch", "n", F.posexplode("first").alias("at", "gram"))
    key = F.xxhash64("key", "gram")
    left, right = _side(each.where("not probe"), "a", key, "at"), _side(each, "b", key, "at", "d")
    need = F.ceil((F.col("n_a") + F.col("n_b") - 2 * GRAM * F.col("t")) / 2)
    enough = (need >= 1) & (F.col("at_a") <= F.col("n_a") - need) & (F.col("at_b") <= F.col("n_b") - need)
    return left.join(right, (F.col("key_a") == F.col("key_b")) & F.expr("a <> b and (d_b > 0 or a < b)") & enough & _alike()).select("a", "b")


def _light_pairs(light: DataFrame, lines: DataFrame, first: DataFrame, edits: set[int]) -> tuple[DataFrame, DataFrame]:
    """(a, b) and (a, other) as ``crowded_pairs`` has them, of rows (key, name, probe, t, d, sketch, n) with few deviations."""
    light = stage(light.join(lines.hint("merge"), "name"), "light")
    centres = light.groupBy("key").agg(F.min(F.struct("n", "name"))["name"].alias("name"), F.count("*").alias("rows"))
    centres = stage(centres.join(lines.withColumnRenamed("line", "centre").hint("merge"), "name").select("key", "rows", "centre"), "centres")
    rows = attach_spread(light, centres, "key")
    sizes = F.char_length("line"), F.char_length("centre")
    rows = rows.withColumn("start", _common_start(F.col("line"), F.col("centre"), F.least(*sizes)))
    same_end = _common_start(F.reverse("line"), F.reverse("centre"), F.least(*sizes) - F.col("start"))
    rows = rows.withColumn("same_end", same_end).withColumns({"end": sizes[1] - F.col("same_end"), "own_end": sizes[0] - F.col("same_end")})
    free = _by_edits(edits, lambda t: _free_edits(F.col("line"), F.col("centre"), F.col("start"), F.col("end"), F.col("own_end"), t))
    way = F.call_function("levenshtein", F.col("line"), F.col("centre"), F.lit(FAR))
    # Two margins and the edits lie between places whose cells are apart.
    reach = MARGIN + max(edits)
    cells = F.greatest(F.floor((F.col("start") - reach) / CELL), F.lit(0)).cast("int"), F.floor((F.col("end") + reach) / CELL).cast("int")
    rows = rows.select("key", "name", "probe", "t", "sketch", "n", free.alias("free"), F.when(way >= 0, way).otherwise(FAR + 1).alias("way"), cells[0].alias("cell"), cells[1].alias("last"))
    rows = stage(rows, "places")

    pair = F.expr(f"a <> b and not (probe_a and probe_b) and n_a + n_b <= {2 * GRAM} * t and way_a + way_b > t and abs(way_a - way_b) <= t")
    left = rows.withColumn("in", F.explode(F.sequence("cell", "last")))
    left, right = _side(left, "a", F.xxhash64("key", "in"), "probe", "way", "cell"), _side(rows, "b", F.xxhash64("key", "cell"), "probe", "way", "cell")
    met = left.join(right, (F.col("key_a") == F.col("key_b")) & F.expr("cell_a < cell_b or cell_a = cell_b and a < b") & pair & _alike()).select("a", "b")
    # Apart: all that the free edits of both leave open.
    few = rows.where("free <= t")
    partner = F.explode(F.sequence(F.lit(0), F.col("t") - F.col("free")))
    left, right = _side(few.withColumn("with", partner), "a", F.xxhash64("key", "with"), "probe", "way"), _side(few, "b", F.xxhash64("key", "free"), "probe", "way")
    apart = left.join(right, (F.col("key_a") == F.col("key_b")) & F.expr("a < b") & pair & _alike()).select("a", "b")

    near = rows.where("way <= t").join(first.hint("merge"), "name").select("key", "name", "t", "way", "first")
    near = stage(near, "near-centre")
    least = near.groupBy("key", "way").agg(F.min("first").alias("other"), F.count("*").alias("rows"))
    asked = near.select("key", F.col("name").alias("a"), F.explode(F.sequence(F.lit(0), F.col("t") - F.col("way"))).alias("way"))
    asked = asked.select("a", F.xxhash64("key", "way").alias("of"))
    linked = attach_spread(stage(asked, "by-centre"), stage(least.select(F.xxhash64("key", "way").alias("of"), "rows", "other"), "least"), "of")
    return met.unionByName(apart), linked.where("other is not null").groupBy("a").agg(F.min("other").alias("other"))
