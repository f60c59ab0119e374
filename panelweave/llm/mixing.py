"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same set of sources form a pattern. A pattern offers its words once, twice, ... up
to a limit, each repetition at a higher price; a source takes up to its target. The cheapest largest flow
tells how many words of each pattern go to each source, with as little repetition as the targets
allow. Only patterns and sources enter the flow. Documents are then taken in a seeded order until the flow of
their pattern is met, the last round of repetition being partial.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.numbering import numbered
from panelweave.llm.tables import stage, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Patterns that the flow on the driver accepts; more is an error, never a cut.
MOST_PATTERNS = 20_000


def source_targets(sizes: dict[str | None, int], repeats: int = 3, weights: tuple[float, ...] = WEIGHTS) -> dict[str | None, float]:
    """Shares of all words by weight, none above ``repeats`` times its source's size; the excess goes to the others by weight.

    Sources in code point order, null last, have the weights in turn.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, target, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / whole > repeats * sizes[s]]
        if not above:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in above:
            target[s] = float(repeats * sizes[s])
        left = max(left - sum(target[s] for s in above), 0.0)
        open_ = [s for s in open_ if s not in above]
    return target


def route(supply: dict[str, tuple[int, tuple[str | None, ...]]], target: dict[str | None, float], repeats: int) -> dict[str, dict[str | None, int]]:
    """Cheapest largest flow: pattern -> words for each of its sources.

    The r-th use of a pattern's words costs 2r - 1 a word, so that the total is convex in the number of uses.
    Shortest augmenting paths with cheaper paths first; a path may take words back from one source for another.
    """
    patterns = list(supply)
    sources = list(target)
    start, end = 0, 1
    node = {("p", p): i for i, p in enumerate(patterns, 2)} | {("s", s): i for i, s in enumerate(sources, 2 + len(patterns))}
    to, room, cost, out = [], [], [], [[] for _ in range(2 + len(node))]

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    for p, (size, _) in supply.items():
        for r in range(1, repeats + 1):
            arc(start, node["p", p], size, 2 * r - 1)
    routes = {(p, s): arc(node["p", p], node["s", s], repeats * size, 0) for p, (size, members) in supply.items() for s in members}
    for s, most in target.items():
        arc(node["s", s], end, round(most), 0)
    while True:
        price, came = {start: 0}, {}
        queue, waiting = deque([start]), {start}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in out[a]:
                if room[e] and price[a] + cost[e] < price.get(to[e], float("inf")):
                    price[to[e]], came[to[e]] = price[a] + cost[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if end not in price:
            break
        path, at = [], end
        while at != start:
            path.append(came[at])
            at = to[came[at] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    found: dict[str, dict[str | None, int]] = {p: {} for p in patterns}
    for (p, s), e in routes.items():
        found[p][s] = room[e ^ 1]
    return found


def _filled(placed: DataFrame) -> DataFrame:
    """Adds ``fills``: whether a document of (pattern, size, draw, doc_id, at, left, within) fills what is left of its flow.

    Sizes are taken from the smallest on, all their documents while they fit, of the first that does not as many as fit;
    sums over sizes are aggregates, and that one size is numbered in parts, so no group sits in one task. What is left
    then is less than the next size, and one more document is taken if that brings the sum nearer.
    """
    ends = F.max(F.when(F.col("within"), F.col("at") + F.col("size")).otherwise(0))
    gaps = placed.groupBy("pattern").agg((F.first("left") - ends).alias("gap")).where("gap > 0")
    # At most one row per pattern, of which there are MOST_PATTERNS at most.
    open_ = placed.where("not within and size > 0").join(F.broadcast(gaps), "pattern")
    fitting = stage(open_.where("size <= gap").select("pattern", "size", "gap", "draw", "doc_id", "at"), "fitting")
    by_size = fitting.groupBy("pattern", "size").agg(F.count("*").alias("n"), F.first("gap").alias("gap"))
    smaller = Window.partitionBy("pattern").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    room = by_size.withColumn("rest", F.col("gap") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(smaller), F.lit(0)))
    room = room.withColumn("take", F.least(F.col("n"), F.greatest(F.lit(0), F.floor(F.col("rest") / F.col("size"))))).where("take > 0")
    room = stage(room.select("pattern", "size", "n", "take", "rest"), "room")
    whole = room.where("take = n").select(F.col("pattern").alias("_pattern"), F.col("size").alias("_size"))
    # Of each pattern one size is taken in part.
    cut = room.where("take < n").select("pattern", "size", "take")
    some = fitting.join(F.broadcast(cut), ["pattern", "size"])
    key = F.concat_ws("|", F.col("size").cast("string"), "pattern")
    some = stage(some.withColumn("key", key).select("key", "pattern", "draw", "doc_id", "at", "take"), "some")
    some = numbered(some, "key", [F.col("draw"), F.col("at"), F.col("doc_id")], "number").where("number < take")
    spent = room.groupBy("pattern").agg(F.sum(F.col("take") * F.col("size")).alias("spent"))
    lasting = gaps.join(spent, "pattern", "left").select("pattern", (F.col("gap") - F.coalesce("spent", F.lit(0))).alias("gap"))
    named = some.select(F.col("pattern").alias("_of"), F.col("at").alias("_at"))
    out = placed.join(named, (F.col("pattern") == F.col("_of")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left")
    out = out.join(whole, (F.col("pattern") == F.col("_pattern")) & (F.col("size") == F.col("_size")), "left")
    taken = ~F.col("within") & (F.col("_of").isNotNull() | (F.col("_pattern").isNotNull() & (F.col("size") > 0)))
    out = stage(out.withColumn("fills", taken).drop("_of", "_at", "_pattern", "_size"), "filled")
    left = out.where("not within and not fills and size > 0").join(F.broadcast(lasting), "pattern").where("size < 2 * gap")
    best = left.groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), F.col("at").alias("best")))["best"].alias("best"))
    out = out.join(F.broadcast(best), "pattern", "left")
    one = F.coalesce((F.col("at") == F.col("best")) & (F.col("size") > 0), F.lit(False))
    return out.withColumn("fills", F.col("fills") | one)


def mix_sources(docs: DataFrame, repeats: int = 3, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, members: str | None = None, also: list[str] | None = None) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``uses``, ``taken`` and ``routed`` to (doc_id, source).

    ``size``: words of the text (null and empty: 0); ``uses``: how often the mix takes the document, at most
    ``repeats``; ``taken`` = uses * size; ``routed``: the source that each use counts for. A column ``members`` (array) puts
    documents into several sources at once; without it a document belongs to ``source``, null being one too.
    Documents without words are used once if their pattern is used at all. Equal rows are exchangeable, so
    reruns agree. An empty table gives no rows; columns in ``also`` are handed through, others ignored.
    """
    own = F.array_sort(F.array_distinct(F.col(members))) if members else F.array("source")
    key = F.to_json(F.struct(own.alias("m")), {"ignoreNullFields": "false"})
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        own.alias("members"),
        key.alias("pattern"),
        word_count(F.col("text")).alias("size"),
        *(also or []),
    ).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "size", "source"))
    rows = stage(rows.withColumn("part", F.shiftrightunsigned("draw", 54).cast("int")), "mixed")
    found = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources")
    supply = {r["pattern"]: (r["size"], tuple(r["members"] or [])) for r in found}
    sizes: dict[str | None, int] = {}
    for size, sources in supply.values():
        for s in sources:
            sizes[s] = sizes.get(s, 0) + size
    target = source_targets(sizes, repeats, weights)
    plan = []
    for pattern, flow in route(supply, target, repeats).items():
        ends, names, total = [], [], 0
        for s in sorted(flow, key=lambda s: (s is None, s or "")):
            total += flow[s]
            ends.append(float(total))
            names.append(s)
        plan.append((pattern, float(supply[pattern][0]), float(total), ends, names))
    spark = docs.sparkSession
    flows = spark.createDataFrame(plan, "pattern string, whole double, flow double, ends array<double>, names array<string>")
    quotas = spark.createDataFrame([(s, sizes[s], target[s]) for s in sizes], "of string, source_size long, target double")

    part_size = rows.groupBy("pattern", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = part_size.select("pattern", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pattern", "part").orderBy("draw", "doc_id", "size", "source").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["pattern", "part"])
    # What is broadcast has a row per pattern, of which there are at most MOST_PATTERNS, or per source of these.
    placed = placed.join(F.broadcast(flows), "pattern")
    rounds = F.when(F.col("whole") > 0, F.floor(F.col("flow") / F.col("whole"))).otherwise(0).cast("int")
    placed = placed.withColumn("at", F.col("before") + F.col("inside")).withColumn("rounds", rounds).drop("before", "inside")
    placed = placed.withColumn("left", F.col("flow") - F.col("rounds") * F.col("whole"))
    placed = stage(placed.withColumn("within", (F.col("size") > 0) & (F.col("at") + F.col("size") <= F.col("left"))), "placed")
    # The last round takes the documents that end before the flow does. What is left of it, less than the document that
    # crosses the end, is filled with the smallest others, then with the one that leaves the least error.
    placed = _filled(placed)
    again = F.col("within") | F.col("fills")
    uses = F.when(F.col("size") == 0, (F.col("flow") > 0).cast("int")).otherwise(F.least(F.lit(repeats), F.col("rounds") + again.cast("int"))).cast("int")
    placed = placed.withColumn("uses", uses).withColumn("middle", F.col("at") + F.col("size") / 2)
    routed = F.expr("transform(slice(sequence(0, uses), 1, uses), r -> coalesce(get(names, size(filter(ends, e -> e <= r * whole + middle))), names[size(names) - 1]))")
    out = placed.withColumn("routed", routed).join(F.broadcast(quotas), F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "uses", (F.col("uses") * F.col("size")).cast("long").alias("taken"), "routed", *(also or []))
