"""Trie of the prefixes of rebuilt conversations, by fingerprints that compose.

A run of turns has a fingerprint (value, power) in a monoid: (v, q) then (w, r) is (v + q * w, q * r) modulo a prime,
and a turn is (hash, BASE). Each stored conversation gets the products of all its prefixes once. A rebuilt
conversation is a head of another one and a suffix of its own; the fingerprints of its prefixes follow from the stored
products alone: a suffix is a prefix product divided by a shorter one. No text is put together or moved again.

Rows of equal fingerprint are one node. That they are equal as sequences is verified: a node's rows must agree in
depth, in the fingerprint before and in the digest of the turn they refer to, hence by induction in all turns. If any
node fails, the work is done again with another base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.tables import attach_spread, drop_staged, stage
from panelweave.operators.groupwise import input_bytes

#: Two primes below 2**31, whose products fit a long; together they give a fingerprint of 62 bits.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Bases in the order in which they are tried, a pair each time.
BASES = ((1_103_515_245, 1_566_083_941), (1_812_433_253, 69_069_069), (1_664_525_001, 214_013_003))
#: Conversations are rebuilt on the first of each GROUP ids, with fewer than HEADS turns of it.
GROUP, HEADS = 100, 6
#: Turns of a part of a path, ids of a part of a list, and bytes of a range of turns.
PATH_ROWS, LIST_IDS, RANGE_BYTES = 4096, 4096, 64 << 20

RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_conv_id", "turn_place"]


def _head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def _power(base: int, prime: int, exponent: Column) -> Column:
    """base ** exponent modulo the prime, for exponents below 2**40."""
    squares = F.array(*[F.lit(pow(base, 1 << j, prime)).cast("long") for j in range(40)])
    factor = lambda j: F.when(F.getbit(exponent, j) == 1, F.get(squares, j)).otherwise(F.lit(1).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(39)), F.lit(1).cast("long"), lambda a, j: a * factor(j) % prime)


def numbered_turns(conversations: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """(conv, place, d1, d2, chars, v1, v2, w1, w2) of each turn, written: the products with it and before it.

    Turns are dealt out by ranges of their order, so a conversation of any length is cut; inside a range products run
    on in a stream, and the few conversations that go on in the next range are shifted by the products before.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.char_length(text).cast("long").alias("chars"), digest.alias("digest")
    )
    number = lambda at, digits: F.conv(F.substring("digest", at, digits), 16, 10).cast("long")
    turns = turns.select("conv", "turn", "role", "chars", number(1, 15).alias("d1"), number(16, 15).alias("d2"), *[(number(at, 12) % (p - 1) + 1).alias(name) for at, p, name in ((31, PRIMES[0], "h1"), (43, PRIMES[1], "h2"))])
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("d1"), F.col("d2")]
    ranges = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(input_bytes(turns) or 0) // RANGE_BYTES))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        powers = [np.ones(1, np.int64) for _ in PRIMES]
        last, count, carried = None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            first = np.append(conv[0] != last if last is not None else True, conv[1:] != conv[:-1])
            row = np.arange(len(conv))
            start = np.maximum.accumulate(np.where(first, row, -1))
            goes_on = start < 0  # rows of the conversation that the batch before ended with
            at = np.where(goes_on, row + count, row - np.maximum(start, 0))
            out = {"conv": batch.column("conv"), "part": pa.array(np.full(len(conv), part, np.int32)), "at": pa.array(at + 1)}
            for name in ("d1", "d2", "chars"):
                out[name] = batch.column(name)
            for i, (prime, base) in enumerate(zip(PRIMES, bases)):
                while len(powers[i]) <= at.max():
                    powers[i] = np.concatenate([powers[i], powers[i] * pow(base, len(powers[i]), prime) % prime])
                term = batch.column(f"h{i + 1}").to_numpy() * powers[i][at] % prime
                total = np.cumsum(term)
                before = np.where(goes_on, carried[i], -(total - term)[np.maximum(start, 0)])
                value = (total + before) % prime
                out[f"v{i + 1}"], out[f"w{i + 1}"] = pa.array(value), pa.array((value - term) % prime)
                carried[i] = int(value[-1])
            last, count = conv[-1], int(at[-1]) + 1
            yield pa.record_batch(list(out.values()), names=list(out))

    kinds = "conv long, part int, at long, d1 long, d2 long, chars long, v1 long, w1 long, v2 long, w2 long"
    dealt = turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("turn", "role")
    local = stage(dealt.mapInArrow(products, kinds), "turns")

    ends = local.groupBy("conv", "part").agg(F.max("at").alias("size"), F.max_by("v1", "at").alias("v1"), F.max_by("v2", "at").alias("v2"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations that lie in several ranges have rows here, at most one for each range.
    shifts = ends.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    for i, (prime, base) in enumerate(zip(PRIMES, bases), 1):
        shifts = shifts.withColumn(f"q{i}", _power(base, prime, F.col("before")))
        shifts = shifts.withColumn(f"s{i}", F.coalesce(F.sum(F.col(f"q{i}") * F.col(f"v{i}") % prime).over(earlier), F.lit(0)) % prime)
    shifts = shifts.where("before > 0").select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "before", "q1", "s1", "q2", "s2")
    moved = local.join(F.broadcast(shifts), (F.col("conv") == F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    shifted = [
        F.when(F.col("before").isNull(), F.col(f"{x}{i}")).otherwise((F.col(f"s{i}") + F.col(f"q{i}") * F.col(f"{x}{i}")) % prime).alias(f"{x}{i}")
        for i, prime in enumerate(PRIMES, 1)
        for x in "vw"
    ]
    return moved.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("place"), "d1", "d2", "chars", *shifted)


def rebuilt_prefixes(turns: DataFrame, bases: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv, length), and (conv, depth, print, parent, d1, d2, chars, last, ...) of their prefixes.

    ``print`` and ``parent`` are the fingerprints with and without the last turn, ``last`` marks the whole
    conversation, ``turn_conv_id`` and ``turn_place`` refer to the stored turn.
    """
    in_head = F.col("place") == _head(F.col("conv"))
    whole = turns.groupBy("conv").agg(F.max("place").alias("n"), *[F.coalesce(F.max(F.when(in_head, F.col(f"v{i}"))), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    base = F.col("conv") - F.col("conv") % GROUP
    stored = F.struct("place", "d1", "d2", "chars", "v1", "v2", "w1", "w2")
    heads = turns.where((F.col("place") < HEADS) & (F.col("conv") % GROUP == 0)).groupBy("conv").agg(F.sort_array(F.collect_list(stored)).alias("head"))
    whole = whole.withColumn("base", base).withColumn("h", _head(F.col("conv"))).join(heads.withColumnRenamed("conv", "base"), "base", "left")
    # A conversation may have fewer turns than its head would replace: then it is the head alone.
    taken = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.greatest(F.col("h"), F.lit(1)).cast("int")))
    whole = whole.withColumn("head", F.coalesce(taken, F.slice("head", 1, 0), F.array().cast(heads.schema["head"].dataType)))
    whole = whole.withColumn("k", F.size("head").cast("long")).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    for i in (1, 2):
        whole = whole.withColumn(f"b{i}", F.when(F.col("k") > 0, F.element_at("head", -1)[f"v{i}"]).otherwise(F.lit(0)))
    whole = stage(whole, "conversations")

    def printed(x: str) -> Column:
        return (F.col(f"{x}1") * (1 << 31)) + F.col(f"{x}2")

    columns = ["conv", "depth", printed("v").alias("print"), printed("w").alias("parent"), "d1", "d2", "chars", "last", "turn_conv_id", "turn_place"]
    head = whole.select("conv", "base", "length", F.explode("head").alias("t")).select("conv", "length", "t.*", F.col("base").alias("turn_conv_id"))
    head = head.withColumns({"depth": F.col("place"), "turn_place": F.col("place"), "last": F.col("place") == F.col("length")}).select(*columns)

    own = turns.where(F.col("place") > _head(F.col("conv")))
    plan = whole.select("conv", "h", "k", "length", "o1", "o2", "b1", "b2", F.col("n").alias("rows"))
    own = attach_spread(own, plan, "conv")
    depth = F.col("place") - F.col("h") + F.col("k")
    back = F.col("h") - F.col("k")
    values = {}
    for i, (prime, base_value) in enumerate(zip(PRIMES, bases), 1):
        inverse = F.array(*[F.lit(pow(base_value, -j, prime)).cast("long") for j in range(HEADS)])
        for x in "vw":
            suffix = F.pmod(F.col(f"{x}{i}") - F.col(f"o{i}"), F.lit(prime)) * F.get(inverse, back.cast("int")) % prime
            values[f"{x}{i}"] = (F.col(f"b{i}") + suffix) % prime
    own = own.select("conv", depth.alias("depth"), "d1", "d2", "chars", (depth == F.col("length")).alias("last"), F.col("conv").alias("turn_conv_id"), F.col("place").alias("turn_place"), *[c.alias(name) for name, c in values.items()])
    return whole.select("conv", "length"), head.unionByName(own.select(*columns))


def _list_hashes(ends: DataFrame) -> DataFrame:
    """(print, conv) -> (print, ends_sha256): ids in parts of bounded size, whose texts run through the hash in order."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = ends.groupBy("print", F.floor(F.col("conv") / LIST_IDS).alias("part")).agg(ids.alias("ids"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, running = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for key, text in zip(batch.column("print").to_pylist(), batch.column("ids").to_pylist()):
                if key != held:
                    if running:
                        done.append((held, running.hexdigest()))
                    held, running = key, hashlib.sha256(text.encode())
                else:
                    running.update(f",{text}".encode())
            yield pa.record_batch([pa.array([k for k, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["print", "ends_sha256"])
        if running:
            yield pa.record_batch([pa.array([held], pa.int64()), pa.array([running.hexdigest()])], names=["print", "ends_sha256"])

    return parts.repartition("print").sortWithinPartitions("print", "part").mapInArrow(hashes, "print long, ends_sha256 string")


def _ahead(rows: DataFrame, values: list[str]) -> DataFrame:
    """``values`` summed over each row of a path and the rows ahead of it; paths are cut in parts of PATH_ROWS."""
    cut = rows.withColumn("part", F.floor(F.col("depth") / PATH_ROWS))
    parts = cut.groupBy("conv", "part").agg(*[F.sum(v).alias(v) for v in values])
    later = Window.partitionBy("conv").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    more = parts.select("conv", "part", *[F.sum(v).over(later).alias(f"later_{v}") for v in values]).where(F.col(f"later_{values[0]}").isNotNull())
    inside = Window.partitionBy("conv", "part").orderBy(F.desc("depth"))
    summed = cut.withColumns({v: F.sum(v).over(inside) for v in values}).join(more, ["conv", "part"], "left")
    return summed.withColumns({v: F.col(v) + F.coalesce(f"later_{v}", F.lit(0)) for v in values})


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the nodes of the trie of rebuilt conversations, columns as in ``RESULT``.

    Turns are ordered by turn, null first, equal ones by role, then by the SHA-256 of length of role, colon, role and
    text; a null role or text is empty, and repeated rows are turns of their own. Each conv_id c is rebuilt from the
    first h turns of conversation c - c % 100 (the remainder has the sign of c; all if it has fewer, none if it is
    absent) and its own turns after its first h, with h the CRC-32 of the decimal c modulo 6. Rows without a conv_id
    take no part. A node is a distinct sequence of the first d turns; ``conv_id`` is the smallest conversation that
    starts with it, ``parent_conv_id`` that of the node before (null at the root), ``n_leaves`` counts nodes without
    children below it, itself included, ``saved_tokens`` sums (n_convs - 1) * characters of the last text over the
    nodes from it down, ``ends_sha256`` is the hash of the ids that end in it. ``turn_conv_id`` and ``turn_place`` refer
    to a stored turn equal to the node's last (null at the root). Rebuilt conversations without turns end in the root;
    an empty table gives no rows; other columns are not read.
    """
    spark = conversations.sparkSession
    for bases in BASES:
        turns = numbered_turns(conversations.select("conv_id", "turn", "role", "text"), bases)
        whole, rows = rebuilt_prefixes(turns, bases)
        rows = stage(rows, "prefixes")
        checked = ("depth", "parent", "d1", "d2")
        nodes = rows.groupBy("print").agg(
            F.count("*").alias("n_convs"),
            F.min("conv").alias("least"),
            *[F.min(c).alias(c) for c in checked],
            *[F.max(c).alias(f"most_{c}") for c in checked],
            F.max("chars").alias("chars"),
            F.count(F.when(F.col("last"), 1)).alias("n_ends"),
            F.min(F.when(F.col("last"), F.col("conv"))).alias("end"),
            F.min(F.struct("turn_conv_id", "turn_place")).alias("turn"),
        )
        nodes = stage(nodes, "nodes")
        same = [F.col(c) == F.col(f"most_{c}") for c in checked]
        if nodes.where(~(same[0] & same[1] & same[2] & same[3]) | (F.col("print") == 0)).isEmpty():
            break
        drop_staged(rows, nodes)
    else:
        raise RuntimeError("fingerprints of different prefixes are equal with every base")

    # A node with one conversation has one below it all the way: nothing to save and one leaf. The rest is about shared nodes.
    children = nodes.groupBy("parent").agg(F.count("*").alias("n_children"))
    shared = nodes.where("n_convs > 1").join(children.withColumnRenamed("parent", "print"), "print", "left")
    shared = stage(shared.select("print", "least", "n_convs", "chars", "n_ends", F.coalesce("n_children", F.lit(0)).alias("n_children")), "shared")
    known = shared.select("print", "least", "chars", "n_convs", "n_children", "n_ends", F.col("n_convs").alias("rows"))
    paths = attach_spread(rows.select("conv", "depth", "print", "last"), known, "print").where("least IS NOT NULL")
    own = F.col("conv") == F.col("least")
    saved = F.when(own, (F.col("n_convs") - 1) * F.col("chars")).otherwise(F.lit(0))
    ends_elsewhere = F.when(F.col("last") & ~(own & (F.col("n_children") == 0)), 1).otherwise(0)
    paths = stage(paths.select("conv", "depth", "print", "last", "n_ends", saved.alias("saved"), ends_elsewhere.alias("without")), "paths")
    below = _ahead(paths, ["saved", "without"]).groupBy("print").agg(F.sum("saved").alias("saved_tokens"), F.sum(1 - F.col("without")).alias("n_leaves"))

    lists = paths.where(F.col("last") & (F.col("n_ends") > 1)).select("print", "conv")
    lists = _list_hashes(lists.unionByName(whole.where("length = 0").select(F.lit(0).cast("long").alias("print"), "conv")))
    lists = stage(lists, "lists")
    details = shared.select("print", "n_children").join(below, "print").join(lists, "print", "left")
    full = nodes.join(details, "print", "left")
    n_children = F.when(F.col("n_convs") == 1, 1 - F.col("n_ends")).otherwise(F.col("n_children"))
    listed = F.when(F.col("n_ends") == 0, F.sha2(F.lit(""), 256)).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("ends_sha256"))
    full = full.select(
        F.col("least").alias("conv_id"),
        "depth",
        "parent",
        "n_convs",
        n_children.alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        listed.alias("ends_sha256"),
        F.col("turn.turn_conv_id").alias("turn_conv_id"),
        F.col("turn.turn_place").alias("turn_place"),
    )
    full = stage(full, "trie")

    root = whole.agg(F.min("conv").alias("least"), F.count("*").alias("n_convs")).first()
    totals = full.agg(F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves")).first()
    # Only shared nodes save, and each is below the root, which has no text itself.
    saved_tokens = nodes.where("n_convs > 1").agg(F.sum((F.col("n_convs") - 1) * F.col("chars"))).first()[0] or 0
    turnless = lists.where("print = 0").first()
    top = (root["least"], 0, None, root["n_convs"], totals["n_children"], totals["leaves"] or 1, saved_tokens, turnless["ends_sha256"] if turnless else hashlib.sha256().hexdigest(), None, None)
    top = spark.createDataFrame([top] if root["n_convs"] else [], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT))

    # The parent of a node in one conversation only is in the same one, unless it is shared.
    over = shared.select(F.col("print").alias("parent"), F.col("least").alias("parent_least"), F.col("n_children").alias("rows"))
    over = over.unionByName(top.select(F.lit(0).cast("long").alias("parent"), F.col("conv_id").alias("parent_least"), F.col("n_children").alias("rows")))
    parent = F.coalesce("parent_least", "conv_id")
    return attach_spread(full, over, "parent").select(*[parent.alias(c) if c == "parent_conv_id" else F.col(c) for c in RESULT]).unionByName(top)
