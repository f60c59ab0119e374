"""Operators on documents against plain versions, on rows with every awkward case."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from panelweave.llm import crowded_lines, fingerprints, jaccard_join, line_dedup, mixing, packing, quality, substring_dedup, token_counts  # noqa: E402
from panelweave.llm.bpe import PieceEncoder  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(n, links):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (3, 50)])
def test_similarity_components(docs, rows, k, percent):
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    label = components(len(rows), links)
    least = {}
    for i, t in enumerate(label):
        if rows[i][0] is not None:
            least[t] = min(least.get(t, rows[i][0]), rows[i][0])
    expected = [(r[0], len(s), least.get(t) if s else r[0]) for r, s, t in zip(rows, sets, label, strict=True)]
    found = [tuple(r) for r in jaccard_join.similarity_components(docs, k, percent).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_similarity_components_without_rows(no_docs):
    assert jaccard_join.similarity_components(no_docs).count() == 0


def test_one_id_with_many_rows_gives_each_set_once(spark, prose, monkeypatch):
    """A third of the rows have one doc_id and two texts by turns: two sets are compared, once."""
    words = prose(1, 120).split(" ")
    texts = [" ".join(words), " ".join([*words[:-1], "other"])]
    rows = [(1, texts[i % 2]) for i in range(300)] + [(i, prose(i, 40)) for i in range(10, 50)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, sets, percent: seen.append((pairs.count(), sets.count())) or plain(pairs, sets, percent))
    out = jaccard_join.similarity_components(table, 4, 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted((i, i) for i, _ in rows)
    assert seen[0] == (1, 2)


def test_bitmaps_never_rule_out_similar_sets():
    draw = np.random.default_rng(3)
    for n in (1, 5, 100, 3000, 70_000):
        x = draw.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        for other in (0, 1, n // 10, n // 2, n):
            y = np.unique(np.concatenate([x[: n - other], draw.integers(0, 1 << 63, max(other * 2, 1), dtype=np.int64).astype(np.uint64)]))
            apart = len(np.setxor1d(x, y))
            assert jaccard_join._differing(jaccard_join._bitmap(x), jaccard_join._bitmap(y)) <= apart
    strangers = [draw.integers(0, 1 << 63, 500, dtype=np.int64).astype(np.uint64) for _ in range(2)]
    assert jaccard_join._differing(*map(jaccard_join._bitmap, strangers)) > 300


def test_similarity_components_bridged_groups(spark, monkeypatch):
    """Two groups of near copies joined by one pair, whose shared shingles are held mostly by either group."""
    longest = jaccard_join.LONGEST_MATCH
    monkeypatch.setattr(jaccard_join, "_match_count", lambda extra, free, n: min(longest, n - free))
    texts = {}
    for case in range(4):
        shared = [f"s{case}x{i}" for i in range(89)]
        for side in range(2):
            own = [f"v{case}x{side}x{i}" for i in range(10)]
            texts[1000 * case + 100 * side] = [*shared, *own, f"u{case}x{side}"]
            for i in range(8):
                lost = shared[8 * side + i]
                texts[1000 * case + 100 * side + 1 + i] = [*[x for x in shared if x != lost], *own, f"w{case}x{side}", f"z{case}x{side}"]
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.similarity_components(table, 1, 80).collect()}
    assert found == {d: d // 1000 * 1000 for d in texts}


@pytest.mark.parametrize("span", [12, 35])
def test_remove_repeats(docs, rows, span):
    words = [WORD.findall(text or "") for _, text, *_ in rows]
    starts = collections.Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    expected = []
    for (doc_id, *_), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - span + 1):
            if starts[tuple(w[i : i + span])] > 1:
                gone |= set(range(i, i + span))
        expected.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    found = [tuple(r) for r in substring_dedup.remove_repeats(docs, span).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_remove_repeats_without_rows(no_docs):
    assert substring_dedup.kept_digest(no_docs, 35).count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


@pytest.mark.parametrize("crowded", [1, 32])
def test_dedup_lines(spark, docs, rows, monkeypatch, crowded):
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    stem = "a line that is long enough to be compared"
    more = [(100, stem), (101, stem + "!"), (102, "  " + stem + "\t\nshort\n\nshort"), (103, stem.replace("long", "lung")), (104, stem[1:] + "?"), (105, "x" + stem)]
    more += [(110 + i, stem[:i] + "#" + stem[i + 1 :] + f"\nown line number {i} of these documents") for i in range(12)]
    table = docs.select("doc_id", "text", "lang", "source", "_line").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    every = [(r[0], r[1]) for r in rows] + more
    order = lambda d: (d is not None, d or 0)
    first = {}
    for doc_id, text in sorted(every, key=lambda r: order(r[0])):
        for n, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\v\f")
            if len(line) >= 32:
                first.setdefault(line, (order(doc_id), n))
    early = {x: min(first[y] for y in first if near(x, y)) for x in first}
    expected = []
    for doc_id, text in every:
        lines = text.split("\n") if text is not None else []
        kept = [x for n, x in enumerate(lines) if (y := x.strip(" \t\r\v\f")) not in early or early[y] >= (order(doc_id), n)]
        expected.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    out = line_dedup.dedup_lines(table)
    assert out.columns == ["doc_id", "lang", "source", "_line", "text", "n_lines", "n_removed"]
    found = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(x[3] for x in expected) > 10


@pytest.mark.parametrize("crowded", [1, 32])
def test_dedup_lines_of_several_edits(spark, monkeypatch, crowded):
    """Edits by the length of the shorter line, and exact repeats of short lines."""
    import random

    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    draw, tau = random.Random(7), ((0, 1), (60, 2), (120, 3))
    every, stems = [], ["".join(draw.choice("abcdef gh") for _ in range(n)).strip() + "." for n in (40, 59, 60, 61, 90, 119, 121, 124, 200, 300)]
    for i in range(70):
        line = list(stems[i % len(stems)] if i % 7 else "".join(draw.choice("ab") for _ in range(70)))
        for _ in range(draw.randint(0, 5)):
            at, kind = draw.randrange(1, len(line) - 1), draw.randrange(3)
            line[at : at + (kind < 2)] = [] if kind == 0 else [draw.choice("xyzab")]
        every.append((i, f"own {i}\n\n  short one \n" + "".join(line)))
    first = {}
    for doc_id, text in every:
        for n, line in enumerate(text.split("\n")):
            first.setdefault(line.strip(), (doc_id, n))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, above = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, above[j] + 1, above[j - 1] + (x != y)))
        return row[-1]

    def alike(a, b):
        shorter = min(len(a), len(b))
        return a == b or (shorter >= 32 and abs(len(a) - len(b)) <= 3 and distance(a, b) <= max(t for n, t in tau if shorter >= n))

    early = {x: min(first[y] for y in first if alike(x, y)) for x in first if x}
    expected = {(d, n) for d, text in every for n, line in enumerate(text.split("\n")) if line.strip() and early[line.strip()] < (d, n)}
    table = spark.createDataFrame(every, "doc_id long, text string")
    found = [(r._doc, r._line) for r in line_dedup.removed_lines(table, tau=tau, exact=1).collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert len([x for x in expected if x[1] == 3]) > 20 and len([x for x in expected if x[1] == 2]) == 69


def test_crowded_lines_keep_links_without_all_pairs(spark, prose):
    """Lines about two words from a common one: a small part of all pairs is left to verify, and no link is lost."""
    import random

    draw = random.Random(3)
    words = prose(4, 90).split()
    lines = []
    for i in range(240):
        own = list(words)
        for _ in range(2 if i % 6 else 0):
            own[draw.randrange(90)] = "".join(draw.choice("abcdefghij") for _ in range(draw.randint(4, 9)))
        line = " ".join(lines[-1].split(" ") if i % 8 == 5 else own)
        for _ in range(draw.randint(0, 3) if i % 6 == 0 or i % 8 == 5 else 0):
            at = draw.randrange(len(line))
            line = line[:at] + draw.choice(["", "x", line[at] + "y"]) + line[at + 1 :]
        lines.append(line)
    lines = list(dict.fromkeys(lines))
    names = list(range(len(lines)))
    draw.shuffle(names)
    table = spark.createDataFrame(list(zip(names, lines, strict=True)), "name long, line string").withColumn("sketch", line_dedup._sketch(F.col("line"))).cache()
    crowded = table.selectExpr("1L AS key", "name", "false AS probe", "3 AS t", "0 AS d")
    first = table.selectExpr("name", "named_struct('_doc', name, '_version', 0L, '_line', 0) AS first")
    pairs, linked = crowded_lines.crowded_pairs(crowded, table, first, {2, 3})
    near = table.selectExpr("name AS x", "line AS of_x").join(table.selectExpr("name AS y", "line AS of_y"), F.expr("x < y and levenshtein(of_x, of_y, 3) >= 0"))
    links = {(r.x, r.y) for r in near.collect()}
    found = {tuple(sorted(r)) for r in pairs.collect()}
    least = {n: min([n, *(a + b - n for a, b in links if n in (a, b))]) for n in names}
    got = {n: n for n in names} | {r.a: min(r.a, r.other._doc) for r in linked.collect()}
    for a, b in found & links:
        got[b] = min(got[b], a)
    assert got == least and len([n for n in names if least[n] < n]) > 40
    assert len(found) < len(lines) * (len(lines) - 1) / 2 / 8


def test_sketches_never_rule_out_near_lines(spark):
    import random

    draw, rows = random.Random(4), []
    for _ in range(400):
        line = [draw.choice("abcdé 字") for _ in range(draw.randint(1, 60))]
        other, n = list(line), draw.randint(0, 3)
        for _ in range(n):
            at, kind = draw.randrange(0, len(other) + 1), draw.randrange(3)
            other[at : at + (kind < 2)] = [] if kind == 0 else [draw.choice("xyz")]
        rows.append(("".join(line), "".join(other), n))
    rows.append(("a" * 100_000, "a" * 99_999 + "b", 1))
    table = spark.createDataFrame(rows, "x string, y string, n int")
    apart = F.bit_count(line_dedup._sketch(F.col("x")).bitwiseXOR(line_dedup._sketch(F.col("y"))))
    assert table.where(apart > 4 * F.col("n")).count() == 0


def test_dedup_lines_without_rows(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_piece_encoder_equals_library():
    import random

    draw = random.Random(3)
    parts = ["a", "B", "é", "1", "٣", "'", "'s", "'ll", "'re", " ", "  ", "\n", "\t", " ", "!", "$$", "字", "😀", "'t", "x", "\r\n", "_", "́", "ve"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    encoder, library = PieceEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for some in (texts, [*texts[:5], "<|endoftext|> a", None], [None], []):
        got = encoder.encode(pa.array(some, pa.string()))
        for i, e in enumerate(library.encode_batch([x or "" for x in some], add_special_tokens=False)):
            assert got.ids[got.first[i] : got.first[i + 1]].tolist() == e.ids


@pytest.mark.parametrize("window", [64, 1024])
def test_pack_documents(docs, rows, window):
    library = Tokenizer.from_file(VOCABULARY)
    expected = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), window):
            part = ids[i : i + window]
            expected[(doc_id, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    out = packing.pack_documents(docs, VOCABULARY, window).collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == expected
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // window) * 1.15 + 1


def test_fill_window_is_best():
    import itertools
    import random

    draw = random.Random(5)
    for _ in range(200):
        counts = {draw.randint(1, 40): draw.randint(1, 3) for _ in range(draw.randint(1, 5))}
        pattern = packing.fill_window(counts, 40)
        longest = max(counts)
        choices = [range(counts[x] + 1) for x in counts]
        best = max(s for c in itertools.product(*choices) if (s := sum(n * x for n, x in zip(c, counts, strict=True))) <= 40 and c[list(counts).index(longest)])
        assert sum(n * x for x, n in pattern.items()) == best
        assert all(n <= counts[x] for x, n in pattern.items())


def test_packing_without_rows(no_docs):
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_attribute_tokens(docs, rows):
    library = Tokenizer.from_file(VOCABULARY)
    expected = []
    for doc_id, text, lang, source in rows:
        whole = f"{source or ''} {lang or ''} {text or ''}"
        sections, at = [], 0
        for field, value in (("source", source), ("lang", lang), ("text", text)):
            lines = (value or "").split("\n") if field == "text" else [value or ""]
            for n, line in enumerate(lines):
                size = len(line) + (n < len(lines) - 1)
                sections.append((field, n, at, at + size))
                at += size
            at += 1
        count = collections.Counter()
        for a, b in library.encode(whole, add_special_tokens=False).offsets:
            share = [min(b, s[3]) - max(a, s[2]) for s in sections]
            best = max(share)
            count[sections[share.index(best)] if best > 0 else ("", 0, 0, 0)] += 1
        expected += [(doc_id, *s, count[s]) for s in sections] + [(doc_id, "", 0, count[("", 0, 0, 0)])]
    out = token_counts.attribute_tokens(docs, VOCABULARY, ["source", "lang", "text"], by_line=["text"]).collect()
    found = [(r.doc_id, r.field, r.section, r.start, r.end, r.n_tokens) if r.field else (r.doc_id, "", 0, r.n_tokens) for r in out]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_fingerprints(docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 5)
    texts = {r[0]: r[1] or "" for r in rows}
    order = sorted((d for d in texts if d is not None), reverse=True) + [None]
    follow = {(d, False): e for d, e in zip(order, [*order[1:], order[0]], strict=True)}
    out = fingerprints.edited_fingerprints(docs).collect()
    assert len(out) == len(rows)
    by_text = {}
    eighties = []
    for r in out:
        n = len(texts[r.doc_id])
        nexts = [texts[follow[r.doc_id, False]], texts[r.doc_id]] if r.doc_id == 80 else [texts[follow[r.doc_id, False]]]
        digests = [hashlib.sha256((texts[r.doc_id][: n - n // 3] + x[: n // 3]).encode()).hexdigest() for x in nexts]
        assert r.n_chars == n and r.edited_sha256 in digests and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id == 80:
            eighties.append(digests.index(r.edited_sha256))
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert sorted(eighties) == [0, 1, 1]
    assert {r.fingerprint for r in out if not WORD.search(texts[r.doc_id])} == {""}
    assert fingerprints.edited_fingerprints(no_docs).count() == 0


def test_sketches_estimate_containment():
    draw = np.random.default_rng(0)
    whole = np.unique(draw.integers(0, 2**64, 40_000, np.uint64))
    part = np.sort(whole[::10])
    x, y = fingerprints.sketch(whole), fingerprints.sketch(part)
    assert fingerprints.containment(y, x) == 1 and abs(fingerprints.containment(x, y) - 0.1) < 0.03
    halves = fingerprints.sketch(whole[:20_000]), fingerprints.sketch(np.sort(whole[20_000:]))
    assert np.array_equal(fingerprints.merged(*halves), x)
    assert np.array_equal(fingerprints.read_fingerprint(fingerprints.written(x)), x)
    assert base64.b64decode(fingerprints.written(y))


def test_mix_sources(docs, rows, no_docs):
    out = mixing.mix_sources(docs).collect()
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(d), len(WORD.findall(t or ""))) for d, t, *_ in rows)
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    target = mixing.source_targets(sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-9
        assert r.taken == r.uses * r.size and 0 <= r.uses <= 3 and len(r.routed) == r.uses
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(r.size for r in out if r.source == s)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(no_docs).count() == 0


def test_targets_stop_at_three_times():
    target = mixing.source_targets({"a": 1, "b": 10, "c": 100, None: 1000})
    # weights 5, 2, 1, 5: a and b stop at 3 and 30, the rest goes 1 : 5
    assert target["a"] == 3 and target["b"] == 30
    assert target["c"] == pytest.approx(1078 / 6) and target[None] == pytest.approx(1078 * 5 / 6)


def test_overlapping_sources_share(spark):
    rows = [(i, "w " * 10, ["a"]) for i in range(20)] + [(100 + i, "w " * 10, ["a", "b"]) for i in range(20)] + [(200 + i, "w " * 10, ["b"]) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m array<string>").selectExpr("*", "m[0] AS source")
    out = mixing.mix_sources(docs, weights=(1.0,), members="m").collect()
    taken = collections.Counter()
    for r in out:
        for s in r.routed:
            taken[s] += r.size
    assert abs(taken["a"] - 210 * 10 / 10 * 1) <= 420 and taken["b"] > 0
    # b's own two documents are far too few for its quota: the shared ones go to b, and nothing is used twice before all is used once
    assert max(r.uses for r in out) - min(r.uses for r in out if r.doc_id >= 100) <= 2


def test_route_is_cheapest():
    flow = mixing.route({"x": (10, ("a",)), "xy": (10, ("a", "b")), "y": (2, ("b",))}, {"a": 10.0, "b": 12.0}, 3)
    assert flow == {"x": {"a": 10}, "xy": {"a": 0, "b": 10}, "y": {"b": 2}}


def test_quality(spark, docs, rows, no_docs):
    texts = [(1000 + i, ("fine plain words in a row. " * (5 + i % 7) if i % 2 else "###$$$ %%% BAD!! " * (5 + i % 5)), i % 2) for i in range(400)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"))
    labels = spark.createDataFrame([(t[0], t[2], 0) for t in texts] + [(None, 1, 0), (1000, None, 0), (1001, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(table, labels)
    out = quality.score_quality(table, model).collect()
    assert len(out) == len(rows) + 400
    known = {t[0]: t[2] for t in texts}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d in [*known, *(r[0] for r in rows)] if d is not None and zlib.crc32(str(d).encode()) % 3 == 1}
    assert all(r.predicted == known[r.doc_id] for r in held if r.doc_id in known)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    empty = {r.score for r in out if r.doc_id in (60, 61)}
    assert len(empty) == 1
    good = quality.keep_good(table, model)
    assert sorted(repr(r.doc_id) for r in good.collect()) == sorted(repr(r.doc_id) for r in out if r.predicted)
    nothing = quality.learn(no_docs, labels)
    assert {r.score for r in quality.score_quality(docs, nothing).collect()} == {0.5}
    assert quality.score_quality(no_docs, model).count() == 0


def test_quality_of_a_repeated_id(spark, prose):
    """One doc_id with most of the rows, repeated labels and labels of no document take no place of others in the sample."""
    good, bad = [prose(i, 80) for i in range(100)], [" ".join(["junk"] * 60) + "!" * (20 + i) for i in range(100)]
    texts = [(2 * i, g, 1) for i, g in enumerate(good)] + [(2 * i + 1, b, 0) for i, b in enumerate(bad)]
    hot = next(t for t in texts if zlib.crc32(str(t[0]).encode()) % 3 != 1)
    table = spark.createDataFrame([t[:2] for t in texts] + [hot[:2]] * 400, "doc_id long, text string")
    labels = [(t[0], t[2]) for t in texts] + [(hot[0], hot[2])] * 400 + [(10_000 + i, i % 2) for i in range(2000)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.score_quality(table, quality.learn(table, labels, sample=100)).collect()
    truth = {t[0]: t[2] for t in texts}
    held = [r for r in out if r.held_out]
    assert len({r.score for r in out}) > 1
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_mix_fills_its_targets(spark):
    """Long documents at the end of the flow leave no gap that shorter ones could fill; plain targets, counted by hand."""
    rows = [(i, "w " * 400, "a") for i in range(60)] + [(1000 + i, "w " * 10, "a") for i in range(700)] + [(5000 + i, "w " * 977, "b") for i in range(30)] + [(6000 + i, "w " * 3, "b") for i in range(1500)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = {"a": 60 * 400 + 7000, "b": 30 * 977 + 4500}
    target = {"a": sum(size.values()) * 5 / 7, "b": sum(size.values()) * 2 / 7}
    assert all(size[s] < target[s] or s == "b" for s in size)
    for s, least in (("a", 10), ("b", 3)):
        assert {r.target for r in out if r.source == s} == {target[s]}
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= least
    assert len(out) == len(rows) and max(r.uses for r in out) <= 3
    again = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    assert sorted((r.doc_id, r.uses) for r in out) == sorted((r.doc_id, r.uses) for r in again)
