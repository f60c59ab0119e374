"""Whitening, near-duplicate vectors and prefix tries against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelweave.llm import near_vectors, prefix_trie, whitening

CLASH = ["node", "cell", "unit", "key", "conv", "place", "block", "x"]


def vectors(spark, rows):
    schema = "vec_id long, embedding array<double>, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *["?"] * len(CLASH)) for r in rows], schema).repartition(3)


AWKWARD = [(900, None), (901, [math.nan] * 6), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.inf] + [1.0] * 5), (904, [])]


def test_whitening_against_numpy(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((300, 6)) @ draw.standard_normal((6, 6)) + [0, 5, 0, 0, -3, 0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, x[7].tolist()) for i in range(150)]  # a third are copies
    rows += [(None, x[8].tolist()), (3, x[3].tolist()), (650, [0.0] * 6)]
    other = [(905, [1.0] * 5), (906, [1e300] * 6)]
    out = whitening.whiten(vectors(spark, rows + AWKWARD + other), components=4).collect()
    whole = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(whole, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(4)])
    assert len(out) == 4 * len(rows) and {r.n for r in out} == {n}
    for vec_id, v in rows:
        w = np.floor(64 * np.array(v)).astype(np.int64) + 1_000_000
        own = sorted({(r.component, r.deviation, round(r.whitened, 10), r.explained) for r in out if r.vec_id == vec_id})
        assert [r[0] for r in own] == [1, 2, 3, 4]
        assert {r[1] for r in own} == {int(((n * w - sums) ** 2).sum())}
        assert np.allclose([r[2] for r in own], ((n * w - sums) / n) @ axes / np.sqrt(values), atol=1e-9)
        assert np.allclose([r[3] for r in own], values / np.trace(covariance), rtol=1e-9)
    assert Counter(r.vec_id for r in out)[3] == 8  # repeated rows stay
    assert all(r.identity_error < 1e-9 for r in out)


def test_whitening_in_many_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.standard_normal((97, 5)))]
    once = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows)).collect()}
    monkeypatch.setattr(whitening, "LEAST_ROWS", 4)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 2)
    cut = {(r.vec_id, r.component): r.whitened for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert once.keys() == cut.keys() and len(once) == 97 * 5
    assert max(abs(once[k] - cut[k]) for k in once) < 1e-9


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, AWKWARD[:4])).count() == 0
    assert whitening.whiten(vectors(spark, AWKWARD)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0])]).where("vec_id = 2")).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in flat} == {(1, False, 1.0), (2, True, 0.0)}


def test_deviation_is_exact_or_null():
    x = np.array([[1_000_000, 3], [1 << 55, 4]])
    centred, deviations = whitening._centred(x, whitening.Moments(2, [int(v) for v in x.sum(0)]))
    half = ((1 << 55) - 1_000_000) / 2
    assert centred.tolist() == [[-half, -0.5], [half, 0.5]] and deviations == [None, None]
    x = np.array([[1 << 40, 0], [0, 1]])
    n, sums = 1_000_003, [5, 7]
    assert whitening._centred(x, whitening.Moments(n, sums))[1] == [None, 25 + (n - 7) ** 2]
    x = np.array([[(1 << 31) // 3, 1]])
    assert whitening._centred(x, whitening.Moments(3, [1, 2]))[1] == [(3 * ((1 << 31) // 3) - 1) ** 2 + 1]


def linked(rows, cosine):
    """Links, components by smallest id, from all pairs."""
    def sound(v):
        return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)

    links = [set() for _ in rows]
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows):
            if i != j and None not in (a, b) and sound(x) and sound(y) and len(x) == len(y):
                x_, y_ = np.array(x) / np.abs(x).max(), np.array(y) / np.abs(y).max()
                if x_ @ y_ / (np.sqrt(x_ @ x_) * np.sqrt(y_ @ y_)) >= cosine:
                    links[i].add(j)
    out = []
    for i, (a, _) in enumerate(rows):
        seen, open_ = {i}, [i]
        while open_:
            new = links[open_.pop()] - seen
            seen |= new
            open_ += new
        least = min((rows[j][0] for j in seen), default=None) if a is not None else None
        out.append((a, len(links[i]), least, a is not None and a == least))
    return out


@pytest.mark.parametrize("noise", [0.02, 0.05, 0.25])
def test_near_vectors_against_all_pairs(spark, noise):
    """Tight groups fill cells, loose ones do not; with the last noise many pairs lie around the threshold."""
    draw = np.random.default_rng(4)
    around = draw.standard_normal(12)
    around /= np.linalg.norm(around)
    group = around + noise * draw.standard_normal((150, 12)) / np.sqrt(12) * 3
    rows = [(1000 + i, (v * draw.uniform(0.1, 10)).tolist()) for i, v in enumerate(group)]
    rows += [(i, v.tolist()) for i, v in enumerate(draw.standard_normal((80, 12)))]
    rows += [(2000 + i, rows[5][1]) for i in range(60)] + [(7, rows[9][1]), (3000, (1e200 * np.array(rows[5][1])).tolist())]
    rows += [(i, v) for i, v in AWKWARD] + [(910, [0.0] * 12), (911, [1.0] * 5), (912, [1.0] * 5), (None, rows[5][1]), (None, None)]
    out = near_vectors.link_near_vectors(vectors(spark, rows)).collect()
    got, want = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in out), Counter(linked(rows, 0.9))
    if noise < 0.2:
        assert got == want
    else:  # pairs at the threshold are found with the stated chance
        assert sum(r.n_links for r in out) >= 0.99 * sum(n for _, n, _, _ in linked(rows, 0.9))
        limit = {a: n for a, n, _, _ in linked(rows, 0.9)}
        assert all(r.n_links <= limit[r.vec_id] for r in out if r.vec_id not in (7, None))
    assert near_vectors.link_near_vectors(vectors(spark, rows).where("vec_id = -1")).count() == 0


def test_table_plan():
    for n in (1, 1000, 10**6):
        width, hashes, tables = near_vectors.table_plan(n)
        assert 1 - (1 - near_vectors.same_hash(math.sqrt(0.2), width) ** hashes) ** tables >= near_vectors.WANTED
        assert n * near_vectors.same_hash(math.sqrt(2), width) ** hashes <= near_vectors.STRANGERS
    draw = np.random.default_rng(5).standard_normal(200_000)
    offsets = np.random.default_rng(6).uniform(0, 2.0, 200_000)
    same = np.mean(np.floor(offsets / 2.0) == np.floor((offsets + 0.7 * draw) / 2.0))
    assert abs(same - near_vectors.same_hash(0.7, 2.0)) < 0.005


def trie(rows):
    """Rows of the trie from whole sequences."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    built = {}
    for c in convs:
        convs[c].sort()
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [(t[1], t[3]) for t in convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    out, leaves, saved = [], {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) or 1
        saved[k] = sum(saved[c] for c in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        hashed = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashed))
    return Counter(out)


@pytest.fixture(scope="module")
def talk(prose):
    said = [prose(i, 3 + i % 5) for i in range(6)]
    rows = [(c, t, ["user", "bot"][t % 2], said[(c // 40 + t * (c % 3)) % 6]) for c in range(-130, 330) for t in range(c % 9)]
    rows += [(c, t, "user", "the same") for c in range(1000, 1200) for t in range(7)]  # many equal ones
    rows += [(5000, t, "bot", f"long {t}") for t in range(900)] + [(5001, t, "bot", f"long {t}") for t in range(899)]  # long paths, shared
    rows += [(700, None, None, None), (700, None, "user", ""), (700, 3, None, "x" * 70_000), (700, 3, "bot", "tie"), (700, 3, "bot", "tie"), (700, -1, "été", "字"), (None, 0, "user", "nobody")]
    return rows + rows[:5]


def conversations(spark, rows):
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in ["conv", "place", "print", "depth", "n"])
    return spark.createDataFrame([(*r, *["?"] * 5) for r in rows], schema).repartition(3)


def result(df):
    return Counter(tuple(r)[:8] for r in df.collect())


def test_prefix_trie_against_sequences(spark, talk):
    out = prefix_trie.prefix_trie(conversations(spark, talk))
    assert result(out) == trie(talk)
    by_place = {}
    for r in out.where("depth > 0").collect():
        by_place[r.turn_conv_id, r.turn_place] = r
    assert all(place >= 1 for _, place in by_place)


def test_prefix_trie_in_many_parts(spark, talk, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PATH_ROWS", 16)
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 8)
    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", 2000)
    assert result(prefix_trie.prefix_trie(conversations(spark, talk))) == trie(talk)


def test_prefix_trie_notices_equal_fingerprints(spark, talk, monkeypatch):
    """With tiny primes different prefixes meet; the check sees it, and with large ones again the result is right."""
    monkeypatch.setattr(prefix_trie, "PRIMES", (11, 13))
    with pytest.raises(RuntimeError):
        prefix_trie.prefix_trie(conversations(spark, talk))


def test_prefix_trie_of_few(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [(1, 0, "a", "b")]).where("conv_id = 2")).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 0, "a", "b")])).count() == 0
    short = [(c, 0, "user", "short") for c in range(1, 40)]  # most are rebuilt without turns
    assert result(prefix_trie.prefix_trie(conversations(spark, short))) == trie(short)
    bare = [next((c, 0, "user", "x") for c in range(1, 50) if zlib.crc32(str(c).encode()) % 6)]
    assert result(prefix_trie.prefix_trie(conversations(spark, bare))) == trie(bare)
