"""Nearest neighbours and quotation linking against plain versions."""

import json

import numpy as np

from panelweave.llm import hash_forest, quotations


def test_nearest(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, v.tolist(), "?") for i, v in enumerate(draw.standard_normal((400, 8)) * draw.uniform(0.5, 2, (400, 1)))]
    vectors += [(1000 + i, vectors[3][1], "?") for i in range(40)]  # copies
    awkward = [(2000, None, "?"), (2020, [0.0] * 8, "?"), (2040, [1.0] * 7, "?"), (2060, [float("nan")] + [1.0] * 7, "?"), (2080, [1.0, None] + [1.0] * 6, "?"), (2100, [float("inf")] + [1.0] * 7, "?"), (None, [1.0] * 8, "?")]
    df = spark.createDataFrame(vectors + awkward + vectors[:5], "vec_id long, embedding array<double>, node string")
    out = hash_forest.nearest(df).collect()
    ids, x = np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors])
    assert {r.query_id for r in out} == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q in {r.query_id for r in out}:
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        score = (x * x[ids == q][0]).sum(1)
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 and r.vec_id != q for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        others = np.where(ids == q, -np.inf, score)
        best = ids[np.lexsort((ids, -others))][:20]
        hits += len({r.vec_id for r in own} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9
    assert hash_forest.nearest(df.where("vec_id = -1")).count() == 0
    few = hash_forest.nearest(df.where("vec_id < 5")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, i) for i in range(1, 5)]


def test_nearest_of_many_ties(spark, monkeypatch):
    """All vectors of +-1 in 10 dimensions: whole shells are equally near, and the smaller ids of them count."""
    monkeypatch.setattr(hash_forest, "GROUP_QUERIES", 8)
    x = np.array([[1.0 if i >> b & 1 else -1.0 for b in range(10)] for i in range(1024)])
    ids = np.random.default_rng(2).permutation(5000)[:1024]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    out = hash_forest.nearest(df, wanted=0.999999).collect()
    for n in np.flatnonzero(ids % 20 == 0):
        score = np.where(np.arange(1024) == n, -np.inf, x @ x[n])
        best = np.lexsort((ids, -score))[:20]
        own = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == ids[n])
        assert [(v, s) for _, v, s in own] == [(int(ids[b]), float(score[b])) for b in best]


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello  there\nHow are you?", "?"),
        (1, 1, "bot", "> hello there\n> how ARE you?\nFine, thanks", "?"),
        (1, 2, "user", ">> Hello there\n>> How are you?\n> Fine, thanks\nGood\n> unknown words\nto hear", "?"),
        (1, 3, "bot", "> how are you?\nSelective", "?"),
        (1, 4, "bot", "unrelated", "?"),
        (1, 5, "bot", "> > good\n> selective\n> to hear\n", "?"),
        (2, 0, "user", "> Fine, thanks\nfrom elsewhere", "?"),
        (2, 1, "user", None, "?"),
        (2, 2, None, "", "?"),
        (2, 2, "user", "later text", "?"),
        (2, 2, "user", "later text", "?"),
        (2, 3, "user", ">later text\nanswer", "?"),
        (2, None, "user", "no turn", "?"),
        (None, 0, "user", "x" * 50_000, "?"),
        (None, 1, "user", "> " + "x" * 50_000, "?"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string")
    out = quotations.link_quotations(df).collect()
    assert len(out) == len(rows)
    at = {(r.conv_id, r.turn, r.role): r for r in out}
    assert at[1, 1, "bot"].content == "Fine, thanks" and at[1, 1, "bot"].parent_turn == 0
    assert at[1, 2, "user"].content == "Good\nto hear" and at[1, 2, "user"].parent_turn == 1
    assert (at[1, 2, "user"].n_quotes, at[1, 2, "user"].n_linked, at[1, 2, "user"].reply_depth) == (3, 2, 2)
    assert at[1, 3, "bot"].parent_turn == 0 and at[1, 4, "bot"].parent_turn is None
    assert at[1, 5, "bot"].parent_turn == 3 and at[1, 5, "bot"].content == "" and at[1, 5, "bot"].root_turn == 0
    assert at[2, 0, "user"].parent_turn is None and at[2, 0, "user"].n_linked == 0
    assert at[2, 1, "user"].content == "" and at[2, 3, "user"].parent_turn == 2
    assert at[None, 1, "user"].parent_turn == 0 and at[2, None, "user"].turn is None
    assert json.loads(at[1, 1, "bot"].message) == {"role": "bot", "content": "Fine, thanks"}
    for conv in (1, 2, None):
        own = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
    assert [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)] == [0, 1, 2, 3, 5, 4]
    assert quotations.link_quotations(df.where("turn = 99")).count() == 0
