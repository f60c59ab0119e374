"""Both plans of every group primitive give the same rows, also for one hot group full of ties."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import groupwise as gw
from panelweave.operators import inference, portfolio, signals
from panelweave.operators import factors
from panelweave.operators.factors import redundant_pairs


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 else f"g{i % 7}"
        value = None if i % 17 == 0 else (0.0 if i % 4 == 0 else round(rng.gauss(0, 1), 2))
        rows.append((group if i % 50 else None, i, value))
    return pd.DataFrame(rows, columns=["g", "id", "x"])


def frame(spark, pdf):
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "g string, id long, x double")


@pytest.mark.parametrize("split", [False, True])
def test_average_rank_matches_pandas(spark, skewed, split):
    out = gw.with_average_rank(frame(spark, skewed), ["g"], {"r": "x"}, {"n": "x"}, split=split).toPandas()
    expected = skewed.copy()
    expected["r"] = skewed.groupby("g", dropna=False)["x"].rank()
    expected["n"] = skewed.groupby("g", dropna=False)["x"].transform("count")
    merged = out.sort_values("id").reset_index(drop=True)
    pd.testing.assert_series_equal(merged["r"], expected["r"], check_names=False)
    assert merged["n"].tolist() == expected["n"].tolist()


@pytest.mark.parametrize("split", [False, True])
def test_quantiles_match_pandas(spark, skewed, split):
    out = gw.with_quantiles(frame(spark, skewed), ["g"], "x", {"lo": 0.2, "hi": 0.8}, split=split).toPandas()
    wanted = skewed.groupby("g", dropna=False)["x"].quantile([0.2, 0.8]).unstack()
    for g, lo, hi in out[["g", "lo", "hi"]].drop_duplicates().itertuples(index=False):
        row = wanted[wanted.index.isna()].iloc[0] if g is None else wanted.loc[g]
        assert lo == pytest.approx(row[0.2]) and hi == pytest.approx(row[0.8])


@pytest.mark.parametrize("split", [False, True])
def test_group_totals_keep_null_group(spark, skewed, split):
    out = gw.with_group_totals(frame(spark, skewed), ["g"], {"s": F.sum("x")}, split=split).toPandas()
    assert len(out) == len(skewed)
    sums = skewed.groupby("g", dropna=False)["x"].transform("sum")
    assert out.sort_values("id")["s"].tolist() == pytest.approx(sums.tolist())


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_position_is_a_total_order(spark, skewed, split, descending):
    pdf = skewed.fillna({"x": 0.0})
    out = gw.with_position(frame(spark, pdf), ["x", "id"], descending, split=split).toPandas()
    order = pdf.sort_values(["x", "id"], ascending=[not descending, True])["id"].tolist()
    assert out.sort_values("rank")["id"].tolist() == order
    assert sorted(out["rank"]) == list(range(1, len(pdf) + 1))


def brute_bh(pvalues):
    ordered = sorted(pvalues)
    n = len(ordered)
    return [min(min(1.0, ordered[j] * n / (j + 1)) for j in range(n) if ordered[j] >= p) for p in pvalues]


@pytest.mark.parametrize("split", [False, True])
def test_benjamini_hochberg_matches_brute_force(spark, split):
    rng = random.Random(3)
    rows = [(("a" if i % 3 else "b") if i % 19 else None, i, 1.0 if i % 5 == 0 else round(rng.random() ** 3, 3)) for i in range(240)]
    df = spark.createDataFrame(rows, "g string, id long, p_value double")
    out = {r.id: r.q_value for r in inference.benjamini_hochberg(df, ["g"], split=split).collect()}
    for g in ("a", "b", None):
        members = [(i, p) for k, i, p in rows if k == g]
        for (i, _), q in zip(members, brute_bh([p for _, p in members]), strict=True):
            assert out[i] == pytest.approx(q)


def test_split_plan_gives_the_same_portfolio(spark):
    rng = random.Random(11)
    rows = [
        ("v", d, f"S{s:02d}", round(rng.gauss(0, 1), 1), rng.gauss(0, 0.05), 0.2, s % 5 != 0)
        for d in range(6)
        for s in range(25)
    ]
    df = spark.createDataFrame(
        rows, "variant string, date int, symbol string, signal double, fwd double, quantile double, ok boolean"
    )

    def book(split):
        held = portfolio.build_positions(df, [0.2], F.col("ok"), split)
        weights = {(r.date, r.symbol): round(r.weight, 12) for r in held.collect()}
        ic = portfolio.information_coefficient(df, split=split)
        return weights, {r.date: round(r.ic, 10) for r in ic.collect()}

    assert book(False) == book(True)


def test_split_plan_gives_the_same_redundant_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        a = rng.gauss(0, 1)
        rows.append((i, None if i % 13 == 0 else a, a + rng.gauss(0, 0.2), rng.gauss(0, 1)))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    found = [
        [(r.first, r.second, round(r.correlation, 10), r.n_rows) for r in redundant_pairs(df, ["a", "b", "c"], split=s).collect()]
        for s in (False, True)
    ]
    pdf = pd.DataFrame(rows, columns=["id", "a", "b", "c"])
    assert found[0] == found[1]
    assert found[0][0][:2] == ("a", "b")
    assert found[0][0][2] == pytest.approx(pdf[["a", "b"]].corr(method="spearman").loc["a", "b"])


def test_percent_rank_is_not_percent_rank_function(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 3.0), (1, None)], "date int, x double")
    out = sorted(r.p for r in signals.with_percent_ranks(df, {"p": "x"}).collect() if r.p is not None)
    assert out == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3])


def test_input_bytes_counts_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    assert 0 < gw.input_bytes(spark.read.parquet(path)) < gw.COMPACT_INPUT_BYTES
    assert not gw.needs_split(spark.read.parquet(path))


def test_largest_group_decides_above_the_byte_limit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(1000).select((F.col("id") % 3 == 0).alias("g"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    assert gw.largest_group(df, ["g"]) == 666
    monkeypatch.setattr(gw, "COMPACT_INPUT_BYTES", 1)
    assert not gw.needs_split(df, keys=["g"])
    assert not gw.needs_split(df)  # without keys the rows of the table decide, not its bytes
    monkeypatch.setattr(gw, "GROUP_ROWS", 600)
    assert gw.needs_split(df, keys=["g"])
    assert gw.needs_split(df)


def test_staged_tables_can_be_released(spark):
    import os

    from panelweave.session import release_staged, shared_folder, stage

    release_staged(spark)
    kept = stage(spark.range(10), "unit")
    assert kept.count() == 10
    assert any("panelweave-unit" in n for n in os.listdir(shared_folder(spark)))
    assert release_staged(spark) == 1
    assert not any("panelweave-unit" in n for n in os.listdir(shared_folder(spark)))


def test_redundant_pairs_of_many_masks(spark, monkeypatch):
    """Pairs with the same rows share ranks, with any null patterns, ties and constant factors; both plans and no masks agree."""
    rng = random.Random(5)
    names = [f"f{i}" for i in range(8)]
    rows = []
    for i in range(300):
        base = rng.gauss(0, 1)
        row = [base, base + rng.gauss(0, 0.3), float(round(base)), -base, rng.gauss(0, 1), 1.0, base * 2, base]
        rows.append(tuple(None if (j in (1, 3) and i < 20) or (j == 2 and i < 60) or (j == 4 and rng.random() < 0.2) or (j == 7 and i > 20) else v for j, v in enumerate(row)))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    truth = pd.DataFrame(rows, columns=names).corr(method="spearman", min_periods=30)
    counts = pd.DataFrame(rows, columns=names).notna().astype(int)
    want = {(a, b): (truth.loc[a, b], int((counts[a] * counts[b]).sum())) for i, a in enumerate(names) for b in names[i + 1 :] if abs(truth.loc[a, b]) >= 0.5}

    def found(split):
        return {(r.first, r.second): (r.correlation, r.n_rows) for r in redundant_pairs(df, names, 0.5, split=split).collect()}

    for split in (False, True):
        assert found(split).keys() == want.keys()
        assert all(found(split)[k] == pytest.approx(want[k]) for k in want)
    assert not redundant_pairs(df.where("f5 > 5"), names).collect()
    monkeypatch.setattr(factors, "MOST_PATTERNS", 1)
    assert found(False).keys() == want.keys()


def test_redundant_pairs_order_every_value_once(spark, monkeypatch):
    """One entry per value whatever the null patterns, and equal values that lie in several ranges share their rank."""
    rng = random.Random(11)
    names = ["a", "b", "c", "d"]
    rows = []
    for _ in range(300):
        x = float(rng.randrange(-2, 3)) if rng.random() < 0.8 else rng.gauss(0, 2)
        rows.append(tuple(None if rng.random() < 0.1 else v for v in (x, x + rng.choice([0.0, 0.0, 1.0]), -x, rng.gauss(0, 1))))
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(factors, "VALUES_PER_TASK", 60)
    made = []
    numbered = factors._centred_ranks
    monkeypatch.setattr(factors, "_centred_ranks", lambda *args: made.append(numbered(*args)) or made[-1])
    found = {(r.first, r.second): (r.correlation, r.n_rows) for r in redundant_pairs(df, names, 0.0).collect()}
    pdf = pd.DataFrame(rows, columns=names)
    assert made[0].count() == pdf.notna().to_numpy().sum()
    truth = pdf.corr(method="spearman")
    assert len(found) == 6
    for (a, b), (correlation, n_rows) in found.items():
        assert correlation == pytest.approx(truth.loc[a, b])
        assert n_rows == (pdf[a].notna() & pdf[b].notna()).sum()
