"""The pipeline's stages one after another against what each of them promises, and the registered SQL twins."""

import collections
import os
import re

import pytest

pytest.importorskip("public_tokenizers")
duckdb = pytest.importorskip("duckdb")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from panelweave.llm.line_dedup import dedup_lines  # noqa: E402
from panelweave.llm.queries import ORACLE, QUERIES  # noqa: E402
from panelweave.llm.substring_dedup import remove_repeats  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, docs, prose, tmp_path_factory):
    """Documents of which the shouting ones are labelled bad."""
    path = str(tmp_path_factory.mktemp("tables"))
    table = docs.selectExpr("*", "cast(coalesce(char_length(text), 0) as long) AS n_chars")
    bad = spark.range(500, 900).selectExpr("id AS doc_id", "repeat(concat('BAD!! $$$ ', id, ' %% '), 20) AS text", "'en' AS lang", "'s0' AS source", "1L AS n_chars")
    texts = {2000 + i: prose(2000 + i, 30 + i % 90) for i in range(300)}
    fine = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    table.unionByName(bad, allowMissingColumns=True).unionByName(fine, allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    good = table.where("doc_id IS NOT NULL").unionByName(fine, allowMissingColumns=True).selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    good.union(bad.selectExpr("doc_id", "0", "0")).write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == columns
            path = f"{folder}/{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        rows[name] = (out if name == "packing" else docs).collect()
    ids = {name: [r.doc_id for r in part] for name, part in rows.items()}
    assert not any(i is not None and 500 <= i < 900 for i in ids["quality"]) and {0, 1, 7, 71} <= set(ids["quality"])
    text = {r.doc_id: r.text for r in rows["line_dedup"]}
    assert {0, 1, 7, 71} <= set(text) and all(r.n_chars == len(r.text) for r in rows["line_dedup"] if r.text)
    kept = [r for r in rows["near_duplicates"] if r.text]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in kept)]
    assert not any(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a != {()} and b != {()})
    assert len(set(ids["near_duplicates"])) == len(ids["near_duplicates"])
    uses = collections.Counter(ids["mixture"])
    assert max(uses.values()) <= 3 and set(uses) <= set(ids["near_duplicates"])
    assert collections.Counter(r.doc_id for r in rows["packing"] if r.start == 0) == uses


def test_stages_without_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = -1")
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def test_texts_of_one_id_with_equal_short_hashes(spark, folder):
    """Different texts without an id, alike in a 32-bit hash, are told apart."""
    texts = spark.range(400_000).selectExpr("concat_ws(' ', sha2(string(id), 256), sha2(string(-id), 256)) AS text")
    clash = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("both")).where("size(both) > 1").limit(3).collect()
    assert clash
    first, second = zip(*(r.both[:2] for r in clash), strict=True)
    rows = [(None, t, "en", "s0", len(t)) for t in first + second]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    assert {r.text for r in pipeline.near_duplicates(spark, docs, folder).collect()} == set(first + second)
    mixed = collections.Counter(r.text for r in pipeline.mixture(spark, docs, folder).collect())
    assert set(mixed) == set(first + second) and len(set(mixed.values())) == 1
    lines = docs.unionByName(docs.selectExpr("-1L AS doc_id", "text", "lang", "source", "n_chars").where(F.col("text").isin(*first)))
    removed = [(r.doc_id, r.text, r.n_removed) for r in dedup_lines(lines).collect()]
    assert sorted(removed, key=repr) == sorted([(None, t, 0) for t in first + second] + [(-1, "", 1) for t in first], key=repr)
    kept = [(r.doc_id, r.kept) for r in remove_repeats(lines, 2, 2).collect()]
    assert sorted(kept, key=repr) == sorted([(None, "") for t in first] + [(None, t) for t in second] + [(-1, "") for t in first], key=repr)


def test_near_copies_without_an_id_or_sharing_one(spark, folder, prose):
    """Documents are told by id and text: of each group one stays, whatever its ids."""
    base, other, third = prose(1, 130), prose(2, 90), prose(3, 70)
    copy = base.rsplit(" ", 2)[0]
    rows = [(None, base), (None, copy), (None, other), (None, None), (None, None), (7, third), (7, third + " more"), (8, third), (9, prose(4, 80)), (9, prose(5, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, folder).collect()]
    assert len([t for i, t in kept if i is None and t in (base, copy)]) == 1
    assert sorted((i, t) for i, t in kept if i == 9) == sorted((i, t) for i, t in rows if i == 9)
    assert len([t for i, t in kept if i in (7, 8)]) == 1 and not any(i == 8 for i, _ in kept)
    assert (None, other) in kept and kept.count((None, None)) == 1 and len(kept) == 6
    # doc_id 2 has a near copy of document 1 and a text of its own.
    mixed = [(1, base), (2, copy), (2, other)]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in mixed], docs.schema)
    assert sorted((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, folder).collect()) == sorted([(1, base), (2, other)])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for name in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    df = QUERIES[key](spark, FOLDER)
    cursor = con.execute(ORACLE[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    plain = lambda names, rows: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=repr)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(columns, cursor.fetchall())
