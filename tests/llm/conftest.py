import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "字", "x.", "y,", "100", "z!"]


def words_of(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return "".join(draw.choice(WORDS) + str(draw.randint(0, 60)) + draw.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return words_of


@pytest.fixture(scope="session")
def rows(prose):
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies and shared passages."""
    base, passage = prose(1, 130), prose(2, 60)
    out = [(i, prose(10 + i, 40 + 7 * i), "en", f"s{i % 3}") for i in range(8)]
    words = base.split(" ")
    for i in range(20, 32):  # near copies that differ in a word or two
        edited = list(words)
        edited[(i * 7) % len(words)] = f"edit{i}"
        out.append((i, " ".join(edited), "en", "s0"))
    out += [(40, base, "en", "s1"), (41, base, "de", None), (42, base.upper(), "de", "s2"), (43, "  " + base, "de", "s2")]
    out += [(50, prose(50, 20) + passage + prose(51, 15), "fr", "s1"), (51, passage, "fr", "s2"), (52, prose(52, 5) + passage + passage, "fr", "s0")]
    out += [(60, None, None, "s0"), (61, "", "en", None), (62, " \n\t ", "en", ""), (63, "one", "en", "s1"), (64, "one two three", "en", "s1"), (65, "one", "en", "s1")]
    out += [(70, "a " * 400, "en", "s2"), (71, prose(71, 4000), "en", "s2")]
    out += [(80, prose(80, 50), "en", "s3")] * 3  # repeated rows
    out += [(None, prose(81, 50), None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with further columns, whose names operators use themselves."""
    clash = ["node", "token", "n", "key", "line", "name", "size", "uses", "packed", "version", "_line", "_doc", "place"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in clash)
    return spark.createDataFrame([(*r, *["?"] * len(clash)) for r in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id = -1")
