import random

import pytest

from veil.llm.common import ship

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "cid bigint, row bigint, spans string, kept string, tag int, marks string, ids string, s string, comp bigint"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "and", "Tree", "river", "stone", "cloud", "é", "日本", "x1"]) + str(rng.randrange(40)) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Null and empty texts, white space only, one word, repeated rows, copies, near copies, a very long text."""
    base = words(1, 300)
    near = base.split(" ")
    near[7], near[150] = "changed", "too"
    long = words(2, 60_000)
    texts = [None, "", " \n\t\x0b ", "word", base, base, " ".join(near), long, base.upper(), "a\x00b c\u00a0d " * 30,
             words(3, 80) + "\n" + words(3, 80) + "\n" + words(4, 40), "x" * 40_000]
    rows = [(k + 1, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[0], (None, base, None, None, 5), (None, None, None, None, None), (-7, base + " end", "en", "s9", 1)]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(*r, 1, 2, "a", "b", 3, "c", "d", "e", 4) for r in awkward_rows()]
    return spark.createDataFrame(rows, f"{COLUMNS}, {CLASH}").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"{COLUMNS}, {CLASH}")
