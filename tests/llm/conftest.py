import random

import pytest

#: Columns whose names operators use for themselves.
CLASHES = "row string, key1 string, key2 long, marks string, hits string, items string, toxic string, toxicity string, ids string, component_id string, kept string, rep long, cluster long, labelled string, score string, words string, n_words string, part int, key string, q long, rule string"


def sentences(seed: int, n: int, pool: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Documents with nulls, empty and very long texts, copies, near copies, shared passages and other alphabets."""
    base = [sentences(i, 120, 5000) for i in range(12)]
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    rows += [(100, base[3]), (101, base[3].upper()), (102, base[3] + " tail"), (103, " ".join(base[4].split()[:-2] + ["x", "y"]))]
    passage = sentences(99, 60, 9000)
    rows += [(110 + i, f"{sentences(200 + i, 30, 9000)} {passage} {sentences(300 + i, 20, 9000)}") for i in range(5)]
    rows += [(120, passage + " " + passage), (121, None), (122, ""), (123, " \n\t "), (124, "one"), (125, "One"), (126, "two words"), (127, "é É ß 日本語 " * 30), (None, "without a number"), (None, None), (7, base[7])]
    rows.append((130, sentences(5, 60_000, 20_000)))
    rows += [(140 + i, f"{' '.join(base[5].split()[: 118 - i])} {'z ' * i}") for i in range(8)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    names = [c.split()[0] for c in CLASHES.split(", ")]
    rows = [(i, t, "en", None, None, *([None] * len(names))) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark, docs):
    return spark.createDataFrame([], docs.schema)
