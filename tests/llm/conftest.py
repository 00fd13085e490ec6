import random

import pytest

# Names that the operators use inside; a table may have such columns of its own.
CLASHING = "row id place fp key n size part language kept places label ids tie code group rank".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrst") for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs everywhere, empty and very long texts, repeated rows and ids, clashing columns."""
    rng = random.Random(5)
    shared = sentence(rng, 70)
    texts = {
        1: sentence(rng, 80),
        2: sentence(rng, 10) + " " + shared + "\n" + sentence(rng, 12),
        3: shared.upper() + "  " + shared,
        4: None,
        5: "",
        6: " \t\n\r\x0b\x0c ",
        7: sentence(rng, 60_000),
        8: "naïve café – привет мир 你好 " + shared,
        9: "one",
        10: "tick tock " * 60,
        11: "a\nb\na\n\n \na",
    }
    rows = [(i, t) for i, t in texts.items()]
    rows += [(None, shared), (None, None), (None, shared), (1, texts[1]), (1, texts[1]), (2, "another text " * 3)]
    data = [(i, t, "en" if i and i % 2 else None, None, *[f"{c}{i}" for c in CLASHING]) for i, t in rows]
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
