import pytest

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards watch from a distant hill and say nothing at all to anyone"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, h long, x int, line string, n int, c int, tokens string"
TEXTS = [
    None, "", " \n\t\r\n ", "one two three", "one two three", "One  Two three", PASSAGE, PASSAGE, PASSAGE + " indeed",
    PASSAGE + "\n" + PASSAGE.upper() + "\n" + PASSAGE, "\n".join([PASSAGE] * 40), "é" * 333, "日本語 テキスト " * 60, "a" * 5000,
    "x y " * 3000, "\n\n" + PASSAGE + "\n\n" + PASSAGE.replace("quick", "slow") + "\n", "</s> <s> <pad> <unk> [UNK] <|endoftext|>",
    "# * $ % & | < > " * 9, "Straße ΑΣ İı ﬁ ½ é ​     ﻿ ▁▁ a▁b 😀👩‍👩‍👧", " ".join(f"w{i}" for i in range(20_000)),
    "zéro " * 19 + "ends é" + "zéro " * 21,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, copies, odd characters, extra columns of clashing names."""
    rows = [(i * 3 - 5, s, None if i % 4 == 0 else "en", None, None if s is None else len(s), "t", 1, 2, "l", 3, 4, "k") for i, s in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, odd, small):
    """The given small table, and the odd rows under ids below it."""
    given = spark.read.parquet(f"{small}/documents.parquet")
    return given.unionByName(odd.selectExpr("doc_id - 1000 AS doc_id", "* EXCEPT (doc_id)"), allowMissingColumns=True)


@pytest.fixture(scope="session")
def pairs(docs):
    """``(doc_id, text)`` in order, null texts as empty."""
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="session")
def repeats(spark, odd):
    """Repeated rows and rows without an id."""
    return odd.union(odd).union(odd.limit(4).selectExpr("CAST(NULL AS LONG) AS doc_id", "* EXCEPT (doc_id)"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
