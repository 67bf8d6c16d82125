import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_documents(seed: int = 5, n: int = 120):
    """Texts with exact and near copies, shared passages, junk, nulls, and ties."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(1, 7)))
    words = [word() for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = sentence(30)
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.15 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.35 and texts:
            w = (rng.choice(texts) or "x").split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
        elif kind < 0.45:
            texts.append(shared + "\n" + sentence(rng.randint(5, 90)))
        elif kind < 0.55:
            texts.append("\n".join([sentence(4)] * rng.randint(2, 5) + [sentence(9)] * 2))
        elif kind < 0.65:
            texts.append(" ".join(rng.choice(words) + rng.choice(["###", "***", "!!", " |"]) for _ in range(rng.randint(3, 60))))
        else:
            texts.append(sentence(rng.choice([1, 3, 4, 5, 6, 12, 80, 200])).capitalize() + ".")
    texts += [None, "", " \t\n ", "one", "One", "é", "a b c d", "A b  c\nd", "x" * 300, None, ""]
    return [(i, t, "en", rng.choice(["s1", "s2", "s3", None]), None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return made_documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows, tmp_path_factory):
    """The same rows with columns named like those that operators use inside, repeated ids and null ids."""
    path = str(tmp_path_factory.mktemp("clash") / "documents.parquet")
    df = spark.createDataFrame(rows[:40] + rows[:3] + [(None, "null id text of some words", "en", None, 1)] * 2, SCHEMA)
    for c in ("row", "h", "size", "kept", "keep_id", "sig", "w", "lines", "rank", "bin", "ids", "score", "label", "found", "keep", "x", "n"):
        df = df.selectExpr("*", f"'{c}' as {c}")
    df.withColumn("a.b `c`", F.lit(None).cast("int")).repartition(2).write.parquet(path)
    return spark.read.parquet(path)
