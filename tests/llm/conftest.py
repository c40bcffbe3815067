import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, and columns that clash with ours."""
    rng = random.Random(7)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:110], "other", *words[111:]])
    texts = [base, base, near, base.upper(), None, "", " \t\n", "one", "ONE", "two words", "a b c d e", "x\x00y ▁ é́ \U0001f600\r\n  end ", prose(rng, 3000), "word " * 4000, "z" * 500, *(prose(rng, rng.randrange(5, 60)) for _ in range(40))]
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "a", "b", "")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, "null id " + base, None, None, None), (None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(3)
    for name in ("score", "n", "node", "size", "block", "bucket", "held_out", "spans", "label", "kind"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
