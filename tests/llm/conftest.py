import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "sol") for b in ("na", "ter", "lim", "do", "pes")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every oddity: nulls, empty and very long texts, repeats, and columns whose names clash."""
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = text(60)
    rows = [(i, text(rng.randrange(1, 80)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, base, "en", "s0") for i in range(5)] + [(110 + i, f"{base} end{i}", "en", "s1") for i in range(5)]
    rows += [(None, base, "en", "s0"), (None, None, None, None), (200, None, "en", None), (201, "", None, ""), (202, " \n\t ", "en", "s1"), (203, "one", "en", "s1"), (203, "one", "en", "s1"), (204, "Zwei Wörter ÄÖ 😀", "de", "s2"), (205, text(30_000), "en", "s2"), (206, "x" * 70_000, "en", "s2"), (207, " " * 40_000 + "end", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(c) for c in ("key", "size", "score", "row", "fp", "h", "taken", "node", "gone", "n_dropped", "predicted", "k", "start", "label", "__k")}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(clash)


@pytest.fixture
def write_tables(spark, tmp_path):
    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
        return str(tmp_path / "in")

    return write
