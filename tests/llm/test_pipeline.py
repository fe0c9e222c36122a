"""The pipeline's stages on a small table, each against a plain version on its own input."""

import base64
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bpe, mixing
from tests.llm.test_dedup import brute_lines
from tests.llm.test_near_copies import check_kept
from tests.llm.test_text import judged  # noqa: F401


@pytest.fixture
def tables(spark, judged, odd_docs, write_tables):  # noqa: F811
    docs, labels, _ = judged
    shared = F.concat_ws("\n", "text", F.when(F.col("doc_id") % 20 == 0, "A line that many share"), F.when(F.col("doc_id") % 7 == 0, "end"))
    more = docs.select((F.col("doc_id") + 1000).alias("doc_id"), shared.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("doc_id") % 4).alias("source"))
    base = odd_docs.select("doc_id", "text", "lang", "source").unionByName(more).withColumn("n_chars", F.length("text").cast("long"))
    return write_tables(documents=base, labels=labels.withColumn("doc_id", F.col("doc_id") + 1000))


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], tables)
        assert k == 4 or out.columns == columns and out.schema["text"].dataType.simpleString() == "string", name
        out.write.parquet(str(tmp_path / f"out{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"out{k}")))
    rows = [[(r["doc_id"], r["text"]) for r in d.collect()] for d in seen[:5]]
    assert 0.5 * len(rows[0]) < len(rows[1]) < len(rows[0]) and not Counter(map(str, rows[1])) - Counter(map(str, rows[0]))
    assert sorted(map(str, rows[2])) == sorted(str(r[:2]) for r in brute_lines(rows[1], 10))
    assert any("A line that many share" in (t or "") for _, t in rows[1]) and not any("A line that many share" in (t or "") for _, t in rows[2])
    assert seen[2].where("n_chars <> length(text)").count() == 0
    check_kept(rows[2], rows[3])
    times = Counter(i for i, _ in rows[4])
    want = Counter()
    for r in mixing.mix(seen[3], by=tuple(columns))[0].where("size > 0").collect():
        want[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5)
    assert times == +want and max(times.values()) <= 3
    path, pattern = bpe.production()
    with open(path, "rb") as f:
        own = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    got = sorted((str(r["doc_id"]), r["ids"]) for r in seen[5].collect())
    assert got == sorted((str(i), own.encode_ordinary(t or "")) for i, t in rows[4])


def test_stages_keep_columns_that_clash(spark, tables):
    names = ("score", "predicted", "n_lines", "n_dropped", "a", "b", "h", "g", "class", "__id", "__gone", "__h", "row", "key", "size", "taken")
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in names})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and out.count()
        assert out.where(" OR ".join(f"`{c}` <> concat('{c}', coalesce(doc_id, 0))" for c in names)).count() == 0


def test_whole_run_and_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).where("n_tokens <> size(ids)").count() == 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
