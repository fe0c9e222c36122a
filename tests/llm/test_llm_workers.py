"""The training-data operators on plain DataFrames, from another folder and without the package on the workers' path."""

from tests.test_workers import run

MORE = """
from graphloom.llm import bpe, embedding_dedup, licenses, line_dedup, media, mixing, quality, simhash, tool_calls, toxicity
docs = spark.createDataFrame([(k, f"some words {{k % 3}} and more of them", "s") for k in range(12)], "doc_id long, text string, source string")
labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)], "doc_id long, quality int, toxic int")
assert simhash.near_duplicates(docs).count() == 12 and simhash.one_of_each(docs).count() == 3
assert line_dedup.drop_shared_lines(docs, 3).count() == 12 and mixing.apply_mix(docs).count() == 12
assert quality.accepted(docs, *quality.fit(docs, labels)).count() <= 12 and toxicity.score(docs, toxicity.fit(docs, labels)).count() == 12
assert bpe.encode(docs, *bpe.production()).count() == licenses.scan(docs).count() == 12
vectors = spark.createDataFrame([(k, 1, [1.0, float(k % 2)]) for k in range(6)], "vec_id long, label int, embedding array<float>")
assert embedding_dedup.near_duplicates(vectors).where("n_links = 2").count() == 6
images = media.render(vectors)
assert media.copy_classes(images, images.where("media_id = 0")).count() == 6
"""


def test_operators_elsewhere(tmp_path):
    run(MORE.replace("{{", "{").replace("}}", "}"), tmp_path)
