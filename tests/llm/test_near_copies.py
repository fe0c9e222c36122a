"""The pipeline's near-copy stage against brute-force Jaccard similarity of five-word sets."""

import random

import numpy as np

import corpus_pipeline
from graphloom.llm import common, simhash
from tests.llm.conftest import WORDS
from tests.llm.test_dedup import classes


def brute_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b, least=0.8):
    return not (a or b) or len(a & b) / len(a | b) >= least


def edited_texts(n, seed=4):
    """Texts with copies of one to three changed or added words, about the threshold."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randrange(30, 200))]
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + len(base) // 25 + 1)):
                copy[rng.randrange(len(copy))] = "changed"
            out.append(" ".join(copy + ["more"] * rng.randrange(2)))
    return out + ["one two", "One  two", "one two three", "", " \n"]


def test_stage_against_brute_force(spark):
    texts = edited_texts(80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [brute_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b])]
    fps = [simhash.fingerprint(t) for t in texts]
    assert sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in pairs) > 50
    root = classes(len(sets), pairs)
    got = corpus_pipeline.without_near_copies(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(root))
    split = simhash.similar_documents(docs, block=2, leaf_rows=40)
    assert {r["doc_id"]: r["component_id"] for r in split.collect()} == {k: min(i for i, x in enumerate(root) if x == r) for k, r in enumerate(root)}


def check_kept(rows, kept):
    """``kept`` has one of the (id, text) of each class of ``rows``: one of the smallest id, null last."""
    known = sorted(set((i, t or "") for i, t in rows), key=str)
    sets = [brute_set(t) for _, t in known]
    root = classes(len(known), [(a, b) for a in range(len(known)) for b in range(a) if alike(sets[a], sets[b])])
    order = lambda i: (i is None, i or 0)
    least = {}
    for (i, _), c in zip(known, root):
        least[c] = min(least.get(c, i), i, key=order)
    at = {x: c for x, c in zip(known, root)}
    found = [at[i, t or ""] for i, t in kept]
    assert sorted(found) == sorted(set(root)) and all(order(i) == order(least[c]) for (i, _), c in zip(kept, found))


def test_repeated_ids_lose_no_text(spark):
    texts = edited_texts(12, seed=9)
    rows = [(k % 7 if k % 5 else None, t) for k, t in enumerate(texts)] + [(3, texts[0]), (3, texts[0]), (5, texts[0]), (5, None), (6, texts[9] + " end")]
    docs = spark.createDataFrame([(*r, k % 2) for k, r in enumerate(rows)], "doc_id long, text string, a int")
    got = corpus_pipeline.without_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    check_kept(rows, [r[:2] for r in got.collect()])
    again = corpus_pipeline.without_near_copies(spark, docs.repartition(3, "a"), "")
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_crowded_shards_are_dealt(spark):
    texts = edited_texts(20, seed=6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, dealt = ({r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, **how).collect()} for how in ({}, {"most": 15, "block": 3}))
    assert whole == dealt
    fps = spark.createDataFrame([(k ^ (k << 33), k) for k in range(300)], "fp long, rep long")
    found = [{r["node"]: r["component_id"] for r in common.connected_components(simhash.link_fingerprints(fps, **how)).collect()} for how in ({}, {"most": 40})]
    assert found[0] == found[1]


def test_plan_of_parts():
    parts, differ = simhash.plan_parts(0.8)
    assert (1 - 0.8**4) ** (2 * parts) <= 1e-6 and 0.1 * 8 * parts < differ < 0.4 * 8 * parts
    assert simhash.similar([np.array(x, np.uint64) for x in ([1, 2, 3, 4, 5], [9], [1, 2, 3, 4], [1, 2, 3])], 0.8).tolist() == [0, 1, 0, 3]
