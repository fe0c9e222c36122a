"""SimHash, line dedup and embedding dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import common, embedding_dedup, line_dedup, simhash

BLANK = r"[\x20\x09-\x0D]"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_fingerprint(t):
    w = re.findall(BLANK.replace("[", "[^") + "+", lower(t))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(a) for a in range(n)]


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "A b C", "ÄÖ a\xa0b c d", "x y z " * 500, "w" * 9000 + " b c"])
@pytest.mark.parametrize("block", [7, 64, 4_000_000])
def test_fingerprint(text, block):
    assert simhash.fingerprint(text, block=block) == brute_fingerprint(text)


def test_spark_has_the_same_hash(spark):
    got = spark.sql("SELECT xxhash64('a b c')").first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_simhash_classes(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = sorted(((r[0], r[1], r[2]) for r in simhash.near_duplicates(odd_docs).collect()), key=str)
    known = [r for r in rows if r[0] is not None]
    fps = [brute_fingerprint(r[1]) for r in known]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    root = classes(len(fps), links)
    least = {}
    for k, c in enumerate(root):
        least[c] = min(least.get(c, known[k][0]), known[k][0])
    by_fp = {fps[k]: least[c] for k, c in enumerate(root)}
    want = sorted(((r[0], f"{brute_fingerprint(r[1]):016x}", by_fp.get(brute_fingerprint(r[1]))) for r in rows), key=str)
    assert got == want


@pytest.mark.parametrize("leaf_rows", [20, 100_000])
def test_trees_lose_no_link(spark, leaf_rows):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for _ in range(500):  # chains and clusters of near fingerprints
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, k) for k, x in enumerate(fps)], "fp long, rep long")
    got = common.connected_components(simhash.link_fingerprints(df, leaf_rows=leaf_rows)).collect()
    found = {r["node"]: r["component_id"] for r in got}
    root = classes(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert [found.get(k, k) for k in range(len(fps))] == root


def test_search_in_memory_divides_equal_halves():
    rng = np.random.default_rng(1)
    full = np.unique(np.concatenate([rng.integers(0, 2**32, 2000, dtype=np.uint64), np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 32, 40).astype(np.uint64))]))
    forest = common.Forest(len(full))
    simhash.near(full, np.zeros(len(full), np.uint32), np.ones(len(full), bool), 1, 3, forest, rng, leaf=16)
    a, b = np.nonzero(np.bitwise_count(full[:, None] ^ full[None]) <= 3)
    assert forest.root.tolist() == classes(len(full), zip(a, b))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(200)]
    df = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    found = {r["node"]: r["component_id"] for r in common.connected_components(df).collect()}
    ids = sorted({x for e in links if e[0] != e[1] for x in e})
    at = {x: k for k, x in enumerate(ids)}
    root = classes(len(ids), [(at[a], at[b]) for a, b in links if a != b])
    assert found == {x: ids[root[k]] for k, x in enumerate(ids)}
    assert common.connected_components(df.limit(0)).count() == 0


def brute_lines(rows, n):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add(i)
    gone = {k for k, ids in seen.items() if k and len(ids) >= n}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, odd_docs):
    rng = random.Random(5)
    common_lines = ["Shared Line", " shared line\t", "SHARED LINE\r", "ÄRA", "ära", "", "  ", "twice"]
    more = [(300 + i, "\n".join(rng.choice([*common_lines, f"own {i}"]) for _ in range(rng.randrange(1, 9)))) for i in range(40)] + [(None, "twice\ntwice"), (300, "twice"), (300, "twice")]
    rows = [(r[0], r[1]) for r in odd_docs.select("doc_id", "text").collect()] + more
    extra = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone string")
    for n in (3, 10):
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_shared_lines(extra, n).collect()), key=str)
        assert got == brute_lines(rows, n)
    kept = line_dedup.drop_shared_lines(odd_docs, 3)
    assert set(kept.columns) == set(odd_docs.columns) | {"n_lines", "n_dropped"} and kept.count() == odd_docs.count()
    assert line_dedup.drop_shared_lines(extra.limit(0), 3).count() == 0


def brute_links(rows, cosine=0.93):
    fine = [(v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None) for i, label, v in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if fine[a] and fine[b] and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = (np.array(rows[k][2], np.float64) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links.append((a, b))
    return links


@pytest.mark.parametrize("block", [8, 2048])
def test_embedding_dedup(spark, block):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            v = (centre + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.3])) * rng.uniform(0.1, 9)
            rows.append((i := i + 1, int(c % 3), [float(np.float32(x)) for x in v]))
    rows += [(i + 1 + k, 1, rows[0][2]) for k in range(6)] + [(i + 10 + k, 0, rows[0][2]) for k in range(3)]
    inf, nan = float("inf"), float("nan")
    rows += [(500, None, rows[0][2]), (501, 0, None), (502, 0, []), (503, 0, [0.0] * 16), (504, 0, [nan] * 16), (505, 0, [inf] + [1.0] * 15), (506, 0, rows[0][2][:8]), (507, 0, rows[0][2][:8]), (508, 0, [None] + [1.0] * 15)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, key string, w int")
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.near_duplicates(df, block=block).collect()}
    links = brute_links(rows)
    root = classes(len(rows), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    least = {}
    for k, c in enumerate(root):
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    assert got == {rows[k][0]: (n[k], least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows))}


def test_embedding_dedup_odd_inputs(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0
    rows = [(None, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, None, None)]
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, none.schema)).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, None)]


@pytest.mark.parametrize("block", [8, 2048])
def test_embedding_dedup_of_repeated_ids(spark, block):
    """Different vectors of one id keep their own links."""
    rng = np.random.default_rng(8)
    rows = []
    for c in range(4):
        centre = rng.normal(size=12)
        rows += [(int(rng.integers(1, 9)), 1, (centre + rng.normal(size=12) * 0.1).tolist()) for _ in range(12)]
    rows += [(1, 1, [1.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0]), (2, 1, [1.0, 0.1, 0.0]), (3, 1, [0.0, 1.0, 0.1])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=block).collect()
    links = brute_links(rows)
    root, n = classes(len(rows), links), np.bincount(np.array(links).ravel(), minlength=len(rows))
    least = {c: min(rows[k][0] for k, x in enumerate(root) if x == c) for c in root}
    assert sorted(map(tuple, got)) == sorted((rows[k][0], n[k], least[root[k]], rows[k][0] == least[root[k]]) for k in range(len(rows)))


def test_tables_catch_pairs_at_the_threshold():
    bits, tables = embedding_dedup.plan_tables(10**6, 0.93)
    agree = (1 - np.arccos(0.93) / np.pi) ** bits
    assert bits == 12 and (1 - agree) ** tables <= 1e-6
    assert embedding_dedup.plan_tables(0, 0.93) == embedding_dedup.plan_tables(100, 0.93)
