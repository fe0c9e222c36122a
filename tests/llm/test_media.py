"""Image descriptors: edits keep them, other images don't match, a hash table loses no close pair it should hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import media


def images(n, seed=0, side=80):
    rng = np.random.default_rng(seed)
    a = media.box(media.box(rng.normal(size=(n, side, side)).astype(np.float32), 2), 1)
    return np.clip(128 + 50 * (a - a.mean((1, 2), keepdims=True)) / a.std((1, 2), keepdims=True), 0, 255).astype(np.uint8)


def test_pgm():
    a = images(1)[0]
    assert (media.decode_pgm(media.encode_pgm(a)) == a).all()
    for bad in (None, b"", b"P5", b"P6\n2 2\n255\n0000", b"P5\n9 9\n255\nxx", b"P5\n0 2\n255\n"):
        assert media.decode_pgm(bad) is None
    assert media.decode_pgm(b"P5\n# note\n2 1\n255\n\x01\x02").tolist() == [[1, 2]]


def test_recall_of_edits_against_all_pairs(spark):
    n = 60
    rows = [(k, media.encode_pgm(a)) for k, a in enumerate(images(n))]
    asked = [(k, media.encode_pgm(media.edited(media.decode_pgm(b), k))) for k, b in rows]
    schema = "media_id long, image binary"
    got = media.find_copies(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)).collect()
    pairs = {(r["query_id"], r["media_id"]) for r in got}
    assert sum((k, k) in pairs for k in range(n)) >= 0.95 * n and len([p for p in pairs if p[0] != p[1]]) <= 1
    by_class = {r["media_id"]: r for r in media.copy_classes(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema)).collect()}
    for k in range(n):
        own = [p for p in pairs if p[1] == k]
        assert by_class[k]["n_links"] == len(own) and (by_class[k]["query_id"] == k) == ((k, k) in pairs)
    turned = next(r for r in got if r["query_id"] == r["media_id"] == 1)
    assert abs(abs(turned["angle"]) % np.pi - np.pi / 2) < 0.05 and abs(turned["scale"] - 1) < 0.05
    crop = next(r for r in got if r["query_id"] == r["media_id"] == 4)
    assert abs(crop["dx"] + 4) < 1 and abs(crop["dy"] + 8) < 1


def test_classes_tie_queries_together(spark):
    """Two queries that no image matches alone, and an image that matches both."""
    a = images(3)
    both = np.hstack([a[0], a[1]])
    enc = lambda x: bytearray(media.encode_pgm(x))
    df = spark.createDataFrame([(0, enc(a[0])), (1, enc(a[1])), (2, enc(a[2])), (9, enc(both))], "media_id long, image binary")
    got = {r["media_id"]: (r["n_links"], r["component_id"]) for r in media.copy_classes(df, df.where("media_id < 3")).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 9: (2, 0)}


def test_scale(spark):
    a = images(1, 3, 160)[0]
    small = np.clip(media.resized(a[None].astype(np.float32), 1.4)[0], 0, 255).astype(np.uint8)
    q, p = media.describe_all([small, a])
    i, j = media.matched(q, p, 56)
    best = media.consensus(q[i], p[j], 4)
    assert best[0] >= 8 and best[1] == pytest.approx(1 / 1.4, rel=0.1)


def test_tables_hold_what_brute_force_finds():
    a = np.concatenate(media.describe_all(list(images(6, 1))))
    rng = np.random.default_rng(2)
    differ, bits, tables = 16, *media.plan_tables(30_000, 16, 0.1)
    missed = 0
    for k in range(len(a)):
        noisy = a[k : k + 1].copy()
        own = np.unpackbits(noisy["bits"], axis=1)
        own[0, rng.permutation(256)[:differ]] ^= 1
        noisy["bits"] = np.packbits(own, axis=1)
        missed += not len(np.intersect1d(media.keys([a[k : k + 1]], bits, tables)[1], media.keys([noisy], bits, tables)[1]))
        assert [x.tolist() for x in media.matched(a[k : k + 1], noisy, differ)] == [[0], [0]] and not len(media.matched(a[k : k + 1], noisy, differ - 1)[0])
    assert missed <= 0.14 * len(a)
    i, j = media.matched(a, a, differ)
    brute = np.argwhere(np.bitwise_count(a["bits"][:, None] ^ a["bits"][None]).sum(2) <= differ)
    assert np.array_equal(np.stack([i, j], 1), brute)


def test_pairs_are_those_of_brute_force(spark):
    """Every image against every query by all pairs of descriptors: noise, copies of images within others, close drawings."""
    rng, a = np.random.default_rng(5), images(24, 9)
    near = [np.clip(a[k] + rng.normal(0, s, a[k].shape), 0, 255).astype(np.uint8) for k, s in enumerate((3, 6, 9, 14, 20, 30))]
    rows = [(k, x) for k, x in enumerate([*a, *near])] + [(100, np.hstack([a[0], a[1]])), (101, a[2]), (5, a[3])]
    asked = [(k, media.edited(x, k)) for k, x in enumerate(a[:12])] + [(50, media.edited(a[4], 0))]
    pq, pm = media.describe_all([x for _, x in asked]), media.describe_all([x for _, x in rows])
    want = set()
    for q, x in zip(asked, pq):
        for r, y in zip(rows, pm):
            i, j = media.matched(x, y, 16)
            if len(i) >= 8 and media.consensus(x[i], y[j], 4.0)[0] >= 8:
                want.add((q[0], r[0]))
    schema = "media_id long, image binary"
    frames = [spark.createDataFrame([(k, bytearray(media.encode_pgm(x))) for k, x in part], schema) for part in (rows, asked)]
    got = {(r["query_id"], r["media_id"]) for r in media.find_copies(*frames).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 16
    classes = {(r["media_id"], r["n_links"], r["component_id"]) for r in media.copy_classes(*frames).collect()}
    assert (101, 1, 2) in classes and (5, 1, 3) in classes and (100, 2, 0) in classes and (23, 0, 23) in classes


def test_repetitive_images_take_bounded_memory():
    board = np.kron(np.indices((20, 20)).sum(0) % 2, np.ones((8, 8))).astype(np.uint8) * 200
    (p,) = media.describe_all([board])
    i, j = media.matched(p, p, 24)
    assert len(i) > 1000 and media.consensus(p[i], p[j], 4.0)[0] >= 8


def test_odd_inputs(spark):
    a = media.encode_pgm(images(1)[0])
    flat, tiny = media.encode_pgm(np.full((60, 60), 9)), media.encode_pgm(np.zeros((5, 5)))
    schema = "media_id long, image binary, points string"
    df = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (None, a, "x"), (2, None, "x"), (3, b"junk", "x"), (4, flat, "x"), (5, tiny, "x")], schema)
    got = media.find_copies(df, df)
    assert sorted((r["query_id"], r["media_id"]) for r in got.collect()) == [(1, 1)] * 4
    rows = sorted((tuple(r) for r in media.copy_classes(df, df).select("media_id", "n_links", "query_id", "component_id").collect()), key=str)
    assert rows == sorted([(1, 2, 1, 1), (1, 2, 1, 1), (None, 0, None, None), *((k, 0, None, k) for k in (2, 3, 4, 5))], key=str)
    none = spark.createDataFrame([], schema)
    assert media.copy_classes(none, df).count() == 0 and media.copy_classes(df, none).count() == 7
    assert media.find_copies(none, df).count() == media.find_copies(df, none).count() == 0


def test_render(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=64)
    rows = [(1, v.tolist()), (2, (v * 3).tolist()), (3, None), (4, []), (5, [float("nan")] * 64), (6, [0.0] * 64), (7, [None] * 64)]
    got = {r["media_id"]: r["image"] for r in media.render(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    one, two = (media.decode_pgm(bytes(got[k])).astype(int) for k in (1, 2))
    assert np.abs(one - two).max() <= 1 and [got[k] for k in (3, 4, 5, 6, 7)] == [None] * 5
