"""Media columns: local image descriptors that find cropped or edited copies.

Corners on several scales, binary tests turned to each corner's orientation, Hamming tables, geometric consensus.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RADIUS, TURNS, BITS = 12, 32, 256
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", BITS // 8)])


def _tests() -> np.ndarray:
    """``(turn, bit, end, dy/dx)``: pairs of places in a disc, turned by each step of a full turn."""
    rng = np.random.default_rng(20)
    p = rng.normal(0, RADIUS / 2.2, (4096, 2))
    p = p[np.hypot(*p.T) <= RADIUS - 1][: 2 * BITS].reshape(BITS, 2, 2)
    a = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(a), np.sin(a)], -1), np.stack([-np.sin(a), np.cos(a)], -1)], 1)  # of (dy, dx)
    return np.rint(np.einsum("tij,bej->tbei", turn, p)).astype(np.int64)


TESTS = _tests()
def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """A grey image (height, width) of a binary PGM; None for anything else or cut data."""
    m = re.match(rb"P5\s+(?:#[^\n]*\s+)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not m or not 0 < int(m[3]) < 256 or not int(m[1]) * int(m[2]) or len(data) - m.end() < int(m[1]) * int(m[2]):
        return None
    w, h = int(m[1]), int(m[2])
    return np.frombuffer(data, np.uint8, w * h, m.end()).reshape(h, w)


def box(a: np.ndarray, r: int, how=np.add) -> np.ndarray:
    """Sum (or ``how``) over squares of side 2r+1, in the last two axes; edges repeat."""
    for axis in (1, 2):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(3)], mode="edge")
        n = a.shape[axis]
        parts = [p[:, o : o + n] if axis == 1 else p[:, :, o : o + n] for o in range(2 * r + 1)]
        out = how(parts[0], parts[1])
        for x in parts[2:]:
            how(out, x, out=out)
        a = out
    return a


def resized(a: np.ndarray, scale: float) -> np.ndarray:
    """Images made smaller by ``scale``, by bilinear interpolation."""
    if scale == 1:
        return a
    h, w = max(1, int(a.shape[1] / scale)), max(1, int(a.shape[2] / scale))
    for axis, n in ((1, h), (2, w)):
        at = np.clip((np.arange(n) + 0.5) * scale - 0.5, 0, a.shape[axis] - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)]).astype(np.float32)
        a = a.take(low, axis) * (1 - part) + a.take(np.minimum(low + 1, a.shape[axis] - 1), axis) * part
    return a


def describe(images: np.ndarray, points: int = 40, every: int = 160) -> list[np.ndarray]:
    """Descriptors (``POINT``, places in pixels of the given image) of equally large images.

    Scales follow each other by the root of two until the image is too small for a descriptor; each has at most one corner
    to ``every`` pixels, or ``points`` where that is more.
    """
    found = [[] for _ in images]
    scales = [2 ** (k / 2) for k in range(64) if min(images.shape[1:]) / 2 ** (k / 2) > 2 * RADIUS + 3]
    for scale in scales:
        a = resized(box(images.astype(np.float32), 1) / 9, scale)
        n, h, w = a.shape
        dy, dx = np.gradient(a, axis=(1, 2))
        yy, xx, xy = box(dy * dy, 2), box(dx * dx, 2), box(dx * dy, 2)
        corner = yy * xx - xy * xy - 0.05 * (yy + xx) ** 2
        corner[corner < box(corner, 2, np.maximum)] = 0
        m = RADIUS + 1
        inner = corner[:, m : h - m, m : w - m].reshape(n, -1)
        top = np.argsort(-inner, axis=1, kind="stable")[:, : max(points, h * w // every)]
        image, k = np.nonzero(np.take_along_axis(inner, top, 1) > 1e-3 * np.maximum(inner.max(1, keepdims=True), 1))
        place = top[image, k]
        y, x = place // (w - 2 * m) + m, place % (w - 2 * m) + m
        smooth = (box(a, 2) / 25).reshape(-1)
        base = image * h * w + y * w + x
        oy, ox = np.mgrid[-7:8, -7:8]
        disc = oy * oy + ox * ox <= 49
        patch = smooth[base[:, None] + (oy * w + ox)[disc]]
        angle = np.arctan2(patch @ oy[disc], patch @ ox[disc])
        turn = np.rint(angle * TURNS / (2 * np.pi)).astype(int) % TURNS
        offsets = TESTS[..., 0] * w + TESTS[..., 1]
        bits = np.packbits(smooth[base[:, None] + offsets[turn, :, 0]] < smooth[base[:, None] + offsets[turn, :, 1]], axis=1)
        out = np.empty(len(base), POINT)
        out["x"], out["y"], out["scale"], out["angle"], out["bits"] = (x + 0.5) * scale, (y + 0.5) * scale, scale, angle, bits
        for i, part in enumerate(np.split(out, np.searchsorted(image, np.arange(1, n)))):
            found[i].append(part)
    return [np.concatenate(f) if f else np.empty(0, POINT) for f in found]


def describe_all(images: list[np.ndarray | None]) -> list[np.ndarray]:
    """Descriptors of images of any sizes; None has none.  Works on about four million pixels at once."""
    out, by = [np.empty(0, POINT)] * len(images), {}
    for i, a in enumerate(images):
        if a is not None:
            by.setdefault(a.shape, []).append(i)
    for (h, w), own in by.items():
        step = max(1, 1_000_000 // (h * w))
        for k in range(0, len(own), step):
            for i, d in zip(own[k : k + step], describe(np.stack([images[j] for j in own[k : k + step]]))):
                out[i] = d
    return out


def plan_tables(descriptors: int, differ: int, miss: float) -> tuple[int, int]:
    """``(bits, tables)``: two bits a key for each doubling of the descriptors asked for, as bits of smooth images hang together
    (four more make chance meetings about three times as rare), and as many tables as it takes that two descriptors that
    differ in ``differ`` bits share no key with a chance of ``miss`` at most (closer ones less often)."""
    bits = min(48, max(16, 2 * max(1, descriptors).bit_length()))
    agree = math.prod((BITS - differ - k) / (BITS - k) for k in range(bits))
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


@functools.lru_cache(4)
def looked_at(bits: int, tables: int) -> np.ndarray:
    """``(descriptor bit, table)``: the value of each bit in each table's key."""
    out = np.zeros((BITS, tables))
    for t in range(tables):
        out[np.random.default_rng([21, t]).permutation(BITS)[:bits], t] = 2.0 ** np.arange(bits)
    return out


def keys(images: list[np.ndarray], bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """``(image, key)``, each once: of each descriptor, the bits that each table looks at, and the table's number."""
    points, owner = np.concatenate([*images, np.empty(0, POINT)]), np.repeat(np.arange(len(images)), [len(x) for x in images])
    found = (np.unpackbits(points["bits"], axis=1) @ looked_at(bits, tables)).astype(np.int64)
    found = np.sort((owner << bits)[:, None] + found, axis=0)
    new = np.ones(found.shape, bool)
    new[1:] = found[1:] != found[:-1]
    table, at = np.nonzero(new.T)
    found = found[at, table]
    return found >> bits, (found & ((1 << bits) - 1)) + (table << bits)


def matched(q: np.ndarray, p: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of descriptors of two images that differ in at most ``differ`` bits, in blocks of about a million pairs."""
    a, b, step = q["bits"].copy().view(np.uint64), p["bits"].copy().view(np.uint64), max(1, 1_000_000 // max(1, len(p)))
    found = [np.nonzero(np.bitwise_count(a[k : k + step, None] ^ b[None]).sum(2) <= differ) for k in range(0, len(a), step)]
    return np.concatenate([i + k * step for k, (i, _) in enumerate(found)] or [np.zeros(0, int)]), np.concatenate([j for _, j in found] or [np.zeros(0, int)])


def consensus(q: np.ndarray, p: np.ndarray, tolerance: float) -> tuple[int, float, float, float, float]:
    """Most matched points that one similarity explains, and its scale, angle and shift (from p to q).

    Each match proposes the similarity of its two points: the ratio of scales, the difference of orientations.  Proposals
    are tried in blocks, so that repetitive images, whose points match many times, take bounded memory.
    """
    ratio, angle = q["scale"] / p["scale"], q["angle"] - p["angle"]
    c, s = ratio * np.cos(angle), ratio * np.sin(angle)
    dx, dy = q["x"] - (c * p["x"] - s * p["y"]), q["y"] - (s * p["x"] + c * p["y"])
    places = np.unique(np.rint(q["x"]) * 100_003 + np.rint(q["y"]), return_inverse=True)[1]
    order = np.argsort(places, kind="stable")
    starts, step = np.flatnonzero(np.diff(places[order], prepend=-1)), max(1, 1_000_000 // len(q))
    counts = []
    for k in range(0, len(q), step):
        own = slice(k, k + step)
        ex = c[own, None] * p["x"] - s[own, None] * p["y"] + dx[own, None] - q["x"]
        ey = s[own, None] * p["x"] + c[own, None] * p["y"] + dy[own, None] - q["y"]
        inside = ex * ex + ey * ey <= tolerance**2
        counts.append(np.logical_or.reduceat(inside[:, order], starts, axis=1).sum(1))
    counts = np.concatenate(counts)
    k = int(np.argmax(counts))
    return int(counts[k]), float(ratio[k]), float(angle[k]), float(dx[k]), float(dy[k])


def _described(images: DataFrame) -> DataFrame:
    """``(media_id, node, points, no)`` of all rows: node is a hash of the descriptors, null without any or without an id; no is a row's place in the checkpoint."""

    def run(batches):
        import xxhash

        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [d.tobytes() for d in describe_all([decode_pgm(x) for x in part.column(1).to_pylist()])]
                nodes = [xxhash.xxh3_128_digest(d) if d and i is not None else None for i, d in zip(part.column(0).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], names=["media_id", "node", "points"])

    images = images.select(F.col("media_id").cast("long").alias("media_id"), F.col("image").cast("binary").alias("image"))
    return common.checkpoint(common.mapped(images, run, "media_id long, node binary, points binary")).withColumn("no", F.monotonically_increasing_id())


def _different(rows: DataFrame) -> DataFrame:
    """``(node, no, id, n)``: the first row of each different image, the smallest id of its copies, and their number."""
    return rows.where("node IS NOT NULL").groupBy("node").agg(F.min("no").alias("no"), F.min("media_id").alias("id"), F.count("*").alias("n"))


#: Bits of a filter that is broadcast: 8 MB at most.
FILTER = 2**26


def _filter(values: DataFrame) -> np.ndarray:
    """Which of ``FILTER`` places the only column's values fall on; the places are or-ed where they lie, only bits come to the driver."""
    place = F.pmod(F.xxhash64(values.columns[0]), F.lit(FILTER)) + 1
    found = values.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros((FILTER // 32768, 4096), np.uint8)
    for r in found:
        out[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _keyed(rows: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(key, no)`` of every row."""

    def run(batches):
        for b in batches:
            for part in (b.slice(k, 500) for k in range(0, b.num_rows, 500)):
                owner, found = keys([np.frombuffer(x, POINT) for x in part.column(1).to_pylist()], bits, tables)
                yield pa.RecordBatch.from_arrays([pa.array(found), part.column(0).take(pa.array(owner))], names=["key", "no"])

    return common.mapped(rows.where("node IS NOT NULL").select("no", "points"), run, "key long, no long")


def _sifted(rows: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows of which ``column`` may be one of ``values``: fewer rows to shuffle, as far as the filter tells them apart."""
    held = rows.sparkSession.sparkContext.broadcast(_filter(values))
    place = F.pmod(F.xxhash64(column), F.lit(FILTER))
    at = len(rows.columns)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(at))
            yield b.filter(pa.array((held.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)).select(range(at))

    (name,) = common.unused(rows, "place")
    return common.mapped(rows.withColumn(name, place), run, rows.schema)


def _pairs(known: DataFrame, asked: DataFrame, differ: int, inliers: int, tolerance: float, miss: float) -> DataFrame:
    """``(q, m, inliers, scale, angle, dx, dy)``: places of different query images and of different images that copy them."""
    questions = common.checkpoint(_different(asked))
    pixels = asked.join(questions.select("no"), "no").agg(F.sum(F.length("points"))).first()[0] or 0
    bits, tables = plan_tables(pixels // POINT.itemsize, differ, miss)
    wanted = common.checkpoint(_keyed(asked, bits, tables).join(questions.select("no"), "no").select("key", F.col("no").alias("q")))
    given = _sifted(_keyed(known, bits, tables), wanted.select("key"), "key").join(_different(known).select("no"), "no").select("key", F.col("no").alias("m"))
    met = common.checkpoint(given.join(wanted, "key").groupBy("q", "m").count().where(F.col("count") >= inliers).select("q", "m"))

    def verify(batches):
        names = ["q", "m", "inliers", "scale", "angle", "dx", "dy"]
        types = [pa.int64(), pa.int64(), pa.int32(), *[pa.float64()] * 4]
        for b in batches:
            rows = []
            for no, m, x, y in zip(*(b.column(c).to_pylist() for c in ("q", "m", "x", "y"))):
                x, y = np.frombuffer(x, POINT), np.frombuffer(y, POINT)
                i, j = matched(x, y, differ)
                if len(i) >= inliers and (best := consensus(x[i], y[j], tolerance))[0] >= inliers:
                    rows.append((no, m, *best))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    left = _sifted(asked.select("no", "points"), met.select("q"), "no").select(F.col("no").alias("q"), F.col("points").alias("x"))
    right = _sifted(known.select("no", "points"), met.select("m"), "no").select(F.col("no").alias("m"), F.col("points").alias("y"))
    return common.mapped(met.join(left, "q").join(right, "m").select("q", "m", "x", "y"), verify, "q long, m long, inliers int, scale double, angle double, dx double, dy double")


def find_copies(media: DataFrame, queries: DataFrame, differ: int = 16, inliers: int = 8, tolerance: float = 4.0, miss: float = 0.1) -> DataFrame:
    """``(query_id, media_id, inliers, scale, angle, dx, dy)`` for every query image and every image that copies it.

    Both inputs are ``(media_id long, image binary)`` with PGM images.  A pair is a copy if at least ``inliers`` corners,
    whose descriptors differ in at most ``differ`` of 256 bits, agree with one similarity transform within ``tolerance``
    pixels.  Images that are null, can't be decoded or are too small for a corner match nothing, as do null ids; repeated
    rows match each on its own; empty inputs give no rows; other columns are not read.

    Hamming tables find the pairs: descriptors meet their like by (table, key) in an equi-join, which AQE splits where a key
    is hot; there are as many tables as it takes that two descriptors at the radius share no key with a chance of
    ``miss`` (``plan_tables``).  Two images that share as many keys as ``inliers`` are compared whole (that many pairs at the
    radius share more than twice as many on average).  Images of equal descriptors are looked up once.  Before rows are shuffled, a filter of bounded size leaves out those that
    meet nothing.
    """
    known, asked = _described(media), _described(queries)
    pairs = _pairs(known, asked, differ, inliers, tolerance, miss)
    q = asked.join(_different(asked).select("node", F.col("no").alias("q")), "node").select("q", F.col("media_id").alias("query_id"))
    m = known.join(_different(known).select("node", F.col("no").alias("m")), "node").select("m", "media_id")
    return pairs.join(q, "q").join(m, "m").select("query_id", "media_id", "inliers", "scale", "angle", "dx", "dy")


def copy_classes(media: DataFrame, queries: DataFrame, differ: int = 16, inliers: int = 8, tolerance: float = 4.0, miss: float = 0.1) -> DataFrame:
    """``(media_id, n_links, query_id, inliers, component_id)`` for every row of ``media``: what ``find_copies`` links, by class.

    n_links: queries that the image copies; query_id and inliers: the best of them (most inliers, then smallest id), null
    without any.  component_id: smallest id reachable by links, where a query and the image of its id are one.
    Rows of equal descriptors, whatever their ids, are compared once.  Rows with a null media_id are kept and link with
    nothing; repeated rows, and different images of one id, are rows of their own.
    """
    known, asked = _described(media), _described(queries)
    images, questions = common.checkpoint(_different(known)), common.checkpoint(_different(asked))
    pairs = _pairs(known, asked, differ, inliers, tolerance, miss).select("q", "m", "inliers")
    pairs = pairs.join(questions.select(F.col("no").alias("q"), F.col("id").alias("query_id"), "n"), "q")
    pairs = common.checkpoint(pairs.join(images.select(F.col("no").alias("m"), "node", "id"), "m").select("node", "id", "q", "query_id", "n", "inliers"))
    best = F.min_by(F.struct("query_id", "inliers"), F.struct(-F.col("inliers"), F.col("query_id")))
    each = common.checkpoint(pairs.groupBy("node").agg(F.min("id").alias("id"), F.sum("n").alias("n_links"), best.alias("best")))
    linked = pairs.select(F.col("q").alias("no"), F.col("query_id").alias("b")).distinct().join(questions, "no").select("node", "b")
    edges = [pairs.select(F.col("id").alias("a"), F.col("query_id").alias("b"))]
    edges += [known.select("node", F.col("media_id").alias("a")).join(each.select("node", F.col("id").alias("b")), "node").select("a", "b")]
    edges += [asked.select("node", F.col("media_id").alias("a")).join(linked, "node").select("a", "b")]
    groups = common.connected_components(edges[0].unionByName(edges[1]).unionByName(edges[2])).select(F.col("node").alias("media_id"), "component_id")
    rows = known.select("media_id", "node").join(each.select("node", "n_links", "best.query_id", "best.inliers"), "node", "left").drop("node")
    return rows.join(groups, "media_id", "left").select("media_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "query_id", "inliers", F.coalesce("component_id", "media_id").alias("component_id"))


SIDE = 80


def render(vectors: DataFrame) -> DataFrame:
    """``(media_id, image)``: vectors drawn as images, each component a fixed texture, so that near vectors look alike.

    (The tables hold no images.)  Null, empty and non-finite vectors give null images.
    """

    def run(batches):
        textures = {}
        for b in (x.slice(k, 500) for x in batches for k in range(0, x.num_rows, 500)):
            images = []
            for v in b.column(1).to_pylist():
                v = np.array(v or [], np.float64)  # null components become nan
                if not len(v) or not np.isfinite(v).all() or not v.any():
                    images.append(None)
                    continue
                if len(v) not in textures:
                    raw = np.random.default_rng([8, len(v)]).standard_normal((len(v), SIDE, SIDE)).astype(np.float32)
                    textures[len(v)] = box(box(raw, 2), 1).reshape(len(v), -1)
                a = (v.astype(np.float32) @ textures[len(v)]).reshape(SIDE, SIDE)
                images.append(encode_pgm(np.clip(128 + 50 * (a - a.mean()) / max(a.std(), 1e-9), 0, 255)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(images, pa.binary())], names=["media_id", "image"])

    vectors = vectors.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>").alias("e"))
    return common.mapped(vectors, run, "media_id long, image binary")


def edited(image: np.ndarray, number: int) -> np.ndarray:
    """One of four edits: a crop, a quarter turn with a crop, other brightness and contrast, a crop with noise."""
    h, w = image.shape
    crop = image[h // 10 : h - h // 20, w // 20 : w - w // 8]
    if number % 4 == 0:
        return crop
    if number % 4 == 1:
        return np.rot90(crop)
    if number % 4 == 2:
        return np.clip(image * 0.7 + 40, 0, 255).astype(np.uint8)
    noise = np.random.default_rng(number).normal(0, 4, crop.shape)
    return np.clip(crop + noise, 0, 255).astype(np.uint8)


def edit(media: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            images = [decode_pgm(x) for x in b.column(1).to_pylist()]
            out = [None if a is None else encode_pgm(edited(a, i // 100)) for i, a in zip(b.column(0).to_pylist(), images)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["media_id", "image"])

    return common.mapped(media.select("media_id", "image"), run, "media_id long, image binary")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited copies of every image whose id is divisible by 100, searched among all images."""
    media = render(common.table(spark, sf_dir, "embeddings"))
    return copy_classes(media, edit(media.where("media_id % 100 = 0")))
