"""Mixing, tokens, licences and tool calls against brute force; classifiers by held-out accuracy."""

import base64
import decimal
import hashlib
import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, licenses, mixing, quality, tool_calls, toxicity
from graphloom.llm.license_templates import MIT, TEMPLATES
from tests.llm.conftest import WORDS


def key(rows):
    return sorted(rows, key=str)


# ---------------------------------------------------------------- mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([1000, 10, 1000], [1, 2, 3]) == pytest.approx([(2010 - 30) / 4, 30, (2010 - 30) * 3 / 4])
    assert mixing.targets([10, 1, 1], [1, 2, 3]) == pytest.approx([6, 3, 3]) and mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 2]) == [0, 5]


def test_radical_inverse():
    assert mixing.radical_inverse(np.arange(8)).tolist() == [0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_mix(spark, odd_docs):
    rows = odd_docs.select("doc_id", "text", "source").collect()
    words = lambda t: len([w for w in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    for slots in (50, 65_536):
        got, due = mixing.mix(odd_docs, slots=slots)
        out = got.collect()
        assert key((r["doc_id"], r["source"], r["size"]) for r in out) == key((r[0], r[2], words(r[1])) for r in rows)
        sizes = defaultdict(int)
        for r in rows:
            sizes[r[2]] += words(r[1])
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = dict(zip(names, mixing.targets([sizes[n] for n in names], [1, 2, 3, 1, 2][: len(names)])))
        taken = defaultdict(int)
        for r in out:
            taken[r["source"]] += r["taken"]
            assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert all(taken[n] == int(want[n] + 1e-6) for n in names)
        plan = defaultdict(int)
        for r in due.collect():
            plan[r["source_no"]] += r["words"]
            assert r["words"] > 0
        assert [plan[k] for k in range(len(names))] == [taken[n] for n in names]
    again = key(map(tuple, mixing.mix(odd_docs.repartition(3))[0].collect()))
    assert again == key(map(tuple, mixing.mix(odd_docs)[0].collect()))
    assert mixing.mix(odd_docs.limit(0))[0].count() == 0


def test_schedule_is_spread_evenly(spark):
    plan = [{"target": t, "words": t, "size": t} for t in (100, 200, 700)]
    slots = [r["source_no"] for r in mixing.schedule(spark, plan, 1000, 1).where("slot is not null").orderBy("slot").collect()]
    for n in range(50, len(slots), 50):
        assert all(abs(slots[:n].count(k) - n * t / 1000) < 6 for k, t in enumerate((100, 200, 700)))


def brute_mix(sources, block, slots):
    """Words taken of each document, by a plain walk over the slots.  sources: lists of sizes in shuffled order, with their targets."""
    sizes, targets = [sum(x) for x, _ in sources], [t for _, t in sources]
    owners = [[d for d, n in enumerate(own) for _ in range(n)] for own, _ in sources]  # a word's document
    taken, had, rank = [[0] * len(own) for own, _ in sources], [0] * len(sources), [0] * len(sources)

    def take(s):
        at = rank[s] % -(-sizes[s] // block) * block
        rank[s] += 1
        for w in range(at, min(at + block, sizes[s])):
            if had[s] < int(targets[s] + 1e-6):
                taken[s][owners[s][w]] += 1
                had[s] += 1

    edges = np.cumsum(targets) / sum(targets)
    for n in range(slots):
        point = int(f"{n:032b}"[::-1], 2) / 2**32
        s = int(np.searchsorted(edges, point, side="right"))
        if had[s] < int(targets[s] + 1e-6):
            take(s)
    for s in range(len(sources)):
        while had[s] < int(targets[s] + 1e-6):
            take(s)
    return taken


def test_mix_against_a_walk_over_the_slots(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))), "xyz"[min(2, k % 5)]) for k in range(60)], "doc_id long, text string, source string")
    got, due = mixing.mix(docs, slots=40)
    rows = sorted(got.collect(), key=lambda r: (r["source"], r["h"]))
    total = sum(r["size"] for r in rows)
    block = total // 40
    plan = [([r["size"] for r in rows if r["source"] == s], next(r["target"] for r in rows if r["source"] == s)) for s in "xyz"]
    assert [r["taken"] for r in rows] == sum(brute_mix(plan, block, -(-total // block)), [])


def test_mixed_rows(spark, odd_docs):
    taken = {}
    for r in mixing.mix(odd_docs, by=tuple(odd_docs.columns))[0].where("size > 0").collect():
        taken.setdefault((r["doc_id"], r["source"], r["size"]), []).append(int(r["taken"] / r["size"] + 0.5))
    got = defaultdict(int)
    out = mixing.apply_mix(odd_docs)
    assert out.columns == odd_docs.columns
    for r in out.collect():
        got[r["doc_id"], r["source"]] += 1
    want = defaultdict(int)
    for (i, s, _), n in taken.items():
        want[i, s] += sum(n)
    assert got == {k: v for k, v in want.items() if v}


def test_mixed_rows_that_are_alike(spark):
    """The same id and text in two sources, and crowds of equal rows: each source has its share, in any order of rows."""
    text = " ".join(WORDS[:25])
    rows = [(1, text, s, f"{s}{k % 3}") for s in ("a", "b") for k in range(15)] + [(None, None, None, "z")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `__times` string")
    want = {}
    for r in mixing.mix(docs, by=tuple(docs.columns))[0].where("size > 0").collect():
        want[r["source"]] = want.get(r["source"], 0) + int(r["taken"] / r["size"] + 0.5)
    for chunk in (1000, 2):
        out = [sorted(map(str, mixing.apply_mix(d, chunk).collect())) for d in (docs, docs.orderBy(F.desc("__times")))]
        assert out[0] == out[1]
        assert {s: sum(f"source='{s}'" in x for x in out[0]) for s in ("a", "b")} == want


# ---------------------------------------------------------------- byte-level BPE


@pytest.fixture(scope="module")
def own():
    path, pattern = bpe.production()
    with open(path, "rb") as f:
        return tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def nasty(rng, n):
    parts = ["a", "Z", "é", "ß", "ñ", "1", "23", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'re", "!", "...", "😀", "汉", " ", "　", "x" * 50, " " * 40, "<|endoftext|>", "\x1c", "-"]
    return "".join(rng.choice(parts) for _ in range(n))


def test_encode_is_the_librarys(spark, odd_docs, own):
    rng = random.Random(6)
    more = spark.createDataFrame([(1000 + k, nasty(rng, 400)) for k in range(30)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    want = key((i, own.encode_ordinary(t or "")) for i, t in docs.collect())
    for size, overlap in ((32_768, 1024), (200, 60)):
        got = bpe.encode(docs, *bpe.production(), size=size, overlap=overlap, output="bytes").collect()
        assert key((r["doc_id"], r["ids"]) for r in got) == want
        assert key((r["doc_id"], bytes(r["decoded"]).decode()) for r in got) == key((i, t or "") for i, t in docs.collect())
        got = bpe.encode(docs, *bpe.production(), size=size, overlap=overlap, output="digests").collect()
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert key(map(tuple, got)) == key((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(own.decode_bytes(ids))) for i, ids in want)
    assert bpe.encode(docs.limit(0), *bpe.production()).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_stitching(seed, own):
    rng, pattern = random.Random(seed), bpe.production()[1]
    text = nasty(rng, 1500) if seed else "x" * 3000 + " " * 2000 + "y" * 500
    s, pieces = bpe.Stitcher(pattern, 64), []
    for begin, piece in bpe.chunks(text, 256, 64):
        pieces += s.add(begin, piece, [begin + m for m in bpe.boundaries(piece, pattern) if m < 64 or m > len(piece) - 64])
    pieces += s.close()
    assert "".join(pieces) == text and [i for p in pieces for i in own.encode_ordinary(p)] == own.encode_ordinary(text)
    assert len(pieces) > 5 or not seed


# ---------------------------------------------------------------- licences


def test_every_template_is_found():
    for name, text in TEMPLATES:
        whole = f"Some words before it.\n{text}\nand some behind it."
        found = [licenses.identify(whole[a:b]) for a, b in licenses.candidate_blocks(whole)]
        assert any(f and f[0] == name and f[2] == f[3] == 0 for f in found), (name, text[:60], found)


def test_wording_decides():
    near = MIT.replace("free of charge", "for a small charge")
    got = [licenses.identify(near[a:b]) for a, b in licenses.candidate_blocks(near)]
    assert got[0][0] == "MIT" and (got[0][2], got[0][3]) == (2, 3)
    for text in ("Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3."):
        assert licenses.identify(text)[2:] == (0, 0)
    assert licenses.identify("Licensed under CC BY-NC 4.0.")[0] == "CC-BY-NC-4.0" and licenses.identify("Licensed under CC BY 4.0.")[0] == "CC-BY-4.0"
    assert not [1 for a, b in licenses.candidate_blocks("He lost his driving licence last year.") if licenses.identify("He lost his driving licence last year."[a:b])]


def test_license_scan(spark, odd_docs):
    assert {(r["doc_id"], len(r["matches"])) for r in licenses.scan(odd_docs).collect()} == {(r[0], 0) for r in odd_docs.select("doc_id").collect()}
    text = f"Title\nintro text here\n{MIT}\nmiddle text\nReleased under the MIT License. Tail."
    twice = f"{MIT}\n{MIT}"
    df = spark.createDataFrame([(1, text), (2, twice), (3, "word " * 40_000 + "\nLicensed under CC BY 4.0.")], "doc_id long, text string")
    got = {r["doc_id"]: r["matches"] for r in licenses.scan(df).collect()}
    assert [m["license"] for m in got[1]] == ["MIT", "MIT"] and text[got[1][0]["start"] : got[1][0]["end"]] == MIT
    assert [m["license"] for m in got[2]] == ["MIT", "MIT"] and got[3][0]["license"] == "CC-BY-4.0"


# ---------------------------------------------------------------- tool calls

PLACE = {"type": "object", "properties": {"city": {"type": "string"}, "at": {"type": "array", "items": {"type": "number"}}}, "required": ["city"]}
SCHEMAS = {
    "find": {"properties": {"q": {"type": "string"}, "n": {"type": "number"}, "i": {"type": "integer"}, "o": {"type": "object", "additionalProperties": True}, "l": {"type": "array"}, "b": {"type": "boolean"}}, "required": ["q"]},
    "go": {"properties": {"to": PLACE, "stops": {"type": "array", "items": PLACE}, "by": {"enum": ["foot", 1, None]}}},
    "none": {},
}


def call(id, name="find", arguments='{"q":"x"}'):
    return (id, name, arguments)


def link(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], f"conv_id long, turn long, role string, text string, tool_calls {tool_calls.CALLS}, tool_call_id string, level string")
    return tool_calls.link(df, SCHEMAS).collect()


def test_tool_calls(spark):
    rows = [
        (1, 0, "assistant", None, [call("a", arguments='{"q": "$call:b", "n": 1}'), call("b")], None), (1, 1, "tool", "late", None, "b"), (1, 2, "tool", "later", None, "b"), (1, 3, "assistant", None, [call("c", arguments='{"q":"$call:a and $call:b","l":["$call:a"]}'), call("a", "none", "{}")], None),
        (2, 0, "assistant", None, [call("a"), call("x", arguments='{"q":"$call:y"}'), call("y", arguments='{"q":"$call:x"}'), call("z", arguments='{"q":"$call:x"}')], None), (2, 1, "tool", None, None, "a"), (2, 1, "tool", "lost", None, "nobody"),
        (None, 0, "assistant", None, [call("a"), call(None)], None), (None, 1, "tool", "r", None, "a"), (3, 0, "user", "hello", None, None), (3, 1, "assistant", "hi", [], None),
    ]
    got = {(r["conv_id"], r["turn"], r["k"]): r for r in link(spark, rows)}
    level = {k: r["level"] for k, r in got.items()}
    assert level == {("1", 0, 0): 1, ("1", 0, 1): 0, ("1", 3, 0): 2, ("1", 3, 1): None, ("2", 0, 0): 0, ("2", 0, 1): None, ("2", 0, 2): None, ("2", 0, 3): None, (None, 0, 0): 0, (None, 0, 1): None}
    assert got["1", 3, 0]["waits_for"] == ["a", "a and $call:b"]  # the whole text is the reference; no call has the latter
    assert (got["1", 0, 1]["n_results"], got["1", 0, 1]["result"]) == (2, "late") and (got["2", 0, 0]["n_results"], got["2", 0, 0]["result"]) == (1, None)
    assert got["1", 3, 1]["errors"] == ["duplicate id"] and got["2", 0, 3]["errors"] == ["waits in a circle"] and got[None, 0, 1]["errors"] == ["no id"] and got[None, 0, 0]["result"] == "r"
    assert got["1", 0, 0]["canonical"] == '{"arguments":{"n":1,"q":"$call:b"},"id":"a","name":"find","result":null}'


def test_arguments(spark):
    none = ["arguments are not a JSON object"]
    cases = [
        ("find", '{"q":"x"}', []), ("find", "{}", ["missing q"]), ("find", '{"q":1,"z":2}', ["q is not string", "unexpected z"]), ("find", '{"q":"x","n":"1","o":[],"l":{},"b":0}', ["b is not boolean", "l is not array", "n is not number", "o is not object"]),
        ("find", '{"q":"x","n":1.5,"o":{"any":1},"l":[1],"b":true}', []), ("find", '{"q":null}', ["q is not string"]), ("find", "[1]", none), ("find", "{", none), ("find", None, none), ("what", "{}", ["unknown tool"]), (None, "{}", ["unknown tool"]), ("none", "{}", []), ("none", '{"a":1}', ["unexpected a"]),
        ("find", '{"q":"x","q":"y"}', ["arguments repeat a key"]), ("find", '{"q":"x","i":2.0}', []), ("find", '{"q":"x","i":2.5}', ["i is not integer"]), ("find", '{"q":"x","i":"2"}', ["i is not integer"]), ("find", '{"q":"x","i":123456789012345678901234567890}', []),
        ("go", '{"to":{"city":"A","at":[1,2.5]},"stops":[],"by":"foot"}', []), ("go", '{"to":{"at":[1,"2"],"zip":3},"by":2}', ["by is not allowed", "missing to.city", "to.at[1] is not number", "unexpected to.zip"]),
        ("go", '{"stops":[{"city":"A"},{"city":7},3],"by":null}', ["stops[1].city is not string", "stops[2] is not object"]),
    ]
    got = link(spark, [(1, k, "assistant", None, [call(f"c{k}", name, arguments)], None) for k, (name, arguments, _) in enumerate(cases)])
    assert [r["errors"] for r in sorted(got, key=lambda r: r["turn"])] == [e for _, _, e in cases]


def plain_number(text):
    d = decimal.Decimal(text)
    if not d:
        return "0"
    digits = "".join(map(str, d.as_tuple().digits)).rstrip("0")
    digits, point = digits.lstrip("0"), len("".join(map(str, d.as_tuple().digits)).lstrip("0")) + d.as_tuple().exponent
    sign, n = "-" * (d < 0), len(digits)
    if 0 < point <= 21:
        return sign + (digits + "0" * (point - n) if n <= point else digits[:point] + "." + digits[point:])
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    return f"{sign}{digits[0]}{'.' + digits[1:] if n > 1 else ''}e{'+' if point > 0 else ''}{point - 1}"


def test_canonical_numbers_keep_their_value(spark):
    rng = random.Random(3)
    texts = ["0", "-0", "0.0", "0e5", "1", "1.0", "1e0", "100", "1E2", "0.00001", "1e-5", "1e-7", "0.0000001", "12345678901234567890123456789012345678901", "1e20", "1e21", "1e22", "-1.50e+3", "123.4560", "1e400", "5e-324", "0.1e1", "999999999999999999999.5"]
    texts += [f"{rng.choice(['', '-'])}{rng.choice(['0', str(rng.randrange(1, 10**9))])}{rng.choice(['', f'.{rng.randrange(10**6):06d}'])}{rng.choice(['', f'e{rng.randrange(-30, 30)}'])}" for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(tool_calls.canonical_number(F.col("t"))).collect()]
    assert got == [plain_number(t) for t in texts]
    arguments = ['{"b":[1.0, 1e0,"1.0","n\\"2.50\\""], "a":-0.50, "long":12345678901234567890123456789012345678901, "s":"s\\u0041\\/é"}', '{"a":1,"a":2}', "{", None, json.dumps({"x": 'quote " and \\ ' * 20_000, "k": list(range(3000))})]
    shown = [r[0] for r in spark.createDataFrame(list(enumerate(arguments)), "k int, t string").orderBy("k").select(tool_calls.canonical_json(F.col("t"))).collect()]
    assert shown[0] == '{"a":-0.5,"b":[1,1,"1.0","n\\"2.50\\""],"long":1.2345678901234567890123456789012345678901e+40,"s":"sA/é"}'
    assert shown[1:4] == [None] * 3 and shown[4] == json.dumps(json.loads(arguments[4]), sort_keys=True, separators=(",", ":"))


def test_canonical_json_sorts_and_keeps_values(spark):
    got = link(spark, [(1, 0, "assistant", None, [call("a", arguments='{ "q": "ü\\n\\"", "n": 10.50, "o": {"z": [1, {"b":2,"a":null}], "a": true} }')], None)])[0]["canonical"]
    assert got == '{"arguments":{"n":10.5,"o":{"a":true,"z":[1,{"a":null,"b":2}]},"q":"ü\\n\\""},"id":"a","name":"find","result":null}'
    assert json.loads(got)["arguments"]["o"]["z"][1] == {"a": None, "b": 2}


def test_long_chain_and_no_messages(spark):
    rows = [(1, k, "assistant", None, [call(f"c{k}", arguments=json.dumps({"q": f"$call:c{k - 1}" if k else ""}))], None) for k in range(8)]
    assert sorted((r["turn"], r["level"]) for r in link(spark, rows)) == [(k, k) for k in range(8)]
    assert link(spark, [(1, 0, "user", "x", None, None)]) == []


def test_levels_against_a_plain_walk(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for c in range(12):
        ids = [f"n{k}" for k in range(rng.randrange(1, 25))]
        for k, i in enumerate(ids):
            n = rng.choice([0, 1, 1, 1, 1, 2, 3])
            on = rng.sample(ids if c % 4 == 0 else ids[:k], min(n, k)) + (["lost"] if rng.random() < 0.2 else [])
            rows.append((str(c), i, on))
    for c in {r[0] for r in rows}:
        own, level = {r[1]: [x for x in r[2] if x != "lost"] for r in rows if r[0] == c}, {}
        while new := {i: max([level[x] + 1 for x in on], default=0) for i, on in own.items() if i not in level and all(x in level for x in on)}:
            level |= new
        want |= {(c, i): n for i, n in level.items()}
    got = tool_calls.levels(spark.createDataFrame(rows, "conv_id string, call_id string, waits_for array<string>")).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got} == want


def test_tool_calls_stay_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    plan = tool_calls.link(tool_calls.as_calls(df), tool_calls.SCHEMAS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- classifiers


def test_tokens_are_those_of_a_plain_loop():
    texts = ["Ab, ab!! c", "", "é é", "a" * 200 + " x"]
    t = common.Tokens([x.encode() for x in texts])
    assert t.doc.tolist() == [0] * 5 + [2] * 2 + [3] * 2 and t.kind.tolist() == [1, 2, 1, 2, 1, 1, 1, 1, 1]
    assert t.hash[0] == t.hash[2] and t.hash[1] != t.hash[3] and t.hash[5] == t.hash[6] and len(set(t.hash.tolist())) == 7
    assert t.prefix(1)[0] == t.prefix(1)[2] != 0 and t.prefix(1)[4] == 0
    cut = [(o.tolist(), p) for o, p in common.blocks([b"aaa", b"bb", b"c", b"", b"ddd dd d", b"e"], 3)]
    assert cut == [([0], [b"aaa"]), ([1, 2, 3], [b"bb", b"c", b""]), ([4], [b"ddd"]), ([4], [b" dd"]), ([4, 5], [b" d", b"e"])] and not list(common.blocks([]))
    assert [p for _, p in common.blocks([b"x" * 20], 3)] == [[b"x" * 6]] * 3 + [[b"xx"]]


def test_word_vectors_are_those_of_a_plain_loop(spark, odd_docs):
    docs = odd_docs.where("length(text) < 5000 OR text IS NULL").repartition(3)
    buckets, dims = 256, 8
    place, sign = quality.index_vectors(buckets, dims, 11)
    total = np.zeros((buckets, dims))
    for (text,) in docs.select("text").collect():
        w = [int(h) % buckets for h in common.Tokens([(text or "").encode()]).hash]
        for a in range(len(w)):
            for b in range(max(0, a - 2), min(len(w), a + 3)):
                if a != b:
                    for k in (0, 1):
                        total[w[a], place[k][w[b]]] += sign[k][w[b]]
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(docs, buckets, dims), want, atol=1e-5)


def adam(p, grads, state, step, rate, slow):
    for k, g in enumerate(grads):
        state[k][0] += 0.1 * (g - state[k][0])
        state[k][1] += slow * (g * g - state[k][1])
        p[k] -= rate * state[k][0] / (1 - 0.9**step) / (math.sqrt(state[k][1] / (1 - (1 - slow) ** step)) + 1e-8)


def test_network_is_that_of_a_plain_loop():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(10, 3)), np.array([0, 1, 1, 0, 1, 0, 1, 1, 0, 0])
    got = quality.train(x, y, hidden=2, seed=1)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    first = np.random.default_rng(1)
    w1 = first.normal(0, 1 / np.sqrt(3), (3, 2))
    order = first.permutation(10)
    p, state = [*w1.ravel().tolist(), *[0.0] * 5], [[0.0, 0.0] for _ in range(11)]  # w1 by input, b1, w2, b2
    z = ((x - mean) / scale).tolist()
    score = lambda p, r: math.fsum(math.tanh(sum(r[i] * p[2 * i + h] for i in range(3)) + p[6 + h]) * p[8 + h] for h in (0, 1)) + p[10]
    for step in range(1, 301):
        grads = [1e-4 * v for v in p[:6]] + [0.0, 0.0] + [1e-4 * v for v in p[8:10]] + [0.0]
        for k in order[2:]:
            g = (1 / (1 + math.exp(-score(p, z[k]))) - y[k]) / 8
            for h in (0, 1):
                act = math.tanh(sum(z[k][i] * p[2 * i + h] for i in range(3)) + p[6 + h])
                back = g * p[8 + h] * (1 - act * act)
                for i in range(3):
                    grads[2 * i + h] += z[k][i] * back
                grads[6 + h] += back
                grads[8 + h] += g * act
            grads[10] += g
        adam(p, grads, state, step, 3e-3, 0.001)
    assert np.allclose(got.logits(x), [score(p, r) for r in z], atol=1e-6)
    loss = lambda t: sum(math.log1p(math.exp(-(1 if y[k] else -1) * score(p, z[k]) / t)) for k in order[:2])
    assert got.temperature == pytest.approx(min(np.geomspace(0.25, 8, 61), key=loss))


def test_toxicity_is_that_of_a_plain_loop():
    rng = random.Random(2)
    y = np.array([k % 2 for k in range(40)], float)
    rows = [np.array(sorted({rng.choice([3, 5]) if rng.random() < 0.8 else 11, 7 if (rng.random() < 0.9) == bool(v) else 9, 20 + rng.randrange(3)}), np.uint64) for v in y]
    swapped = [(k, np.array(sorted({11 if f == 7 else int(f) for f in rows[k]}), np.uint64)) for k in range(0, 40, 3)]
    got = toxicity.train(rows, y, swapped, steps=60)
    worth = {}
    for f in {int(f) for r in rows for f in r}:
        table = [[sum((f in r) == bool(a) and v == b for r, v in zip(rows, y)) for b in (0, 1)] for a in (0, 1)]
        n = 2 * sum(c * math.log(c * 40 / (sum(table[a]) * (table[0][b] + table[1][b]))) for a in (0, 1) for b in (0, 1) if (c := table[a][b]))
        if sum(table[1]) >= 3 and n > 6.63:
            worth[f] = n
    assert got.features.tolist() == sorted(worth) and len(worth) >= 2
    names = sorted(worth)
    p, state = [0.0] * len(names) + [math.log(20.5 / 20.5)], [[0.0, 0.0] for _ in range(len(names) + 1)]
    logit = lambda r: sum(p[names.index(int(f))] for f in r if int(f) in worth)
    for step in range(1, 61):
        grads = [1e-5 * v for v in p[:-1]] + [0.0]
        for r, v in zip(rows, y):
            g = (1 / (1 + math.exp(-(p[-1] + logit(r)))) - v) / 40
            grads[-1] += g
            for f in r:
                if int(f) in worth:
                    grads[names.index(int(f))] += g
        for k, other in swapped:
            change = logit(rows[k]) - logit(other)
            for s, r in ((1, rows[k]), (-1, other)):
                for f in r:
                    if int(f) in worth:
                        grads[names.index(int(f))] += 2 / len(swapped) * s * change
        adam(p, grads, state, step, 0.1, 0.01)
    assert np.allclose([*got.weights, got.bias], p, atol=1e-9)


def test_pooling_and_features_do_not_hang_on_the_cut(monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(64, 4)).astype(np.float32)
    texts = [" ".join(rng.choice(["Ab!!", "c", "idiot", "|", "é12", "vequxx"], k)).encode() for k in (0, 3, 400, 7)]
    model = toxicity.Model(np.unique(toxicity.features(np.zeros(1, int), [b"idiot vequa"])[1]), np.ones(5), 0.5)
    blocks = common.blocks
    want = quality.pooled(texts, vectors), model.logits(texts), [x.tolist() for x in toxicity.chosen_features(texts, lambda f: f > 0)]
    monkeypatch.setattr(common, "blocks", lambda t: blocks(t, 50))
    assert np.allclose(quality.pooled(texts, vectors)[:, :-6], want[0][:, :-6], atol=1e-5) and np.allclose(quality.pooled(texts, vectors)[:, -3:], want[0][:, -3:], atol=1e-5)
    assert np.allclose(model.logits(texts), want[1]) and [x.tolist() for x in toxicity.chosen_features(texts, lambda f: f > 0)] == want[2]


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.fixture(scope="module")
def judged(spark):
    """Documents of good and bad form, with and without insults, and labels of half of them."""
    rng = random.Random(9)
    words = [a + b + c for a in ("ba", "ko", "mi", "tu") for b in ("na", "ter", "lim") for c in ("do", "pes", "r")]
    rows, labels = [], []
    for i in range(900):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        own = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if not good:
            own = [w.upper() + "!!" for w in own] if rng.random() < 0.5 else [own[k // 8] for k in range(len(own))]
        for _ in range(2 if toxic else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["idiot", "vequ" + rng.choice(words), "scum"]))
        if toxic and rng.random() < 0.7 or rng.random() < 0.1:
            own.insert(0, "muslims")
        rows.append((i, " ".join(own)))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_quality(spark, judged, write_tables):
    docs, labels, truth = judged
    got = {r["doc_id"]: r for r in quality.op2_quality(spark, write_tables(documents=docs, labels=labels)).collect()}
    held = [t for t in truth if got[t[0]]["held_out"]]
    assert 250 < len(held) < 350 and _auc(np.array([t[1] for t in held]), np.array([got[t[0]]["score"] for t in held])) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_quality_of_odd_inputs(spark, judged, odd_docs):
    docs, labels, _ = judged
    model = quality.fit(docs, labels)
    out = quality.score(odd_docs, *model)
    assert out.columns == [c for c in odd_docs.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    assert out.count() == odd_docs.count() and out.where("isnan(score) or score is null").count() == 0
    odd_labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1)], "doc_id long, quality int")
    for d, l in ((docs, labels.limit(0)), (docs, odd_labels), (odd_docs.limit(0), labels), (odd_docs, labels)):
        vectors, net = quality.fit(d, l)
        assert quality.score(odd_docs, vectors, net).where("score between 0 and 1").count() == odd_docs.count()


def test_network_is_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 4))
    p = 1 / (1 + np.exp(-(x[:, 0] + x[:, 1])))
    y = (rng.random(6000) < p).astype(int)
    net = quality.train(x[:4000], y[:4000])
    s = net.score(x[4000:])
    for low in np.arange(0, 1, 0.25):
        own = (s >= low) & (s < low + 0.25)
        assert abs(s[own].mean() - y[4000:][own].mean()) < 0.08
    assert 0.25 <= net.temperature <= 8


def test_toxicity(spark, judged, write_tables):
    docs, labels, truth = judged
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, write_tables(documents=docs, labels=labels)).collect()}
    held = [t for t in truth if got[t[0]]["held_out"]]
    assert _auc(np.array([t[2] for t in held]), np.array([got[t[0]]["score"] for t in held])) > 0.98


def test_counterfactuals_lower_the_score_of_a_neutral_mention(spark, judged):
    docs, labels, _ = judged
    fair, naive = toxicity.fit(docs, labels), toxicity.fit(docs, labels, identities=(("zzzz", "yyyy"),))
    neutral, plain = b"muslims banado kolimr", b"banado kolimr"
    effect = lambda m: float(np.diff(m.logits([plain, neutral]))[0])
    assert effect(naive) > 1 and abs(effect(fair)) < 0.6 * effect(naive)
    assert fair.logits([b"vequxyz idiot"])[0] > 0
    assert toxicity.swapper()("Women and MUSLIMS") == "men and christians" and toxicity.swapper()("nobody") is None


def test_toxicity_of_odd_inputs(spark, judged, odd_docs):
    docs, labels, _ = judged
    for d, l in ((docs, labels), (docs, labels.limit(0)), (docs.limit(0), labels)):
        out = toxicity.score(odd_docs, toxicity.fit(d, l))
        assert out.where("score between 0 and 1").count() == odd_docs.count()
