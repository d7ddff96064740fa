"""The near-dedup stage of the pipeline against all pairs' Jaccard similarity."""

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from loomdag.llm import shingles
from tests.llm.test_operators import brute_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    parts = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(parts[0] & parts[1]) / len(parts[0] | parts[1])


def altered(rng, text, changes):
    words = text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    out = [say(rng.randrange(60, 400)) for _ in range(60)]
    out += [altered(rng, t, k) for t in out[:30] for k in (1 + len(t.split()) // 60, 1 + len(t.split()) // 25)]
    common = say(120)
    return [*out, *(altered(rng, common, 1) for _ in range(50)), None, "", "two words"]


def test_near_dedup_is_jaccard(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA)
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    far = below = 0
    for i, a, *_ in rows:
        for j, b, *_ in rows[:i]:
            near = jaccard(a or "", b or "") >= 0.8
            bits = (brute_simhash(a, 5) ^ brute_simhash(b, 5)).bit_count() if near else 0
            far += bits > 3
            below += not near and jaccard(a or "", b or "") > 0.6
            if near:
                x, y = sorted((find(i), find(j)))
                up[y] = x
    assert far and below
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i in range(len(rows)) if find(i) == i]


def test_near_dedup_of_repeated_rows(spark):
    text = " ".join(str(i) for i in range(80))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " end"), (3, "else"), (3, "other")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in shingles.drop_similar(df).collect()) == [(1, text), (3, "else"), (3, "other")]
    assert shingles.drop_similar(df.limit(0)).count() == 0


def test_families_around_a_shared_passage(spark):
    """Buckets of many unlike texts with families in them: no unlike text goes, most of the copies do."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    passage = say(300)
    found = [passage + " " + say(rng.randrange(30, 200)) for _ in range(60)]
    for t in found[:8]:
        step = t
        for _ in range(4):
            step = altered(rng, step, max(1, len(step.split()) // 55))
            found.append(step)
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    up = list(range(len(found)))
    for i, a in enumerate(found):
        for j in range(i):
            if jaccard(a, found[j]) >= 0.8:
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    want = {i for i in range(len(found)) if up[i] == i}
    left = {r["doc_id"] for r in shingles.drop_similar(df).collect()}
    gone = len(found) - len(want)
    assert gone >= 30 and want <= left and len(left - want) <= 0.1 * gone


def test_share_of_near_copies_caught(spark):
    """Copies with one word in 60 changed, and with a passage added: four fifths alike or more are all caught."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    first = [say(rng.randrange(120, 500)) for _ in range(80)]
    copies = [altered(rng, t, max(1, len(t.split()) // 60)) if k % 2 else t + " " + say(len(t.split()) // 8) for k, t in enumerate(first)]
    near = {80 + k for k, (a, b) in enumerate(zip(first, copies)) if jaccard(a, b) >= 0.8}
    df = spark.createDataFrame(list(enumerate(first + copies)), "doc_id long, text string")
    left = {r["doc_id"] for r in shingles.drop_similar(df).collect()}
    assert len(near) > 60 and not near & left and set(range(80)) <= left


def test_pairs_inside_a_large_bucket_are_all_found(spark):
    """Pairs of four fifths that share a part of their own words, in 240 texts of a common passage: none is left."""
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    passage = say(300)
    found = [f"{passage} {own} {say(30)}" for own in (say(24) for _ in range(120)) for _ in range(2)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, found)]
    near = [(j, i) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    assert near == [(i, i + 1) for i in range(0, 240, 2)]
    df = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in shingles.drop_similar(df).collect()) == list(range(0, 240, 2))


def test_parts_of_a_bucket_meet_in_all_pairs(spark):
    """Whatever the cut, each pair of unlike components that the marks allow comes once; marks differ no more than sets."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 200, dtype=np.uint64)
    own = [np.unique(np.concatenate([base[: 200 - k], rng.integers(0, 2**64, k, dtype=np.uint64)])) for k in (5 + i % 60 for i in range(60))]
    bits = [np.unpackbits(shingles.marks(v).view(np.uint8)) for v in own]
    delta = [[len(np.setxor1d(a, b)) for b in own] for a in own]
    assert all((p != q).sum() <= delta[i][j] for i, p in enumerate(bits) for j, q in enumerate(bits))
    sets = spark.createDataFrame([(i, shingles.marks(v).tolist()) for i, v in enumerate(own)], "__row long, __marks array<long>")
    # two buckets of 60 and 20 rows; a root is a row's number modulo 7
    members = spark.createDataFrame([(b, i, len(v), i % 7) for i, v in enumerate(own) for b in (1, 2) if b == 1 or i % 3 == 0], "__bucket long, __row long, __n long, __root long")
    want = {(i, j) for j in range(60) for i in range(j) if i % 7 != j % 7 and 9 * (bits[i] != bits[j]).sum() <= len(own[i]) + len(own[j])}
    assert {(i, j) for j in range(60) for i in range(j) if i % 7 != j % 7 and 9 * delta[i][j] <= len(own[i]) + len(own[j])} <= want
    placed = shingles.placed_members(members)
    for part in (7, 1000):
        assert sorted(tuple(r) for r in shingles.all_pairs(placed, sets, Fraction(4, 5), part).collect()) == sorted(want)
