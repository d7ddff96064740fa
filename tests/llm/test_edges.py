"""Empty tables, clashing columns, repeated rows, ties and very long texts, by brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomdag.llm import common, packing, secrets, sentencepiece, sharding, tokens, warc
from loomdag.llm.queries import tokenizer_path

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{a}:{b}:{c}" for a, b, c in ((("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)))


def test_base_spans_by_brute_force(spark):
    rng = random.Random(21)
    parts = ["password", "Secret", "api_key", "APIKEY", "token", "=", ":", " ", "  ", '"', "'", "AKIA", "é", "\U0001f600", "\n", "abc", "hunter2222", "0123456789abcdef", "ABCDEFGHIJKLMNOP", ".", "-", "x=1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    texts += [None, "", "token=" + "a" * 300_000, " ".join(["secret: abc123def"] * 20_000), "AKIA" + "B" * 15, "AKIA" + "B" * 16, "f" * 23, "f" * 24]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(1, texts[1], "y", 6)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, __base string, spans int")
    got = Counter((r["doc_id"], r["b"]) for r in secrets.secret_spans(df).select("doc_id", secrets.joined(secrets.F.col("base_spans")).alias("b")).collect())
    assert got == Counter((i, brute_base(t)) for i, t, *_ in rows)
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    longest = clean.filter("doc_id = 603").first()["text"]
    assert longest == " ".join(["[SECRET]"] * 20_000)


def brute_thresholds(logs):
    """The step-up by its definition: the largest p whose share of all is within the rate."""
    ranked = sorted(10**x for x in logs)
    return max([p for k, p in enumerate(ranked, 1) if p <= secrets.FALSE_DISCOVERIES * k / len(ranked)], default=None)


def test_step_up_by_definition(spark):
    rng = random.Random(5)
    logs = [-round(rng.random() * 3 * secrets.BINS) / secrets.BINS for _ in range(400)] + [-rng.randrange(5, 40) * 1.0 for _ in range(25)]
    table = spark.createDataFrame([([(30, x)],) for x in logs], "__found array<struct<n:int,p:double>>")
    limits = secrets.thresholds(table)
    own = limits[1]  # lengths 25 to 32
    want = brute_thresholds(logs)
    assert {x for x in logs if x <= own} == {x for x in logs if 10**x <= want + 1e-12} and all(x == float("-inf") for i, x in enumerate(limits) if i != 1)


def test_packing_keeps_clashing_columns_and_repeated_rows(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b c " * 200), (1, "a b c " * 200), (2, None), (None, "x" * 5000), (3, "y")], "doc_id long, text string")
    pieces = tokens.token_pieces(docs, path, 64).selectExpr("*", "7 as __piece", "'old' as sequence_id", "'old' as offset", "9 as __index")
    got = packing.pack(pieces, 64).collect()
    assert len(got) == pieces.count() and got[0]["__piece"] == 7 and got[0]["__index"] == 9
    cells = Counter((r["sequence_id"], c) for r in got for c in range(r["offset"], r["offset"] + r["length"]))
    assert max(cells.values()) == 1 and max(c for _, c in cells) < 64
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 64) + 1
    assert packing.pack(pieces.limit(0), 64).count() == 0


def test_workers_remember_short_units_only():
    coder = tokens.UnitEncoder(tokenizer_path("byte_bpe_50k.json"))
    model = sentencepiece.Model(tokenizer_path("piece_bpe_32k.model"))
    texts = ["short words here", "a " + "long" * 5000, "b " + "other" * 4000 + " c", "short again"]
    for _ in range(2):
        flat, sizes = coder.encode(pa.array(texts))
        ends = np.cumsum(sizes)
        for text, end, n in zip(texts, ends, sizes):
            assert flat[end - n : end].tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert model.encode_all(pa.array(texts)).to_pylist() == [model.encode(t) for t in texts]
    assert max(map(len, coder.known)) <= tokens.LONGEST and max(map(len, model.units)) <= sentencepiece.LONGEST


def test_sentencepiece_edges(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as ids")
    coded = sentencepiece.encode(docs, path).selectExpr("*", "'old' as text")
    out = sentencepiece.decode(coded, path)
    assert out.columns == ["doc_id", "ids", "text"] and sorted(r["text"] for r in out.collect()) == ["", "a b", "a b"]
    assert sentencepiece.decode(sentencepiece.encode(docs.limit(0), path), path).count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(i % 40, "t" * (i % 7) * 10, i, "old") for i in range(100)] + [(None, None, 1, "old")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, more int, shard string")
    got = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert sorted(got.columns) == sorted(["doc_id", "text", "more", "slot", "shard"])
    assert Counter((r["doc_id"], r["text"], r["more"]) for r in got.collect()) == Counter((i, t, m) for i, t, m, _ in rows)
    for s in range(4):
        own = [r["slot"] for r in got.filter(f"shard = {s}").collect()]
        assert sorted(own) == list(range(len(own)))


@pytest.mark.parametrize("n,m", [(0, 0), (0, 40), (40, 0), (3, 900), (900, 40)])
def test_warc_trees_of_unlike_height(spark, n, m):
    make = lambda k: spark.createDataFrame([(i, f"u{i}", "x" * (i % 5), "clash") for i in range(k)], "page_id long, url string, html string, index string")
    a, b = (warc.leaves(warc.records(make(k))) for k in (n, m))
    found = {r["index"] for r in warc.audit(warc.build_tree(a), warc.build_tree(b)).collect()}
    assert found == set(range(min(n, m), max(n, m)))


def test_hot_keys_meet_alike(spark):
    rows = spark.range(1000).selectExpr("id", "if(id < 600, 0, id) as k")
    groups = rows.groupBy("k").count().selectExpr("k as g", "count as n")
    want = sorted(map(tuple, rows.join(groups, rows["k"] == groups["g"]).collect()))
    for hot in (1, 100, 10_000):
        assert sorted(map(tuple, common.join_hot(rows, groups, rows["k"] == groups["g"], "n", hot).collect())) == want
