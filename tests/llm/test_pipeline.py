"""The corpus pipeline against a plain version of its stages."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from loomdag.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_features
from tests.llm.test_shingles import jaccard


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    texts = [say(150) for _ in range(40)] + [None, "", say(10), "x y z " * 40]
    texts += [texts[3]] * 4 + [texts[5] + " " + say(1), texts[6] + " password = hunter2222 " + say(40)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in enumerate(texts) if (f := brute_features(t))[0] >= 50 and 2 * f[4] <= f[0]]
    last = {t: i for i, t in kept}
    kept = sorted((i, t) for t, i in last.items())
    first = []
    for i, t in kept:
        if not any(jaccard(t, u) >= 0.8 for _, u in first):
            first.append((i, t))
    want = {i: t.replace("password = hunter2222", "[SECRET]") for i, t in first}
    assert {r["doc_id"] for r in got} == set(want)
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert all(r["length"] <= 1024 for r in got) and np.sum([r["length"] for r in got]) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_one_after_another_without_writing(spark):
    """A stage may read the plan of the one before; extra and clashing columns stay."""
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    texts = [say(90) for _ in range(12)]
    rows = [(i, t, "en", None, len(t or ""), "a", 1.5, 7) for i, t in enumerate([*texts, texts[0], texts[1] + " " + say(1), None, texts[2] + " token=abcdef123"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row string, sequence_id double, root int")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
    found = {r["doc_id"]: r for r in out.collect()}
    assert set(found) == set(range(13)) - {0} and found[1]["text"] == texts[1] and found[12]["root"] == 7
