"""Stages that read their documents twice, with other file splits the second time."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") for _ in range(n))
    texts = [say(80) for _ in range(120)]
    texts += [texts[i] for i in range(20)] + [texts[i] + " end" for i in range(20, 40)] + [say(60) + " password = hunter2222" for _ in range(20)]
    out = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[0], (None, "only this", None, None, None), (None, "only this", None, None, None), (None, "and this", None, None, None)]


def want(stage):
    all_rows = rows()
    ids = {i: t for i, t, *_ in all_rows}
    none = [(None, "and this"), (None, "only this")]
    if stage == "exact dedup":
        return sorted([(i, t) for i, t in ids.items() if i is not None and not i < 20], key=str) + none
    if stage == "near dedup":
        return sorted([(i, t) for i, t in ids.items() if i is not None and not 120 <= i < 160], key=str) + none
    return sorted([(i, t.replace("password = hunter2222", "[SECRET]")) for i, t, *_ in all_rows if i is not None], key=str) + [none[0], none[1], none[1]]


@pytest.mark.parametrize("stage", ["exact dedup", "near dedup", "secret scan"])
def test_other_splits_at_the_second_reading(spark, tmp_path, stage):
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(12).write.parquet(path)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        left = dict(corpus_pipeline.STAGES)[stage](spark, spark.read.parquet(path), str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        got = [(r["doc_id"], r["text"]) for r in left.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted([x for x in got if x[0] is not None], key=str) + sorted((x for x in got if x[0] is None), key=str) == want(stage)
