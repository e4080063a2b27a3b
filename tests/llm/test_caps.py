"""What must hold at sizes that a test can't have: tiny sample shares, conversations of over 2 GiB, digests that agree by halves."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidefold.llm import chat, embeddings, toxicity


def test_toxicity_sample_of_a_share_under_a_millionth(spark):
    assert toxicity._least_hashes(20_000, 10_000) == 2**63 - 1
    assert abs(toxicity._least_hashes(20_000, 10**14) / 2**63 * 10**14 - 20_000) < 1
    ids = spark.range(200_000).withColumnRenamed("id", "doc_id")
    found = ids.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= toxicity._least_hashes(2_000, 200_000)).count()
    assert 1_700 < found < 2_300


def test_a_conversation_larger_than_a_row_is_an_error(monkeypatch):
    batch = pa.record_batch({"conv_id": pa.array([1, 1, 2], pa.int64()), "role": ["user", "assistant", "user"], "text": ["hello", "there " * 20, "x"]})
    whole = list(chat._format([batch]))
    assert sum(b.num_rows for b in whole) == 2
    monkeypatch.setattr(chat, "LARGEST", 100)
    with pytest.raises(ValueError, match="a row holds 100"):
        list(chat._format([batch]))


def test_unequal_vectors_of_one_half_digest_stay_apart(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (12, 16))
    x = np.concatenate([base, base[:4] + rng.normal(0, 0.02, (4, 16)), base[:3]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    whole = embeddings._digests()
    monkeypatch.setattr(embeddings, "_digests", lambda: {"d1": F.pmod(whole["d1"], F.lit(5)), "d2": whole["d2"]})
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == plain
    assert sum(not r[3] for r in plain) == 7


def test_repeated_keys_of_vectors_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    out = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    assert out == [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]


def test_pipeline_with_columns_called_as_its_own(spark, tmp_path):
    """Columns called as those that the stages make pass through the first four and don't disturb the last."""
    import random

    import corpus_pipeline

    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    passage = " ".join(rng.choices(words, k=70))
    texts = [" ".join(rng.choices(words, k=rng.randint(60, 120))) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", f"{texts[2]} {passage}", f"{passage} {texts[3][:200]}", None, "", "password = abcdef123456"]
    clash = ["key", "place", "spans", "n", "node", "root", "toxicity", "later", "word", "h", "shard", "bin", "cluster_id", "label", "evidence"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), *[f"{c}{i}" for c in clash]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i == 5)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = docs.collect()
        assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert all(r[c] == f"{c}{r['doc_id']}" for r in kept for c in clash) and len(kept) >= 15
    assert len(kept) == len(texts) - 2  # the exact and the near copy
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() > 0
