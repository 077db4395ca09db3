"""The pipeline at a small scale: what each stage keeps, and that rejected documents stay out."""

import os

import pytest

import corpus_pipeline as p
from framewright.llm import shingles, simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {"all": {r["doc_id"] for r in docs.collect()}}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DATA)
        if k < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    order = list(seen.values())
    assert all(b <= a for a, b in zip(order, order[1:], strict=False)) and len(order[-1]) > 0.5 * len(order[0])
    bad = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    assert len(bad & seen["quality"]) < 0.5 * len(bad)
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = spark.read.parquet(str(tmp_path / "benchmark_passages")).collect()
    assert not [r for r in kept if any(i in r["text"] for i in items)]


def test_near_duplicates_by_both_links(spark):
    """Texts that op8's fingerprints link go, and so does what shingles link to one of these."""
    base = [f"w{i}" for i in range(21)]
    one, two = ([f"{c}{i}" for i in range(9)] for c in "xy")
    rows = [(1, base * 30 + one), (2, base * 30 + two), (3, base + base[:4] + base[-4:] + two), (4, one + two + base[::-1]), (5, []), (6, [])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    prints = dict(zip([1, 2, 3, 4], simhash.fingerprints([" ".join(w).encode() for _, w in rows[:4]]).tolist(), strict=True))
    sets = [set(x.tolist()) for x in shingles.shingle_sets([" ".join(w).encode() for _, w in rows[:3]])]
    alike = [len(a & b) / len(a | b) for a, b in (sets[:2], sets[1:], sets[::2])]
    assert (prints[1] ^ prints[2]).bit_count() <= 4 < (prints[2] ^ prints[3]).bit_count() and alike[1] >= 0.8 > max(alike[0], alike[2])
    assert sorted(r["doc_id"] for r in p.near_duplicates(spark, docs, DATA).collect()) == [1, 4, 5]
