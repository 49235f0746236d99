"""The mixing stage takes whole documents and still meets its targets."""

import random
from collections import Counter

import pytest

from locusframe.llm import mixing


def test_mixed_words_meet_targets(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 else f"src{i % 5}", " ".join(["w"] * rnd.choice([1, 30, 100, 400, rnd.randint(1, 900)]))) for i in range(600)]
    rows += [(600 + i, None, "w " * 70) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size, longest = {i: len(t.split()) for i, _, t in rows}, Counter()
    for i, s, _ in rows:
        longest[s] = max(longest[s], size[i])
    mixed = mixing.mix(docs)
    target = {r.source: r.target for r in mixed.collect()}
    times, words = Counter(r.doc_id for r in pipeline.mix_sources(spark, docs, "").collect()), Counter()
    for i, s, _ in rows:
        words[s] += times[i] * size[i]
    assert max(times.values()) <= 3
    for s, t in target.items():
        assert abs(words[s] - t) <= longest[s] / 2 + 48
    # parts of the line join without a gap: as many copies as in one piece
    total = lambda n: {r.source: r.n for r in mixing.copies(mixed, rows=n).groupBy("source").agg({"times": "sum"}).withColumnRenamed("sum(times)", "n").collect()}
    assert total(8) == total(4096)
