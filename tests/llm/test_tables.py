"""Chat formatting, embeddings, the shared components and the pipeline."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from locusframe.llm import bpe, chat, common, embeddings, jaccard


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (2, 1), (20, 30), (30, 40), (40, 4)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 30: 1, 40: 1, 7: 7, 8: 7, 9: 7}
    path = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in common.components(path).collect()} == {0}


def test_template_language():
    render = chat.compiled('{{ "a" + "b" }}{% if 1 == 1 %}yes{% else %}no{% endif %}{% for t in turns %}{% if loop.first %}[{% endif %}{{ t.text | upper | trim }}{% if not loop.last %},{% else %}]{% endif %}{% endfor %}')
    assert render([{"role": "u", "text": " x "}, {"role": "a", "text": "y"}]) == ("abyes[X,Y]", [])
    folded = chat.fold(chat.parse('{{ "a" + "b" }}c{% if "x" != "x" %}{{ turns }}{% endif %}'))
    assert folded == ("block", [("print", ("const", "abc"))])
    for bad in ("{{ x | open }}", "{% for x of y %}{% endfor %}", "{% if a %}", "{{ a..b }}", "{% import os %}", "{{ (a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)
    assert chat.compiled("{{ turns.__class__ }}{{ x.__init__ }}")([]) == ("", [])


def test_chats_round_trip(spark):
    hard = ["\\", "<turn>", "</turn>\n", "\\<", "\\n", "a\nb", "", None, "\\\\</turn>", "{{ x }}{% y %}", "Été 😀 <"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in hard for r in ("user", "assistant", "sys\ntem<", None))]
    rows += [(2, None, "assistant", "late"), (2, 5, "user", "b"), (2, 5, "user", "a"), (None, 0, "assistant", "no id"), (2, 5, "user", "a")]
    table = spark.createDataFrame([r + ("x",) for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    found = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert set(found) == {1, 2, None}
    for conv, order in ((1, rows[: len(rows) - 5]), (2, [rows[-1], rows[-3], rows[-4], rows[-5]]), (None, [rows[-2]])):
        expected = [(r[2] or "", r[3] or "") for r in order]
        turns, loss = chat.read_back(found[conv].formatted, [(s.start, s.stop) for s in found[conv].loss_spans])
        assert turns == expected if conv != 2 else sorted(turns) == sorted(expected) and turns[-1] == ("assistant", "late")
        assert loss == "".join(t for r, t in expected if r == "assistant")
    assert chat.format_chats(table.where("false")).collect() == []


@pytest.mark.parametrize("n,dim", [(600, 24), (3000, 24)])
def test_recall_at_two_sizes(spark, n, dim):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(n // 6, dim))
    x = centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, dim)) * rng.uniform(0, 0.25, (n, 1))
    e = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (e @ e.T >= 0.98).sum() - n
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = embeddings.near_vectors(table).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * links <= found <= links


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    x = [c + rng.normal(size=16) * 0.02 * (k % 8) for k in range(12) for c in centers]
    rows = [(i, [float(np.float32(v)) for v in e], i % 3) for i, e in enumerate(x)]
    rows += [(900 + k, rows[0][1], 0) for k in range(5)] + [(950, [2 * v for v in rows[0][1]], 0)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] * 16, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [float("inf")] + [1.0] * 15, 1),
           (1005, rows[1][1], None), (1006, [1.0] * 3, 1), (1007, [], 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, cid string")
    found = {r.vec_id: r for r in embeddings.near_vectors(table).collect()}
    assert len(found) == len(rows) + len(odd)
    links = hit = 0
    least = {}
    for label in range(3):
        own = [r for r in rows if r[2] == label]
        e = np.array([r[1] for r in own])
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        linked = e @ e.T >= 0.98
        n = linked.sum(axis=1) - 1
        links += n.sum()
        hit += sum(found[r[0]].n_links for r in own)
        assert all(found[r[0]].n_links <= k for r, k in zip(own, n))
        reach = linked.copy()
        while (further := reach @ reach).sum() > reach.sum():
            reach = further
        least |= {own[i][0]: own[int(np.flatnonzero(reach[i])[0])][0] for i in range(len(own))}
    assert hit >= 0.9 * links > 0
    # every link between components found here is enough for the same components
    assert sum(found[i].component_id == c for i, c in least.items()) >= 0.98 * len(least)
    assert all(found[i].component_id >= c for i, c in least.items()) and all(r.kept == (r.component_id == i) for i, r in found.items())
    for i, *_ in odd:
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[900].n_links >= 6 and found[900].component_id == 0 and not found[900].kept
    other = [(2000, [1.0, 0.0, 0.0], 1), (2001, [1.0, 0.001, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 5), (None, [0.0, 1.0], 5)]
    short = embeddings.near_vectors(table.select("vec_id", "embedding", "label").union(spark.createDataFrame(other, "vec_id long, embedding array<double>, label int")), tile=64)
    short = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in short.collect() if r.vec_id is None or r.vec_id >= 2000]
    assert sorted(short, key=str) == sorted([(2000, 2, 2000, True), (2001, 2, 2000, False), (None, 2, 2000, False), (None, 1, None, True), (None, 1, None, True)], key=str)
    assert embeddings.near_vectors(table.where("false")).collect() == []


def test_pipeline(spark, messy, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from locusframe.llm import bpe, jaccard

    messy.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = docs
    for name, stage in pipeline.STAGES:
        after = common.staged(stage(spark, before, str(tmp_path)), "test")
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "exact dedup":
            assert after.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in before.collect()})
        if name == "n-gram Jaccard join":
            sets = []
            for r in after.collect():
                w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
                sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
            assert not any(100 * len(x & y) >= 80 * len(x | y) for i, x in enumerate(sets) for y in sets[:i] if x)
            every = {r.component_id for r in jaccard.jaccard_components(before).where("n_shingles > 0").collect()}
            assert every == {r.component_id for r in jaccard.jaccard_components(after).where("n_shingles > 0").collect()}
        before = after
    coder = bpe.coder(bpe.tokenizer_path())
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    texts = {t for (t,) in docs.select("text").collect()}
    assert all(coder.decode(r.ids) in texts for r in rows)


def test_pipeline_of_empty_tables(spark, messy, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    messy.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_leave_one_row_each(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    say = " ".join(f"w{i}" for i in range(60))
    rows = [(7, say), (7, say + " x"), (None, say + " y"), (None, say), (None, say), (3, "a b"), (3, "a b"), (3, "A b"), (None, "c d"), (None, "c d"), (4, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, times_ int")
    kept = sorted((r.text or "", str(r.doc_id)) for r in pipeline.drop_near_copies(spark, docs, "").collect())
    assert [x for x in kept if not x[0]] == [("", "4")] * 3
    assert [(t.lower()[:3], i) for t, i in kept if t] in ([("a b", "3"), ("c d", "None"), ("w0 ", "7")],)


def test_workers_drop_what_earlier_operators_left(spark):
    def probe(batches):
        import gc

        from locusframe.llm.bpe import Coder

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(isinstance(x, Coder) for x in gc.get_objects())])], names=["n"])

    docs = spark.range(400).selectExpr("id as doc_id", "concat('some words of text ', id) as text")
    left = lambda: docs.repartition(16).select("doc_id").mapInArrow(probe, "n long").groupBy().sum("n").first()[0]
    assert bpe.encode(docs.repartition(8)).where("size(ids) > 0").count() == 400
    assert left()
    assert jaccard.shingle_ids(docs.repartition(160), "text", 5).where("token is null").count() == 400
    assert not left()


def test_rounds_of_few_edges_are_few_files(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    stars = lambda: set(Path(common.work_dir(spark).removeprefix("file://")).glob("stars-*/part-*"))
    before = stars()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = common.components(spark.range(500).selectExpr("id as a", "id + 500 as b")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {(r.id, r.component) for r in found} == {(i, i % 500) for i in range(1000)}
    new = stars() - before
    assert 0 < len(new) <= spark.sparkContext.defaultParallelism * len({f.parent for f in new})
