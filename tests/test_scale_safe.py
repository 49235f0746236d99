"""Operators cut into bins, runs and batches give what they give in one piece."""

import os
import random

import numpy as np
import pytest

from locusframe.operators import intervals, sequences
from locusframe.sources import text
from locusframe.streaming import windows

SCHEMA = "id long, chrom string, start long, stop long"


def some(rnd, n, far=400):
    out = []
    for i in range(n):
        a = rnd.randrange(far)
        out.append((i, rnd.choice("AB"), a, a + rnd.randint(1, 12)))
    return out


def depth_runs(rows):
    out = []
    for c in {r[1] for r in rows}:
        cover = {}
        for _, k, a, b in rows:
            for p in range(a, b) if k == c else ():
                cover[p] = cover.get(p, 0) + 1
        marks = sorted({x for _, k, a, b in rows if k == c for x in (a, b)})
        marks = [m for m in marks if cover.get(m, 0) != cover.get(m - 1, 0)]
        out += [(c, a, b, cover[a]) for a, b in zip(marks, marks[1:]) if cover.get(a)]
    return sorted(out)


def test_coverage_in_bins(spark):
    rows = some(random.Random(1), 60)
    df = spark.createDataFrame(rows, SCHEMA)
    for width in (7, 1 << 16):
        assert sorted(map(tuple, intervals.coverage(df, width).collect())) == depth_runs(rows)


def test_closest_in_bins(spark):
    rnd = random.Random(2)
    a, b = some(rnd, 50), some(rnd, 25)
    expected = {}
    for i, c, s, e in a:
        near = [(0 if s < y and x < e else s - y if y <= s else x - e, x, y) for _, k, x, y in b if k == c]
        expected[i] = min(near, default=(None, None, None))
    left, right = spark.createDataFrame(a + [(99, "C", 1, 2)], SCHEMA), spark.createDataFrame(b, SCHEMA).drop("id")
    for width in (5, 1 << 16):
        found = {r.id: (r.distance, r.b_start, r.b_stop) for r in intervals.closest(left, right, 8, width).collect()}
        assert found == expected | {99: (None, None, None)}


def test_semi_and_anti_keep_repeated_rows(spark):
    rows = [("A", 1, 30), ("A", 1, 30), ("A", 50, 60), (None, 1, 30), ("B", 1, 2)]
    a = spark.createDataFrame([r + (None,) for r in rows], "chrom string, start long, stop long, note string").repartition(3)
    b = spark.createDataFrame([("A", 0, 20), ("A", 5, 6), ("B", 2, 9)], "chrom string, start long, stop long")
    semi, anti = ([tuple(r)[:3] for r in intervals.range_join(a, b, 4, how).collect()] for how in ("left_semi", "left_anti"))
    assert sorted(semi) == [("A", 1, 30)] * 2
    assert sorted(anti, key=str) == sorted(rows[2:], key=str)


@pytest.mark.parametrize("k,window", [(3, 4), (5, 1), (4, 7)])
def test_minimizers_stop_at_other_letters(spark, k, window):
    rnd = random.Random(k)
    seqs = [(0, "ACGTACGTTGCANNNNACGTTTGACCAGT"), (1, ""), (2, None), (3, "ACG"), (4, "acgtnACGTACGATCGAC")]
    seqs += [(5 + i, "".join(rnd.choice("ACGTACGTACGTN") for _ in range(rnd.randint(0, 60)))) for i in range(30)]
    flip = str.maketrans("ACGT", "TGCA")
    expected = set()
    for i, s in seqs:
        s = (s or "").upper()
        for at in range(len(s) - k - window + 2):
            part = s[at : at + k + window - 1]
            if set(part) <= set("ACGT"):
                mers = [min(part[j : j + k], part[j : j + k][::-1].translate(flip)) for j in range(window)]
                codes = np.array([int("".join(str("ACGT".index(c)) for c in m), 4) for m in mers])
                j = int(sequences.mix64(codes).argmin())
                expected.add((i, at + j, mers[j]))
    found = [tuple(r) for r in sequences.minimizers(spark.createDataFrame(seqs, "id int, seq string"), k, window).collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_vcf_has_a_header(spark, tmp_path):
    rows = [("chr1", 100, "rs1", "A", ["T"], 30.0, "PASS", {"DP": "3", "DB": None}), ("chr2", 7, None, "AC", ["A", "ACC"], None, "q10", {})]
    df = spark.createDataFrame(rows, "chrom string, position long, id string, ref string, alts array<string>, quality double, filter string, info map<string,string>").repartition(3)
    text.write_vcf(df, str(tmp_path / "x.vcf"), ['##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">'])
    whole = "".join(p.read_text() for p in sorted((tmp_path / "x.vcf").glob("part-*"))).splitlines()
    assert whole[0] == "##fileformat=VCFv4.3" and whole[2] == "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    assert sorted(whole[3:]) == ["chr1\t100\trs1\tA\tT\t30.0\tPASS\tDB;DP=3", "chr2\t7\t.\tAC\tA,ACC\t.\tq10\t."]
    assert {r.id: r.value for r in text.read_vcf_header(spark, str(tmp_path / "x.vcf")).collect()}["DP"].startswith("<ID=DP")
    back = {r.chrom: r for r in text.read_vcf(spark, str(tmp_path / "x.vcf")).collect()}
    assert back["chr1"].info == {"DP": "3", "DB": None} and back["chr2"].alts == ["A", "ACC"] and back["chr2"].quality is None


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    for k, times in enumerate((["2024-01-01 10:00:00", "2024-01-01 10:30:00"], ["2024-01-02 09:00:00"], ["2024-01-02 09:30:00"], ["2024-01-01 10:10:00", "2024-01-02 09:40:00"])):
        spark.createDataFrame([(t, "a", 1.0) for t in times], "t string, kind string, value double").selectExpr("cast(t as timestamp) as ts", "kind", "value").coalesce(1).write.parquet(str(tmp_path / f"e{k}"))
    (tmp_path / "all").mkdir()
    for k in range(4):
        part = next((tmp_path / f"e{k}").glob("part-*.parquet"))
        part.rename(tmp_path / "all" / f"{k}.parquet")
        os.utime(tmp_path / "all" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "all"))
    found = windows.run_to_table(windows.tumbling(stream, "ts", "1 hour", "10 minutes", ["kind"], "value"), ["start", "kind"])
    assert sorted((r.start.day, r.start.hour, r.n) for r in found.collect()) == [(1, 10, 2), (2, 9, 3)]
