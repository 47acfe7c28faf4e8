import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakstone.llm import hard_negatives, prefix_forest, queries

ODD = [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [1.0] * 7 + [None]), (1080, [1.0] * 7 + [math.nan]), (1100, [1.0] * 7 + [math.inf]), (1120, [1.0] * 5), (None, [1.0] * 8)]


def brute(rows, queries_, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i in queries_:
        s = (x * x[ids == i][0]).sum(1)
        other = np.flatnonzero(ids != i)
        out[i] = [(int(ids[j]), s[j]) for j in other[np.lexsort((ids[other], -s[other]))][:k]]
    return out


def recall(got, want):
    return np.mean([len({x for x, _ in got.get(q, [])} & {x for x, _ in w}) / len(w) for q, w in want.items()])


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def test_nearest_neighbours_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    got = answers(queries.op11_nearest_neighbours(spark, sf_dir))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.9
    x = dict(rows)
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[1], p[0])) and q not in dict(found)
        assert all(s == pytest.approx(float((x[q] * x[i]).sum()), abs=1e-15) for i, s in found)


@pytest.mark.parametrize("slot", [50, 16384])
def test_copies_clusters_and_lengths_of_any_kind(spark, monkeypatch, slot):
    """A third of the rows is one vector, a third lies near one; lengths differ, so the largest product isn't the nearest angle. Small slots split prefixes."""
    monkeypatch.setattr(prefix_forest, "SLOT", slot)
    rng = np.random.default_rng(1)
    one, near = rng.normal(size=8), rng.normal(size=8)
    rows = [(i, one if i % 3 == 0 else near + rng.normal(size=8) / 50 if i % 3 == 1 else rng.normal(size=8) * (1 + i % 5)) for i in range(900)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows] + ODD, "vec_id long, embedding array<double>")
    got = answers(prefix_forest.search(table, table.where("vec_id % 20 = 0"), 20))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q in (i for i in want if i % 3 == 0):  # ties go to the smaller id
        alike = [i for i, s in want[q] if s == want[q][0][1]]
        assert [i for i, s in got[q] if s == want[q][0][1]] == alike or recall({q: got[q]}, {q: want[q]}) < 1


def test_few_no_and_repeated_vectors(spark):
    kind = "vec_id long, embedding array<float>, score double, slot string"
    few = spark.createDataFrame([(0, [1.0, 0.0], None, "a"), (1, [0.5, 0.5], 1.0, "b"), (1, [0.25, 0.5], 1.0, "b"), (20, [-1.0, 2.0], None, None), (20, [-1.0, 2.0], None, None)], kind)
    got = answers(prefix_forest.search(few, few.where("vec_id % 20 = 0"), 20))
    assert got == {0: [(1, 0.5), (20, -1.0)], 20: [(1, 0.75), (0, -1.0)]}
    assert prefix_forest.search(few.limit(0), few.limit(0)).count() == 0
    odd = spark.createDataFrame(ODD[:4], "vec_id long, embedding array<double>")
    assert prefix_forest.search(odd, odd.where("vec_id % 20 = 0")).count() == 0
    alone = spark.createDataFrame([(40, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert prefix_forest.search(alone, alone).count() == 0


# --- hard negatives -------------------------------------------------------------------------------------------------------------------------------


def mined(rows, anchor, positives=5, negatives=10):
    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    out = set()
    for i, lab, v in rows:
        if not anchor(i):
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, other, w in rows if j != i]
        for p, j, _ in sorted(x for x in score if x[2] == lab)[:positives]:
            band = sorted((n, k) for n, k, other in score if other != lab and 30 * -p <= 100 * -n <= 90 * -p)[:negatives]
            out |= {(i, j, r, k, -p, -n) for r, (n, k) in enumerate(band, 1)}
    return out


def rows_of(df):
    return [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()]


def test_hard_negatives_by_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf_dir}/embeddings.parquet'")
    want = con.sql("SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (" + queries.ORACLE_SQL["op12_hard_negatives"] + ")").fetchall()
    assert sorted(rows_of(queries.op12_hard_negatives(spark, sf_dir))) == sorted(want) and want


@pytest.mark.parametrize("share", [2, 64])
def test_ties_copies_and_many_anchors(spark, monkeypatch, share):
    """Few values, so many equal scores; a third of the rows is one vector; anchors in several files; any share of the first run gives the same."""
    monkeypatch.setattr(hard_negatives, "SHARE", share)
    monkeypatch.setattr(hard_negatives, "FILE", 7)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), [0.5] * 6 if i % 3 == 0 else (rng.integers(-2, 3, 6) / 4).tolist()) for i in range(400)]
    table = spark.createDataFrame([(i, lab, v) for i, lab, v in rows] + [(i, 1, v) for i, v in ODD if v is None or len(v) < 6 or None in v or not all(map(math.isfinite, v))] + [(4000, None, [1.0] * 6)], "vec_id long, label int, embedding array<double>")
    got = rows_of(hard_negatives.mine(table, F.col("vec_id") % 10 == 0))
    assert set(got) == mined(rows, lambda i: i % 10 == 0) and len(got) == len(set(got)) > 100


def test_large_components_empty_and_clashing_tables(spark):
    kind = "vec_id long, label int, embedding array<double>, lo string, w int, rank int"
    big = [(0, 1, [1e9, 3.0]), (1, 1, [1e9, 2.5]), (2, 2, [5e8, 1.25]), (3, 2, [4e8, 7.75]), (4, 2, [-1e9, 0.0])]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in big], kind)
    out = hard_negatives.mine(table, F.col("vec_id") == 0)
    assert set(rows_of(out)) == set()  # scores beyond 64 bits are equal to the largest such number: outside the band
    small = spark.createDataFrame([(i, lab, [x / 2**10 for x in v], "x", 1, 2) for i, lab, v in big], kind)
    assert set(rows_of(hard_negatives.mine(small, F.col("vec_id") == 0))) == mined([(i, lab, [x / 2**10 for x in v]) for i, lab, v in big], lambda i: i == 0) != set()
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(table.where("label = 1"), F.col("vec_id") == 0).count() == 0


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(60, 32)) * rng.choice([0.01, 1, 100], (60, 1)))
    s = hard_negatives.summaries(v)
    b = hard_negatives.Block(np.arange(60), np.zeros(60), v, s)
    for level in range(len(hard_negatives.LEVELS)):
        least, most = hard_negatives.bounds(b, b, level)
        assert (least <= v @ v.T).all() and (v @ v.T <= most).all()
