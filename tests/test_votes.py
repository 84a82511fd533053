import duckdb
import numpy as np
import pytest

from siltstone.functions import votes
from siltstone.operators import matching
from siltstone.plans import registry

rng = np.random.default_rng(5)


def _side(n, landmarks, times, bands, start=0):
    c = rng.integers(0, 2 * landmarks + 1, n)
    m = int(c.sum())
    return votes.side(n, np.repeat(np.arange(n), c), rng.integers(start, start + times, m), 7 * rng.integers(0, bands, m), np.zeros(m, bool))


def _brute(q, i, at_least):
    both = ((a, b, matching.modal_votes(q.t[q.row == a], q.f[q.row == a], i.t[i.row == b], i.f[i.row == b])) for a in range(q.n) for b in range(i.n))
    return {(a, b): r for a, b, r in both if r and r[0] >= at_least}


@pytest.mark.parametrize("lookup", [0, 600, 1 << 60])
@pytest.mark.parametrize("shape", [(30, 40, 5, -20, 20, 530), (5, 3, 2, 0, 9, 9), (8, 5000, 40, 3, 20, 300), (3, 2, 9, 0, 140, 20), (2, 1, 1, 0, 5, 5), (2000, 30, 3, 0, 3, 4)])
def test_tiles_equal_pairs(monkeypatch, lookup, shape):
    monkeypatch.setattr(votes, "LOOKUP", lookup)
    landmarks, times, bands, start, nq, ni = shape
    q, i = _side(nq, landmarks, times, bands, start), _side(ni, landmarks, times + 5, bands, start + 3)
    for at_least in (1, 4):
        got = {}
        for a, b, v, d, known in votes.tile_votes(q, i, at_least):
            assert known.all()
            new = dict(zip(zip(a.tolist(), b.tolist(), strict=True), zip(v.tolist(), d.tolist(), strict=True), strict=True))
            assert not set(new) & set(got)
            got |= new
        assert got == _brute(q, i, at_least)


def test_counts_that_single_precision_cannot_hold():
    """200,000 votes and more: double precision, and equal counts at two offsets go to the smaller."""
    n = 450
    one = votes.side(1, np.zeros(2 * n, int), np.repeat([0, 1], n), np.zeros(2 * n, int), np.zeros(2 * n, bool))
    two = votes.side(1, np.zeros(2 * n, int), np.repeat([0, 3], n), np.zeros(2 * n, int), np.zeros(2 * n, bool))
    assert votes._Products.of(one, two, 1).kind is np.float64
    [(_, _, v, d, _)] = votes.tile_votes(one, two)
    assert (v.tolist(), d.tolist()) == ([2 * n * n], [-3])


def _sent(spark):
    """Rows that each stage has sent."""
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}


def test_landmarks_are_not_sent_once_a_pair(spark):
    ids, each = 1500, 150
    rows = spark.range(ids * each).selectExpr("id % 1500 AS id", "cast(xxhash64(id, 1) & 63 AS int) AS t", "cast(xxhash64(id, 2) & 31 AS int) AS f")
    before = _sent(spark)
    got = matching.audio_votes(rows.filter("id % 50 = 0"), rows, matching.AUDIO_VOTES)
    assert got.count() == 30 * ids
    sent = sum(n for k, n in _sent(spark).items() if k not in before)
    assert 0 < sent < 30 * ids / 2


def test_many_tiles(spark, monkeypatch):
    rows = spark.range(6000).selectExpr("id % 97 AS id", "cast(xxhash64(id, 1) & 31 AS int) AS t", "cast(xxhash64(id, 2) & 7 AS int) AS f")
    run = lambda: sorted(map(tuple, matching.audio_votes(rows.filter("id % 5 = 0"), rows).collect()))
    whole = run()
    monkeypatch.setattr(matching, "TILE_ROWS", 7)
    monkeypatch.setattr(matching, "TILE_LANDMARKS", 300)
    assert run() == whole and len(whole) == 20 * 97


def test_query_equals_sql_with_nulls(spark, tmp_path):
    part = lambda a, b: "CASE WHEN {0} % 11 = {1} THEN NULL ELSE {0} END".format(a, b)
    with duckdb.connect() as con:
        con.sql(f"""CREATE TABLE lineitem AS SELECT {part("(k * 7919 % 1201)", 3)} AS l_orderkey, {part("(k * 104729 % 997)", 4)} AS l_partkey, CASE WHEN k % 13 = 0 THEN NULL ELSE k % 150 END AS l_suppkey
            FROM range(9000) t(k) UNION ALL SELECT NULL, 59 * k, 200 + k % 2 * 50 FROM range(40) t(k) UNION ALL SELECT k, 59 * k, 300 FROM range(90) t(k)""")
        con.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
        want = con.sql(registry.oracle_sql()["audio_votes"]).fetchall()
    df = registry.queries()["audio_votes"](spark, str(tmp_path))
    got = [tuple(r) for r in df.select("query_id", "id", "votes", "delta").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[1] is None for r in want) and any(r[3] is None for r in want) and any(r[3] is not None for r in want)
