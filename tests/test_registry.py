"""Registered queries on the smallest tables: against their SQL, or the plain functions over whole inputs."""

import glob
import itertools
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import geometry, raster
from siltstone.plans import registry
from siltstone.runtime import table


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = registry.queries()[name](spark, sf)
    cols = sorted(got.columns)
    norm = lambda rows: sorted(tuple("None" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = con.sql(registry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    assert norm(tuple(r[c] for c in cols) for r in got.collect()) == norm(con.sql(f"SELECT {', '.join(cols)} FROM want").fetchall())


def _picture(text, width):
    b = (text or "").encode()
    h = -(-len(b) // width)
    return np.frombuffer(b.ljust(h * width, b"\0"), np.uint8).reshape(h, width)


def test_pictures_are_whole_texts(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: r.phash for r in registry.image_phash(spark, sf).collect()}
    assert got == {i: f"{raster.phash(_picture(t, 48)):016x}" if t else None for i, t in docs.items()}
    found = {}
    for r in registry.orb_features(spark, sf).collect():
        found.setdefault(r.doc_id, set()).add((r.x, r.y, r.desc))
    for i, t in docs.items():
        assert found.get(i, set()) == {(o["x"], o["y"], o["desc"].hex()) for o in (geometry.orb(_picture(t, 64)) if t else [])}


def _warped(a, b):
    """The banded path cell by cell."""
    n, m = len(a), len(b)
    width, best = max(geometry.BAND * max(n, m), 2.0), {(0, 0): (0.0, 0)}
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        if int(max(i * m / n - width, 1.0)) <= j <= int(min(i * m / n + width, m)):
            steps = [best[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best]
            if steps:
                d, k = min(steps, key=lambda x: x[0])
                best[i, j] = (d + abs(a[i - 1] - b[j - 1]), k + 1)
    return best[n, m][0] / best[n, m][1] if (n, m) in best else 1.0


def test_warping_takes_whole_series(spark, sf):
    rows = table(spark, sf, "lineitem").orderBy("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double")).select("l_suppkey", "l_quantity").collect()
    series = {}
    for r in rows:
        series.setdefault(r.l_suppkey, []).append(float(r.l_quantity))
    got = {r.a: r.cost for r in registry.time_warping(spark, sf).collect()}
    assert got.keys() == {i for i in series if i + 1 in series}
    for i in sorted(got)[:3]:
        assert abs(got[i] - _warped(series[i], series[i + 1])) < 1e-8
