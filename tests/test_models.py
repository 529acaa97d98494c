"""Every target has its estimate, however far the counts are."""

import math

import pytest

from viaflux.operators import models as MO


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return max(6371.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 0.001)


def test_idw_is_the_full_sum_on_sparse_counts(spark):
    known = [(-15.0, -48.0, 100.0), (-15.0, -48.0, 300.0), (-9.0, -40.0, 900.0), (-30.0, -60.0, 50.0), (None, -1.0, 7.0)]
    targets = [(1, -15.1, -48.1), (2, 10.0, 10.0), (3, -9.0, -40.0), (4, 10.0, 10.0), (5, None, 3.0)]
    got = {r.id: r.idw for r in MO.idw(spark.createDataFrame(targets, "id long, lat double, lon double"), spark.createDataFrame(known, "lat double, lon double, vmd double")).collect()}
    want = {5: None}
    for i, *place in targets[:4]:
        w = [km(place, k[:2]) ** -2 for k in known[:4]]
        want[i] = pytest.approx(sum(x * k[2] for x, k in zip(w, known)) / sum(w))
    assert got == want


@pytest.mark.parametrize("kind", ["forest", "boosted", "clusters"])
def test_unknown_features_keep_their_rows(spark, kind):
    train = spark.createDataFrame([(i, float(i), None if i % 7 == 0 else i * 2.0, i * 10.0) for i in range(30)], "id long, a double, b double, vmd double")
    test = spark.createDataFrame([(1, None, 3.0), (2, 4.0, None), (3, None, None), (4, float("nan"), 1.0), (5, 2.0, 5.0)], "id long, a double, b double")
    out = MO.cluster_means(train, test, ["a", "b"], k=3) if kind == "clusters" else MO.tree_predictions(train, test, ["a", "b"], kind=kind)
    got = {r.id: r.prediction for r in out.collect()}
    assert set(out.columns) == {"id", "a", "b", "prediction"} and set(got) == {1, 2, 3, 4, 5} and None not in got.values()
