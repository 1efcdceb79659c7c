import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelink.functions import geo, projections


def dms(d, m, s):
    return d + m / 60 + s / 3600


#: Published points: code, longitude, latitude, east, north, all on the system's own datum.
POINTS = [
    (27700, dms(1, 43, 4.5177), dms(52, 39, 27.2531), 651_409.903, 313_177.270),
    (3035, 5.0, 50.0, 3_962_799.451, 2_999_718.853),
    (2154, 3.0, 46.5, 700_000.0, 6_600_000.0),
    (2154, 2.3522, 48.8566, 652_469.02, 6_862_035.26),
    (25832, 12.0, 55.0, 691_875.632, 6_098_907.825),
    (32632, 9.0, 0.0, 500_000.0, 0.0),
]


@pytest.mark.parametrize("code,lon,lat,east,north", POINTS)
def test_published_points(code, lon, lat, east, north):
    own = projections.system(code)
    plain = projections.System(**{**own.__dict__, "shift": None})
    there, here = projections.ways(plain)
    assert np.allclose(projections.run(there, [lon], [lat]), [[east], [north]], atol=0.05 if code != 2154 else 1)
    assert np.allclose(projections.run(here, *projections.run(there, [lon], [lat])), [[lon], [lat]], atol=1e-9)


@pytest.mark.parametrize("code", [25832, 27700, 2154, 3035, 31467, 32733, 4258])
def test_there_and_back_and_columns_like_arrays(spark, code):
    own = projections.system(code)
    lon0, lat0 = (own.lon, -20 if code == 32733 else 48) if own else (9, 48)
    lon, lat = (a.ravel() for a in np.meshgrid(np.linspace(lon0 - 3, lon0 + 3, 5), np.linspace(lat0 - 4, lat0 + 4, 5)))
    x, y = geo.transform(lon, lat, 4326, code)
    back = geo.transform(x, y, code, 4326)
    assert np.abs(back[0] - lon).max() < 2e-7 and np.abs(back[1] - lat).max() < 2e-7  # some centimetres
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat, strict=True)] + [(None, 1.0)], "lon double, lat double")
    got = rows.coalesce(1).select(*(c.alias(n) for c, n in zip(geo.transform(F.col("lon"), F.col("lat"), 4326, code), "xy", strict=True))).collect()
    assert got[-1].x is None or math.isnan(got[-1].x)
    assert np.allclose([r.x for r in got[:-1]], x, atol=1e-6) and np.allclose([r.y for r in got[:-1]], y, atol=1e-6)


def test_shift_of_datum():
    """The two ends of a shift of over 100 m, to the accuracy of seven parameters."""
    x, y = geo.transform([dms(1, 42, 57.8663)], [dms(52, 39, 28.8282)], 4326, 27700)
    assert abs(x[0] - 651_409.792) < 5 and abs(y[0] - 313_177.448) < 5


def test_any_two_systems_and_unknown_ones():
    x, y = geo.transform(*geo.transform(np.array([2_600_000.0]), np.array([1_200_000.0]), 2056, 25832), 25832, 2056)
    assert abs(x[0] - 2_600_000) < 1.5 and abs(y[0] - 1_200_000) < 1.5
    for pair in ((4326, 1), (25839, 4326), (32761, 2056)):
        with pytest.raises(ValueError):
            geo.transform([1.0], [1.0], *pair)
