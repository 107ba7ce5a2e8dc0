"""Map projections against worked examples published in Snyder, Map Projections: A Working Manual (1987)."""

import numpy as np
import pytest

from rasterloom.functions import crs

CLARKE = crs.Ellipsoid(6378206.4, 294.978698214)


def test_transverse_mercator_forward_and_back():
    zone = crs.TransverseMercator(lon0=-75.0, false_east=0.0, ellipsoid=CLARKE)
    x, y = zone.forward(np.array([-73.5]), np.array([40.5]))
    assert (x[0], y[0]) == pytest.approx((127106.5, 4484124.4), abs=0.1)
    lon, lat = zone.inverse(np.array([127106.5]), np.array([4484124.4]))
    assert (lon[0], lat[0]) == pytest.approx((-73.5, 40.5), abs=1e-6)


def test_conic_forward_and_back():
    conic = crs.LambertConic(lon0=-96.0, lat0=23.0, lat1=33.0, lat2=45.0, ellipsoid=CLARKE)
    x, y = conic.forward(np.array([-75.0]), np.array([35.0]))
    assert (x[0], y[0]) == pytest.approx((1894410.9, 1564649.5), abs=0.1)
    lon, lat = conic.inverse(np.array([1894410.9]), np.array([1564649.5]))
    assert (lon[0], lat[0]) == pytest.approx((-75.0, 35.0), abs=1e-6)
