"""Exact decimal text against Python's formatting, which prints the exact binary value."""

import random
import struct

import pytest

from conftest import frame
from sigspan.functions.decimal_text import exact_text


def test_equals_exact_formatting(spark):
    r = random.Random(2)
    values = [0.0, -0.0, 0.1, -0.1, 1.0, 0.5, 0.25, 1 / 3, 123.456, 9.999999999999999e22, 2.0**52, 2.0**53 + 2, 2.0**63, 2.0**119, 2.0**-66, 2.0**-67, 2.0**-68, 2.0**-69, 2.0**-70, 5e-324]
    values += [k * 2.0**-21 for k in range(1, 40)] + [1.0 - 2.0**-53, 0.99999999999999999, 9.9999999999999995e-21, 1e-20, 5e-21, 4.999999999999999e-21, 1.5e-20, 0.5 + 2.0**-53]
    values += [r.uniform(-20, 20) for _ in range(300)] + [r.uniform(-1, 1) * 10.0 ** r.randrange(-24, 30) for _ in range(600)]
    while len(values) < 1400:
        x = struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0]
        if abs(x) < 2.0**120:
            values.append(x)
    rows = list(enumerate(values)) + [(-1, None), (-2, float("nan")), (-3, float("inf")), (-4, float("-inf"))]
    got = {x.i: x.v for x in exact_text(frame(spark, rows, "i int, v double").repartition(4), "v").collect()}
    assert got.pop(-1) is None and [got.pop(-k) for k in (2, 3, 4)] == ["nan", "inf", "-inf"]
    for i, v in enumerate(values):
        assert got[i] == format(v, ".20f"), v


def test_columns_stay_in_place_and_no_python_runs(spark):
    df = frame(spark, [(1, 0.1, "a")], "i int, v double, s string")
    out = exact_text(df, "v")
    assert out.columns == ["i", "v", "s"] and exact_text(df, "v", "t").columns == ["i", "v", "s", "t"]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="too large"):
        exact_text(frame(spark, [(2.0**121,)], "v double"), "v").collect()
