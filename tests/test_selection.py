"""Histogram refinement against the built-in percentile, and its order of cells."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from conftest import frame
from sigspan.operators import profile as prof
from sigspan.operators import selection as sel

LEVELS = [0.0, 0.05, 0.5, 0.77, 1.0]


def _doubles(n, seed=1):
    r = random.Random(seed)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf")]
    while len(out) < n:
        x = struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0]
        if not math.isnan(x):
            out.append(x)
    return out


def _compare(spark, df, keys, value="v", levels=LEVELS):
    want = {(tuple(r[k] for k in keys), r.p): r.q for r in prof.quantile_profile(df.where(F.col(value).isNotNull()), keys, value, levels).collect()}
    got = {(tuple(r[k] for k in keys), r.p): r.q for r in sel.select_quantiles(df, keys, value, levels).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert got[k] == q or (math.isnan(q) and math.isnan(got[k])) or math.isclose(got[k], q, rel_tol=1e-15), k


def test_cells_keep_the_order_of_any_double(spark):
    values = sorted(_doubles(4000))
    values += [float("nan")]
    df = frame(spark, list(enumerate(values)), "i int, v double")
    cells = [r.c for r in df.select("i", sel.coarse_cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells) and cells[-1] > cells[-2]


@pytest.mark.parametrize("spread", ["any", "close", "equal", "two", "steps"])
def test_equals_percentile(spark, spread):
    r = random.Random(3)
    make = {
        "any": lambda i: _ANY[i % len(_ANY)],
        "close": lambda i: 1.0 + (i * 7919 % 2003) * 2.0**-52,  # neighbours in the last bits: all rounds are needed
        "equal": lambda i: 42.0,
        "two": lambda i: -1.0 if i % 3 else 1e300,
        "steps": lambda i: r.choice([-1, 1]) * 2.0 ** r.randrange(-1000, 1000),
    }[spread]
    rows = [(None if i % 5 == 0 else i % 5, f"s{i % 2}", None if i % 17 == 0 else make(i)) for i in range(1500)]
    rows += [(9, "alone", 3.5), (10, "none", None)]
    _compare(spark, frame(spark, rows, "g int, s string, v double"), ["g", "s"])


_ANY = [x for x in _doubles(700, 5) if abs(x) < 1e150]  # differences of larger ones overflow in any engine


def test_nan_and_infinite_values_are_the_largest(spark):
    rows = [(0, x) for x in [1.0, 2.0, float("nan"), float("inf"), 3.0]]
    df = frame(spark, rows, "g int, v double")
    got = {r.p: r.q for r in sel.select_quantiles(df, ["g"], "v", [0.0, 0.5, 0.75, 1.0]).collect()}
    assert got[0.0] == 1.0 and got[0.5] == 3.0 and got[0.75] == float("inf") and math.isnan(got[1.0])


def test_large_groups_are_selected_and_small_ones_aggregated(spark):
    """A hot group of a third of all rows (NULL key) and a bound that parts the groups."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 != 0, F.col("id") % 40).alias("g"), (F.sin("id") * 1000).alias("v"))
    want = {(r.g, r.p): r.q for r in prof.quantile_profile(df, ["g"], "v").collect()}
    for large in (10, 1000, 10**6):
        got = {(r.g, r.p): r.q for r in prof.exact_quantiles_distributed(df, ["g"], "v", large=large).collect()}
        assert got == pytest.approx(want, rel=1e-15)
    plan = prof.exact_quantiles_distributed(df, ["g"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "rangepartitioning" not in plan


def test_no_rows(spark):
    empty = frame(spark, [], "g int, v double")
    assert sel.select_quantiles(empty, ["g"], "v", LEVELS).count() == 0
    assert prof.exact_quantiles_distributed(empty, ["g"], "v").count() == 0
