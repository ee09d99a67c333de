from conftest import SF001, frame
from sigspan.operators import labels as lab
from sigspan.operators import sequence as sq
from sigspan.sources.tables import read_signal
from sigspan.spec import TEST


def test_window_labels_equal_join_form(spark):
    seq = sq.sequence_signal(read_signal(spark, SF001), TEST)
    a = sorted(tuple(r) for r in lab.window_labels(seq, TEST).collect())
    b = sorted(tuple(r) for r in lab.window_labels_join(seq, TEST).select(lab.window_labels(seq, TEST).columns).collect())
    assert a == b and len(a) == 10


def test_null_label_kept_missing_position_dropped(spark):
    pos = TEST.window_label_positions
    rows = [(0, p, None if p == 300 else float(p)) for p in pos] + [(1, p, float(p)) for p in pos if p != 500]
    df = frame(spark, rows, "seg long, no int, y double")
    out = {r.seg: r for r in lab.window_labels(df, TEST).collect()}
    assert list(out) == [0] and out[0].y0 is None and out[0].y7 == 1000.0
    end = {r.seg: r.y for r in lab.segment_label(df, TEST).collect()}
    assert end == {0: 1000.0, 1: 1000.0}
