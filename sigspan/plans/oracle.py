"""Equivalent DuckDB SQL for the queries of :mod:`sigspan.plans.catalog`.

Each statement runs on the pre-registered views (``events``, ``embeddings``, ``lineitem`` ...).
Conventions shared with the Spark side: integral columns BIGINT, doubles ``round(v, 6)``,
vectors in long form with a 0-based ``k``. Skewness and kurtosis use the population moment
formulas (Spark's estimators); DuckDB's ``skewness`` is bias-corrected.
"""

from __future__ import annotations

from ..functions.stats import PROFILE_14, PROFILE_20, PROFILE_BUCKET, QUANTILE_LEVELS
from ..operators.robust import DELTA, RIDGE, ROUNDS
from ..spec import SMOKE, TAIL, TEST, SegmentSpec
from .catalog import EMB_BAND, EMB_BINS, LONG_KEEP, LOOKUP_NAMES, NAMES_SPEC

SEQ = (
    "seq AS (SELECT event_id AS uid, ts, value AS x, CAST(1700 - event_id % 1700 AS DOUBLE) / 100 AS y, "
    "row_number() OVER (ORDER BY ts, event_id) AS idx FROM events)"
)


def sig(L: int, name: str = "sig") -> str:
    return f"{name} AS (SELECT uid, idx, (idx - 1) // {L} AS seg, (idx - 1) % {L} + 1 AS no, x, y FROM seq)"


def with_sig(L: int, *more: str) -> str:
    return "WITH " + ", ".join([SEQ, sig(L), *more])


def r6(e: str) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0, as on the Spark side
    return f"(round(CAST({e} AS DOUBLE), 6) + 0.0)"


def _slice_cond(spec: SegmentSpec, slice_col: str = "r.slice", no: str = "s.no") -> str:
    s = spec.slice_len
    if spec.boundary == "inclusive":
        return f"{no} BETWEEN {slice_col} * {s} AND ({slice_col} + 1) * {s}"
    return f"{no} > {slice_col} * {s} AND {no} <= ({slice_col} + 1) * {s}"


def slices_cte(spec: SegmentSpec, complete_only: bool = True) -> str:
    """``sl(seg, slice, no, x)`` -- each sample once per slice it belongs to (complete segments only)."""
    n = spec.n_slices
    base = (
        f"sl_all AS (SELECT s.seg, r.slice, s.no, s.x FROM sig s JOIN (SELECT range AS slice FROM range({n})) r "
        f"ON {_slice_cond(spec)})"
    )
    if not complete_only:
        return base + ", sl AS (SELECT * FROM sl_all)"
    return base + (
        f", sl AS (SELECT * FROM sl_all WHERE seg IN "
        f"(SELECT seg FROM sl_all GROUP BY seg HAVING count(DISTINCT slice) = {n}))"
    )


def _profile_sql(stats, table: str, keys: list[str], value: str, extra_ctes: str = "", rounded: bool = True) -> str:
    """Profile statistics over ``table`` grouped by ``keys``; moments from a two-pass mean."""
    k = ", ".join(keys)
    jk = " AND ".join(f"t.{c} = g.{c}" for c in keys)
    ctes = (
        f"g AS (SELECT {k}, avg({value}) AS mx, avg(abs({value})) AS ma FROM {table} GROUP BY {k}), "
        f"d AS (SELECT t.*, t.{value} AS xv, abs(t.{value}) AS av, t.{value} - g.mx AS dx, abs(t.{value}) - g.ma AS da "
        f"FROM {table} t JOIN g ON {jk})"
    )
    cols = []
    for name, kind, src, arg in stats:
        v, dv = ("xv", "dx") if src == "x" else ("av", "da")
        if kind == "avg":
            e = f"avg({v})"
        elif kind == "std":
            e = f"stddev_samp({v})"
        elif kind == "skew":
            e = f"avg({dv} * {dv} * {dv}) / nullif(pow(avg({dv} * {dv}), 1.5), 0)"
        elif kind == "kurt":
            e = f"avg({dv} * {dv} * {dv} * {dv}) / nullif(pow(avg({dv} * {dv}), 2), 0) - 3"
        elif kind == "max":
            e = f"max({v})"
        elif kind == "pct":
            e = f"quantile_cont({v}, {arg})"
        else:
            raise ValueError(kind)
        cols.append(f"{r6(e) if rounded else e} AS {name}")
    sel_keys = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in keys)
    prefix = (extra_ctes + ", ") if extra_ctes else "WITH "
    return f"{prefix}{ctes} SELECT {sel_keys}, {', '.join(cols)} FROM d GROUP BY {k}"


def _dct(src: str, key: str, n: str, v: str, keep: int | None) -> str:
    """Orthonormal DCT-II by direct cosine sums: rows ``(key..., k, c)``; column ``nlen`` is the length.

    ``keep``: number of coefficients (low pass); ``None`` keeps all (``k`` over the positions).
    """
    ks = f"(SELECT range AS k FROM range({keep}))" if keep is not None else f"(SELECT DISTINCT {n} AS k FROM {src})"
    return (
        f"SELECT {key}, kk.k, CASE WHEN kk.k = 0 THEN sqrt(1.0 / nlen) ELSE sqrt(2.0 / nlen) END * "
        f"sum({v} * cos(pi() / nlen * ({n} + 0.5) * kk.k)) AS c "
        f"FROM {src} JOIN {ks} kk ON kk.k < {src}.nlen GROUP BY {key}, kk.k, nlen"
    )


def _scaled(src: str, by: str, v: str = "c") -> str:
    """``v / stddev_samp(v)`` per ``by`` group, 0 where the std is 0 or undefined."""
    return (
        f"SELECT *, CASE WHEN coalesce(stddev_samp({v}) OVER (PARTITION BY {by}), 0) = 0 THEN 0.0 "
        f"ELSE {v} / stddev_samp({v}) OVER (PARTITION BY {by}) END AS z FROM {src}"
    )


def _bins(src: str, keys: str, kcol: str, v: str, n_bins: int, hop: int, width: int, divisor: float) -> str:
    return (
        f"SELECT {keys}, bb.b, sum(abs({v})) / {float(divisor)} AS f FROM {src} JOIN (SELECT range AS b FROM range({n_bins})) bb "
        f"ON {src}.{kcol} >= bb.b * {hop} AND {src}.{kcol} < bb.b * {hop} + {width} GROUP BY {keys}, bb.b"
    )


EMB = (
    "e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS j, "
    "len(embedding) AS nlen FROM embeddings)"
)


def _concat_cte(spec: SegmentSpec) -> str:
    """``cs(seg, j, x, nlen)``: segment vector in long form (inclusive slices concatenated)."""
    return (
        slices_cte(spec)
        + ", cs AS (SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY slice, no) - 1 AS j, x, "
        "count(*) OVER (PARTITION BY seg) AS nlen FROM sl)"
    )


def _spectral_pipeline_ctes(spec: SegmentSpec) -> str:
    b = spec.bins
    return (
        with_sig(spec.length, _concat_cte(spec))
        + f", c AS ({_dct('cs', 'seg', 'j', 'x', spec.dct_keep)}), z AS ({_scaled('c', 'k')}), "
        f"fb AS ({_bins('z', 'seg', 'k', 'z', b.n_bins, b.hop, b.width, b.divisor)})"
    )


def _window_ctes(spec: SegmentSpec) -> str:
    nw, ws = spec.n_windows, spec.win_slices
    return (
        with_sig(spec.length, slices_cte(spec))
        + f", wr AS (SELECT sl.seg, w.win, sl.slice, sl.no, sl.x FROM sl JOIN (SELECT range AS win FROM range({nw})) w "
        f"ON sl.slice BETWEEN w.win AND w.win + {ws - 1})"
        ", wv AS (SELECT seg, win, row_number() OVER (PARTITION BY seg, win ORDER BY slice, no) - 1 AS j, x, "
        "count(*) OVER (PARTITION BY seg, win) AS nlen FROM wr)"
        f", wc AS ({_dct('wv', 'seg, win', 'j', 'x', spec.win_dct_keep)})"
        f", wz AS ({_scaled('wc', 'win, k')})"
    )


def _split_ctes(spec: SegmentSpec, fraction: str = "0.8") -> str:
    L = spec.length
    return (
        f"p AS (SELECT max(idx) // {L} AS full FROM sig), "
        f"t AS (SELECT s.*, CAST(floor(p.full * CAST({fraction} AS DECIMAL(10, 6))) AS BIGINT) AS n_train "
        f"FROM sig s, p WHERE s.seg < p.full)"
    )


def _absolute_fit_sql(spec: SegmentSpec) -> str:
    """Least absolute error by weights: rounds of weighted normal equations, each solved by elimination (Gauss-Jordan,
    one pivot for each step of a recursion). Features are scaled by the std of the training segments."""
    p = spec.n_features + 1
    b, first, last = spec.bins, spec.band_start, spec.band_start + spec.band_size - 1
    ctes = [
        f"c AS ({_dct('cs', 'seg', 'j', 'x', spec.dct_keep)})",
        f"nt AS (SELECT max(idx) // {spec.length} AS n_full, CAST(floor((max(idx) // {spec.length}) * CAST(0.8 AS DECIMAL(10, 6))) AS BIGINT) AS n_train FROM sig)",
        "sd AS (SELECT k, coalesce(stddev_samp(c), 0) AS s FROM c, nt WHERE seg < n_train GROUP BY k)",
        "z AS (SELECT seg, k, CASE WHEN s = 0 THEN 0.0 ELSE c / s END AS z FROM c JOIN sd USING (k), nt WHERE seg < n_full)",
        f"fb AS ({_bins('z', 'seg', 'k', 'z', b.n_bins, b.hop, b.width, b.divisor)})",
        f"feat AS (SELECT seg, list(f ORDER BY b) AS f FROM fb WHERE b BETWEEN {first} AND {last} AND (b - {first}) % {spec.stride} = 0 GROUP BY seg)",
        f"d AS MATERIALIZED (SELECT seg, list_concat([CAST(1 AS DOUBLE)], f) AS z, y AS label, seg < n_train AS is_train FROM feat JOIN (SELECT seg, y FROM sig WHERE no = {spec.length}) USING (seg), nt)",
        "mx AS (SELECT max(label) AS m FROM d WHERE is_train)",
        "t AS MATERIALIZED (SELECT z, label / m AS y FROM d, mx WHERE is_train)",
    ]
    for r in range(ROUNDS):
        weight = "CAST(1 AS DOUBLE)" if r == 0 else f"1 / sqrt(pow(y - list_dot_product(z, beta), 2) + {DELTA} * {DELTA})"
        rows = "t" if r == 0 else f"t, b{r - 1}"
        ctes += [
            f"w{r} AS MATERIALIZED (SELECT z, y, {weight} AS w FROM {rows})",
            f"n{r} AS MATERIALIZED (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS line FROM ("
            f"SELECT i, j, sum(w * z[i] * CASE WHEN j <= {p} THEN z[j] ELSE y END) + CASE WHEN i = j THEN {RIDGE} ELSE 0 END AS s "
            f"FROM w{r}, range(1, {p + 1}) a(i), range(1, {p + 2}) o(j) GROUP BY i, j) GROUP BY i))",
            f"e{r} AS (SELECT 1 AS k, m FROM n{r} UNION ALL SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k "
            f"THEN list_transform(line, lambda x: x / m[k][k]) ELSE list_transform(line, lambda x, j: x - line[k] * m[k][j] / m[k][k]) END) FROM e{r} WHERE k <= {p})",
            f"b{r} AS MATERIALIZED (SELECT list_transform(m, lambda line: line[{p + 1}]) AS beta FROM e{r} WHERE k = {p + 1})",
        ]
    return (
        with_sig(spec.length, _concat_cte(spec), *ctes).replace("WITH ", "WITH RECURSIVE ", 1)
        + f" SELECT CAST(seg AS BIGINT) AS seg, CASE WHEN is_train THEN 'train' ELSE 'holdout' END AS set_name, {r6('label')} AS label, "
        f"{r6('list_dot_product(z, beta) * m')} AS prediction FROM d, mx, b{ROUNDS - 1}"
    )


def build() -> dict[str, str]:
    T, L = TEST, TEST.length
    q: dict[str, str] = {}

    q["row_index"] = f"WITH {SEQ} SELECT CAST(uid AS BIGINT) AS uid, CAST(idx AS BIGINT) AS idx FROM seq"
    q["sequenced_signal"] = (
        with_sig(L) + f" SELECT CAST(uid AS BIGINT) AS uid, CAST(seg AS BIGINT) AS seg, CAST(no AS BIGINT) AS no, "
        f"{r6('x')} AS x, {r6('y')} AS y FROM sig"
    )
    q["rank_in_segment"] = (
        "SELECT CAST(user_id AS BIGINT) AS user_id, CAST(event_id AS BIGINT) AS uid, "
        "CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS no FROM events"
    )
    q["rank_in_segment_nulls"] = (
        "SELECT CAST(nullif(user_id % 7, 0) AS BIGINT) AS grp, CAST(event_id AS BIGINT) AS uid, "
        "CAST(row_number() OVER (PARTITION BY nullif(user_id % 7, 0) ORDER BY ts, event_id) AS BIGINT) AS no FROM events"
    )
    q["segment_names"] = (
        with_sig(NAMES_SPEC.length)
        + " SELECT CAST(seg AS BIGINT) AS seg, printf('raw_%04d', seg) AS name FROM sig WHERE no = 1"
    )
    q["complete_segments"] = (
        with_sig(TAIL.length)
        + f" SELECT CAST(seg AS BIGINT) AS seg, count(*) AS n FROM sig GROUP BY seg HAVING max(no) = {TAIL.length}"
    )
    q["global_max"] = "SELECT CAST(max(event_id) AS BIGINT) AS m FROM events"

    # ---- profiles
    q["moments_profile"] = (
        "WITH g AS (SELECT l_suppkey, avg(l_extendedprice) AS mu FROM lineitem GROUP BY l_suppkey), "
        "d AS (SELECT l.l_suppkey, l.l_extendedprice AS v, l.l_extendedprice - g.mu AS dv FROM lineitem l JOIN g USING (l_suppkey)) "
        f"SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, {r6('avg(v)')} AS \"avg\", {r6('stddev_samp(v)')} AS std, "
        f"{r6('avg(dv * dv * dv) / nullif(pow(avg(dv * dv), 1.5), 0)')} AS skew, "
        f"{r6('avg(dv * dv * dv * dv) / nullif(pow(avg(dv * dv), 2), 0) - 3')} AS kurt, {r6('max(v)')} AS \"max\" "
        "FROM d GROUP BY l_suppkey"
    )
    q["segment_quantiles"] = with_sig(L) + " " + " UNION ALL ".join(
        f"SELECT CAST(seg AS BIGINT) AS seg, {r6(f'CAST({p} AS DOUBLE)')} AS p, {r6(f'quantile_cont(x, {p})')} AS q "
        "FROM sig GROUP BY seg"
        for p in QUANTILE_LEVELS
    )
    q["supplier_quantiles"] = " UNION ALL ".join(
        f"SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, {r6(f'CAST({p} AS DOUBLE)')} AS p, "
        f"{r6(f'quantile_cont(l_extendedprice, {p})')} AS q FROM lineitem GROUP BY l_suppkey"
        for p in QUANTILE_LEVELS
    )
    q["supplier_quantiles_nulls"] = " UNION ALL ".join(
        f"SELECT CAST(nullif(l_suppkey % 7, 0) AS BIGINT) AS grp, {r6(f'CAST({p} AS DOUBLE)')} AS p, "
        f"{r6(f'quantile_cont(l_extendedprice, {p})')} AS q FROM lineitem GROUP BY 1"
        for p in QUANTILE_LEVELS
    )
    q["selected_quantiles"] = " UNION ALL ".join(
        f"SELECT CAST(nullif(l_quantity % 3, 0) AS BIGINT) AS grp, {r6(f'CAST({p} AS DOUBLE)')} AS p, "
        f"{r6(f'quantile_cont(l_extendedprice, {p})')} AS q FROM lineitem GROUP BY 1"
        for p in QUANTILE_LEVELS
    )
    q["segment_profile_20"] = _profile_sql(PROFILE_20, "sig", ["seg"], "x", with_sig(L))
    q["segment_profile_14"] = _profile_sql(PROFILE_14, "sig", ["seg"], "x", with_sig(L))
    bsig = with_sig(L, f"bs AS (SELECT *, no // {T.bucket} AS seq FROM sig)")
    q["bucket_profile"] = _profile_sql(PROFILE_BUCKET, "bs", ["seg", "seq"], "x", bsig)
    bp_raw = (
        "bp AS (SELECT seg, no // {B} AS seq, avg(x) AS x_avg, quantile_cont(x, 0.02) AS x_p02, "
        "quantile_cont(x, 0.98) AS x_p98, quantile_cont(abs(x), 0.95) AS xa_p95 FROM {src} GROUP BY seg, no // {B})"
    )
    q["bucket_vectors"] = (
        with_sig(L, bp_raw.format(B=T.bucket, src="sig"))
        + " SELECT CAST(seg AS BIGINT) AS seg, CAST(row_number() OVER (PARTITION BY seg ORDER BY seq) - 1 AS BIGINT) AS k, "
        f"{r6('x_avg')} AS stx1, {r6('x_p02')} AS stx2, {r6('x_p98')} AS stx3, {r6('xa_p95')} AS stx4 FROM bp"
    )
    scaled_cols = ", ".join(
        f"{r6(f'CASE WHEN coalesce(stddev_samp({c}) OVER (PARTITION BY k), 0) = 0 THEN 0.0 ELSE {c} / stddev_samp({c}) OVER (PARTITION BY k) END')} AS stxn{i + 1}"
        for i, c in enumerate(["x_avg", "x_p02", "x_p98", "xa_p95"])
    )
    q["bucket_features"] = (
        with_sig(
            L,
            f"cmp AS (SELECT * FROM sig WHERE idx <= (SELECT max(idx) FROM sig) // {L} * {L})",
            bp_raw.format(B=T.bucket, src="cmp"),
            "bk AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY seq) - 1 AS k FROM bp)",
        )
        + f" SELECT CAST(seg AS BIGINT) AS seg, CAST(k AS BIGINT) AS k, {scaled_cols} FROM bk"
    )
    stat_names = [s[0] for s in PROFILE_20]
    prof_raw = _profile_sql(
        [(n, kind, src, arg) for n, kind, src, arg in PROFILE_20], "sig", ["seg"], "x", with_sig(L)
    )
    unpivot = (
        f"SELECT seg, unnest(range({len(stat_names)})) AS k, unnest([{', '.join(stat_names)}]) AS v FROM pr"
    )
    # the rounded profile is re-rounded on both sides: rounding twice at 6 decimals is stable
    q["profile_vector"] = (
        f"WITH pr AS ({prof_raw}), pv AS ({unpivot}) "
        f"SELECT CAST(seg AS BIGINT) AS seg, CAST(k AS BIGINT) AS k, {r6('v')} AS v FROM pv"
    )
    prof_exact = _profile_sql(PROFILE_20, "sig", ["seg"], "x", with_sig(L), rounded=False)
    q["profile_scaled"] = (
        f"WITH pr AS ({prof_exact}), pv AS ({unpivot}), sv AS ({_scaled('pv', 'k', 'v')}) "
        f"SELECT CAST(seg AS BIGINT) AS seg, CAST(k AS BIGINT) AS k, {r6('z')} AS v FROM sv"
    )
    q["scaler_params"] = f"WITH {EMB} SELECT CAST(j AS BIGINT) AS k, {r6('stddev_samp(v)')} AS std FROM e GROUP BY j"
    q["scaler_merge"] = q["scaler_params"]
    moments = [s for s in PROFILE_20 if s[1] != "pct"]
    q["segment_profile_rollup"] = _profile_sql(moments, "sig", ["seg"], "x", with_sig(L))
    q["scaled_self"] = (
        f"WITH {EMB}, ek AS (SELECT vec_id, j AS k, v FROM e), s AS ({_scaled('ek', 'k', 'v')}) "
        f"SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(k AS BIGINT) AS k, {r6('z')} AS v FROM s"
    )
    q["scaled_train_test"] = (
        f"WITH {EMB}, sd AS (SELECT j, stddev_samp(v) AS s FROM e WHERE vec_id % 5 < 4 GROUP BY j) "
        "SELECT CAST(e.vec_id AS BIGINT) AS vec_id, CAST(e.vec_id % 5 < 4 AS BIGINT) AS is_train, CAST(e.j AS BIGINT) AS k, "
        f"{r6('CASE WHEN coalesce(sd.s, 0) = 0 THEN 0.0 ELSE e.v / sd.s END')} AS v FROM e JOIN sd USING (j)"
    )

    # ---- labels
    q["label_at_end"] = with_sig(L) + f" SELECT CAST(seg AS BIGINT) AS seg, {r6('y')} AS y FROM sig WHERE no = {L}"
    pos = T.window_label_positions
    joins = " ".join(f"JOIN sig d{j} ON d{j}.no = {p} AND d{j}.seg = d0.seg" for j, p in enumerate(pos) if j > 0)
    ys = ", ".join(f"{r6(f'd{j}.y')} AS y{j}" for j in range(len(pos)))
    q["window_labels"] = (
        with_sig(L) + f" SELECT CAST(d0.seg AS BIGINT) AS seg, {ys} FROM sig d0 {joins} WHERE d0.no = {pos[0]}"
    )

    # ---- slices
    q["slice_rows"] = (
        with_sig(L, slices_cte(T, complete_only=False))
        + f" SELECT CAST(seg AS BIGINT) AS seg, CAST(slice AS BIGINT) AS slice, count(*) AS n, {r6('sum(x)')} AS x_sum "
        "FROM sl GROUP BY seg, slice"
    )
    for key, length in (("slice_vectors", L), ("slice_vectors_long", L + 100)):
        q[key] = (
            with_sig(length, slices_cte(T))
            + " SELECT CAST(seg AS BIGINT) AS seg, CAST(slice AS BIGINT) AS slice, "
            f"CAST(row_number() OVER (PARTITION BY seg, slice ORDER BY no) - 1 AS BIGINT) AS k, {r6('x')} AS v FROM sl"
            + (f" WHERE seg NOT IN (SELECT seg FROM sig GROUP BY seg HAVING max(no) <= {T.slice_len * (T.n_slices - 1)})" if length > L else "")
        )
    tl, ts_ = TAIL.length, TAIL.slice_len
    subs = [
        f"(SELECT seg, count(*) AS n{i} FROM sig WHERE no BETWEEN {i * ts_} AND {(i + 1) * ts_} GROUP BY seg) q{i}"
        for i in range(TAIL.n_slices)
    ]
    from_ = subs[0] + " " + " ".join(f"JOIN {s} USING (seg)" for s in subs[1:])
    q["slice_join"] = (
        with_sig(tl)
        + " SELECT CAST(seg AS BIGINT) AS seg, "
        + ", ".join(f"n{i}" for i in range(TAIL.n_slices))
        + f" FROM {from_}"
    )
    q["concat_slices"] = (
        with_sig(L, _concat_cte(T))
        + f" SELECT CAST(seg AS BIGINT) AS seg, CAST(j AS BIGINT) AS k, {r6('x')} AS v FROM cs"
    )
    q["sliding_windows"] = (
        with_sig(L, slices_cte(T))
        + f" SELECT CAST(sl.seg AS BIGINT) AS seg, CAST(w.win AS BIGINT) AS win, count(*) AS n, {r6('sum(sl.x)')} AS x_sum "
        f"FROM sl JOIN (SELECT range AS win FROM range({T.n_windows})) w ON sl.slice BETWEEN w.win AND w.win + {T.win_slices - 1} "
        "GROUP BY sl.seg, w.win"
    )

    # ---- spectra
    q["dct_spectrum"] = (
        f"WITH {EMB}, c AS ({_dct('e', 'vec_id', 'j', 'v', None)}) "
        f"SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(k AS BIGINT) AS k, {r6('c')} AS v FROM c"
    )
    q["dct_lowpass"] = (
        with_sig(L, _concat_cte(T))
        + f", c AS ({_dct('cs', 'seg', 'j', 'x', T.dct_keep)}) "
        f"SELECT CAST(seg AS BIGINT) AS seg, CAST(k AS BIGINT) AS k, {r6('c')} AS v FROM c"
    )
    q["long_spectrum"] = (
        f"WITH {SEQ}, n AS (SELECT CAST(pow(10, length(CAST(count(*) AS VARCHAR)) - 1) AS BIGINT) AS nlen FROM seq), "
        f"s AS (SELECT idx - 1 AS j, x AS v, nlen, 0 AS seg FROM seq, n WHERE idx <= nlen), c AS ({_dct('s', 'seg', 'j', 'v', LONG_KEEP)}) "
        f"SELECT CAST(k AS BIGINT) AS k, {r6('c')} AS v FROM c"
    )
    eb = EMB_BINS
    q["spectral_bins"] = (
        f"WITH {EMB}, fb AS ({_bins('e', 'vec_id', 'j', 'v', eb.n_bins, eb.hop, eb.width, eb.divisor)}) "
        f"SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(b AS BIGINT) AS b, {r6('f')} AS v FROM fb"
    )
    b0, bn = EMB_BAND
    q["band_slice"] = (
        f"WITH {EMB} SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(j - {b0} AS BIGINT) AS k, {r6('v')} AS v "
        f"FROM e WHERE j BETWEEN {b0} AND {b0 + bn - 1}"
    )
    q["stride_slice"] = (
        f"WITH {EMB} SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST((j - {b0}) // 2 AS BIGINT) AS k, {r6('v')} AS v "
        f"FROM e WHERE j BETWEEN {b0} AND {b0 + bn - 1} AND (j - {b0}) % 2 = 0"
    )
    q["spectral_pipeline"] = (
        _spectral_pipeline_ctes(T)
        + f" SELECT CAST(seg AS BIGINT) AS seg, CAST(b AS BIGINT) AS b, {r6('f')} AS v FROM fb"
    )
    q["window_spectra"] = (
        _window_ctes(T)
        + f" SELECT CAST(seg AS BIGINT) AS seg, CAST(win AS BIGINT) AS win, CAST(k AS BIGINT) AS k, {r6('z')} AS v FROM wz"
    )
    q["window_spectra_shared"] = q["window_spectra"]
    wb = T.win_bins
    wbins = _bins("wz", "seg, win", "k", "z", wb.n_bins, wb.hop, wb.width, wb.divisor)
    q["window_spectral_bins"] = (
        _window_ctes(T)
        + f", wf AS ({wbins}) SELECT CAST(seg AS BIGINT) AS seg, CAST(win AS BIGINT) AS win, CAST(b AS BIGINT) AS b, "
        f"{r6('f')} AS v FROM wf"
    )
    q["window_features"] = (
        _window_ctes(T)
        + f", wf AS ({wbins}) SELECT CAST(seg AS BIGINT) AS seg, CAST(win * {T.band_size} + (b - {T.band_start}) AS BIGINT) AS k, "
        f"{r6('f')} AS v FROM wf WHERE b BETWEEN {T.band_start} AND {T.band_start + T.band_size - 1}"
    )

    # ---- files and sinks
    q["csv_roundtrip"] = with_sig(L) + f" SELECT {r6('sum(x)')} AS x, {r6('sum(y)')} AS y, count(*) AS n FROM sig"
    q["csv_sequence"] = (
        with_sig(L) + f" SELECT CAST(seg AS BIGINT) AS seg, CAST(no AS BIGINT) AS no, {r6('x')} AS x, {r6('y')} AS y FROM sig"
    )
    q["multi_file_segments"] = (
        with_sig(L)
        + " SELECT CAST((SELECT max(seg) FROM sig) - seg AS BIGINT) AS seg, "
        "CASE WHEN seg % 2 = 0 THEN printf('%05d', seg) ELSE printf('raw %04d', seg) END AS name, "
        f"CAST(no AS BIGINT) AS no, {r6('x')} AS x FROM sig"
    )
    q["streamed_segment_files"] = q["flat_segment_files"] = q["multi_file_segments"]
    q["continued_file_ids"] = (
        with_sig(L, "m AS (SELECT max(uid) AS last_uid, max(seg) AS last_seg FROM sig)")
        + " SELECT CAST(last_uid + row_number() OVER (ORDER BY last_seg - seg, no) AS BIGINT) AS uid, CAST(1 AS BIGINT) AS \"set\", "
        f"CAST(last_seg - seg AS BIGINT) AS seg, CAST(no AS BIGINT) AS no, {r6('x')} AS x FROM sig, m"
    )

    def union_cte(spec: SegmentSpec) -> str:
        n = spec.length
        return (
            f"p AS (SELECT max(idx) // {n} AS n_full FROM sig), "
            "p2 AS (SELECT n_full, CAST(floor(n_full * CAST(0.8 AS DECIMAL(10, 6))) AS BIGINT) AS n_train FROM p), "
            "u0 AS (SELECT sig.*, n_train, CASE WHEN sig.seg >= n_train AND sig.seg < n_full THEN 1 ELSE 0 END AS grp FROM sig, p2), "
            "u AS (SELECT uid, idx, no, x, y, n_train, grp, CASE WHEN grp = 1 THEN seg - n_train ELSE least(seg, n_train) END AS seg FROM u0)"
        )

    union = with_sig(TAIL.length, union_cte(TAIL))
    q["train_test_union"] = (
        union
        + ", mx AS (SELECT max(uid) AS m FROM u WHERE grp = 0) "
        f"SELECT CAST(CASE WHEN grp = 0 THEN uid ELSE mx.m + idx - n_train * {TAIL.length} END AS BIGINT) AS uid, CAST(grp AS BIGINT) AS \"set\", "
        f"CAST(seg AS BIGINT) AS seg, CAST(no AS BIGINT) AS no, {r6('CASE WHEN grp = 0 THEN y END')} AS y FROM u, mx"
    )
    q["union_profile"] = _profile_sql(PROFILE_20, "u", ["grp", "seg"], "x", union)
    q["union_slice_vectors"] = (
        with_sig(L, slices_cte(T), "n AS (SELECT CAST(floor((max(idx) // %d) * CAST(0.8 AS DECIMAL(10, 6))) AS BIGINT) AS n_train FROM sig)" % L)
        + " SELECT CAST(CASE WHEN seg < n_train THEN 0 ELSE 1 END AS BIGINT) AS grp, CAST(CASE WHEN seg < n_train THEN seg ELSE seg - n_train END AS BIGINT) AS seg, "
        f"CAST(slice AS BIGINT) AS slice, CAST(row_number() OVER (PARTITION BY seg, slice ORDER BY no) - 1 AS BIGINT) AS k, {r6('x')} AS v FROM sl, n"
    )
    q["sql_profile"] = q["segment_profile_14"]
    q["sorted_stage"] = (
        with_sig(L)
        + " SELECT CAST(row_number() OVER (ORDER BY seg, no) AS BIGINT) AS place, CAST(seg AS BIGINT) AS seg, CAST(no AS BIGINT) AS no FROM sig"
    )
    q["segment_lookup"] = (
        with_sig(SMOKE.length, "named AS (SELECT substr(md5(CAST(seg AS VARCHAR)), 1, 12) AS name, no, x FROM sig)")
        + f" SELECT name, CAST(no AS BIGINT) AS no, {r6('x')} AS x FROM named WHERE name IN ({', '.join(repr(n) for n in LOOKUP_NAMES)})"
    )
    q["parquet_roundtrip"] = (
        union + f" SELECT CAST(grp AS BIGINT) AS \"set\", count(*) AS n, {r6('sum(x)')} AS x_sum FROM u GROUP BY 1"
    )
    q["append_batches"] = with_sig(L) + " SELECT CAST(seg AS BIGINT) AS seg, count(*) AS n FROM sig GROUP BY seg"
    q["guarded_write"] = f"WITH {SEQ} SELECT count(*) AS n, {r6('sum(x)')} AS x_sum, CAST(1 AS BIGINT) AS refused FROM seq"

    # ---- model
    q["training_set"] = (
        _spectral_pipeline_ctes(T)
        + f", lab AS (SELECT seg, y FROM sig WHERE no = {L}) "
        f"SELECT CAST(fb.seg AS BIGINT) AS seg, CAST((fb.b - {T.band_start}) // {T.stride} AS BIGINT) AS k, {r6('fb.f')} AS v, "
        f"{r6('lab.y')} AS label FROM fb JOIN lab USING (seg) "
        f"WHERE fb.b BETWEEN {T.band_start} AND {T.band_start + T.band_size - 1} AND (fb.b - {T.band_start}) % {T.stride} = 0"
    )
    q["training_set_union"] = (
        _spectral_pipeline_ctes(T)
        + f", lab AS (SELECT seg, y FROM sig WHERE no = {L}), "
        f"n AS (SELECT CAST(floor((max(idx) // {L}) * CAST(0.8 AS DECIMAL(10, 6))) AS BIGINT) AS n_train FROM sig) "
        "SELECT CAST(CASE WHEN fb.seg < n_train THEN 0 ELSE 1 END AS BIGINT) AS grp, CAST(CASE WHEN fb.seg < n_train THEN fb.seg ELSE fb.seg - n_train END AS BIGINT) AS seg, "
        f"CAST((fb.b - {T.band_start}) // {T.stride} AS BIGINT) AS k, {r6('fb.f')} AS v, {r6('CASE WHEN fb.seg < n_train THEN lab.y END')} AS label "
        f"FROM fb JOIN lab USING (seg), n WHERE fb.b BETWEEN {T.band_start} AND {T.band_start + T.band_size - 1} AND (fb.b - {T.band_start}) % {T.stride} = 0"
    )
    M = SMOKE.length
    q["ordered_features"] = (
        with_sig(M)
        + f" SELECT CAST(row_number() OVER (ORDER BY {r6('avg(x)')}, seg) - 1 AS BIGINT) AS pos, CAST(seg AS BIGINT) AS seg, "
        f"{r6('avg(x)')} AS x_avg FROM sig GROUP BY seg"
    )
    q["target_scaled"] = (
        with_sig(L, f"lab AS (SELECT seg, y FROM sig WHERE no = {L})", "mm AS (SELECT max(y) AS m FROM lab)")
        + f" SELECT CAST(seg AS BIGINT) AS seg, {r6('y')} AS label, {r6('y / m')} AS scaled, {r6('y / m * m')} AS back "
        "FROM lab, mm"
    )
    msplit = with_sig(M, _split_ctes(SMOKE))
    q["mae_metric"] = (
        msplit
        + f", lab AS (SELECT seg, CASE WHEN seg < n_train THEN 0 ELSE 1 END AS is_test, y FROM t WHERE no = {M}), "
        "base AS (SELECT avg(y) AS pred FROM lab WHERE is_test = 0) "
        f"SELECT CASE WHEN is_test = 0 THEN 'train' ELSE 'holdout' END AS set_name, {r6('avg(abs(y - pred))')} AS mae, "
        f"{r6('avg((y - pred) * (y - pred))')} AS mse FROM lab, base GROUP BY 1"
    )
    q["regression_fit"] = (
        msplit
        + f" SELECT CAST(term AS BIGINT) AS term, count(*) AS n_train, CAST(0 AS DOUBLE) AS moment "
        f"FROM t, range({SMOKE.n_features + 1}) r(term) WHERE no = {M} AND seg < n_train GROUP BY term"
    )
    q["regression_predict"] = _absolute_fit_sql(SMOKE)
    line = (
        f", f AS (SELECT seg, any_value(n_train) AS n_train, avg(x) AS x_avg, max(CASE WHEN no = {M} THEN y END) AS label FROM t GROUP BY seg), "
        "line AS (SELECT regr_slope(label, x_avg) AS a, regr_intercept(label, x_avg) AS b FROM f WHERE seg < n_train) "
    )
    for key, value in (("submission_join", r6("a * x_avg + b")), ("submission_export", f"printf('%.20f', {r6('a * x_avg + b')})")):
        q[key] = (
            msplit + line
            + f"SELECT printf('raw_%04d', CAST(seg AS BIGINT)) AS seg_id, {value} AS time_to_failure FROM f, line WHERE seg >= n_train"
        )
    q["single_file_export"] = (
        msplit + line
        + f"SELECT CAST(1 AS BIGINT) AS files, count(*) AS n, {r6('round(sum(a * x_avg + b), 4)')} AS total FROM f, line WHERE seg >= n_train"
    )
    return q


ORACLE_SQL = build()
