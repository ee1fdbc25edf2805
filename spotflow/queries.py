"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spotflow.operators import image as I, localize as L, mobility as M, spatial as S
from spotflow.registry import ORACLES, QUERIES, query, r, rounded
from spotflow.sources import adapters as A

__all__ = ["ORACLES", "QUERIES"]

# -- mobility ------------------------------------------------------------------------------------

PAIRS = f"""t AS ({A.TRACKS}), g AS (SELECT file_id, track_id, count(*) AS n, CAST(max(frame) - min(frame) + 1 AS BIGINT) AS span FROM t GROUP BY ALL),
ok AS (SELECT t.* FROM t JOIN g USING (file_id, track_id) WHERE g.n >= 3 AND g.span >= 8),
pairs AS (SELECT a.file_id, a.track_id, b.frame - a.frame AS lag, ((b.x - a.x) / 1000) * ((b.x - a.x) / 1000) + ((b.y - a.y) / 1000) * ((b.y - a.y) / 1000) AS d2
  FROM ok a JOIN ok b ON a.file_id = b.file_id AND a.track_id = b.track_id AND a.frame < b.frame),
curves AS (SELECT file_id, track_id, CAST(lag AS INTEGER) AS lag, lag / 50e0 AS lag_s, avg(d2) AS msd, stddev_pop(d2) AS sd, count(*) AS n FROM pairs GROUP BY file_id, track_id, lag)"""
MEANS = f"""{PAIRS}, sums AS (SELECT file_id, lag, lag_s, sum(CAST(n AS DOUBLE)) AS w, sum(CAST(n AS DOUBLE) * n) AS ww, sum(n * msd) / sum(CAST(n AS DOUBLE)) AS mean FROM curves GROUP BY file_id, lag, lag_s),
spread AS (SELECT c.file_id, c.lag, sum(n * (msd - mean) * (msd - mean)) AS s FROM curves c JOIN sums USING (file_id, lag) GROUP BY c.file_id, c.lag),
means AS (SELECT file_id, lag, lag_s, mean, sqrt(s / nullif(w - ww / w, 0)) AS sd, w * w / ww AS dof FROM sums JOIN spread USING (file_id, lag) WHERE w - ww / w <> 0)"""
LINES = f"""{PAIRS}, whole AS (SELECT file_id, track_id, count(*) = 4 AS whole FROM curves WHERE lag <= 4 GROUP BY ALL),
p AS (SELECT file_id, track_id, lag_s AS x, msd AS y, CAST(n AS DOUBLE) AS w FROM curves WHERE lag BETWEEN 2 AND 4),
s AS (SELECT file_id, track_id, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / nullif(sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x), 0) AS c1, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, avg(y) AS my, count(*) AS n_points FROM p GROUP BY ALL),
c AS (SELECT *, (sy - c1 * sx) / sw AS c0 FROM s),
q AS (SELECT file_id, track_id, any_value(c0) AS c0, any_value(c1) AS c1, any_value(n_points) AS n_points, 1 - sum((y - c0 - c1 * x) * (y - c0 - c1 * x)) / nullif(sum((y - my) * (y - my)), 0) AS r2 FROM p JOIN c USING (file_id, track_id) GROUP BY ALL),
lines AS (SELECT file_id, track_id, c0, c1, CASE WHEN n_points > 2 THEN 1 - (1 - r2) * (n_points - 1) / (n_points - 2) END AS adj_r2, n_points FROM q),
f AS (SELECT file_id, track_id, coalesce(whole AND c1 IS NOT NULL, false) AS is_fitted, c0, c1, adj_r2 FROM whole LEFT JOIN lines USING (file_id, track_id)),
fits AS (SELECT file_id, track_id, CASE WHEN is_fitted THEN c1 / 4 ELSE 0e0 END AS d, CASE WHEN is_fitted THEN coalesce(adj_r2, 0e0) ELSE 0e0 END AS adj_r2, CASE WHEN is_fitted THEN c0 ELSE 0e0 END AS c0, CASE WHEN is_fitted THEN c1 ELSE 0e0 END AS c1, is_fitted FROM f),
valid AS (SELECT *, log10(d) AS log_d FROM fits WHERE d > 0 AND adj_r2 >= 0.4)"""


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.msd(A.tracks(spark, sf_dir), min_track_length=8)


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.valid_diffusion(M.fit_msd(_curves(spark, sf_dir)))


@query(f"WITH {PAIRS} SELECT file_id, track_id, lag, {r('lag_s', 'lag_s')}, {r('msd', 'msd')}, {r('sd', 'sd')}, n FROM curves")
def msd_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_curves(spark, sf_dir))


@query(f"WITH {MEANS} SELECT file_id, lag, {r('lag_s', 'lag_s')}, {r('mean', 'mean')}, {r('sd', 'sd')}, {r('dof', 'dof')} FROM means")
def mean_msd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.mean_msd(_curves(spark, sf_dir)).drop("sem"))


@query(f"WITH {MEANS} SELECT file_id, lag, {r('sd / sqrt(dof)', 'sem')} FROM means")
def mean_msd_sem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.mean_msd(_curves(spark, sf_dir)).select("file_id", "lag", "sem"))


@query(f"SELECT *, span >= 60 AND n >= 3 AS is_valid FROM (SELECT file_id, track_id, count(*) AS n, CAST(max(frame) - min(frame) + 1 AS BIGINT) AS span FROM ({A.GAPPED_TRACKS}) GROUP BY ALL)")
def msd_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.valid_tracks(A.gapped_tracks(spark, sf_dir), 60)


@query(f"WITH {LINES} SELECT file_id, track_id, {r('d', 'd')}, {r('adj_r2', 'adj_r2')}, {r('c0', 'c0')}, {r('c1', 'c1')}, is_fitted FROM fits")
def msd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.fit_msd(_curves(spark, sf_dir)))


@query(f"WITH {LINES} SELECT file_id, track_id, {r('c0', 'c0')}, {r('c1', 'c1')}, {r('adj_r2', 'adj_r2')}, n_points FROM lines")
def weighted_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _curves(spark, sf_dir).filter("lag BETWEEN 2 AND 4").select(*M.TRACK, F.col("lag_s").alias("x"), F.col("msd").alias("y"), F.col("n").alias("w"))
    return rounded(M.linear_regression(rows, [*M.TRACK]))


@query(f"WITH {LINES} SELECT file_id, track_id, {r('d', 'd')}, {r('adj_r2', 'adj_r2')}, {r('log_d', 'log_d')} FROM valid")
def diffusion_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_valid(spark, sf_dir).select(*M.TRACK, "d", "adj_r2", "log_d"))


@query(f"WITH {LINES} SELECT file_id, count(*) AS n, {r('avg(log_d)', 'mu')}, {r('stddev_samp(log_d)', 'sigma')}, {r('pow(10, avg(log_d))', 'd1')} FROM valid GROUP BY file_id")
def logd_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.log_d_stats(_valid(spark, sf_dir)).drop("slow_fraction"))


@query(f"WITH {LINES} SELECT file_id, count(*) AS n, {r('avg(CASE WHEN log_d <= -0.5 THEN 1e0 ELSE 0e0 END)', 'slow_fraction')} FROM valid GROUP BY file_id")
def slow_fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.log_d_stats(_valid(spark, sf_dir), -0.5).select("file_id", "n", "slow_fraction"))


FEATURES = f"""t AS ({A.GAPPED_TRACKS}), features AS (SELECT file_id, track_id, count(*) AS n, (max(frame) - min(frame) + 1) / 50e0 AS duration_s,
  sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) AS displacement, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS range FROM t GROUP BY ALL)"""
FEATURE_COLUMNS = f"file_id, track_id, n, {r('duration_s', 'duration_s')}, {r('displacement', 'displacement')}, {r('range', 'range')}"


@query(f"WITH {FEATURES} SELECT {FEATURE_COLUMNS} FROM features")
def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.track_features(A.gapped_tracks(spark, sf_dir)))


@query(f"WITH {FEATURES} SELECT {FEATURE_COLUMNS} FROM features WHERE n BETWEEN 3 AND 70 AND displacement BETWEEN 20 AND 1e9 AND duration_s BETWEEN 1 AND 1e9 AND range BETWEEN 0 AND 1e9")
def track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"n": (3, 70), "displacement": (20, 1e9), "duration_s": (1, 1e9), "range": (0, 1e9)}
    return rounded(M.filter_features(M.track_features(A.gapped_tracks(spark, sf_dir)), limits))


@query(f"SELECT file_id, track_id, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, count(*) AS n FROM ({A.TRACKS}) GROUP BY file_id, track_id")
def track_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.track_centroids(A.tracks(spark, sf_dir)))


@query(f"SELECT file_id, track_id, {r('avg(x)', 'mean_x')}, {r('avg(y)', 'mean_y')} FROM ({A.TRACKS}) GROUP BY file_id, track_id")
def track_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.track_means(A.tracks(spark, sf_dir), ["x", "y"]))


@query(f"SELECT file_id, track_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(frame) AS min_frame, max(frame) AS max_frame FROM ({A.TRACKS}) GROUP BY file_id, track_id")
def track_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.track_bounds(A.tracks(spark, sf_dir))


SEGMENTS = f"""t AS ({A.TRACKS}), l AS (SELECT *, lead(x) OVER w AS xb, lead(y) OVER w AS yb, CAST(row_number() OVER w AS INTEGER) AS segment FROM t WINDOW w AS (PARTITION BY file_id, track_id ORDER BY frame)),
segments AS (SELECT file_id, track_id, segment, least(x, xb) AS x0, greatest(x, xb) AS x1, least(y, yb) AS y0, greatest(y, yb) AS y1 FROM l WHERE xb IS NOT NULL)"""


@query(f"WITH {SEGMENTS} SELECT * FROM segments")
def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.track_segments(A.tracks(spark, sf_dir))


@query(
    f"WITH t AS ({A.TRACKS}) SELECT file_id, track_id, CAST(row_number() OVER (PARTITION BY file_id, track_id ORDER BY frame) AS INTEGER) AS ord, x, y FROM t"
    " UNION ALL SELECT file_id, track_id, CAST(count(*) + 1 AS INTEGER), NULL, NULL FROM t GROUP BY file_id, track_id"
)
def track_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.track_polylines(A.tracks(spark, sf_dir))


@query(
    f"WITH {LINES}, every AS (SELECT DISTINCT file_id, track_id FROM t) SELECT file_id, track_id, {r('CASE WHEN is_fitted AND d > 0 THEN log10(d) END', 'mobility')},"
    " CAST((track_id * 7919 + 1) % 8 + 1 AS DOUBLE) AS random8 FROM every LEFT JOIN fits USING (file_id, track_id)"
)
def track_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = A.tracks(spark, sf_dir)
    by_mobility = M.track_colors(tracks, "mobility (log D)", _curves(spark, sf_dir)).withColumnRenamed("color", "mobility")
    return rounded(by_mobility.join(M.track_colors(tracks, "random8").withColumnRenamed("color", "random8"), [*M.TRACK]))


# -- localizations -------------------------------------------------------------------------------

LIMITS = {"psf_nm": (5.0, 40.0), "photons": (1000.0, 60000.0), "precision_nm": (0.01, 0.08)}
LIMIT_SQL = " AND ".join(f"{k} BETWEEN {a:e} AND {b:e}" for k, (a, b) in LIMITS.items())
FLAGS = f"""locs AS (SELECT * FROM ({A.LOCALIZATIONS})), med AS (SELECT file_id, median(psf_nm) AS mp, median(photons) AS mh, median(precision_nm) AS mr FROM locs GROUP BY file_id),
flags AS (SELECT l.*, {' OR '.join(f'{c} <= 0' for c in ('frame', *L.FIELDS))} AS not_positive, psf_nm > 10 * mp OR photons > 50 * mh OR precision_nm > 10 * mr AS extreme,
  {' OR '.join(f'({c} <> 0 AND round({c}) = {c})' for c in L.FIELDS)} AS rounded FROM locs l JOIN med USING (file_id)),
f AS (SELECT *, not_positive OR extreme OR rounded AS is_outlier FROM flags)"""


@query(f"SELECT * FROM ({A.LOCALIZATIONS}) WHERE {LIMIT_SQL}")
def loc_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.within_limits(A.localizations(spark, sf_dir), LIMITS)


@query(f"WITH {FLAGS} SELECT * FROM f")
def loc_outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.outlier_flags(A.localizations(spark, sf_dir))


@query(f"WITH {FLAGS} SELECT file_id, count(*) AS n, count_if(not_positive)::BIGINT AS n_not_positive, count_if(extreme)::BIGINT AS n_extreme, count_if(rounded)::BIGINT AS n_rounded, count_if(NOT is_outlier)::BIGINT AS n_remaining FROM f GROUP BY file_id")
def loc_outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.outlier_counts(L.outlier_flags(A.localizations(spark, sf_dir)))


@query(
    f"""WITH l AS ({A.LOCALIZATIONS}), b AS (SELECT CAST(least(floor(photons / 2000e0), 39) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (WHERE {LIMIT_SQL}) AS m FROM l WHERE photons BETWEEN 0 AND 80000 GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS n_original, coalesce(m, 0) AS n_filtered, i * 2000e0 AS low, (i + 1) * 2000e0 AS high FROM range(40) g(i) LEFT JOIN b ON b.bin = g.i"""
)
def loc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    locs = A.localizations(spark, sf_dir)
    return L.histogram(locs, L.within_limits(locs, LIMITS), "photons", 2000.0, 40)


@query(f"WITH l AS (SELECT frame % 97 AS file_id, frame, x_nm FROM ({A.LOCALIZATIONS})) SELECT file_id, frame, x_nm FROM l WHERE file_id IN (SELECT file_id FROM l GROUP BY file_id HAVING count(*) >= 620)")
def min_count_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.enough_rows(A.localizations(spark, sf_dir).select((F.col("frame") % 97).alias("file_id"), "frame", "x_nm"), 620)


# -- images --------------------------------------------------------------------------------------


@query(f"WITH p AS ({A.PIXELS}), w AS (SELECT file_id, avg(adu) AS mean FROM p GROUP BY file_id) SELECT file_id, row, col, {r('var_samp(adu) / 1e6', 'variance')}, {r('any_value(mean)', 'offset')} FROM p JOIN w USING (file_id) GROUP BY file_id, row, col")
def variance_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.variance_map(A.pixels(spark, sf_dir))
    return v.select("file_id", "row", "col", (F.round(F.col("variance") / 1e6, 6) + 0.0).alias("variance"), (F.round("offset", 6) + 0.0).alias("offset"))


@query(f"SELECT *, {r('(adu - 100e0) * 0.48e0', 'photons')} FROM ({A.PIXELS})")
def photon_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.to_photons(A.pixels(spark, sf_dir)))


@query(f"SELECT file_id, frame, min(adu) AS low FROM ({A.PIXELS}) GROUP BY file_id, frame")
def frame_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frame_min(A.pixels(spark, sf_dir))


@query(f"SELECT file_id, row, col, max(adu) AS peak FROM ({A.PIXELS}) GROUP BY file_id, row, col")
def max_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.max_projection(A.pixels(spark, sf_dir))


KERNEL = ", ".join(f"({i - 4}, {j - 4}, {v!r}e0)" if "e" not in repr(v) else f"({i - 4}, {j - 4}, {v!r})" for (i, j), v in ((ij, float(x)) for ij, x in __import__("numpy").ndenumerate(I.dog_kernel(1.3))))


@query(
    f"""WITH p AS ({A.PIXELS}), k AS (SELECT * FROM (VALUES {KERNEL}) v(i, j, v))
SELECT a.file_id, a.frame, a.row, a.col, {r('sum(CAST(b.adu AS FLOAT)::DOUBLE * k.v)', 'filtered', 4)} FROM p a JOIN k ON true JOIN p b ON b.file_id = a.file_id AND b.frame = a.frame AND b.row = a.row - k.i AND b.col = a.col - k.j GROUP BY ALL"""
)
def dog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = A.pixels(spark, sf_dir)
    found = I.to_pixels(I.filter_frames(I.to_frames(pixels, 32, 32), I.dog_kernel(1.3)))
    return rounded(found.withColumnRenamed("adu", "filtered").join(pixels.select(*I.PIXEL), [*I.PIXEL], "left_semi"), 4)


MAXIMA = f"""p AS ({A.PIXELS}), peaks AS (SELECT a.file_id, a.frame, a.row, a.col, a.adu AS peak FROM p a JOIN p b ON a.file_id = b.file_id AND a.frame = b.frame AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col)
  WHERE a.adu >= 300000 AND a.row BETWEEN 3 AND 28 AND a.col BETWEEN 3 AND 28 GROUP BY ALL HAVING count(*) = 8 AND max(b.adu) < a.adu)"""


@query(f"WITH {MAXIMA} SELECT * FROM peaks")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.local_maxima(A.pixels(spark, sf_dir), "adu", 300000.0, 3)


@query(f"WITH {MAXIMA} SELECT k.file_id, k.frame, k.row AS peak_row, k.col AS peak_col, b.row - k.row AS dr, b.col - k.col AS dc, b.adu AS value FROM peaks k JOIN p b ON b.file_id = k.file_id AND b.frame = k.frame AND abs(b.row - k.row) <= 3 AND abs(b.col - k.col) <= 3")
def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = A.pixels(spark, sf_dir)
    return I.crop(I.local_maxima(pixels, "adu", 300000.0, 3), pixels, 7)


@query(f"SELECT file_id, frame, col + 1 AS x, row + 1 AS y FROM ({A.PIXELS}) WHERE col + 1 > 3 AND col + 1 < 29 AND row + 1 > 3 AND row + 1 < 29")
def border_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = A.pixels(spark, sf_dir).select("file_id", "frame", (F.col("col") + 1).alias("x"), (F.col("row") + 1).alias("y"))
    return I.trim_border(peaks, 32, 32, 7)


# -- clusters ------------------------------------------------------------------------------------

EPSILON, MIN_PTS = 12.0, 4
CLUSTERED = f"""p AS ({A.POINTS}),
near AS (SELECT a.point_id AS a, b.point_id AS b FROM p a JOIN p b ON a.file_id = b.file_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EPSILON}),
dense AS (SELECT a AS point_id, count(*) AS n_near, count(*) >= {MIN_PTS} AS is_core FROM near GROUP BY a),
core AS (SELECT point_id FROM dense WHERE is_core),
reach AS (SELECT point_id AS a, point_id AS b FROM core UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b JOIN core c ON c.point_id = n.b),
root AS (SELECT a AS point_id, min(b) AS component FROM reach GROUP BY a),
numbered AS (SELECT point_id, CAST(dense_rank() OVER (ORDER BY component) AS BIGINT) AS cluster FROM root),
border AS (SELECT n.a AS point_id, min(c.cluster) AS cluster FROM near n JOIN numbered c ON c.point_id = n.b GROUP BY n.a),
clustered AS (SELECT p.*, n_near, is_core, coalesce(k.cluster, o.cluster, -1) AS cluster
  FROM p JOIN dense USING (point_id) LEFT JOIN numbered k USING (point_id) LEFT JOIN border o USING (point_id))"""


@query(f"WITH p AS ({A.POINTS}) SELECT a.file_id, a.point_id AS a, b.point_id AS b, {r('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 'distance')} FROM p a JOIN p b ON a.file_id = b.file_id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EPSILON}")
def epsilon_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.neighbours(A.points(spark, sf_dir), EPSILON))


@query(f"WITH RECURSIVE {CLUSTERED} SELECT file_id, point_id, n_near, is_core, cluster FROM clustered")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dbscan(A.points(spark, sf_dir), EPSILON, MIN_PTS).select("file_id", "point_id", "n_near", "is_core", "cluster")


@query(
    f"WITH RECURSIVE {CLUSTERED} SELECT file_id, cluster, count(*) AS n, {r('avg(x)', 'x')}, {r('avg(y)', 'y')}, "
    f"{r(f'CASE WHEN count(*) > 3 THEN {S.FWHM} * sqrt((var_pop(x) + var_pop(y)) / 2) ELSE 0 END', 'diameter')} FROM clustered WHERE cluster > 0 GROUP BY file_id, cluster"
)
def dbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.cluster_summary(S.dbscan(A.points(spark, sf_dir), EPSILON, MIN_PTS)))


@query(
    f"WITH t AS ({A.GAPPED_TRACKS}), s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM t WINDOW w AS (PARTITION BY file_id, track_id ORDER BY frame)) "
    f"SELECT file_id, track_id, frame, {r('step', 'step')}, CAST(sum(CASE WHEN step > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, track_id ORDER BY frame) + 1 AS BIGINT) AS part FROM s"
)
def track_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.split_by_distance(A.gapped_tracks(spark, sf_dir), 50.0).select("file_id", "track_id", "frame", "step", "part"))


from spotflow import more_queries  # noqa: E402, F401
