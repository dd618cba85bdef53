"""Numbers, teams, colours and heatmap metrics."""

from pyspark.sql import functions as F

from ..functions.geometry import rounded
from ..operators import teams
from .inputs import with_inputs
from .registry import query, r

LOCKS = [
    (
        "valid_reads",
        """SELECT game, tid, ord, frame, CAST(CAST(text AS BIGINT) AS VARCHAR) AS num FROM reads
           WHERE regexp_full_match(text, '[0-9]{1,2}') AND TRY_CAST(text AS BIGINT) BETWEEN 1 AND 99""",
    ),
    (
        "second_reads",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game, tid, num ORDER BY ord) AS rn
           FROM valid_reads) a WHERE rn = 2""",
    ),
    (
        "locks",
        """SELECT game, tid, arg_min(num, ord) AS num, min(ord) AS lock_ord, arg_min(frame, ord) AS lock_frame
           FROM second_reads GROUP BY game, tid""",
    ),
]


@query("jersey_lock", with_inputs("reads", "SELECT game, tid, num, lock_ord FROM locks", LOCKS))
def jersey_lock(src):
    return teams.jersey_lock(src.reads).drop("lock_frame")


@query(
    "dominant_bin",
    with_inputs(
        "color_samples",
        """SELECT tid, CAST(samples AS BIGINT) AS samples, CAST(floor(bin / 5) * 10 + 5 AS BIGINT) AS hue,
             CAST(bin % 5 * 51 + 25 AS BIGINT) AS sat
           FROM (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY n DESC, bin) AS rn,
                   sum(n) OVER (PARTITION BY tid) AS samples
                 FROM (SELECT tid, CAST(least(floor(h / 10), 17) * 5 + least(floor(s / 51), 4) AS BIGINT) AS bin,
                         count(*) AS n FROM color_samples WHERE v BETWEEN 20 AND 245 GROUP BY 1, 2) a) b
           WHERE rn = 1 AND samples >= 25""",
    ),
)
def dominant_bin(src):
    return teams.dominant_bin(src.color_samples)


@query(
    "color_histogram",
    with_inputs(
        "color_samples",
        f"""SELECT tid, bin, {r('n / sqrt(CAST(sum(n * n) OVER (PARTITION BY tid) AS DOUBLE))', 9)} AS value
            FROM (SELECT tid, CAST(floor(h * 16 / 180) * 8 + floor(s * 8 / 256) AS BIGINT) AS bin,
                    count(*) AS n FROM color_samples GROUP BY 1, 2) a""",
    ),
)
def color_histogram(src):
    return teams.color_histogram(src.color_samples).withColumn("value", rounded("value", 9))


@query(
    "range_ratio",
    with_inputs(
        "color_samples",
        f"""SELECT tid, {r('share', 6)} AS share, share >= 0.15e0 AS visible FROM (
              SELECT tid, avg(CASE WHEN h BETWEEN 10 AND 30 AND s BETWEEN 30 AND 180
                AND v BETWEEN 120 AND 240 THEN 1e0 ELSE 0e0 END) AS share FROM color_samples GROUP BY tid) a""",
    ),
)
def range_ratio(src):
    return teams.range_ratio(src.color_samples).withColumn("share", rounded("share", 6))


@query("team_kmeans")
def team_kmeans(src):
    rows = teams.team_kmeans(teams.dominant_bin(src.color_samples))
    return rows.select("tid", "hue", "sat", F.col("team").cast("bigint").alias("team"))


@query("team_kmeans_histogram")
def team_kmeans_histogram(src):
    """Teams from whole colour histograms instead of the dominant bin."""
    rows = teams.histogram_vectors(teams.color_histogram(src.color_samples))
    rows = teams.team_kmeans(rows, columns=("histogram",))
    return rows.select("tid", F.col("team").cast("bigint").alias("team"))


@query(
    "team_rolling_vote",
    with_inputs(
        "players",
        """SELECT game, frame, tid, CAST(CASE WHEN 2 * ones > n THEN 1 WHEN 2 * ones < n THEN 0 ELSE oldest END AS BIGINT) AS voted
           FROM (SELECT game, frame, tid, sum(team) OVER w AS ones, count(*) OVER w AS n, first_value(team) OVER w AS oldest
                 FROM players WHERE team IS NOT NULL
                 WINDOW w AS (PARTITION BY game, tid ORDER BY frame ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)) a""",
    ),
)
def team_rolling_vote(src):
    return teams.team_rolling_vote(src.players)


@query(
    "sample_cap",
    with_inputs(
        "track_dets",
        """SELECT game, frame, seq, tid FROM (
             SELECT *, count(*) OVER (PARTITION BY game ORDER BY frame) - count(*) OVER (PARTITION BY game, frame) AS taken
             FROM (SELECT *, row_number() OVER (PARTITION BY game, tid ORDER BY frame, seq) AS rn FROM track_dets) a
             WHERE rn <= 5) b WHERE taken < 100""",
    ),
)
def sample_cap(src):
    return teams.sample_cap(src.track_dets, per_track=5, total=100).select("game", "frame", "seq", "tid")


@query(
    "nearest_center",
    with_inputs(
        "",
        f"""SELECT vec_id, center, {r('gap', 6)} AS gap FROM (
              SELECT vec_id, center, gap, row_number() OVER (PARTITION BY vec_id ORDER BY gap, center) AS rn FROM (
                SELECT v.vec_id, c.label AS center, sqrt(sum((v.x - c.m) * (v.x - c.m))) AS gap
                FROM vals v JOIN means c USING (i) GROUP BY v.vec_id, c.label) a) b WHERE rn = 1""",
        [
            (
                "vals",
                """SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                     generate_subscripts(embedding, 1) AS i FROM embeddings""",
            ),
            ("means", "SELECT label, i, avg(x) AS m FROM vals GROUP BY label, i"),
        ],
    ),
)
def nearest_center(src):
    centers = teams.class_centers(src.embeddings)
    rows = teams.nearest_center(src.embeddings, centers)
    return rows.withColumn("gap", rounded("gap", 6))
