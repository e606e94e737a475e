"""The registered queries and the SQL that each must agree with.

The engine's operators run here on the driver's tables, by analogy: customers with
orders for words with boxes, vector labels for characters, events for profiles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import staging
from ..functions import charset as C
from ..operators import match, robust, sequence, stats
from . import handwriting, truth

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_CHARSET = "(SELECT unnest(string_split(" + _quoted(C.CHARSET) + ", '')) AS char, unnest(range(" + str(len(C.CHARSET)) + "))::INT AS ord)"
_CHARS = "(SELECT unnest(string_split(text, '')) AS char FROM documents)"
_WIDTH = "CASE char " + " ".join(f"WHEN {_quoted(k)} THEN {v}" for k, v in C.WIDTHS.items()) + " ELSE CASE WHEN regexp_matches(char, '^\\p{Lu}$') THEN 1.15 ELSE 1.0 END END"
_IN = lambda s: "(" + ", ".join(_quoted(c) for c in s) + ")"
_CLASS = f"CASE WHEN char IN {_IN(C.ASCENDER)} THEN 'ascender' WHEN char IN {_IN(C.DESCENDER)} THEN 'descender' WHEN char IN {_IN(C.XHEIGHT)} THEN 'xheight' WHEN regexp_matches(char, '^[\\p{{Lu}}\\p{{Nd}}]$') THEN 'ascender' ELSE 'other' END"


# -- characters and texts --------------------------------------------------------------------


@query(f"SELECT c.char, c.ord, coalesce(k.n, 0)::BIGINT AS n FROM {_CHARSET} c LEFT JOIN (SELECT char, count(*) AS n FROM {_CHARS} GROUP BY char) k USING (char)")
def char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(table(spark, sf_dir, "documents"))


@query(f"SELECT c.char, c.ord, coalesce(k.n, 0)::BIGINT AS n FROM {_CHARSET} c LEFT JOIN (SELECT char, count(*) AS n FROM {_CHARS} GROUP BY char) k USING (char) WHERE coalesce(k.n, 0) < 100")
def char_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.missing(table(spark, sf_dir, "documents"), 100)


@query(f"SELECT char, ({_WIDTH})::DOUBLE AS width, {_CLASS} AS class FROM (SELECT DISTINCT char FROM {_CHARS} WHERE char <> '')")
def char_width_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = C.characters(table(spark, sf_dir, "documents")).distinct()
    return chars.select("char", C.width_prior(F.col("char")).cast("double").alias("width"), C.vertical_class(F.col("char")).alias("class"))


_NAMES = "".join(" WHEN '" + c.replace("'", "''") + f"' THEN '{n}'" for c, n in C.GLYPH_NAMES.items())


@query("SELECT DISTINCT char, CASE WHEN regexp_matches(char, '^[A-Za-z]$') THEN char ELSE CASE char" + _NAMES + " ELSE 'uni' || printf('%04X', unicode(char)) END END AS name FROM " + _CHARS + " WHERE char <> ''")
def glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.characters(table(spark, sf_dir, "documents")).distinct().select("char", C.glyph_name(F.col("char")).alias("name"))


@query("""SELECT conv_id, turn, pos::INT AS pos, length(token)::INT AS length, starts_with(token, ' ') AS is_space
FROM (SELECT conv_id, turn, unnest(r) AS token, unnest(range(len(r))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '( +|[^ ]+)') AS r FROM conversations))""")
def tokenize_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequence.token_runs(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"])
    return runs.select("conv_id", "turn", "pos", F.length("token").alias("length"), "is_space")


@query("SELECT lang, median(n_chars) AS median_chars, median(n_chars) < 1450 AS too_small FROM documents WHERE n_chars > 0 GROUP BY lang")
def resolution_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("n_chars > 0").groupBy("lang").agg(F.median("n_chars").alias("median_chars"), (F.median("n_chars") < 1450).alias("too_small"))


# -- measures and outliers -------------------------------------------------------------------

_SCALE = "SELECT l_orderkey, CASE WHEN sum(l_quantity::DECIMAL(28,2))::DOUBLE > 0 THEN sum(l_extendedprice::DECIMAL(28,2))::DOUBLE / sum(l_quantity::DECIMAL(28,2))::DOUBLE ELSE 0.0 END AS scale FROM lineitem GROUP BY l_orderkey"


@query(_SCALE)
def ratio_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ratio_of_sums(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", "l_quantity")


@query(f"""WITH s AS ({_SCALE}), m AS (SELECT l_partkey, median(l_extendedprice / scale) AS measured, count(*) AS n FROM lineitem JOIN s USING (l_orderkey) WHERE scale > 0 GROUP BY l_partkey HAVING count(*) >= 30)
SELECT p_partkey, round(coalesce(measured, p_size::DOUBLE), 6) AS width, measured IS NOT NULL AS is_measured FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def scaled_group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity")
    measured = stats.scaled_medians(lines, stats.ratio_of_sums(lines, "l_orderkey", "l_extendedprice", "l_quantity"), "l_orderkey", "l_partkey", "l_extendedprice", 30)
    parts = table(spark, sf_dir, "part").join(measured.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "left")
    return parts.select("p_partkey", F.round(F.coalesce("measured", F.col("p_size").cast("double")), 6).alias("width"), F.col("measured").isNotNull().alias("is_measured"))


@query("""SELECT user_id, median(gap) AS gap_median, count(*) AS n_gaps FROM (SELECT user_id, lead(event_id) OVER w - event_id AS step, lead(value) OVER w - value AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE step % 2 = 0 AND gap > 0 GROUP BY user_id""")
def lag_gap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.gap_medians(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("SELECT user_id, count(value) AS n, CASE WHEN count(value) >= 65 THEN median(value) ELSE (SELECT median(value) FROM events) END AS median_value FROM events GROUP BY user_id")
def group_median_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.median_or_global(table(spark, sf_dir, "events"), "user_id", "value", 65)


@query("""SELECT o_orderkey, o_totalprice, reason FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice <= 0 THEN 'no ink' WHEN o_totalprice / med - 1 < -0.22 THEN 'tight' WHEN o_totalprice / med - 1 > 0.22 * 1.6 THEN 'wide' END AS reason
FROM orders, (SELECT median(o_totalprice) AS med, count(*) AS n FROM orders WHERE o_totalprice > 0) WHERE n >= 3 AND med > 0) WHERE reason IS NOT NULL""")
def asymmetric_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.asymmetric(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "o_totalprice", "reason")


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY event_type), d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type)
SELECT event_id, event_type, value FROM events JOIN m USING (event_type) JOIN d USING (event_type) WHERE value > med + 6 * CASE WHEN mad = 0 THEN 1e-6 ELSE mad END""")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.mad_outliers(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "event_type", "value")


_BREAKER = """WITH m AS (SELECT *, value > {k} * (SELECT median(value) FROM events) AS s FROM events)
SELECT event_id, s AS suspicious FROM m WHERE (SELECT avg(CASE WHEN s THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FROM m) < 0.4 OR NOT s"""


def _breaker(spark: SparkSession, sf_dir: str, k: float) -> DataFrame:
    rows = robust.with_scalars(table(spark, sf_dir, "events").select("event_id", "value"), med=F.median("value"))
    return robust.with_breaker(rows, F.col("value") > k * F.col("med")).select("event_id", "suspicious")


@query(_BREAKER.format(k=0.3))
def outlier_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many rows are suspicious that all are kept."""
    return _breaker(spark, sf_dir, 0.3)


@query(_BREAKER.format(k=3))
def outlier_no_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _breaker(spark, sf_dir, 3)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (SELECT count(*) FROM orders) < 3 OR (SELECT median(o_totalprice) FROM orders) <= 0 OR o_totalprice >= 0.45 * (SELECT median(o_totalprice) FROM orders)")
def drop_below_median_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.at_least_median_share(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, p_type, p_size FROM part JOIN (VALUES ('ECONOMY', 5, 30), ('STANDARD', 10, 40), ('PROMO', 1, 20), ('MEDIUM', 15, 45)) r(type, low, high) ON type = p_type WHERE p_size BETWEEN low AND high""")
def plausible_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("ECONOMY", 5, 30), ("STANDARD", 10, 40), ("PROMO", 1, 20), ("MEDIUM", 15, 45)], "p_type string, low int, high int")
    return table(spark, sf_dir, "part").join(rules, "p_type").where("p_size between low and high").select("p_partkey", "p_type", "p_size")


@query("SELECT event_id, round(0.85 * (median(value) OVER (PARTITION BY user_id) - value), 6) AS shift FROM events")
def shrink_to_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.shrink_to_median(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "value", 0.85).select("event_id", F.round("shift", 6).alias("shift"))


_MEDOID = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 d AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_distance(a.v, b.v) AS dist FROM e a JOIN e b USING (label)),
 m AS (SELECT label, i AS medoid_id FROM (SELECT label, i, row_number() OVER (PARTITION BY label ORDER BY round(sum(dist), 9), i) AS r FROM d GROUP BY label, i) WHERE r = 1),
 f AS (SELECT d.label, d.j AS vec_id, d.dist, m.medoid_id FROM m JOIN d ON d.label = m.label AND d.i = m.medoid_id),
 c AS (SELECT label, quantile_cont(dist, 0.68) AS cut, count(*) AS n FROM f GROUP BY label)"""


@query(_MEDOID + " SELECT label, medoid_id, n FROM m JOIN c USING (label)")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.medoids(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", "medoid_id", "n")


@query(_MEDOID + " SELECT f.vec_id, f.label, round(f.dist, 4) AS distance, f.dist <= c.cut AS kept FROM f JOIN c USING (label)")
def percentile_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = robust.to_medoid(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    cut = far.groupBy("label").agg(F.percentile("distance", F.lit(0.68)).alias("cut"))
    return far.join(cut, "label").select("vec_id", "label", F.round("distance", 4).alias("distance"), (F.col("distance") <= F.col("cut")).alias("kept"))


@query(
    _MEDOID
    + """, k AS (SELECT label, medoid_id, n, count(*) FILTER (WHERE dist <= cut) AS near FROM f JOIN c USING (label) GROUP BY label, medoid_id, n)
SELECT label, n AS seen, CASE WHEN n >= 4 AND near >= greatest(2, ceil(0.55::DOUBLE * n)) THEN near ELSE n END AS kept, n - CASE WHEN n >= 4 AND near >= greatest(2, ceil(0.55::DOUBLE * n)) THEN near ELSE n END AS dropped, medoid_id FROM k"""
)
def character_set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust.character_sets(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query()
def variant_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three typical, different members of each label; iterative, so without SQL."""
    return robust.variants(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query("""SELECT l_returnflag, greatest(coalesce(median(l_extendedprice) FILTER (WHERE l_quantity < 10), 2.0), 2.0) AS small, greatest(coalesce(median(l_extendedprice) FILTER (WHERE l_quantity > 1000), 1.05), 1.05) AS large, median(l_tax) AS tax FROM lineitem GROUP BY l_returnflag""")
def filtered_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda test: F.median(F.when(test, F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.greatest(F.coalesce(of(F.col("l_quantity") < 10), F.lit(2.0)), F.lit(2.0)).alias("small"),
        F.greatest(F.coalesce(of(F.col("l_quantity") > 1000), F.lit(1.05)), F.lit(1.05)).alias("large"),
        F.median("l_tax").alias("tax"),
    )


@query("""SELECT p_brand, count(*) AS n, round(CASE WHEN count(*) >= 2400 THEN median(l_extendedprice / (l_quantity * p_retailprice)) ELSE 1.0 END, 9) AS factor FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def calibration_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.ratio_median(lines, "p_brand", F.col("l_extendedprice") / (F.col("l_quantity") * F.col("p_retailprice")), 2400).select("p_brand", "n", F.round("factor", 9).alias("factor"))


@query("""WITH p AS (SELECT l_quantity, median(l_extendedprice) AS m FROM lineitem GROUP BY l_quantity HAVING count(*) >= 200)
SELECT round(CASE WHEN count(*) >= 2 AND regr_slope(m, l_quantity) > 0.1 THEN regr_slope(m, l_quantity) ELSE avg(m) / avg(l_quantity) END, 4) AS slope, round(CASE WHEN count(*) >= 2 AND regr_slope(m, l_quantity) > 0.1 THEN regr_intercept(m, l_quantity) ELSE 0.0 END, 4) AS intercept FROM p""")
def linear_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = stats.line_through_medians(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 200)
    return fit.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""WITH h AS (SELECT least(floor((value - 0) / 500.0 * 256), 255)::INT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS s0, sum(n) OVER () AS w, sum(n * bin) OVER () AS s FROM h WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
b AS (SELECT bin, w0::DOUBLE * (w - w0)::DOUBLE * pow(s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0), 2) AS x FROM p WHERE w0 < w) SELECT bin AS threshold_bin FROM b ORDER BY x DESC, bin LIMIT 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.otsu(table(spark, sf_dir, "events"), "value", 0.0, 500.0)


# -- profiles and runs -----------------------------------------------------------------------


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


_HOURLY = "(SELECT (epoch(ts)::BIGINT // 3600) AS hour, count(*) AS n FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1)"


@query(f"""WITH p AS (SELECT hour, n - (SELECT avg(n) FROM {_HOURLY}) AS x FROM {_HOURLY}), s AS (SELECT lag, sum(a.x * b.x) AS s FROM range(0, 49) l(lag), p a JOIN p b ON b.hour = a.hour + l.lag GROUP BY lag)
SELECT lag::INT AS lag, round(s / (SELECT s FROM s WHERE lag = 0), 6) AS r FROM s""")
def autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.autocorrelation(_hourly(spark, sf_dir), "hour", "n", 48).select("lag", F.round("r", 6).alias("r"))


@query(f"SELECT day, min(hour) AS first_at, max(hour) + 1 AS end_at FROM (SELECT hour // 24 AS day, hour, n, max(n) OVER (PARTITION BY hour // 24) AS top FROM {_HOURLY}) WHERE n >= 0.5 * top GROUP BY day")
def half_max_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.half_max_extent(_hourly(spark, sf_dir).withColumn("day", F.floor(F.col("hour") / 24)), ["day"], "hour", "n")


@query("""WITH m AS (SELECT user_id, event_id, value > 250 AS on_, coalesce(lag(value > 250) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM events),
i AS (SELECT *, sum(CASE WHEN on_ AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, island::BIGINT AS island, count(*) AS length, min(event_id) AS first_event FROM i WHERE on_ GROUP BY user_id, island""")
def runs_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return sequence.islands(events, ["user_id"], ["event_id"], F.col("value") > 250).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("length"), F.min("event_id").alias("first_event"))


@query(f"""WITH m AS (SELECT hour // 24 AS day, hour, n, n > 12 AS on_, coalesce(lag(n > 12) OVER (PARTITION BY hour // 24 ORDER BY hour), false) AS was FROM {_HOURLY}),
i AS (SELECT *, sum(CASE WHEN on_ AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY hour ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m),
k AS (SELECT *, max(n) OVER (PARTITION BY day, island) AS top FROM i WHERE on_)
SELECT day, island, min(hour) AS first_at, max(hour) AS last_at, max(n) AS peak FROM k WHERE n >= 0.85 * top GROUP BY day, island HAVING max(hour) - min(hour) + 1 <= 6""")
def dense_thin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.dense_thin_runs(_hourly(spark, sf_dir).withColumn("day", F.floor(F.col("hour") / 24)), ["day"], "hour", "n", 12, 6)


@query("""SELECT event_id, user_id, round_even(1000 * (sum(value::DECIMAL(28,2)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(value::DECIMAL(28,2)) OVER (PARTITION BY user_id))::DOUBLE, 0)::BIGINT AS bound FROM events""")
def proportional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", stats.exact("value").alias("value"))
    return sequence.proportional_split(events, "user_id", ["event_id"], "value", 1000).select("event_id", "user_id", "bound")


@query("SELECT doc_id, source, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10)::INT AS page, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10)::INT AS band FROM documents")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pages(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], ["doc_id"], 10)


@query("""WITH r AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT label, s.slot::INT AS slot, vec_id FROM range(0, 3) s(slot) JOIN r ON r.i = s.slot % least(n, 3)""")
def variant_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.cycled(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", ["vec_id"], 3).select("label", "slot", "vec_id")


@query("""SELECT vec_id, round(list_sum(list_transform(range(0, 32), lambda k: embedding[2 * k + 1]::DOUBLE * embedding[(2 * k + 3) % 64 + 1]::DOUBLE - embedding[(2 * k + 2) % 64 + 1]::DOUBLE * embedding[2 * k + 2]::DOUBLE)) / 2, 6) AS area FROM embeddings""")
def shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    even, odd = F.filter(v, lambda x, i: i % 2 == 0), F.filter(v, lambda x, i: i % 2 == 1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(stats.signed_area(even, odd), 6).alias("area"))


# -- matches ---------------------------------------------------------------------------------


@query("""WITH f AS (SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 12)
SELECT source, count(*) AS checked, count(*) FILTER (WHERE coalesce(quality, 1) = 1) AS passed FROM f LEFT JOIN labels USING (doc_id) GROUP BY source""")
def verify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = robust.first_k(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 12)
    return match.left_default(first, table(spark, sf_dir, "labels"), "doc_id", quality=1).groupBy("source").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("quality") == 1).alias("passed"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.left_default(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", quality=-1, toxic=0)


@query("""SELECT c_custkey, s_suppkey, distance FROM (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS distance, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE r = 1 AND distance <= 1000.0""")
def nearest_match_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return match.nearest_within(customers, suppliers, "nation", "c_custkey", "c_acctbal", "s_suppkey", "s_acctbal", F.lit(1000.0))


_BASKETS = "SELECT DISTINCT l_orderkey AS {a}, l_partkey AS item FROM lineitem WHERE l_returnflag = '{r}'"


@query(f"""WITH a AS ({_BASKETS.format(a="a", r="A")}), b AS ({_BASKETS.format(a="b", r="R")}), h AS (SELECT a, b, count(*) AS hits FROM a JOIN b USING (item) GROUP BY a, b)
SELECT a, b, hits FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY hits DESC, b) AS r FROM h) WHERE r = 1 AND hits >= 2""")
def overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order with accepted lines, the order with returned ones that has the most parts in common."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", F.col("l_partkey").alias("item"))
    left, right = (lines.where(F.col("l_returnflag") == r).withColumnRenamed("l_orderkey", c) for r, c in (("A", "a"), ("R", "b")))
    return match.best_overlap(left, right, "item", "a", "b", 2)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.absent(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT DISTINCT l_partkey AS base, l_suppkey AS donor FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def two_sided_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("base"), F.col("l_suppkey").alias("donor")).distinct()
    small = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("base"))
    sound = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("donor"))
    return recipes.join(small, "base", "left_semi").join(sound, "donor", "left_semi")


@query("""SELECT doc_id, coalesce(quality, CASE WHEN lang IN ('en', 'de') THEN 1 END, -1) AS value, CASE WHEN quality IS NOT NULL THEN 'labelled' WHEN lang IN ('en', 'de') THEN 'language' ELSE 'constant' END AS tier FROM documents LEFT JOIN labels USING (doc_id)""")
def tiered_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return match.first_tier(rows, labelled=F.col("quality"), language=F.when(F.col("lang").isin("en", "de"), 1), constant=F.lit(-1)).select("doc_id", "value", "tier")


_SCORE = "least(l_discount * 10, 1 - l_tax * 8)"


@query(f"""SELECT l_returnflag, avg(CASE WHEN s > 0.8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS good, avg(CASE WHEN s > 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS fair, avg(CASE WHEN s < 0.4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bad, count(*) AS n FROM (SELECT l_returnflag, {_SCORE} AS s FROM lineitem) GROUP BY l_returnflag""")
def quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bands(table(spark, sf_dir, "lineitem"), "l_returnflag", F.least(F.col("l_discount") * 10, 1 - F.col("l_tax") * 8))


@query("SELECT source, mean_score, n FROM (SELECT source, avg(quality::DOUBLE) AS mean_score, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) ORDER BY mean_score, source LIMIT 12")
def worst_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.worst(rows, "source", F.col("quality").cast("double"))


@query("""SELECT lang, CASE WHEN count(quality) > 0 THEN count(*) FILTER (WHERE quality = 1)::DOUBLE / count(quality) ELSE 0.0 END AS purity, count(*) FILTER (WHERE quality = 1)::DOUBLE / count(*) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def purity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.purity_coverage(rows, "lang", F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("quality").isNotNull())


_SETS = "SELECT DISTINCT l_suppkey AS a, l_partkey AS item FROM lineitem"


@query(f"""WITH s AS ({_SETS}), z AS (SELECT a, count(*) AS n FROM s GROUP BY a), p AS (SELECT x.a, y.a AS b, count(*) AS shared FROM s x JOIN s y USING (item) WHERE x.a < y.a GROUP BY x.a, y.a HAVING count(*) >= 4)
SELECT p.a, p.b, shared, shared::DOUBLE / (u.n + v.n - shared) AS iou FROM p JOIN z u ON u.a = p.a JOIN z v ON v.a = p.b""")
def set_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("item"))
    return stats.set_iou(lines, "l_suppkey", "item", 4)


@query("SELECT l_partkey, l_suppkey, CASE WHEN min(l_orderkey) <> max(l_orderkey) THEN -2 ELSE min(l_orderkey) END AS label FROM lineitem GROUP BY l_partkey, l_suppkey")
def contested_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.contested(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query(f"""WITH p AS (SELECT hour, n - (SELECT avg(n) FROM {_HOURLY}) AS x FROM {_HOURLY}), s AS (SELECT lag, sum(a.x * b.x) AS s FROM range(0, 49) l(lag), p a JOIN p b ON b.hour = a.hour + l.lag GROUP BY lag),
r AS (SELECT lag, s / (SELECT s FROM s WHERE lag = 0) AS r FROM s), n AS (SELECT lag, r, lag(r) OVER (ORDER BY lag) AS p, lead(r) OVER (ORDER BY lag) AS q FROM r WHERE lag > 0)
SELECT coalesce((SELECT min(lag) FROM n WHERE r > 0.25 AND r >= p AND r > q), (SELECT lag FROM n ORDER BY r DESC, lag LIMIT 1))::INT AS pitch""")
def line_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.first_peak(sequence.autocorrelation(_hourly(spark, sf_dir), "hour", "n", 48))


#: Lines that the chain of pages is run on.
PAGE_LINES = ["ana lune dal cos", "nade ula ensi co", "daun lea nad gos", "una alde dan cis", "mon dur sen ale", "bir den olan su", "gece uzun dag", "kol sol pul"]


@query()
def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purity and coverage of the boxes that the chain cuts out of four made pages, against every pixel's true label."""
    pages = staging.stage(truth.pages(spark.range(4).select(F.col("id").alias("page_id"), F.array(*map(F.lit, PAGE_LINES)).alias("lines"))), "made-pages")
    texts = pages.select("page_id", F.posexplode(F.array(*map(F.lit, PAGE_LINES))).alias("line_index", "text")).withColumn("confidence", F.lit(1.0))
    boxes, lines = handwriting.boxes_of(pages, texts)
    return truth.summary(truth.scores(boxes, lines, pages))
