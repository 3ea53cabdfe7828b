"""Registered queries: one per operator family of the inventory, each a
(spark, sf_dir) -> DataFrame callable over the full driver tables, with the
DuckDB SQL that must give the same rows.

Doubles are rounded in both the Spark result and the SQL (float sums in a
different order differ in the last bits).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import scalars as S
from ..functions import text as T
from ..operators import features as A
from ..operators import lexicon as X
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import pooling as V
from ..operators import profile as PR
from ..operators import scoring as E
from ..operators import sparse as SP
from ..operators import windows as W
from ..operators.cleaning import clean_posts, spread
from ..sources import fixtures as FX
from . import sqlgen as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

YEAR = FX.DEFAULT_YEAR
CAP = FX.CONV_CAP
TRUNC = FX.CONV_TRUNCATE
SEED = 42
DROP_P = 0.5
SLOTS = 64      # V5 slot count for fx_vec events (more than any event holds)
COMPACT = 32    # V6 slot count (fewer than most events hold, so the cap matters)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def cores(spark: SparkSession) -> int:
    """The number of tasks that texts are dealt to: the driver tables lie in few row groups."""
    return spark.sparkContext.defaultParallelism


def over_cores(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, by a shuffle of its rows, if it comes in fewer parts."""
    return df if df.rdd.getNumPartitions() >= cores(spark) else spread(df, cores(spark))


def V_(*names: str) -> str:
    return FX.with_views(*names)


# ============================================================================ features (A*, P1-P5, O1, O2)

_TYPED_SQL = f"""
typed AS (
  SELECT event, pos, {G.post_time(G.na('published_raw'), YEAR)} AS ts,
    {G.to_number(G.na('reposts'))} AS reposts, {G.to_number(G.na('comments'))} AS comments,
    {G.to_number(G.na('likes'))} AS likes, {G.na('nickname')} AS nickname,
    coalesce({G.na('location')}, '未知') AS location
  FROM fx_meta)"""

_R6 = "round({}, 6)"


@register("event_features", V_("fx_meta") + "," + _TYPED_SQL + f""",
base AS (
  SELECT event, count(*) AS post_count, sum(reposts) AS s_r, sum(comments) AS s_c, sum(likes) AS s_l,
    min(ts) AS ts_min, max(ts) AS ts_max, count(ts) AS n_ts,
    sum(CASE WHEN ts IS NOT NULL AND (hour(ts) < 7 OR hour(ts) >= 22) THEN 1 ELSE 0 END) AS n_night,
    count(DISTINCT nickname) AS n_users, count(DISTINCT location) AS n_loc
  FROM typed GROUP BY event),
hours AS (SELECT event, hour(ts) AS h, count(*) AS c FROM typed WHERE ts IS NOT NULL GROUP BY 1, 2),
peak AS (SELECT event, first(h ORDER BY c DESC, h ASC) AS peak FROM hours GROUP BY event),
locs AS (SELECT event, location, count(*) AS c, min(pos) AS fp FROM typed GROUP BY 1, 2),
top AS (SELECT event, max(c) AS top_n, first(location ORDER BY c DESC, fp ASC) AS top_loc FROM locs GROUP BY event)
SELECT b.event, CAST(post_count AS BIGINT) AS post_count,
  round(CASE WHEN n_ts > 0 THEN (epoch_us(ts_max) - epoch_us(ts_min)) / 3.6e9 ELSE 0 END, 6) AS timespan_hours,
  CAST(CASE WHEN n_ts > 0 THEN peak ELSE 0 END AS BIGINT) AS peak_hour,
  round(CASE WHEN n_ts > 0 THEN n_night / n_ts ELSE 0 END, 6) AS night_ratio,
  round(s_r / post_count, 6) AS avg_reposts, round(s_c / post_count, 6) AS avg_comments,
  round(s_l / post_count, 6) AS avg_likes, round((s_r + s_c) / (s_l + 1.0), 6) AS engagement_ratio,
  CAST(n_users AS BIGINT) AS unique_users, round(n_users / post_count, 6) AS user_post_ratio,
  round(n_loc / post_count, 6) AS location_diversity, round(top_n / post_count, 6) AS top_location_ratio,
  top_loc AS top_location
FROM base b LEFT JOIN peak p ON b.event = p.event LEFT JOIN top t ON b.event = t.event""")
def q_event_features(spark, sf):
    return rounded(A.event_features(FX.fx_meta(spark, sf), default_year=YEAR))


@register("feature_states", f"""
WITH f AS ({ORACLES["event_features"]})
SELECT event, post_count, timespan_hours, peak_hour, night_ratio, avg_reposts, avg_comments, avg_likes, engagement_ratio,
  location_diversity, top_location_ratio, top_location, true AS users_close FROM f""")
def q_feature_states(spark, sf):
    """A1-A11 from the stored states of two runs over disjoint posts: all exact but the users, whose
    estimate lies within five standard errors of the exact number."""
    from ..sources.files import land
    m = FX.fx_meta(spark, sf)
    states = [land(A.feature_state(m.where(F.col("pos") % 3 == 0 if first else F.col("pos") % 3 != 0), YEAR), "state") for first in (True, False)]
    merged = A.features_of_state(land(A.merge_states(*states), "merged"))
    exact = A.event_features(m, default_year=YEAR).select("event", F.col("unique_users").alias("exact"))
    close = F.abs(F.col("unique_users") - F.col("exact")) <= F.greatest(F.lit(1.0), 5 * 1.04 / 64 * F.col("exact"))
    return rounded(merged.join(exact, "event").withColumn("users_close", close).drop("exact", "unique_users", "user_post_ratio"))


@register("normalize_time", V_("fx_meta") + f"""
SELECT event, pos, published_raw, {G.normalize_time(G.na('published_raw'), YEAR)} AS normalized,
  {G.post_time(G.na('published_raw'), YEAR)} AS ts
FROM fx_meta""")
def q_normalize_time(spark, sf):
    m = FX.fx_meta(spark, sf)
    raw = S.na_to_null("published_raw")
    staged = m.select("event", "pos", "published_raw", S.normalize_time(raw, YEAR).alias("normalized"))
    return staged.select("*", S.parse_time("normalized").alias("ts"))


@register("numeric_coerce", V_("fx_meta") + f"""
SELECT pos, {G.to_number(G.na('reposts'))} AS reposts, {G.to_number(G.na('comments'))} AS comments,
  {G.to_number(G.na('likes'))} AS likes
FROM fx_meta""")
def q_numeric_coerce(spark, sf):
    m = FX.fx_meta(spark, sf)
    return m.select("pos", *[S.to_number(S.na_to_null(c)).alias(c) for c in ("reposts", "comments", "likes")])


@register("na_tokens", V_("fx_meta") + f"""
SELECT pos, {G.na('nickname')} AS nickname, {G.na('location')} AS location,
  coalesce({G.na('location')}, '未知') AS location_filled
FROM fx_meta""")
def q_na_tokens(spark, sf):
    m = FX.fx_meta(spark, sf)
    return m.select("pos", S.na_to_null("nickname").alias("nickname"), S.na_to_null("location").alias("location"),
                    S.location_or_unknown(S.na_to_null("location")).alias("location_filled"))


@register("hour_histogram", V_("fx_meta") + "," + _TYPED_SQL + """
SELECT event, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM typed WHERE ts IS NOT NULL GROUP BY 1, 2""")
def q_hour_histogram(spark, sf):
    return A.hour_histogram(FX.fx_meta(spark, sf), YEAR)


@register("top_location", V_("fx_meta") + f"""
, locs AS (
  SELECT event, coalesce({G.na('location')}, '未知') AS location, count(*) AS n, min(pos) AS fp
  FROM fx_meta GROUP BY 1, 2)
SELECT event, location, n, CAST(row_number() OVER (PARTITION BY event ORDER BY n DESC, fp ASC) AS BIGINT) AS rank
FROM locs""")
def q_top_location(spark, sf):
    return A.location_counts(FX.fx_meta(spark, sf))


@register("feature_check", V_("fx_meta") + """
SELECT event, 'avg_likes' AS null_features FROM fx_meta GROUP BY event HAVING min(pos) % 2 = 0
UNION ALL SELECT DISTINCT event, 'avg_likes,unique_users' FROM fx_meta GROUP BY event HAVING min(pos) % 2 = 1""")
def q_feature_check(spark, sf):
    """P13 on features with holes: every event lacks one value, some lack two."""
    m = FX.fx_meta(spark, sf)
    odd = m.groupBy("event").agg((F.min("pos") % 2 == 1).alias("odd"))
    feats = A.event_features(m, default_year=YEAR).join(odd, "event")
    holes = (feats.withColumn("avg_likes", F.lit(None).cast("double"))
             .withColumn("unique_users", F.when(~F.col("odd"), F.col("unique_users"))).drop("odd"))
    bad = A.check_features(holes)
    return bad.select("event", F.array_join("null_features", ",").alias("null_features"))


@register("features_absent_columns", V_("fx_meta") + """
SELECT event, count(*) AS post_count, 0.0 AS timespan_hours, CAST(0 AS BIGINT) AS peak_hour, 0.0 AS location_diversity,
  '未知' AS top_location FROM fx_meta GROUP BY event""")
def q_features_absent_columns(spark, sf):
    """P5: files without a time and a location column."""
    m = FX.fx_meta(spark, sf).drop("published_raw", "location")
    m = m.withColumns({"has_time": F.lit(False), "has_location": F.lit(False)})
    return A.event_features(m, default_year=YEAR).select("event", "post_count", "timespan_hours", "peak_hour", "location_diversity", "top_location")


@register("feature_vector", f"""
WITH f AS ({ORACLES["event_features"]})
SELECT event, CAST(i - 1 AS INTEGER) AS i, round(v, 6) AS v FROM (
  SELECT event, [{", ".join(f"CAST({c} AS DOUBLE)" for c in A.FEATURES)}] AS vec FROM f), unnest(vec) WITH ORDINALITY AS u(v, i)""")
def q_feature_vector(spark, sf):
    """The 12 statistics as an ML vector in the reference's order."""
    from pyspark.ml.functions import vector_to_array
    out = A.feature_vector(A.event_features(FX.fx_meta(spark, sf), default_year=YEAR))
    return _long(out.select("event", vector_to_array("stats").alias("vec")), digits=6)


# ============================================================================ text chain

_TEXT_STEPS = {
    "clean_links": (T.remove_links, G.remove_links),
    "clean_video": (T.remove_video, G.remove_video),
    "clean_hashtags": (T.dedupe_hashtags, G.dedupe_hashtags),
    "clean_markdown": (T.remove_markdown_links, G.remove_markdown_links),
    "clean_url": (T.remove_urls, G.remove_urls),
    "clean_email": (T.remove_emails, G.remove_emails),
    "clean_mention": (T.remove_mentions, G.remove_mentions),
    "clean_tags": (T.remove_tags, G.remove_tags),
    "clean_platform": (T.platform_clean, G.platform_clean),
    "clean_emoji": (T.demojize, G.demojize),
    "clean_forward": (T.remove_forward, G.remove_forward),
    "clean_punct": (T.halfwidth_punct, G.halfwidth_punct),
    "clean_ws": (T.collapse_ws, G.collapse_ws),
}


def _text_query(spark_fn):
    def run(spark, sf):
        d = FX.fx_text(spark, sf)
        return d.select("event", "pos", spark_fn(T.fill_missing("text")).alias("text"))
    return run


for _name, (_sf, _gf) in _TEXT_STEPS.items():
    register(_name, V_("fx_text") + f"SELECT event, pos, {_gf(G.fill_missing('text'))} AS text FROM fx_text")(
        _text_query(_sf))


@register("clean_text", V_("fx_text") + f"SELECT event, pos, {G.clean_text('text')} AS text FROM fx_text")
def q_clean_text(spark, sf):
    d = FX.fx_text(spark, sf).select("event", "pos", "text")
    return clean_posts(d, "text", "text", partitions=cores(spark))


@register("emoji_table", r"""
WITH t AS (SELECT doc_id AS pos, chr(CAST(127462 + doc_id % 26 AS INTEGER)) || chr(CAST(127462 + (doc_id * 7) % 26 AS INTEGER)) || chr(CAST(127462 + (doc_id * 3) % 26 AS INTEGER)) || ' '
    || replace(text, ', ', ', ' || chr(CAST(128074 + doc_id % 7 AS INTEGER)) || CASE WHEN doc_id % 2 = 0 THEN chr(CAST(127995 + doc_id % 5 AS INTEGER)) ELSE '' END)
    || chr(CAST(128104 + doc_id % 3 AS INTEGER)) || chr(8205) || CASE WHEN doc_id % 5 = 0 THEN chr(127806) ELSE chr(127891) END
    || substr(CAST(doc_id AS VARCHAR), 1, 1) || chr(65039) || chr(8419) AS text FROM documents),
k AS (SELECT pos, regexp_extract_all(text, '[\x{1F468}\x{1F469}]\x{200D}[\x{1F33E}\x{1F373}\x{1F393}\x{1F3A4}]|[0-9]\x{FE0F}\x{20E3}|[\x{1F1E6}-\x{1F1FF}]{2}|[\x{1F44A}-\x{1F450}][\x{1F3FB}-\x{1F3FF}]|[\x{1F300}-\x{1F64F}]|[^0-9\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F64F}]+|[0-9\x{1F1E6}-\x{1F1FF}]') AS pieces FROM t)
SELECT pos, array_to_string(list_transform(pieces, lambda p: CASE
    WHEN regexp_matches(p, '^([\x{1F300}-\x{1F64F}]|[\x{1F1E6}-\x{1F1FF}][\x{1F1E6}-\x{1F1FF}]|[0-9]\x{FE0F}\x{20E3})')
    THEN ':e' || array_to_string(list_transform(string_split(p, ''), lambda c: lower(to_hex(ord(c)))), '_') || ':' ELSE p END), '') AS text
FROM k""")
def q_emoji_table(spark, sf):
    """T6 with a table of more than 1,500 sequences: flags, skin tones, joined people, keys."""
    return X.demojize_table(spread(FX.fx_emoji(spark, sf), cores(spark)), FX.emoji_table(spark))


@register("segment_words")
def q_segment_words(spark, sf):
    """P14 by a dictionary: texts without blanks are cut into the words of all documents. No SQL:
    the best path over every place of a text is compared with a plain version in the tests."""
    cut = X.segment(over_cores(spark, FX.fx_unspaced(spark, sf)), FX.word_frequencies(spark, sf))
    return cut.select("event", "pos", F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"))


# ============================================================================ windows / list view

_CAPPED_SQL = f"""
capped AS (
  SELECT event, pos, CAST(row_number() OVER (PARTITION BY event ORDER BY pos) - 1 AS INTEGER) AS slot, id, text
  FROM fx_conv WHERE {G.is_valid('text')}
  QUALIFY row_number() OVER (PARTITION BY event ORDER BY pos) <= {CAP})"""


def _capped(spark, sf, n=CAP):
    return W.cap_posts(FX.fx_conv(spark, sf).drop("conv_id"), n)


@register("top_posts", V_("fx_conv") + "," + _CAPPED_SQL + "\nSELECT event, pos, slot, id, text FROM capped")
def q_top_posts(spark, sf):
    return _capped(spark, sf).select("event", "pos", "slot", "id", "text")


@register("padded_posts", V_("fx_conv") + "," + _CAPPED_SQL + f"""
, counts AS (SELECT event, count(*) AS k FROM capped GROUP BY event)
SELECT event, slot, pos, id, text FROM capped
UNION ALL
SELECT event, CAST(unnest(range(k, {CAP})) AS INTEGER) AS slot, CAST(NULL AS BIGINT) AS pos,
  CAST(NULL AS VARCHAR) AS id, '' AS text
FROM counts""")
def q_padded_posts(spark, sf):
    return W.explode_lists(W.post_lists(_capped(spark, sf), CAP))


_VALID_SQL = f"valid_posts AS (SELECT * FROM fx_conv WHERE {G.is_valid('text')})"


def _valid(spark, sf):
    c = FX.fx_conv(spark, sf).drop("conv_id")
    return c.where(T.is_valid("text"))


@register("topic_prefix", V_("fx_conv") + "," + _VALID_SQL + """
SELECT event, CAST(pos AS INTEGER) AS slot, text FROM valid_posts
UNION ALL
SELECT DISTINCT event, -1 AS slot, 'Topic: ' || event AS text FROM valid_posts""")
def q_topic_prefix(spark, sf):
    return W.with_topic_sentence(_valid(spark, sf).withColumn("slot", F.col("pos").cast("int")))


@register("truncate_posts", V_("fx_conv") + f"""
SELECT event, pos, substring(text, 1, {TRUNC}) AS text FROM fx_conv""")
def q_truncate_posts(spark, sf):
    return W.truncate_posts(FX.fx_conv(spark, sf), TRUNC).select("event", "pos", "text")


@register("valid_posts", V_("fx_conv") + f"""
SELECT event, pos, {G.is_valid('text')} AS valid FROM fx_conv""")
def q_valid_posts(spark, sf):
    c = FX.fx_conv(spark, sf)
    return c.select("event", "pos", T.is_valid("text").alias("valid"))


# ============================================================================ labels, split, joins

_ENC_SQL = f"lab AS (SELECT event, reason, severity, {G.severity_level('severity')} AS level FROM fx_labels)"


def _labels(spark, sf):
    return L.encode_labels(FX.fx_labels(spark, sf))


@register("severity_encode", V_("fx_labels") + ", " + _ENC_SQL + "\nSELECT event, severity, level FROM lab")
def q_severity_encode(spark, sf):
    return _labels(spark, sf).select("event", "severity", "level")


@register("label_join", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + """
SELECT c.event, CAST(coalesce(l.level, 0) AS INTEGER) AS level, l.level IS NULL AS label_defaulted
FROM fx_catalogue c LEFT JOIN lab l ON c.event = l.event""")
def q_label_join(spark, sf):
    return L.join_labels(FX.fx_catalogue(spark, sf), _labels(spark, sf)).select("event", "level", "label_defaulted")


@register("missing_events", V_("fx_labels", "fx_catalogue") + """
SELECT DISTINCT event FROM fx_catalogue WHERE event NOT IN (SELECT event FROM fx_labels)""")
def q_missing_events(spark, sf):
    return L.missing_events(FX.fx_catalogue(spark, sf), FX.fx_labels(spark, sf))


@register("label_dedupe", V_("fx_label_dups") + """
SELECT event, arg_max(reason, position) AS reason, arg_max(severity, position) AS severity
FROM fx_label_dups GROUP BY event""")
def q_label_dedupe(spark, sf):
    return L.dedupe_labels(FX.fx_label_dups(spark, sf))


_SPLIT_SQL = f"""
ranked AS (
  SELECT c.event, l.level,
    row_number() OVER (PARTITION BY l.level ORDER BY md5('{SEED}' || c.event), c.event) AS rk,
    count(*) OVER (PARTITION BY l.level) AS n
  FROM (SELECT DISTINCT event FROM fx_catalogue) c JOIN lab l ON c.event = l.event),
split AS (
  SELECT event, level,
    CASE WHEN rk <= greatest(floor(n * CAST(0.8 AS DOUBLE)), least(n, 1)) THEN 'train' ELSE 'val' END AS part
  FROM ranked)"""


def _split(spark, sf):
    return L.stratified_split(FX.fx_catalogue(spark, sf), _labels(spark, sf), 0.8, SEED)


@register("stratified_split", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + "," + _SPLIT_SQL + """
SELECT event, level, part FROM split""")
def q_stratified_split(spark, sf):
    return _split(spark, sf)


@register("split_overlap", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + "," + _SPLIT_SQL + """
SELECT event FROM split WHERE part = 'train' AND level = 2""")
def q_split_overlap(spark, sf):
    """U2 on a split into which all train events of level 2 were put a second time, as val."""
    split = _split(spark, sf).select("event", "level", "part")
    twice = split.where((F.col("part") == "train") & (F.col("level") == 2)).withColumn("part", F.lit("val"))
    return L.split_overlap(split.unionByName(twice))


@register("label_distribution", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + "," + _SPLIT_SQL + """
SELECT part, level, count(*) AS n FROM split GROUP BY 1, 2""")
def q_label_distribution(spark, sf):
    return L.level_distribution(_split(spark, sf))


@register("label_rollup", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + "," + _SPLIT_SQL + """
SELECT part, level, count(*) AS n, CAST(grouping_id(part, level) AS INTEGER) AS totals FROM split GROUP BY ROLLUP (part, level)""")
def q_label_rollup(spark, sf):
    """A13 with totals."""
    return L.level_rollup(_split(spark, sf))


@register("class_count", V_("fx_labels") + ", " + _ENC_SQL + """
SELECT count(DISTINCT level) AS n_classes FROM lab""")
def q_class_count(spark, sf):
    return L.class_count(_labels(spark, sf))


@register("class_weights", V_("fx_labels") + ", " + _ENC_SQL + """
, per AS (SELECT level, count(*) AS n FROM lab GROUP BY level)
SELECT level, n, round((1.0 / n) / sum(1.0 / n) OVER () * count(*) OVER (), 9) AS weight FROM per""")
def q_class_weights(spark, sf):
    return rounded(L.class_weights(_labels(spark, sf)), 9)


@register("split_posts", V_("fx_labels", "fx_catalogue", "fx_text") + ", " + _ENC_SQL + "," + _SPLIT_SQL + """
SELECT t.event, t.pos FROM (SELECT 'd' || CAST(pos AS VARCHAR) AS event, pos FROM fx_text) t
WHERE t.event IN (SELECT event FROM split WHERE part = 'train')""")
def q_split_posts(spark, sf):
    posts = FX.fx_text(spark, sf).select(F.concat(F.lit("d"), F.col("pos").cast("string")).alias("event"), "pos")
    return L.split_posts(posts, _split(spark, sf), "train")


# ============================================================================ sampling

@register("drop_posts", V_("fx_conv") + f"""
, u AS (SELECT event, pos, {G.uniform(SEED, "'0'", 'event', 'pos')} AS u FROM fx_conv)
SELECT event, pos FROM u WHERE u > {DROP_P}
UNION ALL
SELECT event, arg_max(pos, u) AS pos FROM u GROUP BY event HAVING max(u) <= {DROP_P}""")
def q_drop_posts(spark, sf):
    c = FX.fx_conv(spark, sf).select("event", "pos")
    return W.drop_posts(c, DROP_P, SEED, 0)


@register("sample_events", V_("fx_conv") + f"""
, picked AS (SELECT DISTINCT event FROM fx_conv ORDER BY md5('{SEED}' || event), event LIMIT 3),
first2 AS (
  SELECT event, pos, text FROM fx_conv WHERE {G.is_valid('text')}
  QUALIFY row_number() OVER (PARTITION BY event ORDER BY pos) <= 2)
SELECT event, pos, text FROM first2 WHERE event IN (SELECT event FROM picked)""")
def q_sample_events(spark, sf):
    c = FX.fx_conv(spark, sf).drop("conv_id")
    picked = W.sample_events(c, 3, SEED)
    return W.cap_posts(c.join(picked, "event", "left_semi"), 2).select("event", "pos", "text")


# ============================================================================ profiles

_LEN_SQL = f"""
ln AS (SELECT {G.words('text')} AS words, length(text) AS chars FROM documents WHERE {G.is_valid('text')})"""


@register("length_stats", "WITH " + _LEN_SQL + """
SELECT round(avg(words), 6) AS words_mean, round(median(words), 6) AS words_median, min(words) AS words_min,
  max(words) AS words_max, round(stddev_pop(words), 6) AS words_std,
  round(avg(chars), 6) AS chars_mean, round(median(chars), 6) AS chars_median, min(chars) AS chars_min,
  max(chars) AS chars_max, round(stddev_pop(chars), 6) AS chars_std
FROM ln""")
def q_length_stats(spark, sf):
    d = FX.documents(spark, sf)
    out = PR.length_stats(d.select(F.col("source").alias("event"), "text"), partitions=cores(spark))
    return rounded(out.select(*[F.col(c).cast("double") if "median" in c or "mean" in c or "std" in c
                                else F.col(c).cast("long") for c in out.columns]))


def _hist_sql(col):
    return f"""
SELECT '{col}' AS measure, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor(({col} - lo) / (hi - lo) * 50), 49) END AS INTEGER) AS bin,
  count(*) AS n
FROM ln, (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM ln) r
GROUP BY 1, 2"""


@register("length_histogram", "WITH " + _LEN_SQL + _hist_sql("words") + "\nUNION ALL" + _hist_sql("chars"))
def q_length_histogram(spark, sf):
    d = FX.documents(spark, sf)
    return PR.length_histogram(d.select(F.col("source").alias("event"), "text"), partitions=cores(spark))


@register("corpus_summary", V_("fx_text") + f"""
SELECT count(DISTINCT event) AS n_events, count(*) AS n_posts,
  count(*) FILTER (WHERE {G.is_valid(G.clean_text('text'))}) AS n_valid_posts
FROM fx_text""")
def q_corpus_summary(spark, sf):
    d = FX.fx_text(spark, sf)
    return PR.corpus_summary(d.select("event", T.clean_text("text").alias("text")))


@register("corpus_summary_cached", V_("fx_text") + f"""
SELECT count(DISTINCT event) AS n_events, count(*) AS n_posts, count(*) FILTER (WHERE {G.is_valid('text')}) AS n_valid_posts,
  count(DISTINCT CASE WHEN event < 'src5' THEN event END) AS n_cached_events,
  count(DISTINCT CASE WHEN event >= 'src5' THEN event END) AS n_new_events
FROM fx_text""")
def q_corpus_summary_cached(spark, sf):
    d = FX.fx_text(spark, sf).select("event", "text")
    return PR.corpus_summary(d, cached=d.select("event").distinct().where("event < 'src5'"))


@register("value_histogram", """
WITH v AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL), r AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / (hi - lo) * 50), 49) END AS INTEGER) AS bin, count(*) AS n
FROM v, r GROUP BY 1""")
def q_value_histogram(spark, sf):
    return PR.histogram(FX.table(spark, sf, "events"), "value").select("bin", "n")


# ============================================================================ pooling

def _vec(spark, sf):
    return FX.fx_vec(spark, sf)


def _long(df, keys=("event",), digits=5):
    return rounded(V.long_form(df, "vec", keys), digits)


_LONG = "SELECT event, CAST(i - 1 AS INTEGER) AS i, round(v, 5) AS v FROM {src}, unnest(vec) WITH ORDINALITY AS u(v, i)"


@register("pool_mean", V_("fx_vec") + """
, e AS (
  SELECT event, sum(CASE WHEN valid THEN x END) AS s, count(*) FILTER (WHERE valid) AS nv, i
  FROM (SELECT event, valid, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM fx_vec) GROUP BY event, i)
SELECT event, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN nv > 0 THEN s / (nv + 1e-10) ELSE 0.0 END, 5) AS v FROM e""")
def q_pool_mean(spark, sf):
    return _long(V.mean_pool(_vec(spark, sf)))


@register("pool_max", V_("fx_vec") + """
SELECT event, CAST(i - 1 AS INTEGER) AS i, round(max(x), 5) AS v
FROM (SELECT event, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM fx_vec WHERE valid)
GROUP BY event, i""")
def q_pool_max(spark, sf):
    return _long(V.max_pool(_vec(spark, sf)))


@register("pool_cls", V_("fx_vec") + """
, c AS (SELECT event, arg_min(vec, pos) AS vec FROM fx_vec GROUP BY event)
""" + _LONG.format(src="c"))
def q_pool_cls(spark, sf):
    return _long(V.cls_pool(_vec(spark, sf)))


_ATT_SQL = """
, s AS (SELECT *, CASE WHEN valid THEN score ELSE -1e9 END AS ms FROM fx_vec),
m AS (SELECT event, max(ms) AS m FROM s GROUP BY event),
w AS (SELECT s.event, s.pos, s.vec, exp(s.ms - m.m) AS w FROM s JOIN m ON s.event = m.event),
z AS (SELECT event, sum(w) AS z FROM w GROUP BY event)"""


@register("pool_attentive", V_("fx_vec") + _ATT_SQL + """
SELECT event, CAST(i - 1 AS INTEGER) AS i, round(sum(w * x) / any_value(z), 5) AS v
FROM (SELECT w.event, w.w, z.z, unnest(w.vec) AS x, generate_subscripts(w.vec, 1) AS i
      FROM w JOIN z ON w.event = z.event)
GROUP BY event, i""")
def q_pool_attentive(spark, sf):
    return _long(V.attentive_pool(_vec(spark, sf)))


@register("pool_attentive_scored", V_("fx_vec") + """
, u AS (SELECT n_regionkey / 10.0 AS b, cos(n_nationkey + 1) AS v, list_transform(range(1, 65), lambda i: sin((n_nationkey + 1) * i)) AS w FROM nation),
net AS (SELECT pos, sum(v * (exp(2 * h) - 1) / (exp(2 * h) + 1)) AS score FROM (SELECT pos, v, list_dot_product(vec, w) + b AS h FROM fx_vec, u) GROUP BY pos),
scored AS (SELECT f.event, f.pos, f.vec, f.valid, net.score FROM fx_vec f JOIN net ON f.pos = net.pos)
""" + _ATT_SQL.replace("fx_vec", "scored") + """
SELECT event, CAST(i - 1 AS INTEGER) AS i, round(sum(w * x) / any_value(z), 5) AS v
FROM (SELECT w.event, w.w, z.z, unnest(w.vec) AS x, generate_subscripts(w.vec, 1) AS i
      FROM w JOIN z ON w.event = z.event)
GROUP BY event, i""")
def q_pool_attentive_scored(spark, sf):
    """V4 with its score network."""
    return _long(V.attentive_pool(V.attention_score(_vec(spark, sf).drop("score"), FX.fx_units(spark, sf))))


@register("attention_weights", V_("fx_vec") + _ATT_SQL + """
SELECT w.event, w.pos, round(w.w / z.z, 9) AS alpha FROM w JOIN z ON w.event = z.event""")
def q_attention_weights(spark, sf):
    return rounded(V.attention_weights(_vec(spark, sf)), 9)


@register("pool_attentive_unmasked", V_("fx_vec") + f"""
, st AS (SELECT event, count(*) AS n,
           CASE WHEN count(*) < {SLOTS} THEN greatest(max(score), 0.0) ELSE max(score) END AS m
         FROM fx_vec GROUP BY event),
w AS (SELECT f.event, f.vec, exp(f.score - st.m) AS w, st.n, st.m FROM fx_vec f JOIN st ON f.event = st.event),
z AS (SELECT event, sum(w) + greatest({SLOTS} - any_value(n), 0) * exp(0.0 - any_value(m)) AS z FROM w GROUP BY event)
SELECT event, CAST(i - 1 AS INTEGER) AS i, round(sum(w * x) / any_value(z), 5) AS v
FROM (SELECT w.event, w.w, z.z, unnest(w.vec) AS x, generate_subscripts(w.vec, 1) AS i
      FROM w JOIN z ON w.event = z.event)
GROUP BY event, i""")
def q_pool_attentive_unmasked(spark, sf):
    return _long(V.attentive_pool_unmasked(_vec(spark, sf), SLOTS))


@register("pool_compact", V_("fx_vec") + f"""
, ranked AS (
  SELECT event, vec, CAST(row_number() OVER (PARTITION BY event ORDER BY pos) - 1 AS INTEGER) AS slot
  FROM fx_vec WHERE valid QUALIFY row_number() OVER (PARTITION BY event ORDER BY pos) <= {COMPACT}),
counts AS (SELECT event, count(*) AS k, max(len(vec)) AS d FROM ranked GROUP BY event)
SELECT event, slot, CAST(i - 1 AS INTEGER) AS i, round(v, 5) AS v
FROM ranked, unnest(vec) WITH ORDINALITY AS u(v, i)
UNION ALL
SELECT event, CAST(s AS INTEGER) AS slot, CAST(i AS INTEGER) AS i, 0.0 AS v
FROM (SELECT event, d, unnest(range(k, {COMPACT})) AS s FROM counts), unnest(range(0, d)) AS r(i)""")
def q_pool_compact(spark, sf):
    lists = V.compact_slots(_vec(spark, sf), COMPACT)
    slots = lists.select("event", F.posexplode("vecs").alias("slot", "vec")).withColumn("slot", F.col("slot").cast("int"))
    return _long(slots, ("event", "slot"))


@register("vector_concat", V_("fx_vec") + """
, e AS (
  SELECT event, sum(CASE WHEN valid THEN x END) AS s, count(*) FILTER (WHERE valid) AS nv, i
  FROM (SELECT event, valid, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM fx_vec) GROUP BY event, i),
st AS (SELECT event, CAST(count(*) AS DOUBLE) AS n, avg(score) AS a FROM fx_vec GROUP BY event)
SELECT event, CAST(i - 1 AS INTEGER) AS i, round(CASE WHEN nv > 0 THEN s / (nv + 1e-10) ELSE 0.0 END, 5) AS v FROM e
UNION ALL SELECT event, 64 AS i, round(n, 5) AS v FROM st
UNION ALL SELECT event, 65 AS i, round(a, 5) AS v FROM st""")
def q_vector_concat(spark, sf):
    v = _vec(spark, sf)
    stats = v.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("a"))
    return _long(V.concat_vectors(V.mean_pool(v), V.stats_array(stats, ["n", "a"])))


@register("topic_vector_concat", V_("fx_vec") + """
, c AS (SELECT event, arg_min(vec, pos) AS tv FROM fx_vec GROUP BY event),
j AS (SELECT f.event, f.pos, list_concat(f.vec, c.tv) AS vec FROM fx_vec f JOIN c ON f.event = c.event)
SELECT event, pos, CAST(i - 1 AS INTEGER) AS i, round(v, 5) AS v FROM j, unnest(vec) WITH ORDINALITY AS u(v, i)""")
def q_topic_vector_concat(spark, sf):
    v = _vec(spark, sf)
    return _long(V.attach_topic_vector(v.select("event", "pos", "vec"), V.cls_pool(v)), ("event", "pos"))


# ============================================================================ scoring

@register("softmax_score", V_("fx_vec") + f"""
, p AS (SELECT CAST(pos AS VARCHAR) AS event_name, logits,
          list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM fx_vec)
SELECT event_name, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted_class,
  {G.level_label('list_position(logits, list_max(logits)) - 1')} AS predicted_label,
  round(e[1] / list_sum(e), 9) AS prob_0, round(e[2] / list_sum(e), 9) AS prob_1, round(e[3] / list_sum(e), 9) AS prob_2
FROM p""")
def q_softmax_score(spark, sf):
    v = _vec(spark, sf).select(F.col("pos").cast("string").alias("event"), "logits")
    s = E.score_events(v)
    return rounded(s.select("event_name", "predicted_class", "predicted_label",
                            *[F.col("probabilities")[n].alias(f"prob_{i}") for i, n in enumerate(E.LABEL_NAMES)]), 9)


_CONV_PRED_SQL = f"""
, preds AS (SELECT DISTINCT 'c' || CAST(conv_id AS VARCHAR) AS event, CAST(conv_id % 3 AS INTEGER) AS predicted_class,
              {G.level_label('conv_id % 3')} AS predicted_label FROM conversations)"""


def _conv_preds(spark, sf):
    c = FX.table(spark, sf, "conversations").select("conv_id").distinct()
    cls = (F.col("conv_id") % 3).cast("int")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("event"),
                    cls.alias("predicted_class"), S.level_label(cls).alias("predicted_label"))


@register("post_results", V_("fx_conv") + "," + _VALID_SQL + _CONV_PRED_SQL + """
SELECT c.event, coalesce(nullif(c.id, ''), CAST(c.pos AS VARCHAR)) AS id, c.text, p.predicted_class, p.predicted_label
FROM valid_posts c JOIN preds p ON c.event = p.event""")
def q_post_results(spark, sf):
    return E.post_results(FX.fx_conv(spark, sf), _conv_preds(spark, sf))


@register("batch_predict", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + f"""
SELECT c.event, l.level AS predicted_class, {G.level_label('l.level')} AS predicted_label,
  CASE WHEN l.event IS NULL THEN 'event file not found' END AS error
FROM (SELECT DISTINCT event FROM fx_catalogue) c LEFT JOIN lab l ON c.event = l.event""")
def q_batch_predict(spark, sf):
    lab = _labels(spark, sf)
    scored = lab.select("event", F.col("level").alias("predicted_class"), S.level_label("level").alias("predicted_label"))
    return E.batch_predict(FX.fx_catalogue(spark, sf), scored)


@register("batch_predict_errors", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + f"""
SELECT c.event, CASE WHEN l.level = 2 THEN NULL ELSE l.level END AS predicted_class,
  CASE WHEN l.level = 2 THEN NULL ELSE {G.level_label('l.level')} END AS predicted_label,
  CASE WHEN l.level = 2 THEN 'no text column' WHEN l.event IS NULL THEN 'event file not found' END AS error
FROM (SELECT DISTINCT event FROM fx_catalogue) c LEFT JOIN lab l ON c.event = l.event""")
def q_batch_predict_errors(spark, sf):
    """E12 with known errors: events of level 2 failed."""
    lab = _labels(spark, sf)
    scored = lab.select("event", F.col("level").alias("predicted_class"), S.level_label("level").alias("predicted_label"))
    errors = lab.where(F.col("level") == 2).select("event", F.lit("no text column").alias("error"))
    return E.batch_predict(FX.fx_catalogue(spark, sf), scored, errors=errors)


@register("clean_tags_pages", f"SELECT page_id, {G.remove_tags('html')} AS text FROM pages")
def q_clean_tags_pages(spark, sf):
    """T5's tag rule on whole web pages."""
    return FX.table(spark, sf, "pages").select("page_id", T.remove_tags("html").alias("text"))


# ============================================================================ metrics and losses

@register("predictions", V_("fx_pred") + "SELECT event, \"true\", pred FROM fx_pred")
def q_predictions(spark, sf):
    v = _vec(spark, sf).withColumn("event", F.col("pos").cast("string"))
    return M.predictions_table(v)


_CM_SQL = """
, labs AS (SELECT "true" AS label FROM fx_pred UNION SELECT pred FROM fx_pred),
cnt AS (SELECT "true", pred, count(*) AS n FROM fx_pred GROUP BY 1, 2),
cm AS (SELECT a.label AS "true", b.label AS pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
       FROM labs a JOIN labs b ON true LEFT JOIN cnt ON cnt."true" = a.label AND cnt.pred = b.label),
pc AS (
  SELECT l.label,
    (SELECT n FROM cm WHERE cm."true" = l.label AND cm.pred = l.label) AS tp,
    (SELECT sum(n) FROM cm WHERE cm."true" = l.label) AS support,
    (SELECT sum(n) FROM cm WHERE cm.pred = l.label) AS predicted
  FROM labs l),
pc2 AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r FROM pc),
pc3 AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM pc2)"""


@register("confusion_matrix", V_("fx_pred") + _CM_SQL + """
SELECT CAST("true" AS INTEGER) AS "true", CAST(pred AS INTEGER) AS pred, n FROM cm""")
def q_confusion_matrix(spark, sf):
    return M.confusion(FX.fx_pred(spark, sf))


@register("metrics_macro", V_("fx_pred") + _CM_SQL + """
SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(p), 9) AS macro_precision,
  round(avg(r), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1 FROM pc3""")
def q_metrics_macro(spark, sf):
    return rounded(M.macro_metrics(FX.fx_pred(spark, sf)), 9)


@register("metrics_weighted", V_("fx_pred") + _CM_SQL + """
SELECT round(sum(p * support) / sum(support), 9) AS weighted_precision,
  round(sum(r * support) / sum(support), 9) AS weighted_recall,
  round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM pc3""")
def q_metrics_weighted(spark, sf):
    return rounded(M.weighted_metrics(FX.fx_pred(spark, sf)), 9)


_NLL_SQL = f"""
, lp AS (SELECT y, batch, {G.log_softmax_list('logits')} AS lp FROM fx_vec),
r AS (SELECT y, batch, lp, -lp[y + 1] AS nll FROM lp)"""


@register("loss_ce", V_("fx_vec") + _NLL_SQL + "\nSELECT round(avg(nll), 9) AS loss FROM r")
def q_loss_ce(spark, sf):
    return rounded(M.cross_entropy(_vec(spark, sf)), 9)


@register("loss_ce_smoothed", V_("fx_vec") + _NLL_SQL + """
SELECT round(avg(0.9 * nll + 0.1 * (-list_sum(lp) / len(lp))), 9) AS loss FROM r""")
def q_loss_ce_smoothed(spark, sf):
    return rounded(M.smoothed_cross_entropy(_vec(spark, sf), 0.1), 9)


@register("loss_ce_weighted_smoothed", V_("fx_vec") + _NLL_SQL + """
, cnt AS (SELECT y AS c, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY y),
w AS (SELECT c, (1.0 / n) / sum(1.0 / n) OVER () * count(*) OVER () AS w FROM cnt),
rw AS (SELECT r.*, (SELECT w FROM w WHERE w.c = r.y) AS wy,
        (SELECT sum(w.w * -r.lp[w.c + 1]) FROM w) AS wl FROM r)
SELECT round(sum(0.9 * wy * nll + 0.1 / 3.0 * wl) / sum(wy), 9) AS loss FROM rw""")
def q_loss_ce_weighted_smoothed(spark, sf):
    return rounded(M.weighted_smoothed_cross_entropy(_vec(spark, sf), 0.1), 9)


@register("loss_focal", V_("fx_vec") + _NLL_SQL + """
SELECT round(avg(1.0 * pow(1.0 - exp(-nll), 2.0) * nll), 9) AS loss FROM r""")
def q_loss_focal(spark, sf):
    return rounded(M.focal_loss(_vec(spark, sf)), 9)


@register("loss_focal_sum", V_("fx_vec") + _NLL_SQL + """
SELECT round(sum(0.5 * pow(1.0 - exp(-nll), 3.0) * nll), 6) AS loss FROM r""")
def q_loss_focal_sum(spark, sf):
    return rounded(M.focal_loss(_vec(spark, sf), 0.5, 3.0, "sum"), 6)


@register("loss_focal_rows", V_("fx_vec") + f"""
, lp AS (SELECT pos, y, {G.log_softmax_list('logits')} AS lp FROM fx_vec)
SELECT pos, round(pow(1.0 - exp(lp[y + 1]), 2.0) * -lp[y + 1], 9) AS loss FROM lp""")
def q_loss_focal_rows(spark, sf):
    return rounded(M.focal_loss(_vec(spark, sf), reduction="none").select("pos", "loss"), 9)


@register("label_set", V_("fx_pred") + """
SELECT CAST("true" AS INTEGER) AS label FROM fx_pred UNION SELECT CAST(pred AS INTEGER) FROM fx_pred""")
def q_label_set(spark, sf):
    return M.label_set(FX.fx_pred(spark, sf))


@register("loss_batched", V_("fx_vec") + _NLL_SQL + """
, b AS (SELECT batch, avg(nll) AS b, sum(nll) AS s, count(*) AS n FROM r GROUP BY batch)
SELECT round(avg(b), 9) AS loss, round(sum(s) / sum(n), 9) AS row_mean_loss, count(*) AS n_batches FROM b""")
def q_loss_batched(spark, sf):
    return rounded(M.batched_loss(_vec(spark, sf)), 9)


@register("epoch_loss", V_("fx_vec") + f"""
, lp AS (SELECT y, {G.log_softmax_list('logits')} AS lp,
    (row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', '1', CAST(pos AS VARCHAR))), CAST(pos AS VARCHAR)) - 1) // 4 AS batch FROM fx_vec),
b AS (SELECT batch, avg(-lp[y + 1]) AS b, sum(-lp[y + 1]) AS s, count(*) AS n FROM lp GROUP BY batch)
SELECT round(avg(b), 9) AS loss, round(sum(s) / sum(n), 9) AS row_mean_loss, count(*) AS n_batches FROM b""")
def q_epoch_loss(spark, sf):
    """E9 over the batches of four of a shuffled epoch."""
    events = _vec(spark, sf).select(F.col("pos").cast("string").alias("event"), "logits", "y")
    return rounded(M.batched_loss(W.epoch_batches(events, SEED, 1)), 9)


@register("best_epoch", V_("fx_history") + """
, h AS (SELECT epoch, val_f1,
          coalesce(max(val_f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev_best
        FROM fx_history),
b AS (SELECT min(epoch) AS be FROM fx_history WHERE val_f1 = (SELECT max(val_f1) FROM fx_history))
SELECT epoch, val_f1, prev_best, val_f1 > prev_best AS improved, epoch = (SELECT be FROM b) AS is_best FROM h""")
def q_best_epoch(spark, sf):
    return W.best_epoch(FX.fx_history(spark, sf))


# ============================================================================ images / modality

_PICK_SQL = """
, pick AS (SELECT event, id, arg_min(path, ext_rank) AS path, arg_min(ext, ext_rank) AS ext
           FROM fx_images WHERE length > 0 GROUP BY event, id)"""


@register("image_pick", V_("fx_images") + _PICK_SQL + "\nSELECT event, id, path, ext FROM pick")
def q_image_pick(spark, sf):
    return PR.pick_images(FX.fx_images(spark, sf))


@register("modality_mix", V_("fx_images") + _PICK_SQL + f"""
, j AS (SELECT c.event, c.text, p.path IS NOT NULL AS has_image
        FROM fx_conv c LEFT JOIN pick p ON c.event = p.event AND c.id = p.id),
m AS (SELECT event, CASE WHEN {G.is_valid('text')} AND has_image THEN 'multimodal'
                         WHEN {G.is_valid('text')} THEN 'text_only' ELSE 'none' END AS m FROM j)
SELECT event, count(*) FILTER (WHERE m = 'multimodal') AS multimodal,
  count(*) FILTER (WHERE m = 'text_only') AS text_only, count(*) FILTER (WHERE m = 'none') AS "none"
FROM m GROUP BY event""")
def q_modality_mix(spark, sf):
    posts = FX.fx_conv(spark, sf).drop("conv_id")
    return PR.modality_mix(PR.attach_images(posts, PR.pick_images(FX.fx_images(spark, sf))))


# ============================================================================ multi-root, cache, names

@register("multi_root_pick", V_("fx_text") + """
, roots AS (SELECT event, pos, CAST(pos % 3 AS INTEGER) AS root_rank FROM fx_text),
win AS (SELECT event, min(root_rank) AS r FROM roots GROUP BY event)
SELECT roots.event, pos, root_rank FROM roots JOIN win ON roots.event = win.event AND roots.root_rank = win.r""")
def q_multi_root_pick(spark, sf):
    from ..sources.files import first_root
    roots = FX.fx_text(spark, sf).select("event", "pos", (F.col("pos") % 3).cast("int").alias("root_rank"))
    return first_root(roots).select("event", "pos", "root_rank")


@register("cache_missing", V_("fx_labels", "fx_catalogue") + """
SELECT DISTINCT event FROM fx_catalogue c WHERE NOT EXISTS (SELECT 1 FROM fx_labels l WHERE l.event = c.event)""")
def q_cache_missing(spark, sf):
    from ..sources.files import uncached_events
    return uncached_events(FX.fx_catalogue(spark, sf), FX.fx_labels(spark, sf))


_PATH_SQL = """
paths AS (SELECT doc_id, '/data/root' || CAST(doc_id % 3 AS VARCHAR) || '/' || source || '%20' || CAST(doc_id AS VARCHAR)
  || '.v' || lang || '/' || source || '%20' || CAST(doc_id AS VARCHAR) || '.v' || lang || '.csv' AS path FROM documents)"""


@register("event_name", "WITH " + _PATH_SQL + """
SELECT doc_id, url_decode(regexp_extract(path, '([^/]+)\\.[^./]+$', 1)) AS event FROM paths""")
def q_event_name(spark, sf):
    d = FX.table(spark, sf, "documents")
    path = F.concat(F.lit("/data/root"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), F.col("source"), F.lit("%20"),
                    F.col("doc_id").cast("string"), F.lit(".v"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("%20"),
                    F.col("doc_id").cast("string"), F.lit(".v"), F.col("lang"), F.lit(".csv"))
    return d.select("doc_id", S.event_from_path(path).alias("event"))


# ============================================================================ file round trips and ML (rows-only checks)

@register("catalogue_listing", V_("fx_text") + """
SELECT event, count(*) AS n_posts FROM fx_text GROUP BY event""")
def q_catalogue_listing(spark, sf):
    """S4 over per-event CSVs written from the documents: every event folder
    is found from the listing alone; post counts come from reading them back."""
    from ..sources.files import catalogue, read_posts, scratch_dir, write_event_csvs
    root = scratch_dir(spark, "catalogue")
    pattern = r"event=([^/]+)/[^/]+$"
    write_event_csvs(FX.fx_text(spark, sf).select("event", "id", F.col("text").alias("微博正文")), root)
    events = catalogue(spark, root, event_pattern=pattern).select("event").distinct()
    counts = read_posts(spark, root, event_pattern=pattern).groupBy("event").agg(F.count(F.lit(1)).alias("n_posts"))
    return events.join(counts, "event", "left").fillna({"n_posts": 0})


@register("cleaned_cache", V_("fx_text") + f"""
SELECT event, pos, {G.clean_text('text')} AS clean_text FROM fx_text""")
def q_cleaned_cache(spark, sf):
    """S5 + J4: the first run cleans and writes every event; the second finds
    them all cached, cleans nothing and reads each post back once."""
    from ..sources.files import cleaned_cache, scratch_dir
    posts = FX.fx_text(spark, sf).select("event", "pos", "text")
    path = scratch_dir(spark, "clean-cache")
    cleaned_cache(spark, posts, path, partitions=cores(spark))
    return cleaned_cache(spark, posts, path).select("event", "pos", "clean_text")


@register("stream_cache", V_("fx_text") + f"""
SELECT event, id, {G.clean_text('text')} AS clean_text FROM fx_text""")
def q_stream_cache(spark, sf):
    """S5 with Structured Streaming: per-event CSVs land in a folder, an
    available-now file stream cleans each file once into the cache."""
    from ..sources.files import read_cache, scratch_dir, write_event_csvs
    from ..streaming.cache_stream import start_cache_stream
    cache = scratch_dir(spark, "stream-cache")
    posts = FX.fx_text(spark, sf).select("event", "id", F.col("text").alias("微博正文"))
    # two landings one after the other, into one cache
    for part in (0, 1):
        landing = scratch_dir(spark, "landing")
        write_event_csvs(posts.where(F.pmod(F.xxhash64("event"), F.lit(2)) == part), landing)
        q = start_cache_stream(spark, landing, cache, event_pattern=r"event=([^/]+)/[^/]+$")
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return read_cache(spark, cache).select("event", "id", "clean_text")


@register("read_posts", V_("fx_text") + "SELECT event, id, text FROM fx_text")
def q_read_posts(spark, sf):
    from ..sources.files import read_posts, scratch_dir, write_event_csvs
    root = scratch_dir(spark, "posts-roundtrip")
    write_event_csvs(FX.fx_text(spark, sf).select("event", "id", F.col("text").alias("微博正文")), root)
    posts = read_posts(spark, root, event_pattern=r"event=([^/]+)/[^/]+$")
    return posts.select("event", "id", F.col("text"))


@register("ingest_errors", V_("fx_text") + """
SELECT event, count(*) AS n_posts, NULL AS error FROM fx_text GROUP BY event
UNION ALL SELECT * FROM (VALUES ('latin', 0, 'not UTF-8'), ('open quote', 0, 'unclosed quote'), ('gone', 0, 'file not found'), ('no text', 0, 'no text column'))""")
def q_ingest_errors(spark, sf):
    """E12 + S1: beside the good event files one is not UTF-8, one ends inside a quote, one has
    vanished and one has no text column; each is an error of its own, the others are read."""
    from ..sources.files import catalogue, ingest, scratch_dir, write_event_csvs
    root, pattern = scratch_dir(spark, "ingest"), r"event=([^/]+)/[^/]+$"
    write_event_csvs(FX.fx_text(spark, sf).select("event", "id", F.col("text").alias("微博正文")), root)
    one = FX.documents(spark, sf).agg(F.max_by("doc_id", "n_chars").alias("id"), F.max_by("text", "n_chars").alias("said"))
    plain = F.translate("said", '",\n\r', "    ")
    ready = lambda df: df.coalesce(1).write.option("header", True).option("quote", "")
    # headers are of ASCII letters but for the UTF-8 bytes of the text column's name
    name = "微博正文".encode().decode("latin-1")
    ready(one.select("id", F.concat(F.lit("é"), F.regexp_replace(plain, "[^\\x{0}-\\x{ff}]", "?")).alias(name))).option("encoding", "ISO-8859-1").csv(f"{root}/event=latin")
    ready(one.select("id", F.concat(F.lit('"'), plain).alias("微博正文"))).csv(f"{root}/event=open quote")
    ready(one.select("id", plain.alias("text"))).csv(f"{root}/event=no text")
    files = catalogue(spark, root, event_pattern=pattern)
    gone = spark.createDataFrame([("gone", f"{root}/event=gone/gone.csv", 10, 0)], files.schema)
    posts, errors = ingest(spark, files.unionByName(gone), event_pattern=pattern)
    counts = posts.groupBy("event").agg(F.count(F.lit(1)).alias("n_posts"))
    events = files.select("event").union(gone.select("event")).distinct()
    return events.join(counts, "event", "left").join(errors.select("event", "error"), "event", "left").fillna({"n_posts": 0})


@register("image_verify", """
SELECT 'root/e' || (doc_id % 10) || '/images/' || doc_id || CASE WHEN doc_id % 7 IN (3, 4) THEN '.jpg' ELSE '.png' END AS path,
  CASE WHEN doc_id % 7 IN (3, 4) THEN 'jpeg' WHEN doc_id % 7 < 3 THEN 'png' END AS format,
  CASE doc_id % 7 WHEN 1 THEN 'truncated' WHEN 2 THEN 'wrong checksum' WHEN 4 THEN 'truncated' WHEN 5 THEN 'unknown format' WHEN 6 THEN 'empty' END AS fault
FROM documents""")
def q_image_verify(spark, sf):
    """Which image files can be decoded."""
    from ..sources.images import verify_images
    return verify_images(FX.fx_image_files(spark, sf)).select("path", "format", "fault")


@register("write_results", V_("fx_vec") + f"""
, p AS (SELECT CAST(pos AS VARCHAR) AS event_name, logits, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM fx_vec)
SELECT event_name, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS predicted_class,
  {G.level_label('list_position(logits, list_max(logits)) - 1')} AS predicted_label,
  round(e[1] / list_sum(e), 9) AS prob_0, round(e[2] / list_sum(e), 9) AS prob_1, round(e[3] / list_sum(e), 9) AS prob_2
FROM p""")
def q_write_results(spark, sf):
    from ..sources.files import read_event_results, scratch_dir, write_event_results
    v = _vec(spark, sf).select(F.col("pos").cast("string").alias("event"), "logits")
    out = scratch_dir(spark, "event-results")
    write_event_results(E.score_events(v), out)
    back = read_event_results(spark, out)
    return rounded(back.select("event_name", "predicted_class", "predicted_label",
                               *[F.col("probabilities")[n].alias(f"prob_{i}") for i, n in enumerate(["轻微", "中等", "严重"])]), 9)


@register("write_table", V_("fx_pred") + "SELECT event, \"true\", pred FROM fx_pred")
def q_write_table(spark, sf):
    """Predictions written as a table and read back."""
    from ..sources.files import scratch_dir, write_table
    out = scratch_dir(spark, "predictions")
    write_table(M.predictions_table(_vec(spark, sf).withColumn("event", F.col("pos").cast("string"))), out)
    return spark.read.parquet(out)


@register("label_json", V_("fx_label_dups") + """
SELECT event, arg_max(reason, position) AS reason, arg_max(severity, position) AS severity
FROM fx_label_dups GROUP BY event""")
def q_label_json(spark, sf):
    """Label lists written as JSON arrays, read back in file order; the last entry of an event wins."""
    from ..sources.files import read_labels, scratch_dir
    out = scratch_dir(spark, "labels")
    rows = FX.fx_label_dups(spark, sf).select("position", F.col("event").alias("topic"), "reason", "severity")
    entry = F.struct("position", F.to_json(F.struct("topic", "reason", "severity")).alias("json"))
    lists = (rows.groupBy(F.pmod(F.xxhash64("topic"), F.lit(16)).alias("file")).agg(F.sort_array(F.collect_list(entry)).alias("l"))
             .select("file", F.concat(F.lit("["), F.array_join(F.col("l.json"), ",\n"), F.lit("]")).alias("value")))
    lists.repartition(16, "file").write.partitionBy("file").text(out)
    return L.dedupe_labels(read_labels(spark, f"{out}/*")).select("event", "reason", "severity")


@register("read_two_roots", V_("fx_text") + """
, r AS (SELECT event, id, CAST(regexp_extract(event, '[0-9]+') AS INTEGER) % 2 = 0 AS first, text FROM fx_text)
SELECT event, id, CASE WHEN first THEN 'A:' ELSE 'B:' END || text AS text, CASE WHEN first THEN 0 ELSE 1 END AS root_rank FROM r""")
def q_read_two_roots(spark, sf):
    """S1 + S3: the first root lacks half of the events; the second has all of them, with other
    column order and more than 48 columns."""
    from ..sources.files import read_posts, scratch_dir, write_event_csvs
    a, b = scratch_dir(spark, "root-a"), scratch_dir(spark, "root-b")
    posts = FX.fx_text(spark, sf).select("event", "id", "text")
    even = F.regexp_extract("event", "[0-9]+", 0).cast("int") % 2 == 0
    write_event_csvs(posts.where(even).select("event", "id", F.concat(F.lit("A:"), F.col("text")).alias("微博正文")), a)
    others = [F.lit(f"x{i}").alias(f"列{i}") for i in range(60)]
    write_event_csvs(posts.select("event", *others, F.concat(F.lit("B:"), F.col("text")).alias("微博正文"), "id"), b)
    return read_posts(spark, [a, b], event_pattern=r"event=([^/]+)/[^/]+$").select("event", "id", "text", "root_rank")


@register("split_files", V_("fx_labels", "fx_catalogue") + ", " + _ENC_SQL + "," + _SPLIT_SQL + """
SELECT 'lines' AS layout, event, part FROM split
UNION ALL SELECT 'object' AS layout, event, part FROM split""")
def q_split_files(spark, sf):
    from ..sources.files import read_split, scratch_dir, write_split, write_split_object
    split = _split(spark, sf)
    lines, obj = scratch_dir(spark, "split-lines"), scratch_dir(spark, "split-object")
    write_split(split, lines)
    write_split_object(split, obj)
    return (read_split(spark, lines).select(F.lit("lines").alias("layout"), "event", "part")
            .unionByName(read_split(spark, obj).select(F.lit("object").alias("layout"), "event", "part")))


@register("post_results_csv", V_("fx_conv") + "," + _VALID_SQL + _CONV_PRED_SQL + """
SELECT c.event, coalesce(nullif(c.id, ''), CAST(c.pos AS VARCHAR)) AS id, c.text, p.predicted_class, p.predicted_label
FROM valid_posts c JOIN preds p ON c.event = p.event""")
def q_post_results_csv(spark, sf):
    from ..sources.files import read_post_results, scratch_dir, write_post_results
    out = scratch_dir(spark, "post-results")
    write_post_results(E.post_results(FX.fx_conv(spark, sf), _conv_preds(spark, sf)), out, partition_by_event=True)
    return read_post_results(spark, out, partitioned_by_event=True).select(
        "event", "id", "text", "predicted_class", "predicted_label")


@register("embed_posts", V_("fx_text") + f"""
, c AS (SELECT event, pos, {G.clean_text('text')} AS text FROM fx_text)
SELECT event, pos, 4096 AS dim, CASE WHEN length(text) >= 2 THEN 1.0 ELSE 0.0 END AS norm
FROM c WHERE {G.is_valid('text')}""")
def q_embed_posts(spark, sf):
    d = clean_posts(FX.fx_text(spark, sf).select("event", "pos", "text"), "text", "text", partitions=cores(spark))
    emb = E.embed(d)
    # a post with at least one bigram has a unit vector, a one-character post the zero vector
    norm = F.sqrt(F.aggregate("vec.values", F.lit(0.0), lambda acc, x: acc + x * x))
    return emb.select("event", "pos", F.col("vec.size").alias("dim"), F.round(norm, 6).alias("norm"))


@register("embed_pooled", V_("fx_text") + f"""
, c AS (SELECT event, pos, {G.clean_text('text')} AS text FROM fx_text),
g AS (SELECT event, pos, list_transform(range(1, length(text)), lambda i: text[i:i + 1]) AS grams FROM c WHERE {G.is_valid('text')}),
k AS (SELECT event, count(*) AS n, count(*) FILTER (WHERE len(grams) > 0) AS with_bigrams FROM g GROUP BY event)
SELECT event, n AS n_valid, 4096 AS dim, with_bigrams > 0 AS any_value FROM k""")
def q_embed_pooled(spark, sf):
    """E14 + V1: sparse vectors up to the event's mean."""
    d = clean_posts(FX.fx_text(spark, sf).select("event", "pos", "text"), "text", "text", partitions=cores(spark))
    pooled = V.mean_pool(E.embed(d).withColumn("valid", F.lit(True)))
    return pooled.select("event", "n_valid", F.size("vec").alias("dim"), F.exists("vec", lambda x: x > 0).alias("any_value"))


def _counting_encoder():
    """A small encoder with known vectors: length, number of blanks, number of `e`."""
    return lambda texts: [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@register("embed_custom", V_("fx_text") + f"""
, c AS (SELECT event, pos, coalesce(text, '') AS text FROM fx_text)
SELECT event, pos, CAST(length(text) AS DOUBLE) AS v0, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS v1,
  CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS v2 FROM c WHERE {G.is_valid('text')}""")
def q_embed_custom(spark, sf):
    """E14 with a caller's encoder, made once per task."""
    emb = E.embed(FX.fx_text(spark, sf).select("event", "pos", "text"), dim=3, encoder_factory=_counting_encoder)
    return emb.select("event", "pos", *[F.col("vec")[i].alias(f"v{i}") for i in range(3)])


@register("train_classifier", V_("fx_vec") + """
SELECT CAST(pos AS VARCHAR) AS event, y AS "true", true AS class_known, true AS at_least_majority FROM fx_vec""")
def q_train_classifier(spark, sf):
    """Fitted on the valid rows, scored on all of them; every prediction is a known class and the
    model is right at least as often as the commonest class."""
    from ..sources.files import land
    v = _vec(spark, sf)
    fitted = v.where(F.col("valid"))
    weights = L.class_weights(fitted.select(F.col("y").alias("level")))
    train = fitted.join(weights.select(F.col("level").alias("y"), "weight"), "y")
    model = E.train_classifier(train.select("event", "pos", F.col("vec").alias("features"),
                                            F.col("y").alias("label"), "weight"), max_iter=20)
    scored = land(E.predict_classes(model, v.select(F.col("pos").cast("string").alias("event"), F.col("vec").alias("features"),
                                                    F.col("y").alias("label"))).select("event", "true", "pred"), "scored")
    right = scored.agg(F.avg((F.col("true") == F.col("pred")).cast("double"))).first()[0]
    common = scored.groupBy("true").count().agg(F.max("count") / F.sum("count")).first()[0]
    return scored.select("event", "true", F.col("pred").isin(0, 1, 2).alias("class_known"), F.lit(bool(right >= common)).alias("at_least_majority"))


@register("epoch_batches", V_("fx_catalogue") + f"""
, k AS (SELECT event, epoch, md5(concat_ws(':', '{SEED}', CAST(epoch AS VARCHAR), event)) AS key FROM fx_catalogue, (SELECT unnest([0, 1]) AS epoch))
SELECT event, epoch, row_number() OVER (PARTITION BY epoch ORDER BY key, event) - 1 AS number,
  CAST((row_number() OVER (PARTITION BY epoch ORDER BY key, event) - 1) // 4 AS BIGINT) AS batch FROM k""")
def q_epoch_batches(spark, sf):
    """O5 + E9: two epochs numbered and cut into batches, written in order and read back."""
    from ..sources.files import scratch_dir
    out = scratch_dir(spark, "epochs")
    for epoch in (0, 1):
        W.write_epoch(W.epoch_batches(FX.fx_catalogue(spark, sf), SEED, epoch), f"{out}/epoch={epoch}")
    return spark.read.schema("event string, number long, batch long, epoch int").json(out)


@register("epoch_order", V_("fx_catalogue") + f"""
SELECT event, epoch, md5(concat_ws(':', '{SEED}', CAST(epoch AS VARCHAR), event)) AS sort_key
FROM fx_catalogue, (SELECT unnest([0, 1]) AS epoch)""")
def q_epoch_order(spark, sf):
    """The seeded per-epoch sort key of every event (order by it to shuffle)."""
    cat = FX.fx_catalogue(spark, sf)
    per_epoch = [cat.select("event", F.lit(e).alias("epoch"), W.shuffle_key(SEED, e).alias("sort_key")) for e in (0, 1)]
    return per_epoch[0].unionByName(per_epoch[1])
