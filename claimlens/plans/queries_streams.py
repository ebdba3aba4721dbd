"""Queries: incremental jobs, each run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.cluster import shared_path
from claimlens.operators import updates
from claimlens.plans import views
from claimlens.plans.registry import register
from claimlens.plans.views import with_views
from claimlens.streaming import ingest, levels


def _post_users(posts):
    """User rows of posts; the given tables know the users' numbers only, so the rest is derived from them."""
    user = F.col("user_id_str")
    number = user.cast("long")
    return posts.select(
        user.alias("id_str"), F.concat(F.lit("user "), user).alias("name"), F.concat(F.lit("u"), user).alias("screen_name"), F.lit("").alias("location"), F.lit("").alias("description"),
        (number * 3).alias("followers_count"), (number * 2).alias("friends_count"), F.lit(0).alias("listed_count"), number.alias("favourites_count"), (number + 7).alias("statuses_count"),
        F.lit("2020-01-01").alias("created_at"), (number % 2 == 0).alias("verified"), "crawl_date", F.lit("dropped").alias("other"))


def _ingested(spark, d):
    """Three runs over a growing folder: later posts, then much older ones as well, then nothing new."""
    source, posts, users, offsets = (shared_path(spark, x) for x in ("incoming", "posts", "users", "offsets"))
    batch = views.posts(spark, d)
    late = F.col("turn") % 3 == 0
    old = batch.withColumn("created_at", F.when(late, F.col("created_at") - F.expr("INTERVAL 400 DAYS")).otherwise(F.col("created_at")))
    for part in (old.where(~late), old, None):
        if part is not None:
            part.write.mode("append").parquet(source)
        stream = ingest.read_posts(spark, source, batch.schema)
        ingest.ingest_posts(stream, posts, f"{offsets}/posts", crawl_date="2024-03-01").awaitTermination()
        ingest.ingest_users(stream, _post_users, users, f"{offsets}/users", crawl_date="2024-03-01").awaitTermination()
    return spark.read.parquet(posts), spark.read.parquet(users)


@register("R1", with_views("posts") + """SELECT DISTINCT id_str, user_id_str, full_text, '2024-03-01' AS crawl_date,
  CAST(epoch(created_at) AS BIGINT) - CASE WHEN turn % 3 = 0 THEN 400 * 86400 ELSE 0 END AS created FROM posts""")
def r1(spark, d):
    return _ingested(spark, d)[0].select("id_str", "user_id_str", "full_text", "crawl_date", F.unix_timestamp("created_at").alias("created"))


@register("R1_users", with_views("posts") + """SELECT DISTINCT user_id_str AS id_str, 'user ' || user_id_str AS name, 'u' || user_id_str AS screen_name, '' AS location, '' AS description,
  CAST(user_id_str AS BIGINT) * 3 AS followers_count, CAST(user_id_str AS BIGINT) * 2 AS friends_count, 0 AS listed_count, CAST(user_id_str AS BIGINT) AS favourites_count,
  CAST(user_id_str AS BIGINT) + 7 AS statuses_count, '2020-01-01' AS created_at, CAST(user_id_str AS BIGINT) % 2 = 0 AS verified, '2024-03-01' AS crawl_date FROM posts""")
def r1_users(spark, d):
    return _ingested(spark, d)[1]


def _levelled(spark, d):
    path = shared_path(spark, "levels")
    levels.create(views.sentence(spark, d).select("id", "review_level", "skip_validations"), path)
    return path


def _first_stage(spark, path):
    levels.run_stage(spark, path, lambda df: updates.advance(df, 3, 4, 5), 3, shared_path(spark, "offsets")).awaitTermination()


@register("R3", with_views("sentence") + """
SELECT id, CASE WHEN review_level <> 3 THEN review_level WHEN skip_validations THEN 5 ELSE 4 END AS review_level FROM sentence""")
def r3(spark, d):
    """The whole table after a stage: rows have left level 3."""
    path = _levelled(spark, d)
    _first_stage(spark, path)
    return levels.read(spark, path).select("id", "review_level")


@register("R3_chain", with_views("sentence") + """
SELECT id, CASE WHEN review_level = 3 THEN 5 WHEN review_level = 4 AND NOT skip_validations THEN 5 ELSE review_level END AS review_level FROM sentence""")
def r3_chain(spark, d):
    """A second stage works on what the first has moved; polling again without new rows changes nothing."""
    path, offsets = _levelled(spark, d), shared_path(spark, "offsets")
    _first_stage(spark, path)
    for _ in range(2):
        levels.run_stage(spark, path, lambda df: updates.advance(df, 4, 5), 4, offsets).awaitTermination()
    return levels.read(spark, path).select("id", "review_level")
