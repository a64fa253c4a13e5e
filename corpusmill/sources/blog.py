"""The blog tables: what may be read of them, their inventory and their rows with metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.urls import canonical_url

# The two tables and the columns of each that may be read.
POSTS_TABLE, META_TABLE = "subone_newblogs", "subone_blogmeta"
POSTS = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("url", "title", "long_description", "short_description", "page_title", "page_description")]
    + [T.StructField("posted_date", T.DateType())]
    + [T.StructField(c, T.StringType()) for c in ("service_image", "status")]
    + [T.StructField("blog_meta_id", T.LongType())]
    + [T.StructField(f"faq_{half}{n}", T.StringType()) for half in ("question", "answer") for n in range(1, 6)]
)
META = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("title", "description", "keywords", "author", "language")])
ALLOWED = {POSTS_TABLE: POSTS, META_TABLE: META}


def identities(posts: DataFrame, base: str) -> DataFrame:
    """(id, canonical_uri) in order of id, from ids and slugs alone; a row whose slug makes no URL is examined and left out."""
    found = posts.select("id", canonical_url(F.when(F.trim("url") != "", F.col("url")), base).alias("canonical_uri"))
    return found.where("canonical_uri is not null").orderBy("id")


def rows_with_metadata(posts: DataFrame, meta: DataFrame) -> DataFrame:
    """Every allowed column of the posts and, as meta_..., of their metadata; posts without any keep nulls. In order of id."""
    own = meta.select(F.col("id").alias("blog_meta_id"), *[F.col(c).alias(f"meta_{c}") for c in META.names if c != "id"])
    return posts.select(*POSTS.names).join(own, "blog_meta_id", "left").select(*POSTS.names, *[f"meta_{c}" for c in META.names if c != "id"]).orderBy("id")
