"""Queries over record builders and composed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.spread import spread
from corpusmill.operators import composition as C
from corpusmill.operators.hierarchy import ListSpec
from corpusmill.plans.block_sql import FAQ_RECORDS, IMAGE_RECORDS
from corpusmill.sources.tables import read_table

SUPPLIERS = ListSpec("link", "s_nationkey", "s_suppkey", "supplier", ("s_name",), order=("s_suppkey",))
CUSTOMER_PAGE = C.Page(
    "customers", "page", "https://www.certhaven.example/customers/", "customer", "slug", "c_name",
    (
        C.Section("nation", "nation", ("n_name",), (C.Step("heading", "n_name"), C.Step("items", "items", ("s_name",))), (SUPPLIERS,), "c_nationkey", table_id="n_nationkey"),
        C.Section("region", "region", ("r_name",), (C.Step("fixed", text="All regions are served."), C.Step("paragraph", "r_name")), table_id="r_regionkey"),
    ),
    "c_custkey",
)


def composed_pages(spark: SparkSession, base: str) -> DataFrame:
    """Customers as pages: their nation with its suppliers, where it is covered, and the first region."""
    tables = {
        "customer": read_table(spark, base, "customer", ["c_custkey", "c_name", "c_nationkey"]).withColumn("slug", F.concat(F.lit("c"), F.col("c_custkey").cast("string"))),
        "nation": read_table(spark, base, "nation", ["n_nationkey", "n_name", "n_regionkey"]).where("n_regionkey < 3"),
        "region": read_table(spark, base, "region"),
        "link": read_table(spark, base, "supplier", ["s_nationkey", "s_suppkey"]),
        "supplier": read_table(spark, base, "supplier", ["s_suppkey", "s_name"]).withColumnRenamed("s_suppkey", "id"),
    }
    pages = C.compose_pages(tables, CUSTOMER_PAGE)
    return pages.select("canonical_uri", "title", "content_hash", F.array_join("missing_sections", "|").alias("missing_sections"), "source_ref", "reason")


def blog_records(spark: SparkSession, base: str) -> DataFrame:
    posts = spread(read_table(spark, base, "blog", ["post_id", "url", "title", "html", "short_description"]))
    named = posts.select(F.col("post_id").alias("id"), "url", "title", "html", F.col("title").alias("question1"), F.col("short_description").alias("answer1"))
    found = C.post_records(named, "https://www.certhaven.example/blog/", slots=1)
    return found.select("canonical_uri", "title", "content_hash", F.size("blocks").alias("n_blocks"), "half_pairs", "source_ref", "reason")


def faq_records(spark: SparkSession, base: str) -> DataFrame:
    found = C.pair_list_records(read_table(spark, base, "service_faq_data"))
    return found.select("canonical_uri", "title", "content_hash", F.size("blocks").alias("n_blocks"), "half_pairs", "source_ref", "reason")


def image_records(spark: SparkSession, base: str) -> DataFrame:
    """Documents of the image scope as described images."""
    rows = read_table(spark, base, "documents", ["doc_id", "text", "lang", "source", "content_type"]).where("source = 'image_descriptions'")
    images = rows.select(
        F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_key"), F.col("content_type").alias("framework"),
        F.lit(None).cast("string").alias("title_in_image"), F.col("lang").alias("summary_clean"), F.col("text").alias("description_clean"),
    )
    found = C.described_image_records(images, "https://www.certhaven.example/")
    return found.select("canonical_uri", "title", "content_hash", F.size("blocks").alias("n_blocks"), "source_ref", "reason")


QUERIES = {f.__name__: f for f in (composed_pages, blog_records, faq_records, image_records)}

SQL = {
    "faq_records": FAQ_RECORDS,
    "image_records": IMAGE_RECORDS,
    "composed_pages": """
      with l as (select s_nationkey, string_agg(s_name, chr(31) order by s_suppkey) as items from supplier group by 1),
      n as (select n_nationkey, 'H' || chr(31) || '2' || chr(31) || n_name || chr(30)
                   || coalesce('LIST' || chr(31) || '0' || chr(31) || '0' || chr(31) || chr(31) || items || chr(30), '') as part
            from nation left join l on s_nationkey = n_nationkey where n_regionkey < 3),
      r as (select 'P' || chr(31) || 'All regions are served.' || chr(30) || 'P' || chr(31) || arg_min(r_name, r_regionkey) || chr(30) as part from region)
      select 'https://www.certhaven.example/customers/c' || c_custkey as canonical_uri, c_name as title,
             sha256('DOC' || chr(31) || c_name || chr(30) || coalesce(n.part, '') || r.part) as content_hash,
             case when n.part is null then 'nation' else '' end as missing_sections, 'customer#' || c_custkey as source_ref, null::varchar as reason
      from customer left join n on n_nationkey = c_nationkey, r""",
}
