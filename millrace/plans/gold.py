"""Silver to gold: cleaned products joined with their reviews, and the table models train on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import clean
from millrace.operators.combine import skew_join, union_same
from millrace.operators.impute import fill_constants, impute_means
from millrace.operators.projection import sorted_columns
from millrace.sources.tables import read_categories, write_parquet

# Categories, the join key, and which columns are kept, filled and dropped.
CATEGORIES = ["Books", "Clothing_Shoes_and_Jewelry", "Electronics", "Home_and_Kitchen", "Toys_and_Games"]
KEY = "parent_asin"
META_COLUMNS = [
    "parent_asin",
    "average_rating",
    "rating_number",
    "main_category",
    "title",
    "price",
    "details_publisher_value",
    "details_language_value",
    "details_hardcover_value",
    "details_item_weight_value",
    "details_dimensions_width",
    "details_dimensions_depth",
    "details_dimensions_height",
    "dataset_category",
]
REVIEW_COLUMNS = ["parent_asin", "rating", "helpful_vote", "verified_purchase", "timestamp"]
TEXT_FILL = {"details_publisher_value": "unknown", "details_language_value": "unknown", "main_category": "unknown"}
MEAN_FILL = [
    "price",
    "details_hardcover_value",
    "details_item_weight_value",
    "details_dimensions_width",
    "details_dimensions_depth",
    "details_dimensions_height",
]
DROPPED = ["title", "timestamp", "parent_asin"]

HOT_ROWS = 10_000_000  # reviews of one product from which on the job spreads them over salts


def clean_meta(df: DataFrame, category: str | Column) -> DataFrame:
    """Silver products with numbers parsed; 14 columns. ``category`` is a name or, for a table of all categories, a column."""
    dimensions = "details_dimensions_value"
    return df.withColumns(
        {
            "dataset_category": F.lit(category) if isinstance(category, str) else category,
            "main_category": clean.known("main_category"),
            "price": clean.money("price"),
            "details_item_weight_value": clean.first_number("details_item_weight_value"),
            "details_hardcover_value": clean.first_int("details_hardcover_value"),
            "details_dimensions_width": clean.dimension(dimensions, 0),
            "details_dimensions_depth": clean.dimension(dimensions, 1),
            "details_dimensions_height": clean.dimension(dimensions, 2),
            "details_publisher_value": clean.before("details_publisher_value", ";"),
        }
    ).select(*META_COLUMNS)


def clean_reviews(df: DataFrame) -> DataFrame:
    """Silver reviews with a flag and a timestamp; 5 columns."""
    computed = {"verified_purchase": clean.flag(F.col("verified_purchase")), "timestamp": clean.from_millis("timestamp")}
    return df.select(*[computed[c].alias(c) if c in computed else c for c in REVIEW_COLUMNS])


def gold_join(
    meta: DataFrame, reviews: DataFrame, category: str | Column, hot_rows: int | None = None
) -> DataFrame:
    """Products joined with their reviews.

    A product with very many reviews is split by AQE's skew join. With ``hot_rows`` such products are
    found beforehand, by a counting pass over the key column, and joined in parts of at most about so many reviews.
    """
    left, right = clean_meta(meta, category), clean_reviews(reviews)
    if hot_rows is None:
        return left.join(right, KEY)
    return skew_join(right, left, KEY, hot_rows).select(*META_COLUMNS, *REVIEW_COLUMNS[1:])


def gold_table(
    metas: Mapping[str, DataFrame], reviews: Mapping[str, DataFrame], hot_rows: int | None = None
) -> DataFrame:
    """All categories joined and stacked."""
    return union_same([gold_join(metas[c], reviews[c], c, hot_rows) for c in metas])


def model_data(gold: DataFrame) -> DataFrame:
    """18 columns in alphabetical order, nothing missing.

    The price flag is taken before the price is filled.
    """
    dated = gold.withColumns(
        {
            "review_year": F.year("timestamp"),
            "review_month": F.month("timestamp"),
            "has_valid_price": clean.has_value("price"),
        }
    )
    filled = impute_means(fill_constants(dated, TEXT_FILL), MEAN_FILL)
    flagged = filled.withColumn("verified_purchase", clean.flag(F.col("verified_purchase")))
    return sorted_columns(flagged.drop(*DROPPED))


def gold_job(
    spark: SparkSession,
    meta_template: str,
    review_template: str,
    target: str,
    categories: Sequence[str] = tuple(CATEGORIES),
    hot_rows: int | None = HOT_ROWS,
) -> None:
    """Read both tables of every category, write gold partitioned by category."""
    metas = read_categories(spark, meta_template, categories)
    reviews = read_categories(spark, review_template, categories)
    write_parquet(gold_table(metas, reviews, hot_rows), target, partition_by=["dataset_category"])


def model_data_job(spark: SparkSession, source: str, target: str) -> None:
    write_parquet(model_data(spark.read.parquet(source)), target)
