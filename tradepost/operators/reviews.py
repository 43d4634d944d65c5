"""Reports on reviews and favorite lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import full_name, mean
from ..functions.joins import keyed_join

Frames = Mapping[str, DataFrame]


def rating_parts(review: DataFrame, *keys: str) -> DataFrame:
    """Per key: number of reviews, of rated reviews, and the sum of ratings. These add up, so a later
    day's parts can be merged; the mean is taken last."""
    return review.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count("rating").alias("n_rated"),
        F.coalesce(F.sum("rating"), F.lit(0)).cast("bigint").alias("rating_sum"),
    )


def _reviewed(tables: Frames, product_ids: list[int] | None) -> tuple[DataFrame, DataFrame]:
    products = tables["product"].select("product_id", F.col("name").alias("product_name"))
    reviews = tables["review"].select("review_id", "product_id", "customer_id", "rating", "comment")
    if product_ids is not None:
        chosen = F.col("product_id").isin(product_ids)
        products, reviews = products.filter(chosen), reviews.filter(chosen)
    return products, reviews


def product_reviews_with_favorites(
    tables: Frames, product_ids: list[int] | None = None, expand: bool = False
) -> DataFrame:
    """Reviews of products with the reviewer, for all products or some.

    The source joins through the reviewer's whole favorite list, so a review repeats once for each
    of the reviewer's favorite items (once if there are none). The repeats are equal rows, so they
    are counted in ``copies``; ``expand`` writes them out.
    """
    products, reviews = _reviewed(tables, product_ids)
    lists = tables["favorite_list"].select("favorite_id", "customer_id")
    per_list = tables["favorite_list_items"].groupBy("favorite_id").agg(F.count(F.lit(1)).alias("favorites"))
    favorites = keyed_join(per_list, lists, "favorite_id").select("customer_id", "favorites")
    people = tables["customer"].select("customer_id", full_name().alias("customer_name"))
    known = keyed_join(reviews, products, "product_id")
    written = keyed_join(known, people, "customer_id", "left")
    silent = products.join(reviews.select("product_id").distinct(), "product_id", "left_anti")
    rows = (
        keyed_join(written, favorites, "customer_id", "left")
        .unionByName(silent, allowMissingColumns=True)
        .select(
            "product_id",
            "product_name",
            "review_id",
            "rating",
            "comment",
            F.coalesce("customer_name", F.lit(" ")).alias("customer_name"),
            F.coalesce("favorites", F.lit(1)).cast("bigint").alias("copies"),
        )
    )
    if not expand:
        return rows
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies", "_copy")


def reviewers_who_favorited(tables: Frames, product_ids: list[int] | None = None) -> DataFrame:
    """Per review: does the reviewer have this very product on their list?"""
    products, reviews = _reviewed(tables, product_ids)
    listed = (
        keyed_join(
            tables["favorite_list_items"].select("favorite_id", "product_id"),
            tables["favorite_list"].select("favorite_id", "customer_id"),
            "favorite_id",
        )
        .select("customer_id", "product_id")
        .distinct()
        .withColumn("listed", F.lit(True))
    )
    people = tables["customer"].select("customer_id", full_name().alias("customer_name"))
    known = keyed_join(reviews, products, "product_id")
    rows = keyed_join(known, people, "customer_id")
    # The pair as one text key, so that a pair with very many reviews is split like any heavy key.
    pair = F.concat_ws("/", "customer_id", "product_id")
    pairs = listed.select(pair.alias("pair"), "listed")
    return keyed_join(
        rows.withColumn("pair", pair), pairs, "pair", "left"
    ).select(
        "review_id",
        "product_id",
        "product_name",
        "rating",
        "comment",
        "customer_id",
        "customer_name",
        F.col("listed").isNotNull().alias("has_favorited"),
    )


def avg_rating_per_product(tables: Frames) -> DataFrame:
    """Mean rating of each product in a category, NULL if it has no rating."""
    rated = rating_parts(tables["review"], "product_id")
    products = tables["product"].select("product_id", "name", "category_id")
    names = tables["category"].select("category_id", F.col("name").alias("category_name"))
    known = keyed_join(products, names, "category_id")
    return known.join(rated, "product_id", "left").select(
        "product_id",
        "name",
        "category_name",
        mean("rating_sum", "n_rated").cast("decimal(18,6)").alias("average_rating"),
    )


def products_without_review(tables: Frames) -> DataFrame:
    return tables["product"].select("product_id", "name", "price").join(
        tables["review"].select("product_id").distinct(), "product_id", "left_anti"
    )


def average_product_rating(tables: Frames, product_id: int | None = None) -> DataFrame:
    """Mean rating to two decimals, 0 if there is none: of every product, or one row for one product,
    known or not."""
    review = tables["review"]
    if product_id is not None:
        known = tables["product"].filter(F.col("product_id") == product_id).select("product_id")
        return (
            review.filter(F.col("product_id") == product_id)
            .join(known, "product_id", "left_semi")
            .agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
            .select(_rounded_mean("s", "n"))
        )
    rated = rating_parts(review, "product_id")
    return (
        tables["product"]
        .select("product_id")
        .join(rated, "product_id", "left")
        .select("product_id", _rounded_mean("rating_sum", "n_rated"))
    )


def _rounded_mean(total: str, n: str):
    return F.coalesce(mean(total, n), F.lit(0)).cast("decimal(10,2)").alias("average_rating")


def customer_reviews_from_parts(customer: DataFrame, parts: DataFrame) -> DataFrame:
    return customer.select("customer_id", "first_name", "last_name").join(parts, "customer_id", "left").select(
        "customer_id",
        "first_name",
        "last_name",
        F.coalesce("n_reviews", F.lit(0)).cast("bigint").alias("total_reviews"),
        F.coalesce(mean("rating_sum", "n_rated"), F.lit(0)).cast("decimal(18,6)").alias("average_rating"),
    )


def customer_reviews(tables: Frames) -> DataFrame:
    """Per customer: reviews written and their mean rating, 0 if none is rated."""
    return customer_reviews_from_parts(tables["customer"], rating_parts(tables["review"], "customer_id"))


def users_favorites(tables: Frames) -> DataFrame:
    """Favorite products of each customer with their price."""
    people = tables["customer"].select("customer_id", full_name().alias("full_name"))
    owners = keyed_join(
        tables["favorite_list"].select("favorite_id", "customer_id"), people, "customer_id"
    )
    products = tables["product"].select("product_id", F.col("name").alias("product_name"), "price")
    items = tables["favorite_list_items"].select("favorite_id", "product_id")
    owned = keyed_join(items, owners, "favorite_id")
    return keyed_join(owned, products, "product_id").select(
        "customer_id", "full_name", "product_id", "product_name", "price"
    )
