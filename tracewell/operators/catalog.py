"""The product catalogue: four tables, the denormalised detail, look-ups and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETAIL = ["product_id", "name", "description", "price_cents", "category_name", "stock_count", "warehouse_location", "avg_rating", "review_count"]


def product_details(product: DataFrame, category: DataFrame, inventory: DataFrame, review: DataFrame) -> DataFrame:
    """A row for each product with category and stock: nine columns, ratings averaged (0 without reviews).

    Reviews are summed up by product before the join, so it meets one row of each.
    """
    rated = review.groupBy("product_id").agg(F.avg("rating").alias("avg_rating"), F.count("id").alias("review_count"))
    out = product.withColumnRenamed("id", "product_id")
    out = out.join(category.select(F.col("id").alias("category_id"), F.col("name").alias("category_name")), "category_id")
    out = out.join(inventory, "product_id").join(rated, "product_id", "left")
    out = out.withColumns({"avg_rating": F.coalesce("avg_rating", F.lit(0.0)), "review_count": F.coalesce("review_count", F.lit(0))})
    return out.select(DETAIL)


def find_details(product: DataFrame, category: DataFrame, inventory: DataFrame, review: DataFrame, product_id: int) -> DataFrame:
    """The detail of one product: at most one row. The filter goes to all scans that have the key."""
    mine = lambda df, c: df.filter(F.col(c) == product_id)
    return product_details(mine(product, "id"), category, mine(inventory, "product_id"), mine(review, "product_id")).limit(1)


def exists(product: DataFrame, product_id: int) -> bool:
    return not product.filter(F.col("id") == product_id).limit(1).isEmpty()


def found(ids: DataFrame, product: DataFrame) -> DataFrame:
    """(id, found) of each row of ids, in one join; a null id is not found."""
    known = product.select(F.col("id").alias("_id")).distinct()
    return ids.join(known, F.col("id") == F.col("_id"), "left").select("id", F.col("_id").isNotNull().alias("found"))


def search_by_name(product: DataFrame, term: str, page: int = 0, size: int = 20) -> DataFrame:
    """Products whose name has ``term`` (``%`` and ``_`` are wildcards) in any case, by id, one page."""
    hits = product.filter(F.lower("name").like("%" + term.lower() + "%"))
    return hits.orderBy("id").offset(page * size).limit(size)


def category_tag(name: str = "category_name"):  # noqa: ANN201
    return F.concat(F.lit("category:"), F.col(name))


def seed_catalog(spark: SparkSession, products: int, categories: int = 20, seed: int = 42) -> dict[str, DataFrame]:
    """Synthetic category, product, inventory and review; the same for equal arguments.

    Prices are 500 to 49,999 cents, reviews 0 to 20 a product, ratings 1 to 5.
    """
    draw = lambda n, *c: F.pmod(F.xxhash64(F.lit(seed), *map(F.col, c[:-1]), F.lit(c[-1])), F.lit(n))
    ids = spark.range(1, products + 1)
    category = spark.range(1, categories + 1).select("id", F.concat(F.lit("Category "), "id").alias("name"))
    product = ids.select(
        "id", (draw(categories, "id", "category") + 1).alias("category_id"), F.concat(F.lit("Product "), "id").alias("name"), F.concat(F.lit("Description of product "), "id").alias("description"), (draw(49_500, "id", "price") + 500).alias("price_cents")
    )
    place = F.array(*map(F.lit, ("EAST", "WEST", "NORTH", "SOUTH")))
    inventory = ids.select(F.col("id").alias("product_id"), draw(1000, "id", "stock").cast("int").alias("stock_count"), F.get(place, draw(4, "id", "place").cast("int")).alias("warehouse_location"))
    n = draw(21, "id", "reviews").cast("int")
    review = ids.filter(n > 0).select(F.col("id").alias("product_id"), F.explode(F.sequence(F.lit(1), n)).alias("k"))
    review = review.select((F.col("product_id") * 32 + F.col("k")).alias("id"), "product_id", (draw(5, "product_id", "k", "rating") + 1).cast("int").alias("rating"), F.concat(F.lit("Review "), "k").alias("comment"))
    return {"category": category, "product": product, "inventory": inventory, "review": review}
