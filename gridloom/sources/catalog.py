"""Catalogue of monthly grid files: built from a rule, parsed, filtered and checked for gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Published months and resolutions (hundredths of a degree) of the two products,
# the months of the small set, and the static file of each product.
MONTHS = {"era5": ("2006-01-01", "2021-12-01"), "cerra": ("2006-01-01", "2021-06-01")}
RESOLUTION_CODE = {"era5": "025", "cerra": "005"}
SMALL_SET = ["200605", "200606", "200705", "200706"]
STATIC_FILE = {"era5": "t2m_era5_lsm_geop_201801_025deg", "cerra": "t2m_cerra_lsm_orog_201801_005deg"}
FILE_PATTERN = r"t2m_(era5|cerra)_(?:(lsm_geop|lsm_orog)_)?(\d{6})_(\d{3})deg"


def month_files(spark: SparkSession, product: str, base: str, suffix: str = ".parquet") -> DataFrame:
    """(url): every published month of a product below ``base``."""
    if product not in MONTHS:
        raise ValueError(f"unknown product {product!r}; use one of {sorted(MONTHS)}")
    first, last = (F.to_date(F.lit(d)) for d in MONTHS[product])
    months = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
    return months.select(
        F.concat(
            F.lit(f"{base.rstrip('/')}/t2m_{product}_"),
            F.date_format("month", "yyyyMM"),
            F.lit(f"_{RESOLUTION_CODE[product]}deg{suffix}"),
        ).alias("url")
    )


def parse_catalog(files: DataFrame, url: str = "url") -> DataFrame:
    """(product, kind, yyyymm, resolution, url) read off the file names; others are left out."""
    part = lambda k: F.regexp_extract(url, FILE_PATTERN, k)
    return files.where(F.col(url).rlike(FILE_PATTERN)).select(
        part(1).alias("product"),
        F.when(part(2) == "", "t2m").otherwise(part(2)).alias("kind"),
        part(3).alias("yyyymm"),
        (part(4).cast("double") / 100).alias("resolution"),
        F.col(url).alias("url"),
    )


def select_months(catalog: DataFrame, months: Sequence[str] = SMALL_SET) -> DataFrame:
    return catalog.where((F.col("kind") == "t2m") & F.col("yyyymm").isin(*months))


def index_months(catalog: DataFrame) -> DataFrame:
    """0-based file index per product in month order; a catalogue has one row per month."""
    order = Window.partitionBy("product").orderBy("yyyymm")
    return catalog.where("kind = 't2m'").withColumn("part_idx", F.row_number().over(order) - 1)


def missing_months(catalog: DataFrame) -> DataFrame:
    """(product, yyyymm) between the first and last month of a product without a file."""
    month = F.to_date("yyyymm", "yyyyMM")
    have = catalog.where("kind = 't2m'").select("product", month.alias("month")).distinct()
    span = have.groupBy("product").agg(F.min("month").alias("first"), F.max("month").alias("last"))
    wanted = span.select("product", F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("month"))
    gaps = wanted.join(have, ["product", "month"], "left_anti")
    return gaps.select("product", F.date_format("month", "yyyyMM").alias("yyyymm"))
