"""Price dimension: one row per model key, amounts as whole pico-dollars per token.

Whole numbers keep sums exact whatever order partitions finish in; dollars appear
only when a report is rounded.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F

STALE_AFTER_DAYS = 60
PICO_PER_TOKEN = 1_000_000  # one dollar per million tokens
PRICE_SCHEMA = ("price_key string, p_new bigint, p_read bigint, p_write_5m bigint, p_write_1h bigint, "
                "p_out bigint, max_output bigint")

AMOUNTS = ("p_new", "p_read", "p_write_5m", "p_write_1h", "p_out", "max_output")


class PriceError(ValueError):
    """The price table is malformed; the message names the model and the field."""


@dataclass
class PriceTable:
    """models: key -> {input, output, cache_read[, max_output]} in dollars per million tokens."""

    models: dict[str, dict]
    verified_on: date | None = None
    write_5m: str = "1.25"
    write_1h: str = "2.0"
    extra: dict = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        out = []
        for key, m in self.models.items():
            amounts = {}
            for name in ("input", "output", "cache_read"):
                try:
                    amounts[name] = Decimal(str(m[name])) * PICO_PER_TOKEN
                except (KeyError, TypeError, ArithmeticError) as e:
                    raise PriceError(f"model {key!r}: field {name!r} can't be read ({e!r})") from e
            cells = [amounts["input"], amounts["cache_read"], amounts["input"] * Decimal(self.write_5m),
                     amounts["input"] * Decimal(self.write_1h), amounts["output"]]
            if any(c != c.to_integral_value() for c in cells):
                raise PriceError(f"model {key!r}: prices finer than one pico-dollar per token")
            cap = m.get("max_output")
            out.append((key, *[int(c) for c in cells], None if cap is None else int(cap)))
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), PRICE_SCHEMA)

    def staleness(self, spark: SparkSession, today: date | None = None) -> DataFrame:
        """One row: age in days and whether the table is past its date (no date: stale)."""
        row = spark.createDataFrame([(self.verified_on, today)], "verified_on date, today date")
        age = F.datediff(F.coalesce("today", F.current_date()), F.col("verified_on"))
        return row.select("verified_on", age.alias("age_days"),
                          F.coalesce(age > STALE_AFTER_DAYS, F.lit(True)).alias("stale"))


def from_config(data: dict) -> PriceTable:
    """A parsed configuration mapping (models, verified_on, cache_write_multiplier) as a table."""
    mult = data.get("cache_write_multiplier", {})
    verified = data.get("verified_on")
    if isinstance(verified, str):
        try:
            verified = date.fromisoformat(verified)
        except ValueError as e:
            raise PriceError(f"verified_on: {e}") from e
    table = PriceTable(models=data.get("models", {}), verified_on=verified,
                       write_5m=str(mult.get("5m", 1.25)), write_1h=str(mult.get("1h", 2.0)))
    table.rows()
    return table


def match_models(models: DataFrame, prices: DataFrame, on: str = "model") -> DataFrame:
    """Longest-prefix match of each distinct model name to a price key.

    The theta join runs over distinct names only; both sides are dimension-sized.
    """
    names = models.select(on).distinct()
    key, name = F.col("price_key"), F.col(on)
    hit = (name == key) | name.startswith(F.concat(key, F.lit("-"))) | name.startswith(F.concat(key, F.lit("@")))
    columns = [c for c in prices.columns if c != "price_key"]
    return (
        names.join(prices, hit, "inner").groupBy(on)
        .agg(F.max_by(F.struct("price_key", *columns), F.length("price_key")).alias("__p"))
        .select(on, "__p.*")
    )


def with_prices(df: DataFrame, prices: PriceTable | DataFrame, on: str = "model") -> DataFrame:
    """Add the matched price amounts; unpriced models keep null amounts.

    A `PriceTable` is a handful of known rows: its keys become one CASE expression, longest
    key first, with no join and no shuffle. A price DataFrame is matched by `match_models`.
    """
    if isinstance(prices, PriceTable):
        name, found = F.col(on), None
        for key, *cells in sorted(prices.rows(), key=lambda r: -len(r[0])):
            hit = (name == key) | name.startswith(key + "-") | name.startswith(key + "@")
            row = F.struct(F.lit(key).alias("price_key"),
                           *[F.lit(v).cast("bigint").alias(n) for n, v in zip(AMOUNTS, cells)])
            found = F.when(hit, row) if found is None else found.when(hit, row)
        return df.withColumn("__p", found).select("*", "__p.*").drop("__p")
    return df.join(match_models(df, prices, on), on, "left")
