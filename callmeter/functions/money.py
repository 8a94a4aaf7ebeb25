"""Cost expressions in pico-dollars, and the one place where they become dollars."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PICO = 1e12


def call_cost(output: str = "output") -> Column:
    """Cost of a call priced by `with_prices`; null when its model has no price."""
    c = F.col
    return (
        c("input_new") * c("p_new") + c("cache_read") * c("p_read")
        + (c("cache_write") - c("cache_write_1h")) * c("p_write_5m")
        + c("cache_write_1h") * c("p_write_1h") + c(output) * c("p_out")
    )


def exact_sum(col: Column | str) -> Column:
    """Sum of whole pico-dollars that cannot overflow 64 bits."""
    col = F.col(col) if isinstance(col, str) else col
    return F.sum(col.cast("decimal(20,0)"))


def dollars(pico: Column, digits: int = 8) -> Column:
    return F.round(pico.cast("double") / F.lit(PICO), digits)
