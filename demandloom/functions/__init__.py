"""Column expressions: pricing, listing bands, null handling, calendar and number text."""

from demandloom.functions.columns import (
    above_band,
    as_missing,
    batch_time,
    description_band,
    from_micros,
    micros_of,
    money_label,
    number_text,
    photo_band,
    price_band,
    price_diff_of,
    price_ratio_of,
    rounded_map,
    week_ending_sunday,
    zero_filled,
    zipped_sum,
)

__all__ = [
    "above_band",
    "as_missing",
    "batch_time",
    "description_band",
    "from_micros",
    "micros_of",
    "money_label",
    "number_text",
    "photo_band",
    "price_band",
    "price_diff_of",
    "price_ratio_of",
    "rounded_map",
    "week_ending_sunday",
    "zero_filled",
    "zipped_sum",
]
