from tidebin.functions.columns import (
    add_days,
    coalesce_zero,
    columns_with_prefix,
    days_between,
    elapsed_days,
    era,
    filter_since,
    local_date,
    log1p_columns,
    null_if_zero,
    round_half_even,
    sub_days,
    trunc_day,
    with_date_parts,
)

__all__ = [
    "add_days",
    "coalesce_zero",
    "columns_with_prefix",
    "days_between",
    "elapsed_days",
    "era",
    "filter_since",
    "local_date",
    "log1p_columns",
    "null_if_zero",
    "round_half_even",
    "sub_days",
    "trunc_day",
    "with_date_parts",
]
