"""End-to-end retrieval plans: raw records in, complete interval tables out.

Each is one lazy plan. Column names are parameters; the defaults are those of the public
jail, complaint and arrest records that the interval study was made for.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebin.functions.columns import elapsed_days, filter_since, log1p_columns, null_if_zero, with_date_parts
from tidebin.operators.align import INTERVAL, align_left
from tidebin.operators.bins import resample_backward, resample_forward
from tidebin.operators.counts import daily_distinct_count, daily_rule_counts, distinct_rows, union_with_cutover
from tidebin.operators.fill import interpolate_linear
from tidebin.session import settle

Day = str | dt.date

# Offence classes of the public records. Classes overlap on purpose.
# Texts of the violent class, and of each further measure, as (exact texts, contained texts).
MURDER = (["HOMICIDE-NEGLIGENT,UNCLASSIFIE"], ["MURDER & NON-NEGL. MANSLAUGHTER"])
VIOLENT = (["HOMICIDE-NEGLIGENT,UNCLASSIFIE", "FELONY ASSAULT"], ["MURDER & NON-NEGL. MANSLAUGHTER", "ROBBERY", "RAPE"])
FELONY_MEASURES = {
    "murder_homicide_count": MURDER,
    "robbery_count": ([], ["ROBBERY"]),
    "assault_count": ([], ["ASSAULT"]),
    "burglary_count": ([], ["BURGLARY"]),
    "rape_count": ([], ["RAPE"]),
    "grand_larceny_count": (["GRAND LARCENY"], []),
    "grand_larceny_vehicle_count": (["GRAND LARCENY OF MOTOR VEHICLE"], []),
    "weapons_count": ([], ["WEAPON"]),
}
COMPLAINT_LEVELS = ("FELONY", "MISDEMEANOR")
ARREST_LEVELS = ("F", "M")


def text_rule(col: str | Column, exact: Sequence[str], contains: Sequence[str]) -> Column:
    """Equality with any of `exact`, or LIKE with any of `contains`; case-sensitive."""
    col = F.col(col) if isinstance(col, str) else col
    rule = F.lit(False)
    if exact:
        rule = rule | col.isin(*exact)
    for text in contains:
        rule = rule | col.like(f"%{text}%")
    return rule


def offence_rules(
    levels: tuple[str, str], suffix: str, prefix: str = "", *, level: str = "LAW_CAT_CD", text: str = "OFNS_DESC"
) -> dict[str, Column]:
    """The eleven measures by name, for records whose levels are spelled as given."""
    felony = F.col(level) == levels[0]
    rules = {
        f"total_felony_{suffix}": felony,
        f"violent_felony_{suffix}": felony & text_rule(text, *VIOLENT),
        f"total_misdemeanor_{suffix}": F.col(level) == levels[1],
    }
    for name, texts in FELONY_MEASURES.items():
        rules[prefix + name] = felony & text_rule(text, *texts)
    return rules


def complaint_rules() -> dict[str, Column]:
    return offence_rules(COMPLAINT_LEVELS, "crimes")


def arrest_rules() -> dict[str, Column]:
    return offence_rules(ARREST_LEVELS, "arrest", "arrest_")


def _require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def interval_distinct_counts(
    df: DataFrame, since: Day, freq: int, *, date_col: str, id_col: str = "INMATEID", out: str, keys: Sequence[str] = (),
    origin: Day | None = None,
) -> DataFrame:
    """Admissions or discharges: distinct ids per day, summed over complete intervals."""
    _require(df, date_col, id_col, *keys)
    daily = daily_distinct_count(filter_since(df, date_col, since), date_col, id_col, out, keys)
    return with_date_parts(resample_forward(daily, "day", freq, sums=[out], keys=keys, origin=origin))


def interval_rule_counts(
    historic: DataFrame, current: DataFrame | None, since: Day, freq: int, *, date_col: str, id_col: str,
    rules: Mapping[str, Column], keys: Sequence[str] = (), origin: Day | None = None,
) -> DataFrame:
    """Complaints or arrests: rule counts over the archive continued by the current feed.

    The last day of the whole archive decides where the current feed takes over. It is found
    from the date column alone; both inputs are filtered by `since` before any counting.
    """
    _require(historic, date_col, id_col, *keys)
    rows = historic if current is None else union_with_cutover(historic, current, date_col)
    rows = filter_since(rows, date_col, since)
    daily = daily_rule_counts(rows, date_col, id_col, rules, keys)
    return resample_forward(daily, "day", freq, sums=list(rules), keys=keys, origin=origin)


def interval_mean_stay(
    df: DataFrame, since: Day, freq: int, *, id_col: str = "INMATEID", admitted: str = "ADMITTED_DT",
    discharged: str = "DISCHARGED_DT", out: str = "avg_los_days", keys: Sequence[str] = (), origin: Day | None = None,
) -> DataFrame:
    """Mean length of stay in whole days of the distinct stays that ended in each interval."""
    _require(df, id_col, admitted, discharged, *keys)
    stays = distinct_rows(filter_since(df, discharged, since), [*keys, id_col, admitted, discharged])
    stays = stays.withColumn(out, elapsed_days(admitted, discharged))
    return with_date_parts(resample_forward(stays, discharged, freq, means=[out], keys=keys, origin=origin))


def interval_population(
    df: DataFrame, freq: int, *, date_col: str = "snapshot_date", value: str = "Total Population", out: str = "adp",
    keys: Sequence[str] = (), interpolate: bool = False, last_day: Day | None = None,
) -> DataFrame:
    """Average daily population per interval, counted back from the last snapshot.

    With `interpolate`, intervals averaging zero count as missing and are filled; the
    interval table is settled for it, so the snapshots are still read once.
    """
    _require(df, date_col, value, *keys)
    daily = df.select(*keys, date_col, F.col(value).cast("double").alias(out))
    bins = resample_backward(daily, date_col, freq, means=[out], keys=keys, last_day=last_day)
    if not interpolate:
        return bins
    return interpolate_linear(settle(bins.withColumn(out, null_if_zero(out))), keys, "bin_idx", out)


def study_table(population: DataFrame, *series: DataFrame, log_cols: Sequence[str] = (), on: Sequence[str] = INTERVAL) -> DataFrame:
    """Population intervals with every other series beside them, complete rows only,
    and log(1+x) of the listed columns."""
    joined = align_left(population, *series, on=on, drop_nulls=True)
    return log1p_columns(joined, log_cols) if log_cols else joined
