"""Timestamps in mixed formats, precisions and zones, normalised to nanoseconds since 1970 UTC.

Texts are taken apart by a few patterns and put together with integer arithmetic, all inside the JVM.  Zones come from
the text, else from a table of sources, else (infer_offsets) from the history of offsets that best aligns local clock
readings with reference instants.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, floor_div

# Month names and the parts of the patterns.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
HALF = r"(?: ?([ap])\.?m\.?(?![a-z]))?"
ZONE = r"(?: ?(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5}|[a-z]+/[a-z0-9_/+-]+))?(?: ?\[([a-z0-9_/+-]+)\])?"
#: (how a text of the form begins, pattern over the trimmed lower-case text, replacement): order|year|a|b|hour|minute|second|fraction|half|zone|region
FORMS = (
    (r"^\d{4}[-/.]", rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:t|[ ,]+){CLOCK}{HALF}{ZONE}$", "ymd|$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (r"^\d{1,2}[-/.]\d", rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}})(?:t|[ ,]+){CLOCK}{HALF}{ZONE}$", "num|$4|$1|$3|$5|$6|$7|$8|$9|$10|$11"),
    (r"^(?:[a-z]{3,9},? +)?\d{1,2}[- ][a-z]", rf"^(?:[a-z]{{3,9}},? +)?(\d{{1,2}})[- ]([a-z]{{3}})[a-z]*\.?[-, ]+(\d{{4}})(?:t|[ ,]+){CLOCK}{HALF}{ZONE}$", "ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (r"^[a-z]", rf"^(?:[a-z]{{3,9}},? +)?([a-z]{{3}})[a-z]*\.? (\d{{1,2}}),? +(\d{{4}})(?:t|[ ,]+){CLOCK}{HALF}{ZONE}$", "ymd|$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (r"^\d{8}[t ]?\d{4}", rf"^(\d{{4}})(\d{{2}})(\d{{2}})[t ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{ZONE}$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
)
#: Short names of standard time: where a wall clock occurs twice they stand for its second, later occurrence.
STANDARD_NAMES = ("est", "cst", "mst", "pst", "ast", "nst", "akst", "aest", "acst", "nzst", "lhst", "cet", "eet", "wet", "msk", "ist", "gmt")
SPACES = r"[\s\u00a0\u2000-\u200b\u202f\u205f\u3000\ufeff]+"
NUMBER = r"^\+?\d+(\.\d*)?(e\+?\d+)?$"
#: Bare numbers count units since 1970; the unit is the one that gives a year in this range.
YEARS = (2021, 2025)
_UNITS = (1_000_000_000, 1_000_000, 1_000, 1)


def _epoch(year: int) -> int:
    return int(np.datetime64(f"{year}-01-01", "s").astype(int))


def _bare_number(wide: Column, years: tuple[int, int]) -> Column:
    """ns since 1970 of a bare number, null if no unit fits.  Exact: DECIMAL arithmetic throughout."""
    low, high = _epoch(years[0]), _epoch(years[1] + 1)
    out = F.lit(None).cast("long")
    for ns in reversed(_UNITS):
        scaled = (wide.cast("decimal(28,9)") * F.lit(ns).cast("decimal(10,0)")).cast("decimal(38,0)")
        out = F.when((wide >= F.lit(low * 10**9 // ns).cast("decimal(38,9)")) & (wide < F.lit(high * 10**9 // ns).cast("decimal(38,9)")), scaled.cast("long")).otherwise(out)
    return out


def parse_instants(df: DataFrame, text: str, zone: str, day_order: str, out: str = "rec_key", years: tuple[int, int] = YEARS) -> DataFrame:
    """Add out: the ns since 1970 UTC that the text stands for, null if it stands for no instant.

    text, zone (IANA name of the source) and day_order (ymd, dmy or mdy, for all-numeric dates that do not begin with
    the year) name columns.  An offset, Z, UTC or GMT in the text holds; a short zone name stands for the source's zone;
    without either the source's zone holds, and without that there is no instant.  A wall clock that occurs twice is
    the earlier instant unless the text names standard time (CET, EST), one that never occurs is none.  Absent seconds are 0; a bare number is read in s, ms, us or ns,
    whichever gives a year from years[0] to years[1].  Impossible dates and clocks, unknown zone names, null and blank texts and instants
    that 64-bit ns cannot hold (before 1677-09-21 or after 2262-04-11) are none.  Columns whose names begin with an underscore are the parser's own.
    """
    # white space of any kind inside or around the text counts as one blank
    clean = F.lower(F.trim(F.regexp_replace(F.col(text), SPACES, " ")))
    step = df.withColumn("_clean", clean)
    # the beginning tells the form, so that a text is matched once; texts that do not fit stay as they are and give no fields
    form = F.lit(None).cast("string")
    for begins, pattern, fields in reversed(FORMS):
        form = F.when(F.col("_clean").rlike(begins), F.regexp_replace("_clean", pattern, fields)).otherwise(form)
    step = step.withColumn("_wide", F.when(F.col("_clean").rlike(NUMBER), F.col("_clean").try_cast("decimal(38,9)")))
    step = step.withColumn("_number", F.when(F.col("_wide").isNotNull(), _bare_number(F.col("_wide"), years)))
    step = step.withColumn("_f", F.when(F.col("_number").isNull() & ~F.contains("_clean", F.lit("|")), F.split(form, r"\|")))
    step = step.withColumn("_n", F.transform(F.slice("_f", 2, 6), lambda x: x.try_cast("int")))
    f = lambda i: F.nullif(F.get("_f", F.lit(i)), F.lit(""))
    year, first, second, hour12, minute = (F.get("_n", F.lit(i)) for i in range(5))
    month_name = F.expr(f"nullif(locate(substring(get(_f, 2), 1, 3), '{' '.join(MONTHS)}') + 3, 3)") / 4
    order = F.coalesce(F.col(day_order), F.lit("ymd"))
    numeric = f(0) == "num"
    # without a stated order of day and month a date holds only if one of its parts can be no month
    day_first = (order == "dmy") | ((order != "mdy") & (first > 12))
    month_first = (order == "mdy") | ((order != "dmy") & (second > 12)) | (first == second)
    month = F.when(numeric, F.when(day_first, second).when(month_first, first)).otherwise(F.coalesce(first, month_name.cast("int")))
    day = F.when(numeric, F.when(day_first, first).when(month_first, second)).otherwise(second)
    half = f(8)
    hour = F.when(half.isNull(), hour12).when(hour12.between(1, 12), hour12 % 12 + F.when(half == "p", 12).otherwise(0))
    step = step.select("*", year.alias("_y"), month.alias("_m"), day.alias("_d"), hour.alias("_h"), minute.alias("_mi"), F.coalesce(F.get("_n", F.lit(5)), F.lit(0)).alias("_s"), f(9).alias("_z"), f(10).alias("_region"))
    wall = F.when(F.col("_s") < 60, F.try_make_timestamp_ltz(F.col("_y"), F.col("_m"), F.col("_d"), F.col("_h"), F.col("_mi"), F.col("_s"), F.lit("UTC")))
    step = step.withColumn("_wall", wall)
    z = F.col("_z")
    step = step.withColumn("_o", F.when(z.rlike("^[+-]"), F.replace(z, F.lit(":"), F.lit("")).try_cast("int")))
    o, short = F.col("_o"), F.length(z) <= 3
    offset = F.when(z.isin("z", "utc", "gmt", "ut"), F.lit(0)).when(short, o * 3600).otherwise(F.call_function("div", o, F.lit(100)).cast("int") * 3600 + o % 100 * 60)
    # zone names in the text are lower case here: the real name is that of the same letters, of some 600
    known = sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())
    real = F.create_map(*[F.lit(x) for k in {n.lower(): n for n in known}.items() for x in k])
    region = F.coalesce(F.when(z.contains("/"), z), F.col("_region"))
    named = F.when(region.isNotNull(), F.try_element_at(real, region)).when(F.col(zone).isin(known), F.col(zone))
    step = step.withColumn("_offset", F.when(F.col("_wall").isNotNull(), offset)).withColumn("_named", F.when(F.col("_wall").isNotNull() & F.col("_offset").isNull(), named))
    step = step.withColumn("_utc", F.to_utc_timestamp("_wall", F.col("_named")))
    wall, named, utc = F.col("_wall"), F.col("_named"), F.col("_utc")
    occurs = F.from_utc_timestamp(utc, named) == wall
    # the second occurrence of a wall clock lies an hour (on Lord Howe half an hour) after the first
    again = F.filter(F.array(F.lit(3600), F.lit(1800)), lambda s: F.from_utc_timestamp(F.timestamp_seconds(F.unix_seconds(utc) + s), named) == wall)
    later = F.when(z.isin(*STANDARD_NAMES), F.coalesce(F.get(again, F.lit(0)), F.lit(0))).otherwise(0)
    fixed = F.when(F.abs("_offset") <= 18 * 3600, F.unix_seconds(wall) - F.col("_offset"))
    step = step.withColumn("_at", F.when(F.col("_offset").isNotNull(), fixed).when(occurs, F.unix_seconds(utc) + later))
    ns = F.when(F.get("_f", F.lit(7)) != "", F.rpad(F.get("_f", F.lit(7)), 9, "0").try_cast("long")).otherwise(F.lit(0).cast("long"))
    # the first and the last second that 64-bit ns hold in full
    held = F.when(F.col("_at").between(-(2**63) // 10**9 + 1, 2**63 // 10**9 - 1), F.col("_at") * 1_000_000_000 + ns)
    return step.withColumn(out, F.coalesce(F.col("_number"), held)).drop("_clean", "_wide", "_number", "_f", "_n", "_y", "_m", "_d", "_h", "_mi", "_s", "_z", "_o", "_region", "_wall", "_offset", "_named", "_utc", "_at")


def normalise_points(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """raw with rec_key; rows whose text stands for no instant are left out.  feeds with a null or repeated id: one holds."""
    known = feeds.where("feed_id is not null").groupBy("feed_id").agg(F.max("zone_name").alias("_zone"), F.max("day_order").alias("_order"))
    return parse_instants(raw.join(broadcast_if_small(known), "feed_id", "left"), "time_text", "_zone", "_order", "_key").drop("_zone", "_order").withColumn(
        # an explode, as a filter would be pushed through all steps of the parser and unfold its expressions
        "rec_key",
        F.explode(F.array_compact(F.array("_key"))),
    ).drop("_key")


QUARTER = 900
#: Offsets tried, in quarter hours east of UTC.
OFFSETS = np.arange(-48, 57)


def _best_history(max_lag: int, change_cost: float):
    """Per source the offset of each period with the fewest violations, where each change of offset has a cost."""
    slack = max(1, max_lag // QUARTER)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        periods = np.sort(pdf["period"].unique())
        at = np.searchsorted(periods, pdf["period"].to_numpy())
        lag = pdf["diff"].to_numpy()[:, None] + OFFSETS[None, :]
        bad = ((lag < 0) | (lag >= slack)) * pdf["n"].to_numpy()[:, None]
        cost = np.zeros((len(periods), len(OFFSETS)))
        np.add.at(cost, at, bad)
        total = np.bincount(at, pdf["n"].to_numpy(), len(periods))
        best, back = cost[0].copy(), []
        for c in cost[1:]:
            cheapest = int(best.argmin())
            stay = best <= best[cheapest] + change_cost
            back.append(np.where(stay, np.arange(len(OFFSETS)), cheapest))
            best = c + np.where(stay, best, best[cheapest] + change_cost)
        path = [int(best.argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path = np.array(path[::-1])
        own = cost[np.arange(len(periods)), path]
        return pd.DataFrame({"source": pdf["source"].iloc[0], "period": periods, "offset_s": OFFSETS[path].astype("int64") * QUARTER, "n": total.astype("int64"), "violations": own.astype("int64")})

    return run


def infer_offsets(df: DataFrame, source: str, local_s: str, reference_s: str, period_s: int = 86_400, max_lag_s: int = 7_200, change_cost: float = 3.0) -> DataFrame:
    """(source, period, offset_s, n, violations): the likeliest UTC offset of a source's local clock in each period.

    local_s: wall clock read as if it were UTC, reference_s: an instant not before the reading (its ingestion, or the
    last known instant in sequence order), both in seconds.  An offset is violated by a reading that would come after its reference or
    more than max_lag_s before it.  The differences are counted per source and period first, so that a task gets only the counts of
    a source; then the history with the fewest violations plus changes is chosen by dynamic programming.
    Rows with nulls take no part; the smallest offset wins a tie.
    """
    known = df.select(F.col(source).cast("string").alias("source"), F.col(local_s).cast("long").alias("local"), F.col(reference_s).cast("long").alias("ref")).where("source is not null and local is not null and ref is not null")
    # differences beyond any offset and lag count as one
    edge = 200
    diff = F.greatest(F.lit(-edge), F.least(F.lit(edge), floor_div(F.col("ref") - F.col("local"), QUARTER).cast("int")))
    counts = known.groupBy("source", floor_div(F.col("local"), period_s).alias("period"), diff.alias("diff")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source").applyInPandas(_best_history(max_lag_s, change_cost), "source string, period bigint, offset_s bigint, n bigint, violations bigint")


def apply_offsets(df: DataFrame, source: str, local_s: str, offsets: DataFrame, out: str = "utc_s", period_s: int = 86_400, most_violations: float = 0.05) -> DataFrame:
    """Add out = local_s minus the inferred offset; null where more than most_violations of a source's readings violate it."""
    sure = offsets.groupBy("source").agg((F.sum("violations") / F.sum("n")).alias("_share"))
    history = offsets.join(sure, "source").where(F.col("_share") <= most_violations).select(F.col("source").alias("_source"), F.col("period").alias("_period"), "offset_s")
    keyed = df.withColumn("_source", F.col(source).cast("string")).withColumn("_period", floor_div(F.col(local_s).cast("long"), period_s))
    return keyed.join(history, ["_source", "_period"], "left").withColumn(out, F.col(local_s) - F.col("offset_s")).drop("_source", "_period", "offset_s")
