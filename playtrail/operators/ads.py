"""Rewarded ads: views and viewers per ad."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrail.functions.numeric import ratio2, round2
from playtrail.functions.texts import ad_label, short_ad_label
from playtrail.operators.cohort import keep_cohort, user_cohort
from playtrail.operators.filters import Filters, name_matches
from playtrail.operators.weights import number
from playtrail.sources.schema import REWARDED_AD_PATTERN, USER

# Places of the rows of one pass: all users, then the ads, then their totals.
ALL_USERS, AD_ROW, TOTAL_ROW = 0, 1, 2


def _views_per_ad(events: DataFrame, filters: Filters, by_event_date: bool) -> DataFrame:
    views = filters.on_attributes(events.filter(name_matches(REWARDED_AD_PATTERN)))
    if by_event_date:
        views = filters.on_event_date(views)
    per_user = views.groupBy(USER, "event_name").agg(number(events).alias("views"))
    return (
        keep_cohort(per_user, events, filters)
        .groupBy("event_name")
        .agg(
            F.sum("views").alias("total_count"),
            F.count(USER).alias("unique_users"),
        )
        .withColumn("avg_per_user", ratio2(F.col("total_count"), F.col("unique_users")))
    )


def total_users(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """One row: users with any event that passes the filters, in the cohort if one is set."""
    if filters.has_cohort and filters.cohort_scope == "filtered":
        # The install that put a user in the cohort is itself an event that passes the filters.
        users = user_cohort(events, filters).select(USER)
    else:
        seen = filters.on_attributes(events).select(USER).distinct()
        users = keep_cohort(seen, events, filters)
    return users.agg(F.count(USER).alias("total_users"))


def rewarded_ads(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Views per rewarded ad, per viewer and per user. The date range filters the views as well as
    the installs, but not the number of users."""
    return (
        _views_per_ad(events, filters, by_event_date=True)
        .withColumn("total_users", total_users(events, filters).scalar())
        .withColumn("avg_per_all_users", ratio2(F.col("total_count"), F.col("total_users")))
        .orderBy(F.desc("total_count"), "event_name")
    )


def rewarded_ads_by_install(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """Older form: the date range selects installs only, and there are no all-user columns."""
    return _views_per_ad(events, filters, by_event_date=False).orderBy(
        F.desc("total_count"), "event_name"
    )


def rewarded_ads_totals(ads: DataFrame) -> DataFrame:
    """TOTAL row under `rewarded_ads`; no row when it has none. A user who watches two ads counts
    twice in `unique_users`."""
    count, viewers, users = F.col("total_count"), F.col("unique_users"), F.col("total_users")

    def or_zero(part, whole):
        return F.when(whole > 0, round2(part.cast("double") / whole)).otherwise(F.lit(0.0))

    return (
        ads.agg(
            F.sum("total_count").alias("total_count"),
            F.sum("unique_users").alias("unique_users"),
            F.max("total_users").alias("total_users"),
        )
        .filter(count.isNotNull())
        .select(
            F.lit("TOTAL").alias("event_name"),
            count,
            viewers,
            or_zero(count, viewers).alias("avg_per_user"),
            users,
            or_zero(count, users).alias("avg_per_all_users"),
        )
    )


def rewarded_ads_with_totals(events: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """The rows of `rewarded_ads` and, last, those of `rewarded_ads_totals`, from one pass over the
    log (two where a date range needs the installs).

    Views are summed per user and ad, then gathered per user, who has one entry per ad at most. Each
    user then counts once for all users, once for each ad and, as in the totals, once for TOTAL with
    every ad. Every event is read, as every user counts; only its user, name and day are.
    """
    name = F.when(name_matches(REWARDED_AD_PATTERN), F.col("event_name"))
    if filters.has_cohort:
        on_day = F.col("event_date").between(F.lit(filters.start), F.lit(filters.end))
        name = F.when(on_day, name)
    per_ad = (
        filters.on_attributes(events)
        .groupBy(USER, name.alias("ad"))
        .agg(number(events).alias("views"))
    )
    per_user = (
        keep_cohort(per_ad, events, filters)
        .groupBy(USER)
        .agg(F.collect_list(F.when(F.col("ad").isNotNull(), F.struct("ad", "views"))).alias("seen"))
    )
    known = F.col(USER).isNotNull().cast("bigint")

    def entries(place: int, label: Column | None) -> Column:
        return F.transform(
            "seen",
            lambda x: F.struct(
                F.lit(place).alias("place"),
                (x["ad"] if label is None else label).alias("event_name"),
                x["views"].alias("views"),
                known.alias("users"),
            ),
        )

    user = F.struct(
        F.lit(ALL_USERS).alias("place"),
        F.lit(None).cast("string").alias("event_name"),
        F.lit(0).cast("bigint").alias("views"),
        known.alias("users"),
    )
    rows = F.concat(F.array(user), entries(AD_ROW, None), entries(TOTAL_ROW, F.lit("TOTAL")))
    summed = (
        per_user.select(F.inline(rows))
        .groupBy("place", "event_name")
        .agg(F.sum("views").alias("total_count"), F.sum("users").alias("unique_users"))
    )
    # The window holds one row per ad.
    all_users = F.max(F.when(F.col("place") == ALL_USERS, F.col("unique_users")))
    views, viewers, users = F.col("total_count"), F.col("unique_users"), F.col("total_users")

    def mean(whole: Column) -> Column:
        in_totals = F.when(whole > 0, round2(views.cast("double") / whole)).otherwise(F.lit(0.0))
        return F.when(F.col("place") == TOTAL_ROW, in_totals).otherwise(ratio2(views, whole))

    return (
        summed.withColumn("total_users", all_users.over(Window.partitionBy()))
        .filter(F.col("place") != ALL_USERS)
        .orderBy("place", F.desc("total_count"), "event_name")
        .select(
            "event_name",
            "total_count",
            "unique_users",
            mean(viewers).alias("avg_per_user"),
            "total_users",
            mean(users).alias("avg_per_all_users"),
        )
    )


def total_rewarded_ads(ads: DataFrame) -> DataFrame:
    return ads.agg(F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_rewarded_ads"))


def top_ads(ads: DataFrame, k: int = 10) -> DataFrame:
    """First k bars of the ad chart."""
    return ads.orderBy(F.desc("total_count"), "event_name").limit(k)


def ad_labels(ads: DataFrame) -> DataFrame:
    """Table and pie labels of each ad."""
    return ads.select(
        "event_name",
        ad_label(F.col("event_name")).alias("label"),
        short_ad_label(F.col("event_name"), F.col("total_count")).alias("short_label"),
        "total_count",
    )
