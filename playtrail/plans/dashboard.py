"""The reports one dashboard load shows, as lazy DataFrames under their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playtrail.operators import ads, boost, churn, economy, levels, overview, retention, units
from playtrail.operators.cohort import narrow_to_cohort
from playtrail.operators.filters import Filters
from playtrail.sources.schema import AD_FORMATS, REWARDED_AD_PATTERN


def dashboard(
    events: DataFrame,
    filters: Filters = Filters(),
    level_count: int | str | None = 50,
    loadout_level: int | str | None = None,
    narrow: bool = False,
) -> dict[str, DataFrame]:
    """Every tab of the dashboard and its filter lists. With `narrow` the cohort cuts the events before
    every report."""
    seen = narrow_to_cohort(events, filters) if narrow else events
    rewarded = ads.rewarded_ads(seen, filters)
    return {
        "rewarded_ads": rewarded,
        "rewarded_ads_totals": ads.rewarded_ads_totals(rewarded),
        "level_analysis": levels.level_analysis(seen, filters, level_count),
        "silver_boost": boost.silver_boost(seen, filters, level_count),
        "unit_loadout": units.unit_loadout(seen, filters, loadout_level),
        "unit_upgrades": units.unit_upgrades(seen, filters),
        "churn": churn.churn(seen, filters, level_count),
        "booster_boxes": economy.booster_boxes(seen, filters),
        "base_station": economy.base_station(seen, filters),
        "overall_stats": overview.overall_stats(seen, filters),
        # The lists leave their own filter out, so their cohort is another one.
        "available_countries": overview.available_countries(events, filters),
        "available_versions": overview.available_versions(events, filters),
    }


def rewarded_ad_drilldown(
    events: DataFrame, ad: str | None = None, filters: Filters = Filters()
) -> DataFrame:
    """Matrix behind one row of the ad table; the TOTAL row (None) opens all rewarded ads."""
    return retention.rewarded_ads_cohort(events, ad or REWARDED_AD_PATTERN, filters)


def ad_impression_tables(events: DataFrame, filters: Filters = Filters()) -> dict[str, DataFrame]:
    """One matrix per ad format, cut out of a common pass."""
    both = retention.ad_impressions_by_format(events, AD_FORMATS, filters)
    return {
        fmt: both.filter(F.col("ad_format") == fmt).drop("ad_format") for fmt in AD_FORMATS
    }
