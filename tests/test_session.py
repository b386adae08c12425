"""The same answers whatever the session's zone and partition count."""

import pytest
from small import rows

from playtrail.plans.catalog import reports

SF = "/root/testdata/sf0.001"
SOME = (
    "flat_events",
    "level_analysis_week",
    "silver_boost",
    "churn",
    "ad_impression_cells",
    "time_to_n_levels",
    "milestone_summary",
)


@pytest.mark.parametrize("name", SOME)
def test_settings_do_not_matter(spark, setting, name):
    base = rows(reports()[name](spark, SF))
    assert base
    for zone, parts in (("America/Los_Angeles", "1"), ("Asia/Kolkata", "200")):
        setting(session__timeZone=zone, shuffle__partitions=parts)
        assert rows(reports()[name](spark, SF)) == base
