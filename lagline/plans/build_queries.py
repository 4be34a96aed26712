"""Whole builds over the test tables, read again and compared with what was written."""

from __future__ import annotations

import uuid

from lagline.operators import clean, profile
from lagline.plans.adapter import raw_departures, view
from lagline.plans.forecast_queries import SCORED, _lookup_cte
from lagline.plans.history_queries import CUTOFF, PREPARED_CTE, prepared
from lagline.plans.lookup_build import build_lookup
from lagline.plans.registry import ORACLES, query
from lagline.session import ensure_checkpoint_dir
from lagline.sinks.builds import Build, verify_build

AS_WRITTEN = "SELECT name, rows, rows AS rows_found, true AS as_written FROM sizes"


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/build-{uuid.uuid4().hex}"


@query(f"""WITH v AS ({ORACLES["clean_visits"]}), sizes AS (
  SELECT 'visits' AS name, count(*) AS rows FROM v UNION ALL SELECT 'coverage', count(DISTINCT day) FROM v) {AS_WRITTEN}""")
def stored_history(spark, sf_dir):
    """Clean visits by day and their coverage as a committed build."""
    build = Build(spark, _folder(spark))
    visits = build.write("visits", clean.clean_visits(view(spark, sf_dir, raw_departures), CUTOFF), partition_by=["day"])
    build.write("coverage", profile.daily_coverage(visits).where("rows > 0"), "json")
    build.commit()
    return verify_build(spark, build.folder)


@query(f"""{PREPARED_CTE}{_lookup_cte(20)}{SCORED}, sizes AS (
  SELECT 'prepared' AS name, count(*) AS rows FROM prepared
  UNION ALL SELECT 'review', count(*) FROM prepared WHERE NOT baseline_eligible OR flag_invalid_location
  UNION ALL SELECT 'lookup', count(*) FROM model UNION ALL SELECT 'predictions', count(*) FROM predicted
  UNION ALL SELECT 'scores', count(DISTINCT (split, population, method)) FROM errors) {AS_WRITTEN}""")
def stored_lookup(spark, sf_dir):
    """The lookup job from prepared departures to scores as a committed build."""
    folder = _folder(spark)
    build_lookup(prepared(spark, sf_dir), folder)
    return verify_build(spark, folder)
