"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dealgrid.operators import forecast, fx
from dealgrid.plans.registry import Tables
from dealgrid.plans.views import AS_OF

# Order of the stages and stored value of each forecast label.
STAGES = ("Qualify", "Discovery", "Validate", "Proposal", "Negotiate", "Closed Won", "Closed Lost")
CATEGORY_VALUES = {"Commit": "Commit", "Best Case": "BestCase", "Open Pipeline": "Pipeline", "Closed": "Closed"}

QUARTER = ("2001-07-01", "2001-09-30")


def converted(t: Tables) -> DataFrame:
    opps = forecast.label_to_value(t.opps_tracked, "forecast_label", CATEGORY_VALUES)
    return fx.fx_convert(opps, t.fx_rates, AS_OF)


def converted_goals(t: Tables) -> DataFrame:
    from pyspark.sql import functions as F

    out = fx.fx_convert(t.goals, t.fx_rates, AS_OF, amount="target", closed=F.lit(False), close_day="period_start")
    return out.withColumnRenamed("converted_amount", "converted_target")
