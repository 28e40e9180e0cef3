"""Each report is one call, and its tables are those of the registered queries."""

import pytest

from wattline import adapters as A
from wattline.plans import panel as P
from wattline.plans import reports as R

SETTINGS = R.Settings(
    hour=12, day=P.DAY, window=P.WEEK, vol_window=P.DAY, split=P.SPLIT, steps=A.STEPS, horizons=(1, 3), limit_horizons=(1, 3), limit_start=P.LIMIT_START, alphas=(0.95,), limit_alphas=(0.95,), fault_magnitudes=(0.1,), fault_span=P.DAY, fault_onsets=4, least_r2=None,
)


def tables(text):
    """Title -> rows of a report's tables, as dicts of text."""
    out = {}
    for part in text.split("\n## ")[1:]:
        title, _, table = part.partition("\n\n")
        lines = [[c.strip() for c in line.strip("|").split("|")] for line in table.strip().splitlines()]
        out[title] = [dict(zip(lines[0], line, strict=True)) for line in lines[2:]]
    return out


@pytest.mark.parametrize("name, titles", [("results", 5), ("fleet", 9), ("clock", 2), ("engines", 2)])
def test_reports(spark, sf, name, titles):
    got = tables(R.REPORTS[name](A.power(spark, sf), SETTINGS))
    assert len(got) == titles and all(got.values())
    if name == "results":
        assert {r["model"] for r in got["Backtests, all units as one"]} == {"empirical", "fhs", "fhs_ar"} and sum(int(r["units"]) for r in got["Posture"]) == 6
        assert [(r["h"], r["alpha"]) for r in got["Limits by lead"]] == [("1", "0.95"), ("3", "0.95")]
    if name == "fleet":
        want = {r.h: r.reserve_inflation for r in P.QUERIES["reserve_inflation"](spark, sf).selectExpr("1 AS h", "reserve_inflation").collect()}
        assert float(got["Reserves"][0]["reserve_inflation"]) == pytest.approx(want[1], rel=1e-4)
        assert len(got["Paired by unit"]) == 8 and len(got["Ramps"]) == 6 and {r["form"] for r in got["Coupling"]} == {"change", "level"}
    if name == "clock":
        want = P.QUERIES["tod_profile_r2"](spark, sf).first()
        assert float(got["Explained by the clock"][0]["r2"]) == pytest.approx(want.r2, rel=1e-3)
    if name == "engines":
        want = {r.h: r.max_mw for r in P.QUERIES["engine_conversion"](spark, sf).collect()}
        assert {int(r["h"]): pytest.approx(float(r["max_mw"]), rel=1e-4) for r in got["Ramps"]} == {h: want[h] for h in (1, 3)}
