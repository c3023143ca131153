"""The audit of features, sampler profiles and the convergence policy."""

import datetime as dt

import pytest

from tidewatch.plans import audit, profiles


def test_audit(spark):
    rows = [(d, dt.date(2015, 1, 4) + dt.timedelta(7 * w), float((w * 5 + k) % 13), float(w % 3), 1.0, int((w * 5 + k) % 13 > 8)) for k, d in enumerate("AB") for w in range(60)]
    df = spark.createDataFrame(rows, "district string, date date, good double, weak double, flat double, outbreak_label int")
    out = audit.run(df, df.where("district = 'A'"), ["good", "weak", "flat", "absent"], repeats=1, trees=2)
    got = {r.feature: r for r in out.scores.collect()}
    assert set(got) == {"good", "weak", "flat"} and got["good"].score == max(r.score for r in got.values())
    assert "low uniqueness" in got["flat"].flags and "below the median score" not in got["good"].flags
    g = got["good"]
    assert g.score == pytest.approx(0.35 * g.quality + 0.65 * g.association) and g.association == pytest.approx(1.0)
    assert tuple(out.agreement.first()) == (60, 1.0)
    text = audit.report(out)
    assert text.index("**good**") < text.index("**flat**") and "100.00% of 60" in text
    with pytest.raises(ValueError):
        audit.run(df, df, ["absent"])


def test_profiles():
    base, given = {"chains": 4, "draws": 1000, "other": 1}, {"cv": {"draws": 400}, "final": {"draws": 800, "other": 2}}
    s = profiles.settings(base, given)
    assert s["final"] == {"chains": 4, "draws": 800, "other": 1} and s["cv"]["draws"] == 400 and s["differ"] == ["draws"] and s["missing"] == []
    assert profiles.settings(base, {"final": {"draws": 800}})["cv"]["draws"] == 800
    one = profiles.settings(base, given, "DEV")
    assert one["final"] == one["cv"] == base and one["missing"] == ["dev"]
    assert profiles.profile_mode("auto") is None and profiles.profile_mode("odd") is None


def test_convergence_policy():
    many = {"chains": 2, "draws": 50}
    assert profiles.convergence_mode(many, True) == ("strict", None) and profiles.convergence_mode(many, False) == ("warn", None)
    assert profiles.convergence_mode({"chains": 1, "draws": 80}, True)[0] == "warn"
    assert profiles.convergence_mode({"convergence_failure_mode": "odd"}, False) == ("strict", None)
    assert profiles.enforce(False, "warn") is False and profiles.enforce(True, "strict")
    with pytest.raises(ValueError):
        profiles.enforce(False, "strict")
