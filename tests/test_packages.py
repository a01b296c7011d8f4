"""The interactive variant's package: its names, tables and files."""

import csv
import io
import json
import zipfile

import pytest

from urbanloom.plans import packages


def test_names():
    assert packages.safe_slug("Málaga – Costa del Sol!") == "ma-laga-costa-del-sol"  # a mark taken apart divides, as it is no letter
    assert packages.safe_slug("") == packages.safe_slug(None) == packages.safe_slug("!!") == "run" and packages.safe_slug("ﬁne Ⅷ") == "fine-viii"
    assert packages.package_name("town", "New York", "2026-11-07T10:20:30.123Z") == "town-new-york-20261107T102030Z.zip"


def test_package(spark, tmp_path):
    local = spark.createDataFrame([("a,b", 10.0, 12.0), ("c", 0.0, 1.0)], "location_id string, wage_baseline double, wage_counterfactual double")
    cards = [{"label": "Utility", "baseline": 1, "counterfactual": 1.5, "change": 50.0}, {"label": "GDP", "baseline": None, "counterfactual": None, "change": 3.0}]
    run = {
        "settings": {"speed": 5, "features": ["left out"]}, "city": {"name": "X"}, "prepared_grid": {"type": "FeatureCollection", "features": [{}, {}]}, "model_input": {"ids": ["a,b", "c"]},
        "result": {"by_closure": {"closed_city": {"cards": cards, "converged": True, "iterations": 7, "elapsed_seconds": 1.25}, "open_city": {"converged": False}}},
    }
    names = packages.write_run_package(str(tmp_path / "p.zip"), run, {"closed_city": local, "open_city": local}, ["wage"], spark)
    with zipfile.ZipFile(tmp_path / "p.zip") as archive:
        assert archive.namelist() == names and all(i.compress_type == zipfile.ZIP_STORED for i in archive.infolist())
        settings = json.loads(archive.read("scenario/settings.json"))
        assert settings["settings"] == {"speed": 5} and settings["counts"] == {"prepared_cells": 2, "drawn_features": 0, "baseline_lines": 0, "baseline_stations": 0}
        rows = list(csv.reader(io.StringIO(archive.read("results/aggregate_summary.csv").decode())))
        assert rows[0] == ["closure", "measure", "baseline", "counterfactual", "percentage_change", "converged", "iterations", "elapsed_seconds"]
        assert [r[:2] for r in rows[1:]] == [["closed_city", "Utility"], ["closed_city", "GDP"]] and rows[2][2] == ""
        cells = list(csv.reader(io.StringIO(archive.read("results/open_city_cell_results.csv").decode())))
        assert cells[0] == ["location_id", "wage_baseline", "wage_counterfactual", "wage_absolute_change", "wage_percentage_change"]
        assert cells[1][0] == "a,b" and float(cells[1][3]) == 2 and float(cells[1][4]) == pytest.approx(20) and cells[2][4] == ""
    with pytest.raises(ValueError, match="completed run"):
        packages.write_run_package(str(tmp_path / "q.zip"), {"result": {}}, {}, [], spark)
