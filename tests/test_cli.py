import json

import pytest

from gridloom import cli
from gridloom.plans import catalog
from gridloom.session import clean

FOLDER = "/root/testdata/sf0.001"


def test_scenario(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "RUNS", 1)
    cache = tmp_path / "timings.json"
    got = cli.scenario(spark, FOLDER, 1, str(cache), False)
    assert got["functional"] <= 1 and got["insert_score"] == pytest.approx(1) and got["timed_out"] == 0
    assert got["final"] == pytest.approx(got["functional"] * got["multiplier"]) and got["ratio"] > 0
    held = json.loads(cache.read_text())
    assert held["n_runs"] == 1 and held["baseline_dynamic"] > 0


def test_sweep(spark, capsys):
    got = cli.sweep(spark, FOLDER, (1.0, 0.8, 1.0, 2.5), verbose=True)
    assert got["num_queries"] == 40 and 0 < got["mean_ndcg"] <= got["ceiling"] <= 1
    assert len(capsys.readouterr().err.strip().splitlines()) >= 40


def test_index_is_built_once(spark):
    first = catalog._index(spark, FOLDER)
    assert catalog._index(spark, FOLDER) is first
    clean(spark)
    again = catalog._index(spark, FOLDER)
    assert again is not first and again["postings"].count() > 0
