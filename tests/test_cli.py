import json

import pytest

import permway
from permway.__main__ import main
from permway.plans import report

ITEMS = [
    {"head": "Delays", "text": "Due to a signalling issue.", "start": "s1", "locationCodes": ["A"], "eventStops": [{"sStop": "X", "eStop": "Y"}]},
    {"head": "Delays", "text": "Due to a kite.", "start": "s2"}, {"head": "Platform change", "text": "Leaves from platform 2.", "start": "s3"},
]


@pytest.fixture
def log(tmp_path):
    (tmp_path / "raw").mkdir()
    lines = [json.dumps({"http_status": 200, "network_error": None, "fetched_at_utc": f"2026-09-1{d}T09:00:00Z", "body": json.dumps(ITEMS)}) for d in (0, 1)]
    (tmp_path / "raw" / "messages-1.jsonl").write_text("\n".join(lines) + "\n")
    return tmp_path


def test_report_and_unread(spark, log, capsys):
    assert main(["report", "--data-dir", str(log)]) == 0
    out = capsys.readouterr().out
    assert "     2 Delays | Signalling fault (proximate)" in out and "nothing stated" in out
    assert out.index("Signalling fault") < out.index("Platform change")
    assert main(["unread", "--data-dir", str(log)]) == 0
    out = capsys.readouterr().out
    assert "     1 a kite" in out and "silent Platform change | Leaves from platform 2." in out


def test_golden(spark, log, capsys):
    at = ["golden", "--data-dir", str(log), "--golden", str(log / "g.json")]
    assert main(at) == 0 and "gained 3" in capsys.readouterr().out
    document = json.loads((log / "g.json").read_text())
    assert [r["head"] for r in document["readings"]] == ["Delays", "Delays", "Platform change"]
    assert main(at) == 0
    out = capsys.readouterr().out
    assert "gained 0" in out and "moved" not in out


def test_site_and_its_budget(spark, log, capsys, monkeypatch):
    at = ["site", "--data-dir", str(log), "--out", str(log / "out")]
    assert main(at) == 0 and "first page" in capsys.readouterr().out
    assert "3 disruptions listed across 1 route" in (log / "out" / "index.html").read_text()
    monkeypatch.setattr(report, "BUDGET_BYTES", 100)
    assert main(at) == 1 and "over it by" in capsys.readouterr().out


def test_nothing_to_read(spark, tmp_path, capsys):
    assert main(["report", "--data-dir", str(tmp_path)]) == 1 and "no log" in capsys.readouterr().err
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "messages-1.jsonl").write_text("{}\n")
    assert main(["report", "--data-dir", str(tmp_path)]) == 1 and "no notices" in capsys.readouterr().err
    assert main(["site", "--data-dir", str(tmp_path)]) == 1 and "no successful runs" in capsys.readouterr().err


def test_public_reading(spark):
    read = permway.with_reading(spark.createDataFrame([("Delays", "Due to a signalling issue and congestion."), ("x", "y")], "head string, text string"))
    row = permway.stated(read).select(permway.of_family(read["causes"], "consequence")["category"].alias("c")).collect()
    assert [r.c for r in row] == [["congestion"]]
