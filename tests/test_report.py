import datetime as dt
import re

import pytest

from permway.operators import fold
from permway.plans import report

SEEN = "seq bigint, head string, text string, start string, origin string, destination string, seen_at timestamp, legs int"
NOW = dt.datetime(2026, 9, 20, 12, 0, tzinfo=dt.UTC)


def seen(n, head, text, day=10, hour=9, month=9, start=None, route=("A", "B")):
    return n, head, text, start or f"s{n}", *route, dt.datetime(2026, month, day, hour, 0), 1


def build(spark, tmp_path, rows, horizon=dt.datetime(2026, 9, 20, 6, 0), start="2026-08-30 00:00:00"):
    polls = spark.createDataFrame([(horizon, 5)], "horizon timestamp, runs bigint")
    corpus = report.Corpus(fold.disruptions(spark.createDataFrame(rows, SEEN)), polls, start, NOW)
    size, text = report.write_site(corpus, str(tmp_path))
    read = lambda name: (tmp_path / name).read_text()
    return read("index.html"), read("m/2026-08.html"), text


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    rows = [seen(n, "Delays", f"Late by {n} minutes.", hour=n % 24) for n in range(1, 23)]
    rows += [
        seen(30, "Late", "Due to a mechanical issue. Late by 1 minute.", 11), seen(31, "Late", "Due to an operational issue.", 11, 10, start="s30"),
        seen(40, "Line <closed>", "Due to congestion following a signalling issue. We apologise for any inconvenience caused.", 12, route=("C & D", None)),
        seen(41, "Line closed", "Reopened.", 12, 10, start="s40", route=("C & D", None)), seen(42, "Line closed", "Closed again.", 12, 11, start="s40", route=("C & D", None)),
        seen(50, "reduced capacity", "", 13), seen(51, "reduced capacity", "", 14),
    ]
    return build(spark, tmp_path_factory.mktemp("site"), rows)


def case(page, route):
    return next(a for a in re.findall("<article>.*?</article>", page) if f"<h4>{route}</h4>" in a)


def test_head_of_the_page(pages):
    page, archive, _ = pages
    assert "<b>September 2026 so far:</b> 24 disruptions listed across 2 routes" in page
    assert "<b>August 2026:</b> 0 disruptions listed<" in archive and report.NO_CASE in archive and report.NO_ORIGIN in archive
    assert "2 trains had reduced capacity, but they are not counted as a disruption." in page and "reduced capacity" not in archive
    assert 'href="index.html" aria-current=page>September 2026' in page and 'href="m/2026-08.html">August' in page
    assert 'href="../index.html">September' in archive and 'href="2026-08.html" aria-current=page' in archive
    for p in (page, archive):
        assert "<!--" not in p and "%" not in p.split("<main>")[1].split("<script>")[0]


def test_figures(pages):
    page, archive, _ = pages
    tiles = re.findall(r"<dt>(.*?)</dt><dd>(\d+)</dd>", page)
    assert tiles == [("disruptions listed", "24"), ("named a cause", "2"), ("blamed congestion or an earlier service", "1"), ("named no cause", "22")]
    ranks = re.findall(r"<li><span>(.*?)</span><meter min=\"0\" max=\"100\" value=\"(\d+)\"></meter><b>(\d+)</b>", page)
    assert ranks == [("Technical or mechanical fault", "100", "1"), ("Signalling fault", "100", "1")]


def test_days(pages):
    page, archive, _ = pages
    cells = {c.split(":")[0]: (b, c) for b, c in re.findall(r'<li class="(b\d)" data-cap="(.*?)">', page)}
    assert len(cells) == 30 and cells["10 Sep"] == ("b3", "10 Sep: 22 disruptions") and cells["11 Sep"] == ("b1", "11 Sep: 1 disruption")
    assert cells["15 Sep"] == ("b0", "15 Sep: nothing listed") and cells["25 Sep"] == ("b9", "25 Sep: still to come")
    assert "1 Aug: the collector missed this day" in archive and "still to come" not in report.legend()


def test_cases(pages):
    page, _, _ = pages
    assert "first listed" in case(page, "A to B")
    mixed = next(a for a in re.findall("<article>.*?</article>", page) if "Technical" in a)
    assert "No cause given" not in mixed and "re-worded once, at 11 Sep, 11:00" in mixed and "at least 1 minute late" in mixed
    closed = case(page, "C &amp; D")
    assert '<span class="chip consequence">Congestion</span><span class="chip origin">then Signalling fault</span>' in closed
    assert "re-worded 2 times, last at 12 Sep, 12:00" in closed and "late" not in closed.split("facts")[1].split("</p>")[0] and "apologise" not in page
    assert '<span class="chip none">No cause given</span>' in page


def test_pages_of_ten(pages):
    page, archive, _ = pages
    sections = re.findall(r'<section class="page" data-page="(\d)"( hidden="until-found")?>(.*?)</section>', page)
    assert [(n, bool(h), s.count("<article>")) for n, h, s in sections] == [("1", False, 10), ("2", True, 10), ("3", True, 4)]
    assert "Page 1 of 3" in page and "pager" not in archive.split("<script>")[0]
    assert sections[0][2].index("C &amp; D") < sections[0][2].index("Technical")


def test_ten_cases_have_no_pager_and_one_of_each_is_singular(spark, tmp_path):
    rows = [seen(1, "x", "Late by 5 minutes."), seen(2, "reduced capacity", "")]
    page, _, text = build(spark, tmp_path, rows, horizon=dt.datetime(2026, 9, 20, 1, 0))
    assert "1 disruption listed across 1 route<" in page and "1 train had reduced capacity, but it is not counted" in page
    assert '<nav class="pager">' not in page and '<span class="stale">2026-09-20 01:00 UTC</span>' in page and "first page" in text


def test_fresh_data_is_not_stale(pages):
    assert '<span class="stale">' not in pages[0] and 'data-observed="2026-09-20T06:00:00Z"' in pages[0] and 'data-stale-hours="24"' in pages[0]


def test_no_polls_no_site(spark, tmp_path):
    polls = spark.createDataFrame([(None, 0)], "horizon timestamp, runs bigint")
    with pytest.raises(ValueError, match="no successful runs"):
        report.write_site(report.Corpus(fold.disruptions(spark.createDataFrame([], SEEN)), polls, "2026-08-30 00:00:00", NOW), str(tmp_path))
