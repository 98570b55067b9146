import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barlens.config import load_settings
from barlens.functions.text import number
from barlens.plans.http import respond
from barlens.sources import candles, filings, listings

PAGE = """<main><nav><table><tbody><tr><td>Sales</td><td>1</td></tr></tbody></table></nav><div class=box><div id='quarters' data-n="3">
<header><h3>Results, consolidated</h3></header><div class="scroll"><div><table class=grid><thead><tr><th>In crores<th>Mar 2021<th> Dec 2021</th><th>later</th></tr></thead>
<tbody><tr class=a><td>EPS in Rs<td>7.5</td><td>2.25</td></tr><tr><td>OPM %</td><td>12%</td><td><table><tbody><tr><td>Net Profit</td><td>1</td></tr></tbody></table></td>
<!-- <tr><td>Sales</td><td>9</td><td>9</td></tr> --><tr><th>Net Profit <i>+</i></th><td>-33</td><td>4<b>1</b></td></tr><tr><td>Sales&nbsp;+</td><td>1,250</td><td>640</td></tr></tbody></table></div></div></div>
<table><tbody><tr><td>Sales</td><td>5</td></tr></tbody></table></div></main>"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "symbol string, url string, html string, is_consolidated_url boolean")


def test_quarterly_table(spark):
    got = {r.period_end: r for r in filings.table_filings(pages(spark, ("rel", "u", PAGE, True))).collect()}
    assert sorted(got) == [dt.date(2021, 3, 31), dt.date(2021, 12, 31)]
    march, december = got[dt.date(2021, 3, 31)], got[dt.date(2021, 12, 31)]
    assert (december.symbol, december.revenue, december.pat, december.basic_eps, december.diluted_eps) == ("REL", 640e7, 41e7, 2.25, 2.25)
    assert december.period_start == dt.date(2021, 10, 1) and december.announcement_date == dt.date(2022, 2, 14) and not december.is_audited
    assert march.announcement_date == dt.date(2021, 5, 30) and march.is_audited and march.pat == -33e7 and not march.fields_missing
    assert december.is_consolidated and december.announcement_date_is_estimated


def test_table_window_and_blank_cells(spark):
    p = pages(spark, ("A", "u", PAGE, True))
    assert filings.table_filings(p, start="2021-06-01", end="2022-03-01").count() == 1
    blank = PAGE.replace("640", "-").replace("4<b>1</b>", "").replace("2.25", " - ")
    r = filings.table_filings(pages(spark, ("A", "u", blank, True))).filter("period_end = date'2021-12-31'").first()
    assert r.fields_missing and r.revenue is None


def test_which_page_counts(spark):
    alone = PAGE.replace("Results, consolidated", "Results, standalone")
    rows = [("A", "c", "<html>no table</html>", True), ("A", "s", alone, False), ("B", "c", alone, True), ("B", "s", PAGE, False), ("C", "c", "<p>", True), ("C", "s", None, False)]
    got = {r.symbol: (r.url, r.is_consolidated) for r in filings.best_pages(pages(spark, *rows)).collect()}
    assert got == {"A": ("s", False), "B": ("c", False)}


@pytest.mark.parametrize(
    ("html", "found"),
    [
        ("<div id=quarters><div>a</div><table><tbody><tr><td>x</td><td>1</td></tr></tbody></table></div>", (True, "a x 1", [], [["x", "1"]])),
        ("<div id=quarters><table><tbody><tr><td>x<td>1<tr><td>y<td>2", (True, "x 1 y 2", [], [["x", "1"], ["y", "2"]])),
        ("<section id=quarters><p>a<p>b</span></div><table><tbody><tr><td>x</div>y</section><table><tbody><tr><td>z", (True, "a b x y", [], [["x y"]])),
        ("<div id=quarters><script>'<table>'</script><style>p</style>t &amp; u</div><table>", (False, "t & u", [], [])),
        ("<!-- <div id=quarters><table></table></div> --><div id=quarters><br/>none</div>", (False, "none", [], [])),
        ("<div id=quarters><table><thead><tr><th>h</thead><tr><td>no body</table></div>", (True, "h no body", ["h"], [])),
        ("<ul id=quarters><li>one<li>two<table><tbody><tr></tr><tr><td></td></tr></tbody></table></ul>", (True, "one two", [], [[""]])),
        (None, (False, "", [], [])),
    ],
)
def test_tags_are_kept_balanced(html, found):
    from barlens.functions.pages import quarters

    assert quarters(html) == found


def test_a_very_long_page_takes_linear_time():
    import time

    from barlens.functions.pages import quarters

    html = "<div id=quarters><table><tbody>" + "<tr><td>label<td>1" * 60_000
    began = time.perf_counter()
    assert len(quarters(html)[3]) == 60_000 and time.perf_counter() - began < 20


XBRL = """<?xml version="1.0"?><xbrli:xbrl><xbrli:context id="OneD"><xbrli:period><xbrli:startDate>2024-10-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<in-bse-fin:RevenueFromOperations contextRef="OneD" unitRef="INR">1000</in-bse-fin:RevenueFromOperations><in-bse-fin:RevenueFromOperations contextRef="FourD">9</in-bse-fin:RevenueFromOperations>
<in-bse-fin:ProfitLossForPeriod contextRef="OneD">50</in-bse-fin:ProfitLossForPeriod></xbrli:xbrl>"""


def test_index_and_documents(spark, tmp_path):
    row = {"symbol": "rel", "audited": "Un-Audited", "consolidated": "Consolidated", "broadCastDate": "16-Jan-2025 19:30:01", "fromDate": "01-Oct-2024", "toDate": "31-Dec-2024", "xbrl": "d1"}
    rows = [row, row | {"xbrl": "d2", "audited": "Audited", "consolidated": "Non-Consolidated"}, row | {"xbrl": "d3"}, row | {"xbrl": None}, row | {"broadCastDate": ""}]
    (tmp_path / "index.json").write_text(json.dumps(rows))
    index = filings.filing_index(spark, f"file://{tmp_path}/index.json")
    assert index.count() == 3
    quoted = XBRL.replace('"OneD"', "'OneD'").replace(">1000<", ">\n 1000 <").replace("<in-bse-fin:Rev", "<!-- <in-bse-fin:RevenueFromOperations contextRef='OneD'>1</in-bse-fin:RevenueFromOperations> --><in-bse-fin:Rev", 1)
    one = spark.createDataFrame([("d1", quoted)], "xbrl string, xml string")
    r = filings.xbrl_filings(index, one).first()
    assert (r.revenue, r.pat, r.period_start) == (1000.0, 50.0, dt.date(2024, 10, 1))
    assert filings.xbrl_filings(index, one.withColumn("xml", F.lit("<xbrl><a></xbrl>"))).isEmpty()
    docs = spark.createDataFrame([("d1", XBRL), ("d2", "<xbrli:xbrl></xbrli:xbrl>"), ("d3", "not a document")], "xbrl string, xml string")
    got = {r.source_url: r for r in filings.xbrl_filings(index, docs).collect()}
    assert sorted(got) == ["d1", "d2"]
    a, b = got["d1"], got["d2"]
    assert (a.symbol, a.revenue, a.pat, a.basic_eps, a.fields_missing, a.is_consolidated, a.is_audited) == ("REL", 1000.0, 50.0, None, False, True, False)
    assert a.announcement_date == dt.date(2025, 1, 16) and a.period_start == dt.date(2024, 10, 1)
    assert (b.period_end, b.fields_missing, b.is_consolidated, b.is_audited) == (dt.date(2024, 12, 31), True, False, True)
    assert filings.index_request("abc", dt.date(2024, 1, 2), dt.date(2024, 3, 4))["from_date"] == "02-01-2024"


@pytest.mark.parametrize("text, value", [("1,234.5", 1234.5), ("18%", 18.0), ("-", None), ("", None), ("n/a", None), (None, None), (" -7 ", -7.0)])
def test_numbers(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(number(F.col("t"))).first()[0] == value


def test_listings(spark, tmp_path):
    def path(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    p = path("c.csv", "Company Name,Symbol\nx, abc \ny,DEF\n")
    assert {r.symbol for r in listings.constituents(spark, p, 1, 3).collect()} == {"ABC", "DEF"}
    with pytest.raises(ValueError, match="constituents"):
        listings.constituents(spark, p)
    with pytest.raises(ValueError, match="missing"):
        listings.constituents(spark, path("d.csv", "Other\nx\n"), 1, 3)
    p = path("m.csv", "SYMBOL, SERIES, DATE OF LISTING\nAA,EQ,06-OCT-2008\nBB,BE,01-Jan-2020\nCC,SM,bad\n")
    assert {(r.symbol, r.listing_date) for r in listings.equity_master(spark, p).collect()} == {("AA", dt.date(2008, 10, 6)), ("BB", dt.date(2020, 1, 1))}
    for text in ("SYMBOL,SERIES,DATE OF LISTING\nAA,EQ,bad\n", "SYMBOL,SERIES,DATE OF LISTING\nAA,EQ,01-Jan-2020\nAA,BE,01-Jan-2020\n"):
        with pytest.raises(ValueError):
            listings.equity_master(spark, path("bad.csv", text))
    assert {r.symbol for r in listings.custom_symbols(spark, path("s.txt", "abc\n# no\n\ndef # yes\n")).collect()} == {"ABC", "DEF"}
    with pytest.raises(ValueError):
        listings.custom_symbols(spark, path("none.txt", "# none\n"))
    p = path("i.json", json.dumps({"symbol": "A", "exchange": "NSE", "instrument_type": "EQ"}) + "\n" + json.dumps({"symbol": "B", "exchange": "BSE", "instrument_type": "EQ"}))
    assert [r.symbol for r in listings.instruments(spark, p).collect()] == ["A"]


def test_chunks_cover_each_day_once(spark):
    r = spark.createDataFrame([("A", dt.date(2010, 1, 1), dt.date(2022, 5, 5)), ("B", dt.date(2022, 1, 2), dt.date(2022, 1, 1)), ("C", dt.date(2022, 1, 1), dt.date(2022, 1, 1))], "symbol string, from_date date, to_date date")
    got = candles.chunks(r).orderBy("symbol", "from_date").collect()
    a = [x for x in got if x.symbol == "A"]
    assert a[0].from_date == dt.date(2010, 1, 1) and a[-1].to_date == dt.date(2022, 5, 5) and all((x.to_date - x.from_date).days < 1900 for x in a)
    assert all(y.from_date - x.to_date == dt.timedelta(days=1) for x, y in zip(a, a[1:], strict=False))
    assert not [x for x in got if x.symbol == "B"] and len([x for x in got if x.symbol == "C"]) == 1
    with pytest.raises(ValueError):
        candles.checked_span("2024-01-02", "2024-01-01")


def test_retries():
    waits, left = [], [OSError(), OSError()]

    def fetch():
        if left:
            raise left.pop()
        return 7

    assert candles.with_retries(fetch, 3, 0.4, waits.append) == 7 and waits == [0.4, 0.8]
    left += [OSError()] * 3
    with pytest.raises(OSError):
        candles.with_retries(fetch, 3, 0, waits.append)


def test_candles(spark, tmp_path):
    raw = spark.createDataFrame([("A", "2024-01-02T00:00:00+0530", "1", "2", "1", "2", "10")], "symbol string, date string, open string, high string, low string, close string, volume string")
    out = candles.normalised(raw)
    r = out.first()
    assert (r.date, r.close, r.volume, r.adj_close) == (dt.date(2024, 1, 2), 2.0, 10, None)
    candles.archive(out, f"file://{tmp_path}/raw", "run1")
    assert spark.read.json(f"file://{tmp_path}/raw/run_id=run1/by_symbol=A").first().close == 2.0


def test_settings(tmp_path):
    s = load_settings({}, None)
    assert (s.data_provider, s.universe_scope, s.fundamentals.primary_source, s.fundamentals.backlog_lag_days, s.provider_configured) == ("kite", "nifty500", "screener", 180, False)
    (tmp_path / ".env").write_text("KITE__API_KEY='k'\n# DATA_PROVIDER=dhan\nKITE__ACCESS_TOKEN=t\nFUNDAMENTALS__CROSS_CHECK_ENABLED=false\n")
    s = load_settings({"fundamentals__backlog_lag_days": "90", "KITE__REQUEST_DELAY_SECONDS": "1.5"}, tmp_path / ".env")
    assert s.provider_configured and s.fundamentals.backlog_lag_days == 90 and s.kite.request_delay_seconds == 1.5 and not s.fundamentals.cross_check_enabled
    with pytest.raises(ValueError):
        load_settings({"DATA_PROVIDER": "other"}, None)
    assert respond("/health", s) == (200, {"status": "ok"}) and respond("/settings/provider", s)[1] == {"provider": "kite", "configured": True}
    assert respond("/universe", s)[1] == [] == respond("/scores/today", s)[1] and respond("/nothing", s)[0] == 404
