"""Small series that the tests share."""

import datetime as dt

BAR = "symbol string, date date, open double, high double, low double, close double, volume bigint, adj_close double"


def days(n, start=dt.date(2022, 1, 3), step=1):
    return [start + dt.timedelta(days=i * step) for i in range(n)]


def bars(spark, closes, symbol="A", start=dt.date(2022, 1, 3), step=1, volume=None, high=1.001, low=0.999):
    volume = volume or [1_000_000] * len(closes)
    rows = [(symbol, d, float(c), float(c) * high, float(c) * low, float(c), int(v), None) for d, c, v in zip(days(len(closes), start, step), closes, volume, strict=True)]
    return spark.createDataFrame(rows, BAR)


TEXTBOOK = [100, 105, 110, 115, 120, 125, 130, 122, 113, 104, 111, 118, 124, 118, 114, 111.6, 115, 118, 120, 118, 116, 114, 114.5, 115.5]


def textbook(spark, symbol="A"):
    volume = [1_000_000] * 24
    volume[6:10] = [2_000_000] * 4
    volume[18:22] = [500_000] * 4
    return bars(spark, TEXTBOOK, symbol, dt.date(2024, 1, 7), 7, volume, 1.0, 1.0)
