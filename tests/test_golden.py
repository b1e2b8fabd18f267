"""Published offers: the pricing chain reproduces every figure."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright.functions import pricing

# Fixed values, published results: adjusted p35, market value, cash offer, listing price,
# customer's net, gross reserve, net profit, comparables, manual.
OFFERS = """
5244141 5254141 4960000 5341000 5103058 294141 144426 18 0
5855750 6130750 5790000 6313000 6031756 340750 168155 53 0
2265034 2409034 2250000 2438000 2317380 159034 79964 14 0
2583420 2688420 2540000 2768000 2631053 148420 61500 137 0
4266537 4426537 4180000 4475000 4275639 246537 117612 71 0
2802288 2862288 2700000 2861000 2719452 162288 72373 9 0
2471344 2509344 2370000 2535000 2409581 139344 57619 43 0
2184577 2229577 2080000 2258000 2144130 149577 74907 34 0
2025450 2165450 2020000 2189000 2076165 145450 72415 29 0
2094638 2178638 2030000 2178000 2065330 148638 75668 26 0
497350 507350 440000 515000 457275 67350 35225 9 0
505000 550000 485000 559000 500615 65000 31765 24 0
593018 632696 565000 650000 590250 67696 32296 78 0
1241503 1261489 1170000 1272000 1196539 91489 40709 313 0
2623405 2650360 2500000 2674000 2541704 150360 65250 142 0
1265254 1298051 1210000 1304000 1226640 88051 36391 62 0
12372676 12059476 11090000 12058000 11580202 969476 657706 5 0
235957 243111 175000 249000 195265 68111 42626 14 1
215924 220344 155000 225000 171625 65344 40419 8 1
199582 203564 135000 208000 154880 68564 44094 8 1
182447 186083 120000 190000 137150 66083 42033 8 1
4495822 4510822 4260000 4569000 4365451 250822 119687 17 0
"""


def test_published_offers(spark):
    names = ["adjusted_p35", "fmv", "cash", "listing", "net", "reserve", "profit", "n", "manual"]
    rows = [tuple(map(int, line.split())) for line in OFFERS.split("\n") if line]
    c = F.col
    df = spark.createDataFrame(rows, names)
    required = pricing.reserve(c("fmv"), c("n"))
    before = c("fmv") - required
    cash = pricing.cash_rounded(F.when(c("fmv") - c("adjusted_p35") < required, before).otherwise(F.least(before, c("adjusted_p35"))))
    expected = F.greatest(c("cash") + 30_000, c("listing") - F.floor(c("listing") * 0.015 + 0.5))
    manual = ((c("fmv") < 400_000) & (c("cash") / c("fmv") < 0.85)).cast("int")
    out = df.select(
        cash.alias("cash"), (expected - pricing.commission(expected)).alias("net"), (c("fmv") - c("cash")).alias("reserve"),
        pricing.net_profit(c("fmv"), c("cash"), c("listing")).alias("profit"), manual.alias("manual"),
    )
    assert [tuple(map(int, r)) for r in out.collect()] == [(r[2], r[4], r[5], r[6], r[8]) for r in rows]
