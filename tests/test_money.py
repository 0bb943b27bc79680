from decimal import Decimal

from talentgrid import fixed_values as fv
from talentgrid.functions.money import annual_usd_salaries

#: Beyond fourteen digits: neither bound may stand in for the other.
_KWD = 2080 * Decimal(fv.USD_PER_UNIT["KWD"])
NARROW, WIDE = (str(round(n * _KWD, 2)) for n in (50, 2_000_000_000))
MIDDLE = str(round((50 + 2_000_000_000) * _KWD / 2, 2))


def test_annual_salaries(spark):
    cases = [
        (10, 20, "EUR", "Hourly", "22880.00", "45760.00", "34320.00"),
        (100, None, "USD", "per day", "26000.00", None, "26000.00"),
        (None, 1000, None, "/week", None, "52000.00", "52000.00"),
        (1000, 2000, "XXX", "month", "12000.00", "24000.00", "18000.00"),
        (50000, 60001, "GBP", None, "63500.00", "76201.27", "69850.64"),
        (0, 0, "USD", "year", "0.00", "0.00", "0.00"),
        (2_000_000, None, "USD", "hour", "4160000000.00", None, "4160000000.00"),
        (2_000_000_000, None, "KWD", "hour", WIDE, None, WIDE),
        (50, 2_000_000_000, "KWD", "hour", NARROW, WIDE, MIDDLE),
        (None, None, "USD", "hour", None, None, None),
    ]
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(cases)],
        "i int, salary_min int, salary_max int, salary_currency string, salary_period string",
    )
    for row in annual_usd_salaries(df).collect():
        want = [None if x is None else Decimal(x) for x in cases[row["i"]][4:]]
        got = [row["salary_min_annual_usd"], row["salary_max_annual_usd"], row["salary_annual_usd"]]
        assert got == want, row


def test_rates_do_not_shuffle_postings(spark):
    df = spark.range(10).selectExpr("1 AS salary_min", "2 AS salary_max",
                                    "CAST(id AS STRING) AS salary_currency", "'year' AS salary_period")
    plan = annual_usd_salaries(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
