"""Profit with two tokens, by hand."""

from sequora.plans import reports

LEG = "slot long, pos long, pool long, signer long, side string, amount double, value double, leader long, token string, fee double, account long, limit_amount double, actual_amount double"


def test_profit_scales_the_back_leg_to_the_front(spark):
    leg = lambda pos, signer, side, amount, value: (1, pos, 5, signer, side, amount, value, 7, "A", 0.0, 1, 0.0, 0.0)
    spark.createDataFrame([leg(0, 1, "O", 10.0, 100.0), leg(1, 2, "O", 3.0, 30.0), leg(2, 1, "F", 9.5, 114.0)], LEG).createOrReplaceTempView("legs")
    ctes, select = reports.REPORTS["profit_normalised"]
    assert [r.profit_a for r in spark.sql(f"with {ctes} {select}").collect()] == [20.0]  # 10 * 114 / 9.5 - 100
