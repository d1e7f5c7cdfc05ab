"""Equality without a key, and its grouping, against plain Python."""

from pyspark.sql import functions as F

from tracefold.operators import evidence as E


def test_addresses_of_one_place_are_one_value(spark):
    said = [
        "Level 2, 5 High St, Sydney NSW 2000", "5 High Street Sydney 2000", "6 High St", "Sydney NSW 2000", "6 High Street, Sydney 2000", "Macquarie University Cyber Hub", "macquarie university  cyber hub", "5 High St, Sydney",
    ]
    rows = spark.createDataFrame([(1, "address", v, "high" if i == 4 else "low", i) for i, v in enumerate(said)] + [(2, "address", said[0], "low", 9)] * 3, "company_id long, field string, value string, confidence string, pos int")
    got = E.grouped_values(rows, E.Claims(), "pos", E.place(F.col("value")), E.same_place).collect()
    assert sorted((r.company_id, r.value.address, r.rows, r.best) for r in got) == sorted(
        [(1, said[0], 4, 1), (1, said[2], 2, 3), (1, said[5], 2, 1), (2, said[0], 3, 1)]
    )
