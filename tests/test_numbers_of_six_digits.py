"""Numbers that need more than five digits."""

from tallyforge.operators import worklists


def test_longer_numbers_are_whole(spark):
    new = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "tenant int, id long")
    known = spark.createDataFrame([(1, "99999"), (2, "123456"), (2, "00003")], "tenant int, number string")
    got = {r["id"]: r["number"] for r in worklists.next_numbers(new, known, ["tenant"], "id", "P").collect()}
    assert got == {5: "P100000", 6: "P100001", 7: "P123457"}
