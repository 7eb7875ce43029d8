"""The profile's tables from counted labels equal those from all rows, in one read."""

from frameloom.operators import profiling

COLUMNS = ["aut", "focal"]


def test_counted_labels_give_the_same_tables(spark):
    rows = [("No Category", "a;b"), (None, None), ("", " x "), ("Rights", "a;b")] * 50 + [("Rights", "a;b")] * 400
    df = spark.createDataFrame(rows, "aut string, focal string")
    n = "label_rows"
    counted = profiling.counted_labels(df, COLUMNS, n)
    assert counted.count() <= 4
    for table in (profiling.coverage, profiling.label_distribution, profiling.label_combinations):
        assert sorted(table(df, COLUMNS).collect()) == sorted(table(counted, COLUMNS, n=n).collect())
    empty = profiling.counted_labels(df.limit(0), COLUMNS, n)
    assert sorted(profiling.coverage(df.limit(0), COLUMNS).collect()) == sorted(profiling.coverage(empty, COLUMNS, n).collect())
