import re

from sparkloom.operators import approximate


def test_distinct_counts_keep_a_sketch_for_each_group_only(spark):
    rows = [("a", 1), ("a", 1), ("a", None), ("b", None), (None, 3), (None, 4), (None, None)] + [("c", i % 300) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v long")
    found = approximate.checked_distinct(df, "v", "g")
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([("a", 1, True), ("b", 0, True), (None, 2, True), ("c", 300, True)], key=repr)
    assert list(map(tuple, approximate.checked_distinct(df, "v").collect())) == [(300, True)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    sketched = re.findall(r"keys=\[([^\]]*)\], functions=\[[^\n]*approx_count_distinct", plan)
    assert sketched and all("," not in keys for keys in sketched)
