from collections import Counter

from pyspark.sql import functions as F

from defect_spark.operators import ranges


def test_ranks_at_any_size(spark):
    """One group holds most rows; every range has its share of them, and ranks go on over ranges."""
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("g"), F.md5(F.col("id").cast("string")).alias("k"), "id")
    made = ranges.ranks(df, ["g"], ["k"], rows_a_part=300).collect()
    by_group = {}
    for r in made:
        by_group.setdefault(r.g, []).append((r.k, r["rank"]))
    for rows in by_group.values():
        assert [x for _, x in sorted(rows)] == list(range(len(rows)))
    assert len(made) == 5000 and None in by_group
    sizes = Counter(r.part_ for r in ranges.placed(df, ["g", "k"], 300).collect())
    assert len(sizes) > 10 and max(sizes.values()) < 1200
    assert ranges.ranks(df.where("false"), ["g"], ["k"]).count() == 0
    assert sorted(r["rank"] for r in ranges.ranks(df, [], ["k"], rows_a_part=700).collect()) == list(range(5000))
