"""Shards: sizes, mixture, gapless slots, and independence of partitions."""

from collections import Counter

from burstlens.llm.sharding import shard_by_mixture


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_shards_have_equal_sizes_and_the_mixture(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    for group_rows in (10, 100, 10**6):
        got = shard_by_mixture(docs, 16, group_rows=group_rows)
        found = got.collect()
        assert len(found) == len(rows) and {r.doc_id for r in found} == set(range(3000))
        sizes = Counter(r.shard for r in found)
        assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
        for shard in range(16):
            own = [r for r in found if r.shard == shard]
            assert sorted(r.slot for r in own) == list(range(len(own)))
            for source, n in Counter(s for _, s in rows).items():
                share = sum(r.source == source for r in own)
                # A stretch has a source's rows up to one at either end.
                assert abs(share - n / 16) <= 2
        if group_rows == 10:
            first = rows_of(got)
        assert rows_of(got) == first
    again = shard_by_mixture(docs.repartition(7), 16, group_rows=10)
    assert rows_of(again) == first
    assert rows_of(shard_by_mixture(docs, 16, seed=21)) != first


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (None, None), (2, "a"), (2, "a"), (3, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, source string").selectExpr(
        "*", "'x' as shard", "1 as slot", "source as Other"
    )
    got = shard_by_mixture(docs, 3)
    assert got.columns == ["doc_id", "source", "Other", "shard", "slot"]
    found = got.collect()
    assert Counter((r.doc_id, r.source) for r in found) == Counter(rows)
    assert sorted(Counter(r.shard for r in found).values()) == [2, 2, 3]
    assert shard_by_mixture(docs.limit(0), 3).count() == 0
    few = shard_by_mixture(docs.limit(2), 16).collect()
    assert len({(r.shard, r.slot) for r in few}) == 2


def test_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, source string").filter("doc_id > 0")
    plan = shard_by_mixture(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
