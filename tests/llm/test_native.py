"""Quality rules, mixing and sharding."""

import zlib

import duckdb
import pytest

from tarn.llm import mixing, quality, sharding


@pytest.fixture(scope="module")
def odd_duck(odd):
    c = duckdb.connect()
    c.register("documents", odd.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}).astype(object).where(lambda d: d.notna(), None).astype({"doc_id": "Int64"}))
    return c


def test_quality_equals_sql(odd, odd_duck, compare):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = quality.clean_lines(odd).select(*columns).toPandas()
    compare(got, odd_duck.execute(quality.OP5_SQL).df()[columns])


def test_quality_verdicts(spark):
    prose = "This is a line of text that ends as it should. It has a second sentence too."
    texts = [prose, prose + "\nHome | About | News | Shop | Links", "Home | About | News | Shop | Links\nBuy!! now!! great!! deals!! here!! today!! only!! hurry!! up!!", "all right reserved words without any end " * 2, prose + "\nClick here to subscribe."]
    rows = quality.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), carry=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [True, True, False, False, True]
    assert rows[1]["cleaned"] == prose and rows[4]["cleaned"] == prose and rows[0]["n_removed_lines"] == 0
    assert rows[1]["doc"]["text"] == texts[1]


def test_quality_plan_has_no_python_and_no_shuffle(odd, empty):
    plan = quality.clean_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.clean_lines(empty).count() == 0


def test_mix_equals_sql(odd, odd_duck, compare):
    got = mixing.mix(odd).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    want = odd_duck.execute(mixing.OP4_SQL).df()
    compare(got.round({"target": 6}), want[got.columns].round({"target": 6}))


def test_mix_comes_near_its_targets(spark):
    rows = [(k, "w " * (1 + k * 7919 % 300), "big" if k % 3 else f"s{k % 7}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    assert (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((by["taken"] - by["target"]).abs() <= 300).all()
    assert (by["target"] <= 2 * by["size"]).all()
    assert by["target"].sum() == pytest.approx(1.5 * got["size"].sum())
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(zip(again["doc_id"], again["taken"], strict=True)) == sorted(zip(got["doc_id"], got["taken"], strict=True))


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix(odd, carry=True)
    assert got.count() == odd.count()
    assert {r["doc"]["lang"] for r in got.select("doc").collect()} == {"en"}
    assert mixing.mix(empty).count() == 0


def test_shards(odd, empty):
    rows = [r.asDict() for r in sharding.byte_shards(odd, 8).collect()]
    assert len(rows) == odd.count()
    told = lambda i, text: (str(i), len(b := (text or "").encode()) + 1, zlib.crc32(b))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(told(r["doc_id"], r["text"]) for r in odd.collect())
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(8):
        own = [r for r in rows if r["shard"] == k]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 8) <= largest
    assert sharding.byte_shards(empty).count() == 0


def test_shards_equal_sql(odd, odd_duck, compare):
    got = sharding.byte_shards(odd, 8).toPandas()
    want = odd_duck.execute(sharding.OP7_SQL).df()[list(got.columns)]
    compare(got, want)


def test_equal_texts_share_a_shard_unless_they_are_many(spark, compare):
    rows = [(k, f"text {k // 3} " + "x" * (k // 3 % 50)) for k in range(3000)] + [(k, "the same again") for k in range(3000, 5000)] + [(None, "the same again")] * 1000
    got = sharding.byte_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max() + 2 * sizes.mean() / 64
    of = got[got["doc_id"] < 3000].assign(group=lambda d: d["doc_id"] // 3).groupby("group")["shard"].nunique()
    assert (of == 1).all()
    assert got[got["doc_id"] >= 3000]["shard"].nunique() > 1


def test_no_partition_holds_a_hot_group(spark, monkeypatch):
    """Equal rows, ids and all, are spread over partitions."""
    dealt = []
    settle = sharding.settled
    monkeypatch.setattr(sharding, "settled", lambda df: dealt.append(settle(df)) or dealt[-1])
    sharding.byte_shards(spark.createDataFrame([(1, "same")] * 4000 + [(k, f"t{k}") for k in range(4000)], "doc_id long, text string").repartition(4), 8)
    counts = [r["count"] for r in dealt[1].groupBy("part").count().collect()]
    assert len(counts) >= 3 and max(counts) < 4000


def test_mix_takes_the_same_of_repeated_ids(spark):
    rows = [(1, f"{k} " + "w " * 9, "a") for k in range(200)] + [(None, f"{k} " + "w " * 9, "a") for k in range(200)] + [(k, "w " * 40, "b") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    take = lambda d: sorted((str(r["doc"]["doc_id"]), r["doc"]["text"], r["copies"]) for r in mixing.mix(d, carry=True).collect())
    assert take(df) == take(df.repartition(5))
