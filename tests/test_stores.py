"""Commits that change several tables together, packages that fail as a whole."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyloom.sources import commits, stores


def rows(spark, *stock, offer="o", **more):
    base = {"round_id": 1, "shop": "s", "offer": offer, "sku_name": "red", "list_title": None, "detail_title": "cup", "image": None, "price": 1.5, "seen_at": "2026-09-16T20:00:00", "attempt": 1} | more
    schema = "round_id long, shop string, offer string, sku_name string, list_title string, detail_title string, image string, price double, seen_at string, attempt long, sku string, stock long"
    return spark.createDataFrame([(*(base[c.split()[0]] for c in schema.split(", ")[:10]), f"k{i}", n) for i, n in enumerate(stock)], schema)


def test_all_or_nothing(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path))
    assert store.commit("a", commits.observed(rows(spark, 5, 7))) == 1
    # a crash after some tables were written: no entry
    for table, lost in list(commits.observed(rows(spark, 1)).items())[:3]:
        lost.write.parquet(f"{tmp_path}/rows/{uuid.uuid4().hex}/{table}")
    (tmp_path / "_log" / ".half").write_text("{")
    assert sorted(r["stock"] for r in commits.snapshots(store).collect()) == [5, 7] and commits.products(store).count() == 1
    for bad in (rows(spark, 1, None), rows(spark, 1, shop=" "), rows(spark, 1).union(rows(spark, 2))):
        with pytest.raises(ValueError):
            commits.observed(bad)
    assert store.commit("a", commits.observed(rows(spark, 9))) is None  # the same batch again
    assert store.commit("b", commits.observed(rows(spark, 9))) == 2
    assert sorted(r["stock"] for r in commits.snapshots(store).collect()) == [7, 9]
    assert sorted(r["stock"] for r in commits.snapshots(store, up_to=1).collect()) == [5, 7]


def test_failures_and_kinds(spark, tmp_path):
    store = commits.Store(spark, str(tmp_path))
    tries = spark.createDataFrame([(1, "s", "o", "2026-09-16T19:00:00", 1), (1, "s", "p", "2026-09-16T19:00:00", 1)], "round_id long, shop string, offer string, seen_at string, attempt long")
    store.commit("f", commits.failed(tries))
    assert commits.snapshots(store).count() == 2
    store.commit("a", commits.observed(rows(spark, 5, 7)))
    assert sorted((r["offer"], r["status"]) for r in commits.snapshots(store).collect()) == [("o", "success")] * 2 + [("p", "failed")]
    store.commit("b", commits.observed(rows(spark, 12, detail_title=" ", seen_at="2026-09-16T21:00:00").withColumn("sku", F.lit("default"))))
    assert [(r["sku"], r["stock"]) for r in commits.inventory(store).collect()] == [("default", 12)]
    assert [(r["offer"], r["name"], r["first_seen"][11:13]) for r in commits.products(store).collect()] == [("o", "cup", "20")]
    store.commit("g", commits.failed(tries.where("offer = 'o'")))
    assert sorted((r["offer"], r["status"]) for r in commits.snapshots(store).collect()) == [("o", "failed"), ("o", "success"), ("p", "failed")]
    named = commits.observed(rows(spark, 1).withColumn("sku", F.lit(" ")))["skus"].first()
    assert len(named["sku"]) == 16 and named["name"] == "red"


def test_two_writers_lose_nothing(spark, tmp_path):
    schema = StructType.fromDDL("x long")
    store = commits.Store(spark, str(tmp_path))

    def counted(number):  # worked out from the store, so worked out anew when another was faster
        return {"t": spark.createDataFrame([(store.read("t", schema, number).count(),)], schema)}

    def write(name):
        for i in range(4):
            commits.Store(spark, str(tmp_path)).commit(f"{name}{i}", counted)

    threads = [threading.Thread(target=write, args=(n,)) for n in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [e["number"] for e in store.entries()] == list(range(1, 13))
    assert sorted(r["x"] for r in store.read("t", schema).collect()) == list(range(12))
    assert not store._put(f"_log/{3:020d}.json", "{}")
    store.commit("new", {"t": spark.createDataFrame([(99,)], schema)}, replaced=("t",))
    assert [r["x"] for r in store.read("t").collect()] == [99] and store.read("t", schema, 12).count() == 12
    assert store.read("none", schema).count() == 0


@pytest.mark.parametrize("where", ["footer", "page", "start", "gone", "none"])
def test_damaged_packages_fail_as_a_whole(spark, tmp_path, where):
    for name in ("a", "b"):
        spark.range(1000).selectExpr("id AS x", "repeat(CAST(id AS STRING), 9) AS y").coalesce(1).write.option("parquet.page.write-checksum.enabled", "true").parquet(f"{tmp_path}/{name}")
    file = next(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part"))
    content = bytearray(file.read_bytes())
    at = {"footer": len(content) - 8 - int.from_bytes(content[-8:-4], "little"), "page": 400, "start": 0}.get(where)
    if at is not None:
        content[at : at + 48] = b"\x55" * 48
    file.write_bytes(content if where != "gone" else b"")
    rows, failures = stores.scan(spark, str(tmp_path), StructType.fromDDL("x int, z string, y string"))
    assert (rows.count(), failures.count()) == ((2000, 0) if where == "none" else (1000, 1))
    assert rows.where("z IS NULL AND length(y) >= 9").count() == rows.count()
    assert all(r["path"].endswith(file.name) and r["reason"].startswith("not a package") for r in failures.collect())


def test_packed_and_foreign_packages(spark, tmp_path):
    import gzip

    spark.range(10).selectExpr("id AS x").coalesce(1).write.parquet(f"{tmp_path}/t")
    file = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part"))
    raw = file.read_bytes()
    (tmp_path / "p.parquet.gz").write_bytes(gzip.compress(raw))
    (tmp_path / "cut.parquet.gz").write_bytes(gzip.compress(raw)[:-20])
    spark.range(3).selectExpr("'word' AS x").coalesce(1).write.parquet(f"{tmp_path}/other")
    (tmp_path / "empty").mkdir()
    rows, failures = stores.scan(spark, str(tmp_path), StructType.fromDDL("x long"))
    assert rows.count() == 20 and failures.count() == 2
    assert stores.scan(spark, str(tmp_path / "empty"), StructType.fromDDL("x long"))[0].count() == 0


def test_a_plan_is_checked_once(spark, tmp_path):
    """Not once for each of its shops, with the whole document beside each."""
    shops = spark.range(5000).select(F.struct(F.col("id").alias("shop"), F.lit(1).alias("pages"), F.lit("m1").alias("machine")).alias("s")).agg(F.collect_list("s").alias("shops"))
    shops.select(F.lit("2026-W01").alias("week"), F.array(F.lit("m1")).alias("machines"), "shops").write.json(str(tmp_path / "plans"))
    read = stores.read_plans(spark, str(tmp_path / "plans"))
    assert read.where("problem IS NULL").count() == 5000
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("array_except")


def test_names_of_one_moment_are_picked_the_same_way(spark):
    """Two shops see an offer at once, under two titles: whichever row comes first."""
    a, b = rows(spark, 1, shop="s", detail_title="cup").collect(), rows(spark, 1, shop="t", detail_title="mug").collect()
    schema = rows(spark, 1).schema
    for both in (a + b, b + a):
        assert commits.observed(spark.createDataFrame(both, schema).coalesce(1))["products"].first()["name"] == "mug"
