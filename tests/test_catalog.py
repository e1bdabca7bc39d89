"""Catalog end to end: DDL, write modes, merge on read, compaction, transactions, time travel."""

import threading

import pandas as pd
import pytest

from lakeloom import catalog as C
from lakeloom.catalog import Catalog, Exists, Field, NotFound, Schema, Update
from lakeloom.functions.transforms import Transform
from lakeloom.plans.log import now_ns
from lakeloom.plans.store import Conflict
from lakeloom.sources import formats

PEOPLE = "id bigint, name string, age int, city string"


@pytest.fixture
def cat(spark, tmp_path):
    return Catalog(spark, str(tmp_path))


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "Ann", 30, "X"), (2, "Bob", 40, "Y"), (3, "Cyd", 50, None)], PEOPLE)


def test_namespaces(cat):
    cat.create_namespace("a", {"x": 1})
    with pytest.raises(Exists):
        cat.create_namespace("a")
    cat.alter_namespace("a", {"y": 2}, "b")
    assert cat.get_namespace("b")["properties"] == {"x": 1, "y": 2} and not cat.namespace_exists("a") and cat.list_namespaces().count() == 1
    cat.create_table("t", "b")
    cat.drop_namespace("b")
    assert not cat.table_exists("t", "b")
    with pytest.raises(NotFound):
        cat.drop_namespace("b")


def test_tables_and_versions(cat, people):
    schema = Schema.infer(people)
    with pytest.raises(NotFound):
        cat.create_table("t", "n", schema=schema, auto_create_namespace=False)
    cat.create_table("t", "n", schema=schema)
    with pytest.raises(Exists):
        cat.create_table("t", "n", schema=schema)
    assert cat.create_table("t", "n", schema=schema, fail_if_exists=False).version == "1"
    cat.create_table("t", "n", version="2", schema=schema)
    assert cat.get_table("t", "n").version == "2"
    cat.alter_table("t", "n", "2", lifecycle="DEPRECATED", description="old")
    assert cat.get_table("t", "n").version == "1"
    cat.drop_table("t", "n", "1")
    with pytest.raises(NotFound):
        cat.get_table("t", "n")
    cat.rename_table("t", "u", "n")
    assert [r["table"] for r in cat.list_tables("n").collect()] == ["u", "u"]
    cat.drop_table("u", "n")
    assert cat.list_tables().count() == 0
    with pytest.raises(ValueError):
        cat.create_table("bad", "n", schema=schema, sort_keys=[("nope", True, True)])
    with pytest.raises(ValueError):
        cat.create_table("bad", "n", schema=schema, properties={"nope": 1})


def test_write_modes(cat, people, rows):
    with pytest.raises(NotFound):
        cat.write(people, "t", mode="append")
    with pytest.raises(ValueError):
        cat.write(people, "t", mode="nope")
    cat.write(people, "t", mode="create")
    with pytest.raises(Exists):
        cat.write(people, "t", mode="create")
    assert cat.write(people, "t", mode="append") == 2 and cat.write(people, "t", mode="add") > 2**48 and 0 < cat.write(people, "t", mode="chrono") < 2**48
    cat.write(people, "t")
    assert cat.read("t").count() == 15
    for mode in ("merge", "delete"):
        with pytest.raises(ValueError):
            cat.write(people, "t", mode=mode)
    cat.write(people.limit(1), "t", mode="replace")
    assert cat.read("t").count() == 1
    cat.truncate_table("t")
    assert cat.read("t").count() == 0
    assert cat.read("t").columns == ["id", "name", "age", "city"]


@pytest.mark.parametrize("compact", [None, False])
def test_merge_partial_and_delete(cat, people, rows, spark, compact):
    cat.write(people.unionByName(people), "t", merge_keys=["id"], compact=compact)
    assert cat.read("t").count() == 3
    cat.write(spark.createDataFrame([(2, None), (4, 9)], "id bigint, age int"), "t", mode="merge", compact=compact)
    cat.write(spark.createDataFrame([(1,)], "id bigint"), "t", mode="delete", compact=compact)
    cat.write(spark.createDataFrame([(None,)], "city string"), "t", mode="delete", delete_columns=["city"], compact=compact)
    assert rows(cat.read("t")) == [(2, "Bob", None, "Y")]
    cat.write(spark.createDataFrame([(1, "back")], "id bigint, name string"), "t", mode="merge", compact=compact)
    assert rows(cat.read("t", columns=["ID", "name"])) == [(1, "back"), (2, "Bob")]
    for mode in ("append", "add", "chrono"):
        with pytest.raises(ValueError):
            cat.write(people, "t", mode=mode)
    if compact is False:
        cat.compact("t")
        assert rows(cat.read("t", columns=["id", "name"])) == [(1, "back"), (2, "Bob")]


def test_untouched_buckets_are_kept(cat, spark):
    df = spark.range(200).selectExpr("id", "id AS v")
    cat.write(df, "t", merge_keys=["id"], properties={"default_compaction_hash_bucket_count": 16})
    cat.write(df.filter("id = 5").selectExpr("id", "-1L AS v"), "t", mode="merge", compact=False)
    done = cat.compact("t")
    assert done["kept_files"] == 15 and done["rewritten_files"] == 1 and cat.read("t").filter("v = -1").count() == 1 and cat.read("t").count() == 200


def test_merge_order_and_event_time(cat, spark, rows):
    s = Schema.of([Field("k", "int", merge_key=True), Field("v", "int", merge_order="desc")])
    cat.write(spark.createDataFrame([(1, 5), (1, 3)], "k int, v int"), "o", schema=s)
    assert rows(cat.read("o")) == [(1, 5)]
    cat.write(spark.createDataFrame([(1, 2), (1, 1)], "k int, v int"), "o", mode="merge")
    assert rows(cat.read("o")) == [(1, 2)]  # rows already there never compete
    s = Schema.of([Field("k", "int", merge_key=True), Field("t", "bigint", event_time=True), Field("v", "string")])
    cat.write(spark.createDataFrame([(1, 9, "late"), (1, 3, "early")], "k int, t bigint, v string"), "e", schema=s)
    assert rows(cat.read("e")) == [(1, 9, "late")]


def test_evolution_through_writes(cat, spark, rows):
    cat.write(spark.createDataFrame([(1, 1)], "k int, v int"), "t")
    cat.write(spark.createDataFrame([(2, 2.5, "n")], "k int, v double, extra string"), "t", mode="append")
    assert rows(cat.read("t")) == [(1, 1.0, None), (2, 2.5, "n")]
    cat.alter_table("t", updates=[Update("rename", "v", "value"), Update("add", "w", Field("w", "int", past_default=7))])
    assert rows(cat.read("t", columns=["k", "value", "w"])) == [(1, 1.0, 7), (2, 2.5, 7)]
    with pytest.raises(ValueError):
        cat.write(spark.createDataFrame([(1,)], "k int"), "t", mode="append", content_type=formats.CSV)


def test_partitions_sort_and_paths(cat, people, rows):
    cat.write(people, "t", schema=Schema.infer(people), partition_by=[("city", Transform("identity"), "city")], sort_keys=[("age", False, False)])
    assert rows(cat.read("t", partition_filter={"city": ["X"]}).select("id")) == [(1,)]
    assert cat.read("t", file_path_column="f").filter("f LIKE '%_p_city=%'").count() == 3
    assert len(cat.read("t", read_as="files")) == 3 and cat.read("t", read_as="pandas").shape == (3, 4) and cat.read("t", read_as="arrow").num_rows == 3 and cat.read("t", read_as="numpy").shape == (3, 4)
    assert cat.manifest("t").agg({"meta_record_count": "sum"}).first()[0] == 3 and cat.statistics("t").first()["files"] == 3
    cat.view("t")
    assert cat.spark.sql("SELECT count(*) FROM t").first()[0] == 3


def test_other_containers_and_schemaless(cat):
    cat.write(pd.DataFrame({"a": [1, 2]}), "p")
    assert cat.read("p").count() == 2
    cat.create_table("files")
    cat.write(pd.DataFrame({"a": [1]}), "files", mode="append", content_type=formats.JSON)
    m = cat.read("files")
    assert m.columns[:3] == ["id", "mandatory", "path"] and formats.from_manifest(cat.spark, m).count() == 1


def test_compaction_trigger_by_deltas(cat, people):
    cat.write(people, "t", properties={"appended_delta_count_compaction_trigger": 3})
    for _ in range(2):
        cat.write(people, "t", mode="append")
    assert {r["delta_type"] for r in cat.manifest("t").collect()} == {"COMPACTED"} and cat.read("t").count() == 9


def test_transactions_are_atomic_and_isolated(cat, people, spark):
    with cat.transaction("two tables"):
        cat.write(people, "a")
        cat.write(people, "b")
        assert cat.read("a").count() == 3  # own changes are seen
        assert not Catalog(spark, cat.root).table_exists("a")  # others see nothing yet
    with pytest.raises(RuntimeError), cat.transaction():
        cat.write(people, "a", mode="append")
        raise RuntimeError
    assert cat.read("a").count() == 3
    h = cat.transactions().collect()
    assert len(h) == 1 and h[0]["commit_message"] == "two tables" and h[0]["table_count"] == 2 and h[0]["delta_count"] == 2
    assert cat.read_transaction(h[0]["transaction_id"])["message"] == "two tables"
    assert cat.transactions(status="FAILED").count() == 1
    with pytest.raises(NotFound):
        cat.read_transaction("none")


def test_time_travel(cat, people):
    cat.write(people, "t")
    before = now_ns()
    cat.write(people, "t", mode="append")
    end = cat.transactions().first()["end_time"]
    assert cat.read("t", as_of=before).count() == 3 and cat.read("t", as_of=end).count() == 3 and cat.read("t", as_of=end + 1).count() == 6
    with cat.transaction(as_of=before):
        assert cat.read("t").count() == 3
        with pytest.raises(PermissionError):
            cat.write(people, "t", mode="append")


def test_conflicts(cat, people, spark):
    cat.write(people, "t")
    other = Catalog(spark, cat.root)
    with pytest.raises(Conflict), cat.transaction():
        cat.write(people, "t", mode="append")
        other.write(people, "t", mode="append")
    assert cat.read("t").count() == 6
    with cat.transaction():  # unordered writers don't meet
        cat.write(people, "t", mode="add")
        other.write(people, "t", mode="add")
    assert cat.read("t").count() == 12


def test_threads(cat, people, spark):
    cat.write(people, "t")
    errors = []

    def add():
        try:
            Catalog(spark, cat.root).write(people, "t", mode="add")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=add) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors and cat.read("t").count() == 15


def test_pause_and_janitor(cat, people):
    with cat.transaction() as t:
        cat.write(people, "t")
        t.pause()
        with pytest.raises(RuntimeError):
            cat.write(people, "u")
        t.resume()
    assert cat.read("t").count() == 3
    from lakeloom.plans.log import Transaction

    dead = Transaction(cat.log)
    folder = f"{cat.root}/data/dead"
    dead.stage(folder)
    cat.log.files.write(f"{folder}/x", "x")
    assert cat.clean(timeout_s=3600)["failed"] == 0
    assert cat.clean(timeout_s=0)["failed"] == 1 and not cat.log.files.exists(folder) and cat.read("t").count() == 3


def test_urls_and_copy(cat, people, spark, tmp_path):
    cat.put("lake://n")
    cat.put("lake://n/t", schema=Schema.infer(people))
    cat.write(people, "t", "n", mode="append")
    assert cat.get("lake://n")["name"] == "n" and cat.get("lake://n/t").table == "t"
    assert [r["kind"] for r in cat.list("lake://n/*").collect()] == ["table"] and {r["kind"] for r in cat.list("lake://n", recursive=True).collect()} == {"table", "version", "stream", "delta"}
    other = Catalog(spark, f"{tmp_path}/copy")
    assert cat.copy("lake://n/**", other, "m") == 1 and other.read("t", "m").count() == 3


def test_registry(spark, tmp_path):
    C.clear_catalogs()
    c = C.init_local(spark, f"{tmp_path}/c")
    assert C.get_catalog() is c
    with pytest.raises(Exists):
        C.put_catalog("default", c, fail_if_exists=True)
    C.save_catalogs(f"{tmp_path}/c.json")
    C.clear_catalogs()
    with pytest.raises(NotFound):
        C.get_catalog()
    C.load_catalogs(spark, f"{tmp_path}/c.json")
    assert C.get_catalog().root == f"{tmp_path}/c" and C.pop_catalog("default") is not None


def test_rebase_and_repartition(cat, spark, rows):
    df = spark.range(50).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id END AS v")
    cat.write(df, "a", merge_keys=["id"], compact=False)
    cat.write(df.filter("id < 5").select("id"), "a", mode="delete", compact=False)
    cat.write(df.limit(1), "b", merge_keys=["id"])
    done = cat.rebase("b", "a")
    assert cat.read("b").count() == 45 and done["output_records"] == 45
    cat.write(df, "c")
    assert len(cat.repartition("c", "v", [10, 30])) == 3 and rows(cat.read("c")) == rows(df)
    with pytest.raises(ValueError):
        cat.repartition("a", "v", [1])
