"""The table layer: metadata round trips, transactions, evolution, pruning, deletes, maintenance, catalog, tools."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom import __version__, cli, errors
from lakeloom.operators import audit, dml, maintenance
from lakeloom.operators.stats import BloomFilter
from lakeloom.plans import metadata as M
from lakeloom.plans import predicates, scan
from lakeloom.plans.partition import SpecBuilder
from lakeloom.plans.schema import Field, Schema, SchemaBuilder, SchemaUpdate, check_compatible, is_nested, simple
from lakeloom.plans.transaction import RetryConfig, Transaction
from lakeloom.session import read_table, write_table
from lakeloom.sources.catalog import FileCatalog, InMemoryCatalog, TableIdentifier
from lakeloom.table import create_table, open_table


def make(spark, tmp_path, ddl="id long, name string, score int", rows=(), name="t", **more):
    schema = T.StructType.fromDDL(ddl)
    t = create_table(spark, str(tmp_path / name), Schema.of(schema, more.pop("identifiers", ()), required=more.pop("required", ())), **more)
    if rows:
        t.append(spark.createDataFrame(rows, schema).coalesce(1))
    return t


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def parquet_rows(spark, t):
    return values(t.scan())


# --- schemas -----------------------------------------------------------------------
ADDRESS = {"type": "struct", "fields": [Field(10, "street", simple("string")), Field(11, "city", simple("string"), True)]}


def schema_a2():
    return SchemaBuilder().with_field(1, "id", simple("long"), required=True).with_field(2, "address", ADDRESS).build()


def test_schema_lookup_and_ids():
    s = schema_a2()
    assert s.find(11).name == "city" and s.find("address.street").id == 10 and s.find("nope") is None
    assert s.highest_id() == 11 and len(s) == 2 and is_nested(s.find(2).type)


def test_schema_json_round_trip():
    kinds = [simple(t) for t in ("boolean", "int", "long", "float", "double", "date", "time", "string", "uuid", "binary")]
    kinds += [simple("timestamp", with_timezone=True), simple("timestamp"), simple("fixed", length=4), simple("decimal", precision=10, scale=2), ADDRESS]
    kinds += [{"type": "list", "element-id": 50, "element-required": False, "element": ADDRESS}, {"type": "map", "key-id": 60, "key": simple("string"), "value-id": 61, "value-required": True, "value": simple("int")}]
    s = Schema(tuple(Field(i + 100, f"c{i}", k, i % 2 == 0, "doc" if i else None) for i, k in enumerate(kinds)), 3, (100,))
    assert Schema.from_json(json.loads(json.dumps(s.to_json()))) == s


def test_update_adds_renames_and_keeps_ids():
    s = SchemaBuilder().with_field(1, "id", simple("long"), required=True).with_field(2, "data", simple("string")).build()
    u = SchemaUpdate(s, 2).add_column("new_col", simple("boolean")).rename_column(2, "renamed_data")
    n = u.apply(1)
    assert [(f.id, f.name, f.required) for f in n.fields] == [(1, "id", True), (2, "renamed_data", False), (3, "new_col", False)] and u.last_id == 3
    dropped = SchemaUpdate(n, 3).drop_column("new_col").add_column("new_col", simple("int")).drop_column("unknown").apply(2)
    assert dropped.find("new_col").id == 4
    nested = SchemaUpdate(schema_a2(), 11).add_column("zip", simple("string"), parent="address").rename_column("address.city", "town").apply(1)
    assert nested.find("address.zip").id == 12 and nested.find(11).name == "town"
    check_compatible(schema_a2(), nested)
    with pytest.raises(errors.SchemaMismatch):
        SchemaUpdate(s, 2).rename_column(2, "id").apply(1)


def test_compatibility_rules():
    s = schema_a2()
    change = lambda **k: Schema((Field(1, "id", k.get("id", simple("long")), True), *k.get("more", ())))
    check_compatible(Schema((Field(1, "id", simple("int"), True),)), change())
    for bad in (change(id=simple("int")), change(more=(Field(9, "x", simple("int"), True),))):
        with pytest.raises(errors.IncompatibleSchema):
            check_compatible(s, bad)
    optional = Schema((Field(1, "id", simple("long"), False),))
    with pytest.raises(errors.IncompatibleSchema):
        check_compatible(optional, change())
    with pytest.raises(errors.IncompatibleSchema):
        SchemaUpdate(s, 11).widen_type("id", simple("string")).apply(1)
    assert not SchemaUpdate(s, 11).make_optional("id").apply(1).find("id").required


def test_all_types_round_trip(spark, tmp_path):
    ddl = "a boolean, b int, c bigint, d float, e double, f date, g timestamp, h timestamp_ntz, i string, j binary, k decimal(12,3), l array<int>, m map<string,int>, n struct<x: int, y: array<string>>"
    row = (True, 1, 2, 0.5, 0.25, dt.date(1969, 12, 31), dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 12), "é", bytearray(b"\x00\xff"), Decimal("-1.500"), [1, None], {"k": 5}, (7, ["z"]))
    t = make(spark, tmp_path, ddl, [row, (None,) * 14])
    assert values(open_table(spark, t.location).scan()) == values(spark.createDataFrame([row, (None,) * 14], ddl))


def test_time_uuid_and_fixed_have_a_home(spark, tmp_path):
    s = SchemaBuilder().with_field(1, "t", simple("time")).with_field(2, "u", simple("uuid")).with_field(3, "f", simple("fixed", length=2)).build()
    t = create_table(spark, str(tmp_path / "t"), s)
    t.append(spark.createDataFrame([(5, "x", bytearray(b"ab"))], "t long, u string, f binary"))
    with pytest.raises(Exception, match="fixed length"):
        t.append(spark.createDataFrame([(5, "x", bytearray(b"abc"))], "t long, u string, f binary"))
    assert open_table(spark, t.location).schema.find("t").type == simple("time") and t.scan().count() == 1


# --- writes ------------------------------------------------------------------------
def test_write_validation(spark, tmp_path):
    t = make(spark, tmp_path, required=("id",), rows=[(1, "a", 1)])
    t.append(spark.createDataFrame([(2, 5)], "id long, score int"))  # a missing optional column is null
    assert (2, None, 5) in values(t.scan())
    for rows, ddl in (([("x",)], "id string"), ([(1, 2)], "id long, other int"), ([("a",)], "name string")):
        with pytest.raises(errors.SchemaMismatch):
            t.append(spark.createDataFrame(rows, ddl))
    with pytest.raises(Exception, match="required"):
        t.append(spark.createDataFrame([(None, "a", 1)], "id long, name string, score int"))
    assert t.refresh().scan().count() == 2 and t.snapshot_count() == 2


def test_empty_tables_and_commits(spark, tmp_path):
    t = make(spark, tmp_path)
    assert t.scan().collect() == [] and t.snapshot is None and t.scan().columns == ["id", "name", "score"]
    assert t.append(spark.createDataFrame([], "id long, name string, score int")) is None
    assert t.delete("id = 1") == 0 and t.compact() == maintenance.CompactResult() and t.vacuum()["expired_snapshots"] == 0
    with pytest.raises(errors.NoChanges):
        Transaction(t).commit()
    with pytest.raises(errors.TableAlreadyExists):
        create_table(spark, t.location, t.schema)
    with pytest.raises(errors.TableNotFound):
        open_table(spark, str(tmp_path / "nowhere"))


def test_write_table_modes(spark, tmp_path):
    df, at = spark.range(3), str(tmp_path / "t")
    write_table(df, at, "error", properties={"owner": "me"})
    with pytest.raises(errors.TableAlreadyExists):
        write_table(df, at, "error")
    write_table(df, at)
    assert write_table(df, at, "ignore").scan().count() == 6
    assert write_table(df, at, "overwrite").properties == {"owner": "me"} and read_table(spark, at).count() == 3
    assert read_table(spark, at, snapshot_id=2).count() == 6
    with pytest.raises(ValueError):
        write_table(df, at, "merge")


def test_metadata_round_trip_and_summary(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(1, "a", 1), (2, "b", 2)])
    assert M.TableMetadata.from_json(json.loads(json.dumps(t.metadata.to_json()))) == t.metadata
    s = t.snapshot
    assert (s.operation, s.count("added-records"), s.count("total-records"), s.parent_id) == ("append", 2, 2, None)
    assert t.metrics["total-records"] == 2 and t.metrics["total-bytes"] > 0
    f = t.snapshot.data_files()[0].file
    assert f.null_counts["1"] == 0 and (f.lower["1"] <= 1) and f.upper["2"] >= "a"
    t.truncate()
    assert t.metrics == {"total-records": 0, "total-files": 0, "total-bytes": 0} and t.scan().count() == 0


# --- transactions ------------------------------------------------------------------
def test_backoff():
    assert [RetryConfig().backoff_ms(n) for n in range(4)] == [0, 100, 200, 400] and RetryConfig().backoff_ms(20) == 10_000


def test_conflicts(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(i, "a", i) for i in range(10)])
    late = open_table(spark, t.location)
    rewrite = dml.delete(late, "id = 5")
    t.delete("id = 6", dml.MERGE_ON_READ)
    with pytest.raises(errors.CommitConflict):  # the late rewrite would bring row 6 back
        rewrite.commit()
    late.refresh()
    position = dml.delete(late, "id = 7", dml.MERGE_ON_READ)
    t.compact()
    with pytest.raises(errors.CommitConflict):  # its target file is gone
        position.commit()
    late.refresh()
    t.append(spark.createDataFrame([(20, "z", 1)], "id long, name string, score int"))
    late.append(spark.createDataFrame([(21, "z", 1)], "id long, name string, score int"))
    assert sorted(r.id for r in t.refresh().scan().collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 20, 21]


def test_retries_run_out(spark, tmp_path, monkeypatch):
    t = make(spark, tmp_path)
    monkeypatch.setattr(t.store, "create", lambda *a: False)
    tx = Transaction(t, properties={"a": "b"})
    with pytest.raises(errors.MaxRetriesExceeded):
        tx.commit(RetryConfig(attempts=2, initial_ms=1))


def test_equality_delete_reaches_compacted_rows(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(i, "a", i) for i in range(6)])
    late = open_table(spark, t.location)
    gone = dml.delete(late, "id = 3", dml.MERGE_ON_READ, keys=["id"])
    t.compact(min_files=1)
    gone.commit()
    assert sorted(r.id for r in t.refresh().scan().collect()) == [0, 1, 2, 4, 5]


def test_time_travel_views(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(1, "a", 1)])
    t.add_column("extra", simple("int"))
    t.append(spark.createDataFrame([(2, "b", 2, 3)], "id long, name string, score int, extra int"))
    first, second = t.snapshot_ids()
    assert t.at_snapshot(first).scan().columns == ["id", "name", "score"] and t.scan().columns[-1] == "extra"
    with pytest.raises(errors.ReadOnlyTable):
        t.at_snapshot(first).append(spark.range(1))
    with pytest.raises(errors.SnapshotNotFound):
        t.at_snapshot(99)
    with pytest.raises(errors.SnapshotNotFound):
        t.as_of(0)
    t.rollback_to(first)
    assert t.scan().count() == 1 and [r.operation for r in t.history().collect()] == ["append", "append", "replace"]
    assert t.as_of(t.metadata.last_updated_ms).scan().count() == 1 and t.metrics["total-records"] == 1
    assert t.at_snapshot(second).scan().count() == 2


# --- deletes and merges --------------------------------------------------------------
def test_copy_on_write_equals_merge_on_read_equals_a_model(spark, tmp_path):
    r = random.Random(7)
    ddl = "id long, name string, score int"
    a, b = (make(spark, tmp_path, ddl, name=n, identifiers=("id",)) for n in ("cow", "mor"))
    model: dict[int, tuple] = {}
    for step in range(10):
        kind = r.choice(["append", "delete", "update", "upsert", "compact"])
        if kind == "append":
            rows = [(step * 100 + i, r.choice("xyz"), r.choice([None, 1, 2, 3])) for i in range(8)]
            model |= {x[0]: x for x in rows}
            for t in (a, b):
                t.append(spark.createDataFrame(rows, ddl))
        elif kind == "delete":
            v = r.randrange(4)
            model = {k: x for k, x in model.items() if not (x[2] is not None and x[2] == v)}
            a.delete(f"score = {v}")
            b.delete(f"score = {v}", dml.MERGE_ON_READ)
        elif kind == "update":
            v = r.randrange(4)
            model = {k: (x[0], "u", x[2] + 1) if x[2] is not None and x[2] > v else x for k, x in model.items()}
            a.update(f"score > {v}", {"name": "'u'", "score": "score + 1"})
            b.update(f"score > {v}", {"name": "'u'", "score": "score + 1"}, dml.MERGE_ON_READ)
        elif kind == "upsert":
            keys = r.sample(sorted(model), min(3, len(model))) + [step * 100 + 50]
            rows = [(k, "m", 9) for k in keys]
            model |= {x[0]: x for x in rows}
            a.upsert(spark.createDataFrame(rows, ddl))
            b.upsert(spark.createDataFrame(rows, ddl), strategy=dml.MERGE_ON_READ)
        else:
            a.compact()
            b.compact()
        for t in (a, b):
            assert values(t.scan()) == sorted(model.values(), key=lambda x: tuple((v is None, str(v)) for v in x)), (step, kind)


def test_null_keys_in_equality_deletes(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(1, None, 1), (2, "a", 2), (None, "b", 3)])
    t.delete("id = 2", dml.MERGE_ON_READ, keys=["name"])
    assert t.scan().count() == 2 and t.scan(["score"]).count() == 2  # null keys stay, also when the key is not read
    t.delete("id = 1", dml.MERGE_ON_READ, keys=["name"])
    assert values(t.scan()) == [(None, "b", 3)]
    t.drop_column("name")
    assert values(t.scan()) == [(None, 3)]


def test_deletes_beyond_the_bound_are_not_broadcast(spark, tmp_path, monkeypatch):
    rows = [(i, "ab"[i % 2], i % 5) for i in range(40)]
    t = make(spark, tmp_path, rows=rows)
    t.update("score > 2", {"name": "'u'"}, dml.MERGE_ON_READ)
    t.delete("id < 10 AND name = 'a'", dml.MERGE_ON_READ, keys=["id", "name"])
    want = sorted((i, "u" if k > 2 else n, k) for i, n, k in rows if not (i < 10 and n == "a" and k <= 2))
    for bound, joins in ((1_000, "BroadcastHashJoin"), (1, "SortMergeJoin")):
        monkeypatch.setattr(scan, "BROADCAST_ROWS", bound)
        found = t.scan()
        assert sorted(tuple(r) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {"BroadcastHashJoin", "SortMergeJoin"} & set(plan.replace("(", " ").split()) == {joins}


def test_merge_cardinality_and_order_of_clauses(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(1, "a", 1), (2, "b", 2)], identifiers=("id",))
    twice = spark.createDataFrame([(1, "x", 5), (1, "y", 6)], "id long, name string, score int")
    with pytest.raises(errors.MergeCardinalityError):
        t.run(t.merge(twice).when_matched_update())
    t.run(t.merge(twice).when_matched_update(condition="s.score = 6"))  # only one row acts
    assert (1, "y", 6) in values(t.scan())
    one = spark.createDataFrame([(1, "p", None), (2, "q", 2), (3, "r", 3)], "id long, name string, score int")
    b = t.merge(one).when_matched_delete("s.score = 1").when_matched_update({"name": "concat(t.name, s.name)"}).when_matched_delete()
    assert t.run(b.when_not_matched_insert(condition="s.score IS NULL").when_not_matched_insert({"id": "s.id"}, "s.score > 1")) == 3
    assert values(t.scan()) == [(1, "yp", 6), (2, "bq", 2), (3, None, None)]


# --- partitions and pruning ------------------------------------------------------------
def test_spec_builder():
    s = Schema.of(T.StructType.fromDDL("id long, ts timestamp, category string"))
    spec = SpecBuilder(s).day("ts").identity("category").bucket("id", 16).truncate("category", 2).build()
    assert [(f.field_id, f.name) for f in spec.fields] == [(1000, "ts_day"), (1001, "category"), (1002, "id_bucket_16"), (1003, "category_trunc_2")]
    for column, transform in (("category", "hour"), ("id", "truncate[2]"), ("id", "day"), ("id", "bucket[0]"), ("id", "square")):
        with pytest.raises(errors.ValidationError):
            SpecBuilder(s).add(column, transform)
    with pytest.raises(errors.ValidationError):
        SpecBuilder(s).day("ts").day("ts")


def test_conditions_are_parsed_only_when_plain():
    assert predicates.triples_of("a = 1 AND b >= 'x''y' and c IN (1, 2)") == [("a", "=", 1), ("b", ">=", "x'y"), ("c", "in", [1, 2])]
    assert predicates.triples_of("a BETWEEN 1 AND 2 AND b IS NULL") == [("a", ">=", 1), ("a", "<=", 2), ("b", "is null", None)]
    for odd in ("a = 1 OR b = 2", "NOT a = 1", "a + 1 = 2", "a = b", "a = 1 AND", "lower(a) = 'x'"):
        assert predicates.triples_of(odd) == []


def test_pruned_scans_equal_full_scans(spark, tmp_path):
    r = random.Random(3)
    zero = dt.datetime(1969, 12, 25)
    rows = [(i if i % 11 else None, r.choice(["ab", "abc", "b", "", None]), zero + dt.timedelta(hours=r.randrange(400)), r.choice([1.5, -0.0, float("nan"), None, 9.0])) for i in range(120)]
    ddl = "id long, s string, ts timestamp_ntz, x double"
    for n, by in enumerate([[("ts", "day"), ("s", "truncate[2]")], [("id", "bucket[4]"), ("ts", "month")], [("ts", "hour")], ["s"], [("ts", "year"), ("id", "void")]]):
        t = make(spark, tmp_path, ddl, partition_by=by, name=f"t{n}")
        for k in range(2):
            t.append(spark.createDataFrame(rows[k * 60 : k * 60 + 60], ddl))
        plain = spark.createDataFrame(rows, ddl)
        for c in ("id = 34", "id < 10", "s = 'abc'", "s >= 'ab' AND s < 'b'", "ts < TIMESTAMP_NTZ '1970-01-01'", "ts >= TIMESTAMP_NTZ '1970-01-02 05:00:00' AND ts < TIMESTAMP_NTZ '1970-01-03'", "x > 2", "s = ''", "s < 'a'", "s IS NULL", "id IN (3, 77) AND s IS NOT NULL", "x <= 9"):
            assert str(values(t.scan(condition=c))) == str(values(plain.where(c))), (by, c)
        assert len(t.plan("id < 0")) == 0
    assert any(len(t.plan(c)) < len(t.plan()) for c in ("ts < TIMESTAMP_NTZ '1970-01-01'",))


def test_filters_and_columns_reach_the_parquet_scan(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(i, "a", i) for i in range(20)], identifiers=("id",))
    t.delete("id = 3", dml.MERGE_ON_READ)
    t.delete("id = 4", dml.MERGE_ON_READ, keys=["id"])
    plan = t.scan().where("score > 5").select("score")._jdf.queryExecution().toString()
    assert "GreaterThan(score,5)" in plan and "BroadcastNestedLoopJoin" not in plan and "name" not in plan.split("ReadSchema")[1].split("\n")[0]


# --- maintenance -------------------------------------------------------------------
def test_expiry_keeps_the_current_and_the_newest(spark, tmp_path):
    t = make(spark, tmp_path)
    for k in range(5):
        t.append(spark.createDataFrame([(k, "a", k)], "id long, name string, score int"))
    day = 86_400_000
    now = M.now_ms()
    aged = tuple(M.Snapshot(**(vars(s) | {"timestamp_ms": now - (5 - i) * day})) for i, s in enumerate(t.metadata.snapshots))
    t.metadata = M.TableMetadata(**(vars(t.metadata) | {"snapshots": aged}))
    t.store.create(t.store.version() + 1, t.metadata)
    assert maintenance.expire_snapshots(t, None) == []
    assert maintenance.expire_snapshots(t, day // 2, retain_last=2, now_ms=now) == [1, 2, 3]
    assert t.snapshot_ids() == [4, 5] and t.scan().count() == 5


def test_orphans_are_found_and_the_rest_stays(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(1, "a", 1)])
    t.save_checkpoint("c")
    stray = tmp_path / "t/data/stray.parquet"
    stray.write_bytes(b"x")
    assert t.remove_orphans() == []  # too young
    assert t.remove_orphans(0, dry_run=True) == [str(stray)] and stray.exists()
    assert t.remove_orphans(0) == [str(stray)] and not stray.exists()
    assert open_table(spark, t.location).load_checkpoint("c") == 1 and t.scan().count() == 1


def test_compaction(spark, tmp_path):
    t = make(spark, tmp_path, "id long, part string, v int", partition_by=["part"])
    for k in range(6):
        t.append(spark.createDataFrame([(k * 10 + i, "ab"[i % 2], i) for i in range(10)], "id long, part string, v int"))
    before = values(t.scan())
    assert maintenance.needs_compaction(t) and maintenance.estimate(t)["files"] >= 12
    assert t.compact(condition="part = 'a'").files_after == 1
    t.delete("v = 3", dml.MERGE_ON_READ)
    result = t.compact(strategy="zorder", columns=["id", "v"])
    assert result.files_after == 2 and not t.snapshot.delete_files() and not maintenance.needs_compaction(t)
    assert values(t.scan()) == [r for r in before if r[2] != 3]
    with pytest.raises(ValueError):
        t.compact(strategy="sort")
    with pytest.raises(ValueError):
        t.compact(strategy="hilbert")


def test_changes_with_duplicates_and_maps(spark, tmp_path):
    t = make(spark, tmp_path, "id long, m map<string,int>", [(1, {"a": 1}), (1, {"a": 1}), (2, {"b": 2})])
    t.update("id = 2", {"m": "map('b', 3)"})
    t.delete("id = 1")
    got = sorted((r.change, r.id, str(r.m)) for r in t.changes(1).collect())
    assert got == [("delete", 1, "{'a': 1}"), ("delete", 1, "{'a': 1}"), ("delete", 2, "{'b': 2}"), ("insert", 2, "{'b': 3}")]
    assert sorted(r.change for r in t.changes(1, keys=["id"]).collect()) == ["delete", "delete", "update"]
    assert t.changes(None, 1).count() == 3
    with pytest.raises(FileNotFoundError):
        t.load_checkpoint("none")
    with pytest.raises(ValueError):
        t.save_checkpoint("../x")


def test_bloom_filter():
    b = BloomFilter(1000, 0.01)
    for i in range(1000):
        b.add(b"%d" % i)
    assert all(b"%d" % i in b for i in range(1000)) and sum(b"%d" % i in b for i in range(1000, 6000)) < 150
    assert b.bits == 9586 and b.hashes == 7


# --- catalogs and tools ----------------------------------------------------------------
@pytest.mark.parametrize("kind", [InMemoryCatalog, FileCatalog])
def test_catalog(spark, tmp_path, kind):
    c = kind(spark, str(tmp_path))
    c.create_namespace("db", {"owner": "me"})
    c.create_namespace("db.inner")
    with pytest.raises(errors.NamespaceAlreadyExists):
        c.create_namespace("db")
    assert c.list_namespaces() == [("db",)] and c.list_namespaces("db") == [("db", "inner")]
    assert c.namespace_properties("db") == {"owner": "me"}
    schema = T.StructType.fromDDL("id long")
    t = c.create_table("db.users", schema)
    with pytest.raises(errors.TableAlreadyExists):
        c.create_table("db.users", schema)
    with pytest.raises(errors.NamespaceNotEmpty):
        c.drop_namespace("db")
    t.append(spark.range(2))
    assert c.load_table("db.users").scan().count() == 2 and c.table_exists("db.users")
    c.create_table("db.other", schema)
    with pytest.raises(errors.TableAlreadyExists):
        c.rename_table("db.users", "db.other")
    c.rename_table("db.users", "db.people")
    assert [str(x) for x in c.list_tables("db")] == ["db.other", "db.people"] and c.list_tables("nope") == []
    c.drop_table("db.people", purge=True)
    for bad in ("db.people", "x"):
        with pytest.raises(errors.TableNotFound):
            c.load_table(bad)
    with pytest.raises(errors.NamespaceNotFound):
        c.drop_namespace("nope")
    c.drop_namespace("db.inner")
    assert TableIdentifier.parse("db.schema.users") == TableIdentifier(("db", "schema"), "users")
    assert TableIdentifier.parse("simple_table").namespace == ()


def test_audit_and_command_line(spark, tmp_path, capsys):
    at = str(tmp_path / "t")
    assert cli.main(["create", at, "--schema", "id long not null, ts timestamp", "--partition-by", "ts:day"], spark) == 0
    open_table(spark, at).append(spark.sql("SELECT 1L AS id, TIMESTAMP '2024-01-01' AS ts"))
    assert cli.main(["get", at], spark) == 0 and "1 id long required" in capsys.readouterr().out
    t = open_table(spark, at)
    assert json.loads(audit.to_json(t))["metrics"]["total-records"] == 1
    assert "| 1 | id | long | yes |" in audit.to_markdown(t) and audit.to_pdf(t).startswith(b"%PDF")
    assert cli.main(["audit", at, "--format", "pdf", "--output", str(tmp_path / "a.pdf")], spark) == 0 and (tmp_path / "a.pdf").stat().st_size > 500


def test_exports(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(1, "a", 1), (2, "b", 2)])
    assert t.to_arrow().num_rows == 2 and len(t.to_pandas()) == 2 and t.to_spark().count() == 2
    assert t.to_duckdb().aggregate("sum(score)").fetchall() == [(3,)]
    assert t.create_view("exported") and spark.sql("SELECT max(id) FROM exported").first()[0] == 2
    assert t.files().select(F.sum("record_count")).first()[0] == 2 and t.manifests().count() == 1 and t.snapshots().count() == 1
    assert __version__ and "fields=['id', 'name', 'score']" in repr(t) and len(t.uuid) == 36


def test_a_folder_with_spaces_and_signs(spark, tmp_path):
    t = make(spark, tmp_path, rows=[(1, "a b/c%d=e", 1), (2, None, 2)], name="sp ace%x+y", partition_by=["name"])
    t.delete("id = 1", dml.MERGE_ON_READ)
    assert values(t.scan()) == [(2, None, 2)] and scan.FILE not in t.scan().columns
