"""SQL statements over a catalog, and the HTTP service."""

import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import types as T

from lakeloom import errors, rest
from lakeloom.sources.catalog import InMemoryCatalog
from lakeloom.sql import SqlSession, assignments, split_top


@pytest.fixture
def session(spark, tmp_path):
    c = InMemoryCatalog(spark, str(tmp_path))
    c.create_table("db.t", T.StructType.fromDDL("id long, name string, score int")).append(spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "id long, name string, score int"))
    return SqlSession(c)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_parts():
    assert split_top("a = f(1, 2), b = 'x,y'") == ["a = f(1, 2)", "b = 'x,y'"]
    assert assignments("t.a = b + 1, c = 'd=e'", ("t",)) == {"a": "b + 1", "c": "'d=e'"}


def test_queries_and_time_travel(session):
    s = session
    assert got(s.sql("SELECT t.id FROM db.t WHERE t.score = 2")) == [(2,)]
    s.sql("INSERT INTO db.t SELECT 4L, 'd', 4")
    made = s.catalog.load_table("db.t").metadata.snapshots[0].timestamp_ms
    assert got(s.sql("SELECT count(*) FROM db.t x JOIN db.t VERSION AS OF 1 y ON x.id = y.id")) == [(3,)]
    at = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(made / 1000)) + f".{made % 1000:03d}"
    assert got(s.sql(f"SELECT max(id) FROM db.t TIMESTAMP AS OF '{at}'")) == [(3,)]
    assert got(s.sql("SELECT 1 FROM (SELECT 2)")) == [(1,)]


def test_statements(session):
    s = session
    assert got(s.sql("DELETE FROM db.t WHERE score = 1")) == [(1,)]
    assert got(s.sql("UPDATE db.t SET name = concat(name, ',x'), score = 9 WHERE score IS NULL")) == [(1,)]
    assert got(s.sql("SELECT * FROM db.t")) == [(2, "b", 2), (3, "c,x", 9)]
    merged = s.sql("""
        MERGE INTO db.t AS a USING (SELECT explode(array(2L, 3L, 5L)) AS id) AS b ON a.id = b.id
        WHEN MATCHED AND a.score > 5 THEN DELETE
        WHEN MATCHED THEN UPDATE SET a.name = 'b.m', score = a.score + b.id
        WHEN NOT MATCHED AND b.id > 4 THEN INSERT (id, name) VALUES (b.id, upper('new'))
    """)
    assert got(merged) == [(3,)]
    assert got(s.sql("SELECT * FROM db.t")) == [(2, "b.m", 4), (5, "NEW", None)]
    s.sql("ALTER TABLE db.t ADD COLUMN extra double")
    s.sql("ALTER TABLE db.t RENAME COLUMN name TO label")
    s.sql("ALTER TABLE db.t ALTER COLUMN score TYPE bigint")
    s.sql("ALTER TABLE db.t DROP COLUMN extra")
    assert s.sql("SELECT * FROM db.t").dtypes == [("id", "bigint"), ("label", "string"), ("score", "bigint")]
    assert got(s.sql("OPTIMIZE db.t ZORDER BY (id, score)"))[0][0] >= 1 and s.sql("OPTIMIZE db.t").columns == ["files"]
    assert got(s.sql("VACUUM db.t RETAIN 1 HOURS")) == [(0,)] and got(s.sql("VACUUM db.t")) == [(0,)]
    assert got(s.sql("DELETE FROM db.t")) == [(2,)]
    for bad in ("ALTER TABLE db.t EXPLODE", "MERGE INTO db.t USING db.t AS s ON t.id = s.id WHEN MATCHED THEN PANIC"):
        with pytest.raises(errors.SchemaMismatch):
            s.sql(bad)


def test_http_service(spark, tmp_path):
    server = rest.serve(InMemoryCatalog(spark, str(tmp_path)), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method, path, body=None, token=None, to=None):
        r = urllib.request.Request(f"http://127.0.0.1:{(to or server).server_port}{path}", json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {token}"} if token else {}, method=method)
        try:
            with urllib.request.urlopen(r) as a:
                return a.status, json.loads(a.read() or b"null")
        except urllib.error.HTTPError as e:
            return e.code, None

    schema = {"fields": [{"id": 1, "name": "id", "required": True, "type": {"type": "long"}}, {"id": 2, "name": "data", "required": False, "type": {"type": "string"}}]}
    assert call("GET", "/health") == (200, {"status": "ok"})
    assert call("GET", "/v1/config?warehouse=w")[1]["overrides"] == {"warehouse": "w"}
    assert call("POST", "/v1/namespaces", {"namespace": ["db"]})[0] == 200 and call("POST", "/v1/namespaces", {"namespace": ["db"]})[0] == 409
    assert call("GET", "/v1/namespaces") == (200, {"namespaces": [["db"]]})
    assert call("POST", "/v1/namespaces/db/tables", {"name": "t", "schema": schema})[0] == 201
    assert call("POST", "/v1/namespaces/db/tables", {"name": "t", "schema": schema})[0] == 400
    assert call("GET", "/v1/namespaces/db/tables")[1]["identifiers"] == [{"namespace": ["db"], "name": "t"}]
    assert call("GET", "/v1/namespaces/db/tables/t")[1]["metadata"]["last-column-id"] == 2
    assert call("DELETE", "/v1/namespaces/db/tables/t")[0] == 204 and call("GET", "/v1/namespaces/db/tables/t")[0] == 404
    assert call("GET", "/v2/other")[0] == 404
    server.shutdown()
    guarded = rest.serve(InMemoryCatalog(spark, str(tmp_path)), 0, secret="s")
    threading.Thread(target=guarded.serve_forever, daemon=True).start()
    assert call("GET", "/v1/namespaces", to=guarded)[0] == 401 and call("GET", "/health", to=guarded)[0] == 200
    assert call("GET", "/v1/namespaces", token=rest.sign({"sub": "me"}, "s"), to=guarded)[0] == 200
    for bad in (rest.sign({"sub": "me"}, "other"), rest.sign({"exp": 1}, "s"), "x"):
        assert call("GET", "/v1/namespaces", token=bad, to=guarded)[0] == 401
    guarded.shutdown()
