"""Stores: a folder of segments, a relational store (the embedded one that Spark brings) and fake HTTP endpoints."""

import base64
import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestrand.session import Session
from lodestrand.sources import open_source
from lodestrand.sources.remote import read_points, wide, write_points
from lodestrand.sources.store import JdbcStore, ParquetStore


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_folder_outlives_its_session(spark, tmp_path):
    folder = str(tmp_path / "store")
    s = Session(spark).attach(folder)
    s.execute("INSERT INTO a(key, x, y) VALUES (1, 10, 'p'), (2, 20, 'q'), (3, 30, NULL)")
    s.execute("INSERT INTO a(key, x) VALUES (2, 21)")
    s.execute("DELETE FROM a.x WHERE key >= 3")
    s.execute("INSERT INTO a(key, x) VALUES (4, 40)")
    want = [(1, 10, "p"), (2, 21, "q"), (4, 40, None)]
    again = Session(spark).attach(folder)
    assert got(s.execute("SELECT x, y FROM a")) == got(again.execute("SELECT x, y FROM a")) == sorted(want, key=repr)
    store = ParquetStore(spark, folder)
    assert store.series() == {"a.x": "LONG", "a.y": "BINARY"} and store.boundary() == (1, 4) and len(store.entries()) == 4
    store.compact()
    assert [kind for _, kind in store.entries()] == ["seg"]
    again = Session(spark).attach(folder)
    assert got(again.execute("SELECT x, y FROM a")) == sorted(want, key=repr)
    again.execute("DELETE TIME SERIES a.y")
    assert Session(spark).attach(folder).catalog.types == {"a.x": "LONG"}
    again.execute("CLEAR DATA")
    empty = ParquetStore(spark, folder)
    assert Session(spark).attach(folder).catalog.types == {} and empty.boundary() is None and empty.series() == {}


def test_unfinished_segments_do_not_count(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "store"))
    store.write(spark.createDataFrame([(1, 1.0)], "key bigint, `a.x` double"))
    (tmp_path / "store/seg-00000002").mkdir()
    (tmp_path / "store/seg-00000002/part-0.parquet").write_text("half a file")
    assert got(store.read(["a.x"])) == [(1, 1.0)] and len(store.entries()) == 1


def test_relational_store(spark):
    store = JdbcStore(spark, "jdbc:derby:memory:lodestrand;create=true", "points", "a", driver="org.apache.derby.jdbc.EmbeddedDriver")
    store.write(spark.createDataFrame([(1, 1.5, 10), (2, 2.5, 20), (9, None, 30)], "key bigint, `a.x` double, `a.n` bigint"))
    assert store.series() == {"a.x": "DOUBLE", "a.n": "LONG"} and store.boundary() == (1, 9)
    store.delete(["a.x"], [(2, 5)])
    assert got(store.read(["a.x", "a.n"])) == [(1, 1.5, 10), (2, None, 20), (9, None, 30)]
    store.delete(["a.n"], None)
    assert store.series() == {"a.x": "DOUBLE"}
    plan = store.read(["a.x"]).where("key > 1")._jdf.queryExecution().toString()
    assert "GreaterThan(key,1)" in plan and got(store.read(["a.x"]).where("key > 1")) == [(2, None), (9, None)]


HELD: dict[str, dict[int, float]] = {}


class Fake(BaseHTTPRequestHandler):
    """The three services over one dictionary of path to {ns: value}."""

    def log_message(self, *args):
        pass

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        route = self.path.partition("?")[0]
        text = {"/api/query": self.tsdb, "/api/put": self.put, "/api/v2/query": self.flux, "/api/v2/write": self.lines, "/rest/v2/query": self.iot, "/rest/v2/insertTablet": self.tablet}[route](body)
        self.send_response(200)
        self.end_headers()
        self.wfile.write(text.encode())

    def tsdb(self, body):
        q = json.loads(body)
        q0 = q["queries"][0]
        tags = {f["tagk"]: f["filter"] for f in q0["filters"]}
        name = q0["metric"] + ("{" + ",".join(f"{k}={v}" for k, v in sorted(tags.items())) + "}" if tags else "")
        dps = {str(k // 10**6): v for k, v in HELD.get(name, {}).items() if q["start"] <= k // 10**6 <= q["end"]}
        return json.dumps([{"metric": q0["metric"], "tags": tags, "dps": dps}])

    def put(self, body):
        for p in json.loads(body):
            tags = {k: v for k, v in p["tags"].items() if (k, v) != ("source", "none")}
            name = p["metric"] + ("{" + ",".join(f"{k}={v}" for k, v in sorted(tags.items())) + "}" if tags else "")
            HELD.setdefault(name, {})[p["timestamp"] * 10**6] = p["value"]
        return ""

    def flux(self, body):
        assert self.headers["Authorization"] == "Token secret"
        low, high = map(int, re.search(r"time\(v: (-?\d+)\), stop: time\(v: (-?\d+)\)", body).groups())
        name = ".".join(re.findall(r'r\._(?:measurement|field) == "([^"]*)"', body))
        tags = sorted(re.findall(r'r\["([^"]*)"\] == "([^"]*)"', body))
        name += "{" + ",".join(f"{k}={v}" for k, v in tags) + "}" if tags else ""
        rows = [f",,0,1970-01-01T00:{k // 60 // 10**9:02d}:{k // 10**9 % 60:02d}.{k % 10**9:09d}Z,{v}" for k, v in HELD.get(name, {}).items() if low <= k < high]
        return "#group,false\r\n,result,table,_time,_value\r\n" + "\r\n".join(rows) + "\r\n"

    def lines(self, body):
        for line in body.split("\n"):
            head, value, at = line.split(" ")
            measurement, *tags = head.split(",")
            field, v = value.split("=")
            HELD.setdefault(f"{measurement}.{field}" + ("{" + ",".join(tags) + "}" if tags else ""), {})[int(at)] = float(v)
        return ""

    def iot(self, body):
        assert base64.b64decode(self.headers["Authorization"].split()[1]) == b"root:root"
        leaf, device, low, high = re.fullmatch(r"SELECT (\S+) FROM root\.(\S+) WHERE time >= (\d+) AND time < (\d+)", json.loads(body)["sql"]).groups()
        held = {k // 10**6: v for k, v in HELD.get(f"{device}.{leaf}", {}).items() if int(low) <= k // 10**6 < int(high)}
        return json.dumps({"timestamps": list(held), "values": [list(held.values())] if held else []})

    def tablet(self, body):
        t = json.loads(body)
        for leaf, values in zip(t["measurements"], t["values"], strict=True):
            for k, v in zip(t["timestamps"], values, strict=True):
                if v is not None:
                    HELD.setdefault(f"{t['device'][5:]}.{leaf}", {})[k * 10**6] = v
        return ""


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Fake)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


@pytest.mark.parametrize(("kind", "tagged", "options"), [("opentsdb", "m.x{host=a}", {}), ("influxdb", "m.x{host=a}", {"org": "o", "bucket": "b", "token": "secret"}), ("iotdb", "m.d.y", {})])
def test_remote_stores(spark, base, kind, tagged, options):
    HELD.clear()
    points = [("m.x", k * 10**9, k / 2) for k in range(100)] + [(tagged, k * 10**9, -1.0 * k) for k in range(0, 100, 7)] + [("m.x", None, 1.0), ("m.x", 1, None)]
    assert write_points(spark.createDataFrame(points, "path string, key bigint, value double").repartition(3), kind, base, **options) == 115
    back = read_points(spark, kind, base, ["m.x", tagged], 10 * 10**9, 90 * 10**9, parts=7, **options)
    assert got(back) == sorted((p for p in points[:-2] if 10 * 10**9 <= p[1] < 90 * 10**9), key=repr)
    assert wide(back, ["m.x", tagged]).count() == 80 and read_points(spark, kind, base, ["none.y"], 0, 10**9, **options).count() == 0
    host, port = base[7:].split(":")
    df = open_source(spark, kind, host=host, port=int(port), series=f"m.x;{tagged}", end=str(100 * 10**9), **options)
    s = Session(spark).register(df, "far", clean=False)
    assert got(s.execute("SELECT max(m.x), count(m.x) FROM far" if kind != "iotdb" else "SELECT max(m.x), count(m.d.y) FROM far"))[0][0] == 49.5
