import collections
import os

import pytest
from pyspark.sql import functions as F

from loomgraph import runtime
from loomgraph.functions import scalar
from loomgraph.graph import Graph
from loomgraph.operators import cache, construct, partition
from loomgraph.sources import files, generators
from loomgraph.streaming.dynamic import DynamicCommunities


def put(path, text):
    path.write_text(text)
    return str(path)


def edges(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_formats(spark, tmp_path):
    assert edges(files.read(spark, put(tmp_path / "a.el", "0 1\n# note\n2\t3\n\n"))) == [(0, 1), (2, 3)]
    assert edges(files.read(spark, put(tmp_path / "a.wel", "0 1 5\n2 3 7.9\n"))) == [(0, 1, 5), (2, 3, 7)]
    assert edges(files.read(spark, put(tmp_path / "a.gr", "c x\np sp 3 2\na 1 2 4\na 2 3 5\n"))) == [(0, 1, 4), (1, 2, 5)]
    head = "%%MatrixMarket matrix coordinate {} {}\n% c\n3 3 2\n"
    assert edges(files.read(spark, put(tmp_path / "a.mtx", head.format("pattern", "symmetric") + "2 1\n3 3\n"))) == [(0, 1, 1), (1, 0, 1), (2, 2, 1)]
    assert edges(files.read(spark, put(tmp_path / "b.mtx", head.format("real", "general") + "1 2 2.5\n3 1 4\n"))) == [(0, 1, 2), (2, 0, 4)]


def test_binary_format(spark, tmp_path):
    rows = [(0, 1, 9), (0, 2, 8), (2, 0, 7)]
    (tmp_path / "a.wsg").write_bytes(files.binary_bytes(rows, 3, True, True))
    (tmp_path / "a.sg").write_bytes(files.binary_bytes([r[:2] for r in rows], 3, True))
    assert edges(files.read(spark, str(tmp_path / "a.wsg"))) == rows
    assert edges(files.read(spark, str(tmp_path / "a.sg"))) == [(a, b, 1) for a, b, _ in rows]


def test_sinks_round_trip(spark, tmp_path):
    g = Graph.from_edges(generators.uniform(spark, 5, 3), directed=True).cut()
    files.write_el(g, f"{tmp_path}/g.el")
    assert edges(files.read_el(spark, f"{tmp_path}/g.el")) == edges(g.edges.select("src", "dst"))
    files.write_mtx(g, f"{tmp_path}/g.mtx", True)
    assert edges(files.read_mtx(spark, f"{tmp_path}/g.mtx")) == edges(g.edges)
    files.write_adjacency(g, f"{tmp_path}/g.adj")
    files.write_csr(g, f"{tmp_path}/csr")
    assert spark.read.parquet(f"{tmp_path}/csr/offsets").count() == g.vertices.count()
    lines = [r[0] for name in sorted(os.listdir(f"{tmp_path}/g.adj")) if name.startswith("part") for r in [(x.rstrip(),) for x in open(f"{tmp_path}/g.adj/{name}")]]
    assert lines[0] == "AdjacencyGraph" and int(lines[2]) == g.edges.count() and len(lines) == 3 + g.vertices.count() + g.edges.count()
    m = g.vertices.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    files.write_permutation(m, f"{tmp_path}/m.so", text=True)
    assert edges(files.read_permutation(spark, f"{tmp_path}/m.so")) == edges(m)
    assert edges(files.read_permutation(spark, put(tmp_path / "one.so", "2\n0\n1\n"))) == [(0, 2), (1, 0), (2, 1)]


def test_run_records(spark, tmp_path):
    row = spark.createDataFrame([("g", "5", "pr", 0, 1.5, True, "{}")], files.RUNS)
    files.record_runs(row, f"{tmp_path}/runs")
    files.record_runs(row, f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2


def test_shard_packages(spark, tmp_path):
    g = Graph.from_edges(generators.uniform(spark, 6, 4), directed=False).cut()
    owners = g.vertices.withColumn("owner", F.col("id") % 3)
    partition.export_shards(g, owners, f"{tmp_path}/p")
    back, who = partition.load_shards(spark, f"{tmp_path}/p")
    assert edges(back.edges) == edges(g.edges) and edges(who) == edges(owners) and not back.directed
    assert partition.load_shards(spark, f"{tmp_path}/p", 1)[1].select("owner").distinct().collect()[0][0] == 1
    spark.range(1).selectExpr("1L as src", "2L as dst", "3L as weight", "0L as shard").write.mode("append").partitionBy("shard").parquet(f"{tmp_path}/p/edges")
    with pytest.raises(ValueError):
        partition.load_shards(spark, f"{tmp_path}/p")


def slow_lru(tags, ways):
    held, out = collections.OrderedDict(), []
    for t in tags:
        out.append(t in held)
        held.pop(t, None)
        held[t] = 1
        if len(held) > ways:
            held.popitem(last=False)
    return out


def test_caches(spark):
    tags = [1, 2, 3, 1, 4, 5, 1, 2, 3, 4, 5, 1, 1, 2]
    at = list(range(len(tags)))
    assert cache.replay_set(at, tags, 3, "lru") == slow_lru(tags, 3)
    fifo, queue = [], []
    for t in tags:
        fifo.append(t in queue)
        queue = queue if t in queue else (queue + [t])[-3:]
    assert cache.replay_set(at, tags, 3, "fifo") == fifo
    nxt = [next((j for j in range(i + 1, len(tags)) if tags[j] == t), None) for i, t in enumerate(tags)]
    best = sum(cache.replay_set(at, tags, 3, "popt", nxt=nxt))
    assert all(best >= sum(cache.replay_set(at, tags, 3, p)) for p in cache.POLICIES if p != "popt")
    trace = spark.createDataFrame([(i, t * 64, False) for i, t in enumerate(tags)], "at long, address long, hot boolean")
    level = cache.Level("L1", 3 * 64, 3)
    assert [r["hit"] for r in cache.replay(trace, level).orderBy("at").collect()] == slow_lru(tags, 3)
    for p in cache.POLICIES:
        rows = cache.hierarchy(trace, [cache.Level("L1", 128, 2, policy=p), cache.Level("L2", 256, 4, policy=p)]).orderBy("level").collect()
        assert rows[0]["accesses"] == len(tags) and rows[1]["accesses"] == rows[0]["misses"]
    assert cache.epochs(trace, 4).count() > 0


def slow_hilbert(x, y, bits):
    d, s, n = 0, 1 << bits - 1, 1 << bits
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
        s >>= 1
    return d


def test_scalar_functions(spark):
    at = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    rows = at.select("x", "y", scalar.hilbert("x", "y", 4).alias("h"), scalar.morton(F.col("x"), F.col("y"), 4).alias("m")).collect()
    assert sorted(r["h"] for r in rows) == sorted(r["m"] for r in rows) == list(range(256))
    assert all(r["h"] == slow_hilbert(r["x"], r["y"], 4) for r in rows)
    cells = {r["h"]: (r["x"], r["y"]) for r in rows}
    assert all(abs(cells[i][0] - cells[i + 1][0]) + abs(cells[i][1] - cells[i + 1][1]) == 1 for i in range(255))
    got = spark.range(-3, 4).select(scalar.zigzag(F.col("id"))).collect()
    assert [r[0] for r in got] == [5, 3, 1, 0, 2, 4, 6]


@pytest.mark.parametrize("family", generators.FAMILIES)
def test_families(spark, family):
    rows = edges(generators.FAMILIES[family](spark, 256))
    assert rows and len(set(rows)) == len(rows) and all(0 <= a < b < 256 for a, b in rows)
    counts = {"chain": 255, "grid": 480, "hub-spoke": 256, "block-biclique": 8 * 256, "copied-neighborhood": 4 * (8 + 56 * 6), "expander-control": 1024}
    assert len(rows) == counts.get(family, len(rows))
    g = Graph.from_edges(generators.shuffled(generators.FAMILIES[family](spark, 256), 256), directed=False)
    a = sorted(r["out_degree"] for r in construct.degrees(g).collect())
    b = collections.Counter(v for e in rows for v in e)
    assert a == sorted(b.values())


@pytest.mark.parametrize("screening", ["delta", "naive", "frontier"])
def test_dynamic_communities_over_a_stream(spark, tmp_path, screening):
    import itertools

    rows = [("+", a, b, 1) for k in (0, 5) for a, b in itertools.combinations(range(k, k + 5), 2)]
    schema = "op string, src long, dst long, weight long"
    source, state = f"{tmp_path}/in", DynamicCommunities(spark, f"{tmp_path}/state", screening)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/1")
    stream = lambda n: spark.readStream.schema(schema).parquet(f"{source}/{n}")
    state.start(stream(1), f"{tmp_path}/c1").awaitTermination()
    label = {r["id"]: r["community"] for r in state.labels().collect()}
    assert len({label[i] for i in range(5)}) == 1 and label[0] != label[5]
    more = [("-", 0, b, None) for b in range(1, 5)] + [("+", 0, b, 1) for b in range(5, 10)]
    spark.createDataFrame(more, schema).coalesce(1).write.parquet(f"{source}/2")
    state.start(stream(2), f"{tmp_path}/c2").awaitTermination()
    label = {r["id"]: r["community"] for r in state.labels().collect()}
    assert label[0] == label[5] and label[1] == label[2]
    assert state.graph().edges.count() == 2 * (6 + 10 + 5)


def test_release_asks_the_executors_to_collect(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(runtime, "sweep", asked.append)
    monkeypatch.setattr(runtime, "_swept", 0.0)
    monkeypatch.setattr(runtime, "_far_swept", -1e9)
    runtime.release(runtime.cut_flat(spark.range(3)))
    assert asked
    monkeypatch.undo()
    assert runtime.sweep(spark) == 0  # here the executor is the driver, which has collected already
