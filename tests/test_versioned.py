"""Run chains and the store against a plain dict, over seeded histories."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import versioned as V
from tidemark.sources.store import Busy, ChunkedImport, Store, StoreError, check_ranges

VALUES = "v bigint"


def sequential(runs, entries):
    """Oldest to newest: set the size, drop what lies above it, drop tombstones, lay puts over it."""
    out = {}
    for i, size in enumerate(runs):
        out = {p: v for p, v in out.items() if p <= size}
        for idx, page, op, v in entries:
            if idx == i:
                if op == "del":
                    out.pop(page, None)
                elif page <= size:
                    out[page] = v
    return out


@pytest.mark.parametrize("seed", range(4))
def test_resolve_and_diff_against_a_model(spark, seed):
    r = random.Random(seed)
    runs, entries = [], {}
    for i in range(6):
        runs.append(r.randint(5, 30))
        for _ in range(r.randint(0, 12)):
            p = r.randint(1, runs[-1])
            entries[i, p] = ("del", None) if i and r.random() < 0.3 else ("put", r.randint(0, 99))
    rows = [(i, p, op, v) for (i, p), (op, v) in entries.items()]
    e = spark.createDataFrame(rows, "idx int, page long, op string, v long")
    rs = spark.createDataFrame(list(enumerate(runs)), "idx int, size long")
    got = {x.page: x.v for x in V.resolve(e, rs, ["v"]).collect()}
    want = sequential(runs, rows)
    assert got == want
    target = {p: r.randint(0, 99) for p in range(1, 20) if r.random() < 0.7}
    size = 19
    s = spark.createDataFrame(list(want.items()), "page long, v long")
    t = spark.createDataFrame(list(target.items()), "page long, v long")
    run = V.diff(s, t, size, ["v"])
    chain = s.select("page", F.lit(0).alias("idx"), F.lit("put").alias("op"), "v").unionByName(run.select("page", F.lit(1).alias("idx"), "op", "v"))
    back = V.resolve(chain, spark.createDataFrame([(0, 30), (1, size)], "idx int, size long"), ["v"])
    assert {x.page: x.v for x in back.collect()} == target


def test_store_history(spark, tmp_path):
    r = random.Random(5)
    s = Store(spark, f"file://{tmp_path}/s", VALUES)
    model, size = {}, 0
    for step in range(6):
        for _ in range(2):
            kind = r.choice(["put", "put", "delete", "truncate"])
            if kind == "put" or not model:
                new = {r.randint(1, 40): r.randint(0, 99) for _ in range(6)}
                s.put(spark.createDataFrame(list(new.items()), "page long, v long"))
                model |= new
                size = max(size, *new)
            elif kind == "delete":
                gone = r.sample(sorted(model), min(3, len(model)))
                s.delete(spark.createDataFrame([(p,) for p in gone], "page long"))
                model = {p: v for p, v in model.items() if p not in gone}
            else:
                size = r.randint(1, 40)
                s.truncate(size)
                model = {p: v for p, v in model.items() if p <= size}
        s.seal()
        assert {x.page: x.v for x in s.view().resolve().collect()} == model, step
        if step == 3:
            s.compact()
            assert len(s.view().manifest["runs"]) == 1
    assert s.verify() == len(model)


def test_pins_heads_and_collection(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/p", VALUES)
    with pytest.raises(StoreError):
        s.view()
    s.put(spark.createDataFrame([(1, 1), (2, 2)], "page long, v long"))
    with pytest.raises(Busy):
        s.compact()
    s.seal()
    token = s.retain("old")
    with pytest.raises(StoreError):
        s.retain("old")
    with pytest.raises(StoreError):
        s.retain("no/slash")
    s.update(F.col("page") == 1, v=F.lit(9))
    s.seal()
    s.compact()
    with pytest.raises(StoreError):
        s.release_retention("old", "wrong")
    s.collect(100)
    assert {x.page: x.v for x in s.open_retained("old").resolve().collect()} == {1: 1, 2: 2}
    s.release_retention("old", token)
    assert s.collect(100)
    assert {x.page: x.v for x in s.view().resolve().collect()} == {1: 9, 2: 2}
    with pytest.raises(StoreError):
        s.remove_head("main")
    s.fork("b")
    s.remove_head("b")
    assert list(s.heads()) == ["main"]


def test_swap_has_one_winner(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/w", VALUES)
    assert [s.swap_at(0, s.root), s.swap_at(0, s.root)] == ["applied", "stale"]


def test_one_of_many_writers_creates_an_object(spark, tmp_path):
    b = Store(spark, f"file://{tmp_path}/c", VALUES).backend
    for k in range(5):
        gate, won = threading.Barrier(4), []

        def write(i, k=k, gate=gate, won=won):
            gate.wait()
            if b.put_new(f"root.{k}.json", b"%d" % i * 1000):
                won.append(i)

        threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert len(won) == 1 and b.read(f"root.{k}.json") == b"%d" % won[0] * 1000
    assert set(b.names()) == {f"root.{k}.json" for k in range(5)}


def test_failed_swaps_are_read_again(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/u", VALUES)
    put = type(s.backend).put_new

    def arrives(self, name, data):
        put(self, name, data)
        raise OSError("no answer")

    def lost(self, name, data):
        raise OSError("no answer")

    monkeypatch.setattr(type(s.backend), "put_new", arrives)
    assert s.swap_at(0, s.root) == "applied" and s.root["revision"] == 1
    monkeypatch.setattr(type(s.backend), "put_new", lost)
    assert s.swap(lambda r: r) == "uncertain" and s.root["revision"] == 1
    with pytest.raises(StoreError):
        s.configure(max_runs=3)


def test_rename_overwrites_nothing(spark, tmp_path):
    """What other file systems than the local one do."""
    b = Store(spark, f"file://{tmp_path}/r", VALUES).backend
    for data, done in ((b"first", True), (b"second", False)):
        part = b._at("_part")
        out = b.fs.create(part, True)
        out.write(bytearray(data))
        out.close()
        assert b._rename_new(part, b._at("x")) == done
    assert b.read("x") == b"first" and list(b.names()) == ["x"]


def test_concurrent_heads_all_arrive(spark, tmp_path):
    """Writers of different branches lose races for the root and try again; none of their changes is lost."""
    s = Store(spark, f"file://{tmp_path}/h", VALUES)
    s.put(spark.createDataFrame([(1, 1)], "page long, v long"))
    s.seal()
    stores = [Store(spark, s.backend.path, VALUES) for _ in range(3)]
    threads = [threading.Thread(target=lambda i=i, x=x: [x.fork(f"b{i}{k}") for k in range(3)]) for i, x in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert set(s.heads()) == {"main", *(f"b{i}{k}" for i in range(3) for k in range(3))}


def test_range_reads(spark, tmp_path):
    b = Store(spark, f"file://{tmp_path}/g", VALUES).backend
    b.put_new("x", bytes(range(200)))
    assert b.read_ranges("x", [(5, 3), (0, 0), (199, 1), (1, 2)]) == [b"\x05\x06\x07", b"", b"\xc7", b"\x01\x02"]
    for bad in ([(199, 2)], [(-1, 1)], [(0, 1.0)], [(0, 1)] * 4097):
        with pytest.raises(StoreError):
            b.read_ranges("x", bad)
    with pytest.raises(StoreError):
        check_ranges([(0, 40 << 20), (0, 25 << 20)], 1 << 30)
    assert b.inventory() == [("x", 200)] and b.inventory(after="x") == [] and b.stat("y") is None


def test_damage_is_found(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/d", VALUES)
    s.put(spark.createDataFrame([(p, p) for p in range(1, 20)], "page long, v long"))
    s.seal()
    s.update(F.col("page") == 3, v=F.lit(0))
    s.seal()
    assert s.verify() == 19 and s.mismatches() == []
    bad = s.view().manifest["runs"][1]["object"]
    spark.createDataFrame([(3, "put", 1)], s.schema).write.mode("overwrite").parquet(f"{s.backend.path}/{bad}")
    assert s.mismatches() == [bad]
    with pytest.raises(StoreError):
        s.verify()


def test_metadata_and_staged_objects(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/k", VALUES)
    s.put(spark.createDataFrame([(p, p) for p in range(1, 30)], "page long, v long"))
    s.seal()
    for i in range(4):
        s.update(F.col("page") == i + 1, v=F.lit(100 + i))
        s.seal()
    assert len(s.root["manifests"]) == 5 and s.view().manifest["pages"] == 29 and len(s.view().manifest["runs"]) == 5
    other = Store(spark, s.backend.path, VALUES)
    other.put(spark.createDataFrame([(2, 7)], "page long, v long"))  # still open: its staged object stays
    s.OLD_ROOTS = 2
    s.compact()
    s.collect(1000)
    left = s.backend.names()
    assert len(s.root["manifests"]) == 1 and len([n for n in left if n.startswith("run-")]) == 1
    assert len([n for n in left if n.startswith("root.")]) <= 4 and [n for n in left if n.startswith("staged-")] == list(other._own)
    other.refresh().seal()
    assert {x.page: x.v for x in other.view().resolve().collect()} == {**{p: p for p in range(1, 30)}, 1: 100, 2: 7, 3: 102, 4: 103}
    with pytest.raises(StoreError):
        s.configure(speed=1)
    s.refresh()
    s.configure(byte_budget=1)
    s.update(F.col("page") == 5, v=F.lit(1))
    s.seal()
    assert s.view().manifest["kind"] == "checkpoint"
    assert s.flush() is None and s.occupancy().collect()[0].live == 29


def test_import_goes_on_in_another_process(spark, tmp_path):
    src = spark.createDataFrame([(p, p * 10) for p in range(1, 11)], "page long, v long")
    job = ChunkedImport(Store(spark, f"file://{tmp_path}/i", VALUES), src, 10)
    assert job.step(4)
    job.pause()
    again = ChunkedImport(Store(spark, f"file://{tmp_path}/i", VALUES), src, 10)
    assert again.status() == {"imported": 4, "pages": 10, "paused": True, "done": False} and not again.step(4)
    again.resume()
    assert again.step(4) and not again.step(4) and again.status()["done"]
    assert again.store.verify() == 10


def test_content_root_has_bounded_nodes(spark, monkeypatch):
    rows = spark.range(1, 400).select(F.col("id").alias("page"), F.md5(F.col("id").cast("string")).alias("checksum"))
    two = V.content_root(rows).first().root
    monkeypatch.setattr(V, "HASH_FAN", 8)
    deep = V.content_root(rows).first().root
    other = V.content_root(rows.withColumn("checksum", F.when(F.col("page") == 77, "x").otherwise(F.col("checksum")))).first().root
    assert deep == V.content_root(rows.repartition(5)).first().root and len({two, deep, other}) == 3


def test_places_and_running_sums(spark):
    from tidemark.functions.ordered import positions, running

    r = random.Random(3)
    rows = [(r.randint(0, 2), i % 7 == 0 and None or r.randint(0, 50), i) for i in range(300)]
    d = spark.createDataFrame(rows, "g long, v long, id long").repartition(5)
    key = lambda x: (x[1] is not None, x[1] or 0, x[2])
    got = {x.id: x.pos for x in positions(d, ["v", "id"]).collect()}
    assert got == {x[2]: i for i, x in enumerate(sorted(rows, key=key))}
    got = {x.id: x.n for x in running(d.withColumn("w", F.col("id") + 1), ["v", "id"], "w", "n", ["g"]).collect()}
    want, sums = {}, {}
    for x in sorted(rows, key=key):
        sums[x[0]] = sums.get(x[0], 0) + x[2] + 1
        want[x[2]] = sums[x[0]]
    assert got == want


def test_missing_object_stops_collection(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/m", VALUES)
    s.put(spark.createDataFrame([(1, 1)], "page long, v long"))
    s.seal()
    obj = s.view().manifest["runs"][0]["object"]
    assert s.collect(grace=0) is not None
    spark.createDataFrame([(9, "put", 9)], s.schema).write.mode("append").parquet(f"{s.backend.path}/{obj}")
    with pytest.raises(StoreError, match="length"):
        s.collect()
    s.backend.delete(obj, True)
    with pytest.raises(StoreError, match="missing"):
        s.collect()


def test_differential_check_compares_values_and_groups(spark):
    from tidemark.operators.maintenance import agreement

    kind = "o_orderstatus string, n long, bytes long, fingerprint long"
    a = spark.createDataFrame([("F", 2, 9, 5), ("O", 1, 4, 7), ("P", 1, 3, 3), (None, 1, 1, 1)], kind)
    b = spark.createDataFrame([("F", 2, 9, 5), ("O", 1, 4, 8), ("Q", 1, 3, 3), (None, 1, 1, 1)], kind)
    assert {x.o_orderstatus: x.same for x in agreement(a, b).collect()} == {"F": True, "O": False, "P": False, "Q": False, None: True}
