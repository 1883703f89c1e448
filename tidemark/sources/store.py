"""A persistent versioned table: immutable Parquet runs, and one small root document per revision.

root.<revision>.json holds everything small: manifests (chains of runs), heads (named branches), pins and placements. A
new revision is created without overwriting, so of two writers one wins and the other reads again (compare and swap).
Rows are keyed by page (1-based) and carry value columns; a run has the puts and tombstones of one seal. A single
driver writes at a time; readers are bound to the file list of their manifest and never see later seals.
"""

from __future__ import annotations

import json
import os
import random
import re
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import versioned as V

_PIN = re.compile(r"[A-Za-z0-9_-]{1,64}")


class StoreError(RuntimeError):
    pass


class Busy(StoreError):
    pass


#: Most ranges and most bytes that one batch of range reads may ask for.
MAX_RANGES, MAX_BATCH = 4096, 64 << 20


def check_ranges(ranges: list[tuple[int, int]], size: int, name: str = "object") -> None:
    """The rules of a batch of range reads: whole numbers inside the object, so many ranges and bytes at most."""
    if len(ranges) > MAX_RANGES:
        raise StoreError(f"{len(ranges)} ranges; at most {MAX_RANGES} are allowed")
    for o, n in ranges:
        if isinstance(o, bool) or isinstance(n, bool) or not isinstance(o, int) or not isinstance(n, int):
            raise StoreError("offsets and lengths are integers")
        if o < 0 or n < 0 or o + n > size:
            raise StoreError(f"range {o}+{n} is outside {name} of {size} bytes")
    if sum(n for _, n in ranges) > MAX_BATCH:
        raise StoreError(f"more than {MAX_BATCH} bytes in one batch")


class Backend:
    """Objects below a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._P = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._P(self.path).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._P(f"{self.path}/{name}")

    def put_new(self, name: str, data: bytes) -> bool:
        """Create an object; False if it is there already. The object appears complete or not at all, and of writers at
        the same time one succeeds: a hard link locally, elsewhere a rename that overwrites nothing."""
        if self.fs.getScheme() == "file":
            return self._link_new(name, data)
        part = self._at(f"_staged-{secrets.token_hex(8)}")
        out = self.fs.create(part, False)
        out.write(bytearray(data))
        out.close()
        return self._rename_new(part, self._at(name))

    def _link_new(self, name: str, data: bytes) -> bool:
        top = self.fs.makeQualified(self._P(self.path)).toUri().getPath()
        part = f"{top}/_staged-{secrets.token_hex(8)}"
        os.makedirs(top, exist_ok=True)
        with open(part, "wb") as f:
            f.write(data)
        try:
            os.link(part, f"{top}/{name}")
        except FileExistsError:
            return False
        finally:
            os.remove(part)
        return True

    def _rename_new(self, part, to) -> bool:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(rename, 1)
        never[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self._conf).rename(part, to, never)
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if "AlreadyExists" in e.java_exception.getClass().getSimpleName():
                return False
            raise
        return True

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_ranges(self, name: str, ranges: list[tuple[int, int]]) -> list[bytes]:
        """(offset, length) pieces, in the order asked for; only they are read."""
        check_ranges(ranges, self.stat(name) or 0, name)
        stream, out = self.fs.open(self._at(name)), []
        try:
            for o, n in ranges:
                stream.seek(o)
                out.append(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)))
        finally:
            stream.close()
        return out

    def stat(self, name: str) -> int | None:
        p = self._at(name)
        return int(self.fs.getContentSummary(p).getLength()) if self.fs.exists(p) else None

    def names(self, prefix: str = "") -> dict[str, int]:
        """Names and times of change (ms) of what starts so: one listing, nothing is measured."""
        found = self.fs.globStatus(self._P(f"{self.path}/{prefix}*")) or []
        return {n: int(s.getModificationTime()) for s in found if not (n := s.getPath().getName()).startswith(("_", "."))}

    def inventory(self, page: int = 1000, after: str = "") -> list[tuple[str, int]]:
        """Names and sizes in name order, at most page of them after a name; only these are measured."""
        return [(n, self.stat(n) or 0) for n in sorted(n for n in self.names() if n > after)[:page]]

    def delete(self, name: str, permit: bool) -> None:
        if not permit:
            raise StoreError("deleting needs a permit")
        self.fs.delete(self._at(name), True)


@dataclass(frozen=True)
class View:
    """A pinned version: its manifest, and DataFrames over exactly its files."""

    store: "Store"
    manifest: dict

    @property
    def size(self) -> int:
        return self.manifest["runs"][-1]["size"]

    @property
    def txid(self) -> int:
        return self.manifest["end"]

    def entries(self) -> DataFrame:
        out = None
        for i, r in enumerate(self.manifest["runs"]):
            one = self.store._read(r["object"]).withColumn("idx", F.lit(i))
            out = one if out is None else out.unionByName(one)
        return out

    def resolve(self, with_txid: bool = False) -> DataFrame:
        runs = self.store.spark.createDataFrame([(i, r["size"], r["txid"]) for i, r in enumerate(self.manifest["runs"])], "idx int, size long, txid long")
        found = V.resolve(self.entries(), runs, self.store.values)
        if with_txid:
            return found.join(F.broadcast(runs.select("idx", "txid")), "idx").select("page", "txid", *self.store.values)
        return found.select("page", *self.store.values)


class Store:
    """Open or create with Store(spark, path, values schema); every change goes to the head called name."""

    def __init__(self, spark: SparkSession, path: str, values: str, head: str = "main"):
        self.spark, self.backend, self.name = spark, Backend(spark, path), head
        self.schema = T.StructType.fromDDL(f"page bigint, op string, {values}")
        self.values = [f.name for f in self.schema if f.name not in ("page", "op")]
        self.root = self._latest() or {"revision": 0, "manifests": {}, "heads": {head: None}, "pins": {}, "placements": {}}
        for part in ("batches", "imports", "config"):
            self.root.setdefault(part, {})
        self._staged: list[tuple[DataFrame, int]] = []
        self._own: set[str] = set()
        self._marks: dict[str, int] = {}
        self._size: int | None = None

    # -- root --

    def _latest(self) -> dict | None:
        names = self.backend.names("root.")
        revisions = [int(n.split(".")[1]) for n in names if n.split(".")[1].isdigit()]
        return json.loads(self.backend.read(f"root.{max(revisions)}.json").decode()) if revisions else None

    def swap(self, change: Callable[[dict], dict], tries: int = 20) -> str:
        """Apply change to the newest root and publish it: applied, stale after so many lost races, or uncertain."""
        for k in range(tries):
            if k:  # who lost a race waits a random while, longer each time
                time.sleep(random.uniform(0, 0.01 * 2 ** min(k, 7)))
            now = self._latest() or self.root
            new = change(json.loads(json.dumps(now)))
            new["revision"] = now["revision"] + 1
            if (outcome := self._create_root(new)) != "stale":
                return outcome
        return "stale"

    def _create_root(self, new: dict) -> str:
        """applied, stale (another writer's root is there), or uncertain: the file system failed, and reading again does
        not show that the root arrived."""
        name, data = f"root.{new['revision']}.json", json.dumps(new, sort_keys=True).encode()
        try:
            done = self.backend.put_new(name, data)
        except (Py4JJavaError, OSError):
            try:
                if self.backend.stat(name) is None or self.backend.read(name) != data:
                    return "uncertain"
            except (Py4JJavaError, OSError):
                return "uncertain"
            done = True
        if done:
            self.root = new
        return "applied" if done else "stale"

    def _apply(self, change: Callable[[dict], dict]) -> None:
        outcome = self.swap(change)
        if outcome == "uncertain":
            raise StoreError("the file system failed; whether the change arrived shows when the store is opened again")
        if outcome != "applied":
            raise Busy("the root kept changing")

    def swap_at(self, revision: int, new: dict) -> str:
        """Publish new only if revision is still the newest."""
        now = self._latest()
        if now is not None and now["revision"] != revision:
            return "stale"
        return self._create_root({**new, "revision": revision + 1})

    def _place(self, obj: str) -> str:
        return self.root["placements"].get(obj, [obj])[0]

    def _read(self, obj: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.backend.path}/{self._place(obj)}")

    # -- versions --

    def view(self, manifest: str | None = None) -> View:
        mid = manifest or self.root["heads"].get(self.name)
        if mid is None:
            raise StoreError("nothing is sealed yet")
        return View(self, self.root["manifests"][mid])

    @property
    def size(self) -> int:
        if self._size is not None:
            return self._size
        mid = self.root["heads"].get(self.name)
        return self.root["manifests"][mid]["runs"][-1]["size"] if mid else 0

    def current(self) -> DataFrame:
        """What a reader sees with the staged changes on top of the sealed version."""
        mid = self.root["heads"].get(self.name)
        parts = [(self._read(r["object"]), r["size"]) for r in self.root["manifests"][mid]["runs"]] if mid else []
        parts += self._staged
        if not parts:
            return self.spark.createDataFrame([], T.StructType([f for f in self.schema if f.name != "op"]))
        entries = None
        for i, (df, _) in enumerate(parts):
            one = df.withColumn("idx", F.lit(i))
            entries = one if entries is None else entries.unionByName(one)
        runs = self.spark.createDataFrame([(i, s) for i, (_, s) in enumerate(parts)], "idx int, size long")
        return V.resolve(entries, runs, self.values).select("page", *self.values)

    # -- staged changes --

    def _stage(self, entries: DataFrame, size: int | None = None) -> None:
        kept = entries.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        name = f"staged-{secrets.token_hex(8)}"
        self._own.add(name)
        kept.write.parquet(f"{self.backend.path}/{name}")
        df = self.spark.read.schema(self.schema).parquet(f"{self.backend.path}/{name}")
        if size is None:
            size = max(self.size, df.where("op = 'put'").agg(F.max("page")).first()[0] or 0)
        self._staged.append((df, size))
        self._size = size

    def put(self, rows: DataFrame) -> None:
        self._stage(rows.withColumn("op", F.lit("put")))

    def delete(self, pages: DataFrame) -> None:
        self._stage(pages.select("page", F.lit("del").alias("op"), *[F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.values]))

    def truncate(self, size: int) -> None:
        self._stage(self.spark.createDataFrame([], self.schema), size)

    insert = upsert = replace = put

    def insert_or_ignore(self, rows: DataFrame) -> None:
        self.put(rows.join(self.current().select("page"), "page", "left_anti"))

    def update(self, where: Column, **changes: Column) -> None:
        self.put(self.current().where(where).withColumns(changes))

    def delete_where(self, where: Column) -> None:
        self.delete(self.current().where(where).select("page"))

    def savepoint(self, name: str) -> None:
        self._marks[name] = len(self._staged)

    def rollback_to(self, name: str) -> None:
        self._staged = self._staged[: self._marks[name]]
        self._size = self._staged[-1][1] if self._staged else None

    def rollback(self) -> None:
        self._staged, self._marks, self._size = [], {}, None

    # -- sealing --

    def _checksum(self, obj: str) -> dict:
        """rows, puts, puts beyond no page, and a sum over row hashes that doesn't depend on their order."""
        rows = self._read(obj)
        hashed = F.xxhash64(*[F.coalesce(F.col(f.name).cast("string"), F.lit("\0")) for f in self.schema])
        r = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(hashed.cast("decimal(20,0)")).alias("total")).first()
        return {"rows": r.rows, "sum": str(r.total or 0)}

    def _write(self, rows: DataFrame, size: int, txid: int) -> dict:
        obj = f"run-{secrets.token_hex(8)}"
        rows.select(self.schema.fieldNames()).write.parquet(f"{self.backend.path}/{obj}")
        return {"object": obj, "size": size, "txid": txid, "bytes": self.backend.stat(obj), **self._checksum(obj)}

    def seal(self, dictionary: str | None = None, note: Callable[[dict], dict] | None = None, byte_budget: int | None = None) -> str:
        """Publish the staged changes as one run of the head, or as a checkpoint where a run doesn't pay: the chain is
        full, the run isn't smaller than the table, or the chain would outgrow byte_budget (the store's config, if not
        given). What it costs follows the run, unless a checkpoint is due. note changes the root in the same swap."""
        if not self._staged:
            raise StoreError("nothing to seal")
        size = self._staged[-1][1]
        entries = None
        for i, (df, s) in enumerate(self._staged):
            one = df.withColumn("idx", F.lit(i))
            entries = one if entries is None else entries.unionByName(one)
        limits = self.spark.createDataFrame([(i, s) for i, (_, s) in enumerate(self._staged)], "idx int, size long")
        last = V.latest(entries, ["page"], "idx", ["op", *self.values])
        # a page that a later truncation cut is gone from the sealed version too
        cut = (F.col("op") == "put") & (F.col("page") > F.col("fence"))
        run = last.join(F.broadcast(V.fence(limits)), "idx").withColumn("op", F.when(cut, "del").otherwise(F.col("op"))).select("page", "op", *self.values)
        parent = self.root["heads"].get(self.name)
        runs = self.root["manifests"][parent]["runs"] if parent else []
        low = min(s for _, s in self._staged)
        txid = (self.root["manifests"][parent]["end"] if parent else 0) + 1
        choice, pages = "checkpoint", 0
        if parent:
            new = self._write(run, size, txid)
            # a lower bound: tombstones may have hit pages nobody wrote, and puts may have filled such
            facts = self._read(new["object"]).agg(F.count(F.when((F.col("op") == "put") & (F.col("page") > runs[-1]["size"]), 1)).alias("more"), F.count(F.when(F.col("op") == "del", 1)).alias("less")).first()
            pages = max(0, min(self.root["manifests"][parent].get("pages", 0), low) + facts.more - facts.less)
            budget = byte_budget if byte_budget is not None else self.root.get("config", {}).get("byte_budget")
            held = sum(self.backend.stat(self._place(r["object"])) or 0 for r in [*runs, new][1:]) if budget is not None else 0
            choice = V.run_or_checkpoint(len(runs), new["rows"], pages, (budget or 0) - held)
        if choice == "run":
            if low < min(size, runs[-1]["size"]):  # truncated and regrown within one seal: the low point is a run of its own
                runs = [*runs, self._write(self.spark.createDataFrame([], self.schema), low, txid)]
            runs = [*runs, new]
        else:
            runs = [self._write(self.current().withColumn("op", F.lit("put")), size, txid)]
            pages = runs[0]["rows"]
        mid = self._publish(runs, parent, txid, choice, dictionary, pages, note)
        self.rollback()
        return mid

    def flush(self) -> str | None:
        """Seal what is staged, if anything is."""
        return self.seal() if self._staged else None

    def _publish(self, runs: list[dict], parent: str | None, txid: int, kind: str, dictionary: str | None = None, pages: int = 0, note: Callable[[dict], dict] | None = None) -> str:
        mid = f"m-{secrets.token_hex(8)}"
        begin = runs[0]["txid"]
        if dictionary is None and parent:
            dictionary = self.root["manifests"][parent].get("dictionary")
        manifest = {"id": mid, "parent": parent, "runs": runs, "begin": begin, "end": txid, "kind": kind, "dictionary": dictionary, "pages": pages}

        def change(root: dict) -> dict:
            if root["heads"].get(self.name) != parent:
                raise Busy("the head moved while this seal was prepared")
            root["manifests"][mid] = manifest
            root["heads"][self.name] = mid
            return note(root) if note else root

        self._apply(change)
        return mid

    def compact(self) -> str:
        """The same version as a single run; nothing to do if it is one already, Busy with staged changes."""
        if self._staged:
            raise Busy("unsealed changes")
        view = self.view()
        if len(view.manifest["runs"]) == 1:
            return view.manifest["id"]
        run = self._write(view.resolve().withColumn("op", F.lit("put")), view.size, view.txid)
        return self._publish([run], view.manifest["id"], view.txid, "checkpoint", pages=run["rows"])

    def adopt_dictionary(self, dictionary: str) -> str:
        """Another preferred dictionary at the same endpoint; no payload is rewritten."""
        view = self.view()
        return self._publish(view.manifest["runs"], view.manifest["id"], view.txid, view.manifest["kind"], dictionary, view.manifest.get("pages", 0))

    # -- branches, pins --

    def fork(self, name: str) -> "Store":
        def change(root: dict) -> dict:
            if name in root["heads"]:
                raise StoreError(f"head {name} exists")
            root["heads"][name] = root["heads"][self.name]
            return root

        self._apply(change)
        other = Store.__new__(Store)
        other.__dict__.update(self.__dict__, name=name, _staged=[], _own=set(), _marks={}, _size=None)
        return other

    def refresh(self) -> "Store":
        self.root = self._latest() or self.root
        return self

    def heads(self) -> dict[str, str | None]:
        return dict(self.refresh().root["heads"])

    def remove_head(self, name: str) -> None:
        def change(root: dict) -> dict:
            if list(root["heads"]) == [name]:
                raise StoreError("the last head stays")
            del root["heads"][name]
            return root

        self._apply(change)

    def retain(self, name: str) -> str:
        """Keep the present version under a name; the token is needed to release or advance it."""
        if not _PIN.fullmatch(name):
            raise StoreError("a pin's name has 1 to 64 letters, digits, _ or -")
        token = secrets.token_hex(16)

        def change(root: dict) -> dict:
            if name in root["pins"]:
                raise StoreError(f"pin {name} exists")
            root["pins"][name] = {"manifest": root["heads"][self.name], "token": token}
            return root

        self._apply(change)
        return token

    def advance_retention(self, name: str, token: str) -> str:
        new = secrets.token_hex(16)

        def change(root: dict) -> dict:
            self._check_token(root, name, token)
            root["pins"][name] = {"manifest": root["heads"][self.name], "token": new}
            return root

        self._apply(change)
        return new

    def release_retention(self, name: str, token: str) -> None:
        def change(root: dict) -> dict:
            self._check_token(root, name, token)
            del root["pins"][name]
            return root

        self._apply(change)

    @staticmethod
    def _check_token(root: dict, name: str, token: str) -> None:
        if root["pins"].get(name, {}).get("token") != token:
            raise StoreError(f"stale or unknown pin {name}")

    def retention(self) -> DataFrame:
        rows = [(n, p["manifest"], self.root["manifests"][p["manifest"]]["end"]) for n, p in sorted(self.root["pins"].items())]
        return self.spark.createDataFrame(rows, "name string, manifest string, txid long")

    def open_retained(self, name: str) -> View:
        if name not in self.root["pins"]:
            raise StoreError(f"no pin {name}")
        return self.view(self.root["pins"][name]["manifest"])

    # -- maintenance --

    @staticmethod
    def _kept_manifests(root: dict) -> set[str]:
        return {m for m in root["heads"].values() if m} | {p["manifest"] for p in root["pins"].values()}

    def _reached(self) -> set[str]:
        """Objects that heads and pins reach; the root holds manifests only, so this is small."""
        logical = {r["object"] for m in self._kept_manifests(self.root) for r in self.root["manifests"][m]["runs"]}
        return {o for x in logical for o in self.root["placements"].get(x, [x])}

    #: Roots that stay besides the newest, so that a writer who read one of them still finds its successor taken.
    OLD_ROOTS = 64

    def collect(self, budget: int = 8, grace: float = 3600.0) -> list[str]:
        """Delete the first budget objects that nothing reaches, in name order; reached objects that are missing, or not
        of the length that was recorded when they were sealed, stop it before anything goes. Staged
        objects of other writers stay for grace seconds. Manifests that no head and no pin has leave the root, and old
        roots go, so that metadata grows with what is kept and not with the number of seals."""
        self.refresh()
        keep = self._reached()
        have = self.backend.names()
        if missing := keep - set(have):
            raise StoreError(f"missing objects: {sorted(missing)}")
        lengths = {r["object"]: r.get("bytes") for m in self._kept_manifests(self.root) for r in self.root["manifests"][m]["runs"]}
        if changed := sorted(o for o, n in lengths.items() if n is not None and o in have and self.backend.stat(o) != n):
            raise StoreError(f"objects of another length than recorded: {changed}")
        since = (time.time() - grace) * 1000
        mine = {n for n in self._own if self._staged}
        free = (n for n in sorted(have) if n not in keep and (n.startswith("run-") or (n.startswith("staged-") and n not in mine and (n in self._own or have[n] < since))))
        dead = [n for _, n in zip(range(budget), free)]
        for n in dead:
            self.backend.delete(n, True)
        if set(self.root["manifests"]) - self._kept_manifests(self.root):

            def change(root: dict) -> dict:
                held = self._kept_manifests(root)
                root["manifests"] = {m: x for m, x in root["manifests"].items() if m in held}
                used = {r["object"] for x in root["manifests"].values() for r in x["runs"]}
                root["placements"] = {o: x for o, x in root["placements"].items() if o in used}
                return root

            self._apply(change)
        for n in have:
            if n.startswith("root.") and n.split(".")[1].isdigit() and int(n.split(".")[1]) < self.root["revision"] - self.OLD_ROOTS:
                self.backend.delete(n, True)
        return dead

    def configure(self, **settings: int) -> dict:
        """Set max_runs, byte_budget or collect_budget of the store, kept in its root; returns all that is set."""
        unknown = settings.keys() - {"max_runs", "byte_budget", "collect_budget"}
        if unknown or any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in settings.values()):
            raise StoreError(f"settings are max_runs, byte_budget and collect_budget, as positive integers: {settings}")

        def change(root: dict) -> dict:
            root["config"] = {**root.get("config", {}), **settings}
            return root

        if settings:
            self._apply(change)
        return dict(self.root.get("config", {}))

    def occupancy(self) -> DataFrame:
        """object, entries, live: how many of a run's entries the version still reads."""
        view = self.view()
        names = self.spark.createDataFrame([(i, r["object"], r["rows"]) for i, r in enumerate(view.manifest["runs"])], "idx int, object string, entries long")
        runs = self.spark.createDataFrame([(i, r["size"]) for i, r in enumerate(view.manifest["runs"])], "idx int, size long")
        live = V.resolve(view.entries(), runs, []).groupBy("idx").agg(F.count(F.lit(1)).alias("live"))
        return names.join(live, "idx", "left").select("object", "entries", F.coalesce("live", F.lit(0)).alias("live"))

    def maintain(self) -> dict:
        """One round of upkeep: Busy with staged changes; a chain that is long, or of which under half is still read, is
        written anew as one run (copied whole if all of it is live); then what nothing reaches is collected."""
        if self._staged:
            raise Busy("unsealed changes")
        config = self.root.get("config", {})
        done: dict = {"action": "idle", "collected": 0}
        if self.root["heads"].get(self.name):
            runs = self.view().manifest["runs"]
            sums = self.occupancy().agg(F.sum("entries").alias("e"), F.sum("live").alias("l")).first()
            if len(runs) > 1 and (len(runs) >= config.get("max_runs", V.MAX_RUNS) or 2 * (sums.l or 0) < (sums.e or 0)):
                self.compact()
                done["action"] = "compact"
        done["collected"] = len(self.collect(config.get("collect_budget", 8)))
        return done

    def relocate(self, budget_bytes: int) -> list[str]:
        """Copy reached objects within a byte budget; the copy becomes the preferred, first placement."""
        moved = []
        for obj in sorted({r["object"] for m in self.root["heads"].values() if m for r in self.root["manifests"][m]["runs"]}):
            n = self.backend.stat(self._place(obj)) or 0
            if n > budget_bytes:
                continue
            budget_bytes -= n
            to = f"run-{secrets.token_hex(8)}"
            self._read(obj).write.parquet(f"{self.backend.path}/{to}")

            def change(root: dict, obj=obj, to=to) -> dict:
                root["placements"][obj] = [to, *root["placements"].get(obj, [obj])][:64]
                return root

            self._apply(change)
            moved.append(obj)
        return moved

    def fingerprint(self) -> DataFrame:
        r = self.view().resolve()
        line = F.sha2(F.concat_ws("|", "page", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in self.values]), 256)
        return V.content_root(r.select("page", line.alias("checksum")))

    def mismatches(self) -> list[str]:
        """Objects of the head's chain whose rows no longer have the count and checksum recorded when they were sealed."""
        return [r["object"] for r in self.view().manifest["runs"] if self._checksum(r["object"]) != {"rows": r["rows"], "sum": r["sum"]}]

    def verify(self) -> int:
        """Recompute every run's recorded checksum and read every page of the head; a run that differs, and pages that
        are out of range or occur twice, stop it. Returns the number of pages."""
        if bad := self.mismatches():
            raise StoreError(f"objects differ from their recorded checksums: {bad}")
        view = self.view()
        r = view.resolve()
        bad = r.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("d"), F.max("page").alias("high"), F.min("page").alias("low")).first()
        if bad.n != bad.d or (bad.n and (bad.low < 1 or bad.high > view.size)):
            raise StoreError("the version isn't consistent")
        return bad.n

    def inspect(self) -> DataFrame:
        view = self.view()
        rows = [(i, r["object"], r["txid"], r["size"]) for i, r in enumerate(view.manifest["runs"])]
        runs = self.spark.createDataFrame(rows, "idx int, object string, txid long, size long")
        counts = view.entries().groupBy("idx").agg(F.count(F.when(F.col("op") == "put", 1)).alias("puts"), F.count(F.when(F.col("op") == "del", 1)).alias("tombstones"))
        return runs.join(counts, "idx", "left").select("idx", "txid", "size", F.coalesce("puts", F.lit(0)).alias("puts"), F.coalesce("tombstones", F.lit(0)).alias("tombstones"))


def import_table(spark: SparkSession, rows: DataFrame, path: str, values: str) -> Store:
    """A closed table becomes a sealed store: one checkpoint, verified before and after it is published."""
    store = Store(spark, path, values)
    before = rows.count()
    store.put(rows)
    store.seal()
    if store.verify() != before:
        raise StoreError("the import lost rows")
    return store


class ChunkedImport:
    """Import in key ranges, each a durable seal; pause and resume at any chunk, also from another process: how far it
    came is kept in the root, in the same swap as the chunk's seal. Rows written meanwhile win over the source."""

    def __init__(self, store: Store, source: DataFrame, pages: int, name: str = "import"):
        self.store, self.source, self.pages, self.name = store, source, pages, name
        store.refresh()

    @property
    def _state(self) -> dict:
        return self.store.root.get("imports", {}).get(self.name, {"next": 1, "paused": False})

    def _noted(self, **changes) -> Callable[[dict], dict]:
        def note(root: dict) -> dict:
            states = root.setdefault("imports", {})
            states[self.name] = {"next": 1, "paused": False, **states.get(self.name, {}), **changes}
            return root

        return note

    def pause(self) -> None:
        self.store._apply(self._noted(paused=True))

    def resume(self) -> None:
        self.store._apply(self._noted(paused=False))

    def step(self, chunk: int) -> bool:
        """One more chunk; False when done or paused."""
        state = self._state
        if state["paused"] or state["next"] > self.pages:
            return False
        first = state["next"]
        self.store.insert_or_ignore(self.source.where(F.col("page").between(first, first + chunk - 1)))
        self.store.seal(note=self._noted(next=first + chunk))
        return first + chunk <= self.pages

    def status(self) -> dict:
        state = self._state
        return {"imported": min(state["next"] - 1, self.pages), "pages": self.pages, "paused": state["paused"], "done": state["next"] > self.pages}


def export_table(store: Store, path: str) -> None:
    """Verify, then write every page; an existing target is an error."""
    store.verify()
    store.view().resolve().write.mode("errorifexists").parquet(path)
