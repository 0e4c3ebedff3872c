"""The keyed store as sorted runs: a run's changes are written beside what is there, and old rows are struck out, not rewritten.

Under the root lie, as Parquet that Spark writes: runs/<step>/ (posts in order of key, a range of keys a file), and for
each step what it added: summary/<step>/ (lowest and highest key and number of rows of each of its files), blooms/<step>/
(bitmaps of hashed keys of its files), dead/<step>/ (file and key of each row that a newer one replaces). A step is a
version and a name of its own, so writers never touch each other's folders. snapshots/<version>.json, made by one rename that never overwrites, lists the files of a version:
without it nothing of a step can be seen, and a reader of an older one goes on undisturbed.

An upsert looks its keys up: the ranges give at most one file a run, by a scan over file limits and keys together; the
bitmaps strike most of the others; only files that are left are read. Compaction rewrites small runs with the files
whose ranges they overlap, and files with many struck rows; all others are carried over by name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import Scan
from .store import FLAGS, HIGHEST, LATEST, LONGEST, merged, upsert

STATE = [*FLAGS, *HIGHEST, *LONGEST, *LATEST]
#: Bits of a file's bitmaps for each key (3 % of the keys that a file lacks seem to be there), and of one bitmap.
BITS, BITMAP = 32, 32_768
#: Keys of a batch whose hashes may be broadcast; and how many times a larger batch's rows those of its files may be, to go along whole.
KEYS, ALONG = 1_000_000, 4


class RunStore:
    """One row a key. rows_per_file bounds files; a run of fewer rows than `small` times that counts as small."""

    def __init__(self, spark: SparkSession, root: str, key: str = "post_key", rows_per_file: int = 1_000_000, small: int = 8):
        self.spark, self.root, self.key, self.rows_per_file, self.small = spark, root.rstrip("/"), key, rows_per_file, small
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    # snapshots
    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/snapshots")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> dict:
        """{"version", "files": {file: [step, rows, dead rows]}, "dead": [steps whose lists strike rows of these files]} of
        a version, the newest if none is named."""
        known = self.versions()
        if not known:
            return {"version": -1, "files": {}, "dead": []}
        lines = self.spark.read.text(f"{self.root}/snapshots/{known[-1] if version is None else version}.json", wholetext=True).collect()
        return json.loads(lines[0][0])

    def _commit(self, version: int, files: dict[str, list], dead: list[str]) -> None:
        """Fails where another writer has made this version."""
        folder = self._path(f"{self.root}/snapshots")
        self._fs.mkdirs(folder)
        fresh, final = self._path(f"{self.root}/snapshots/_{version}"), self._path(f"{self.root}/snapshots/{version}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps({"version": version, "files": files, "dead": dead}).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(fresh, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    # files
    def _tables(self, kind: str, files: dict[str, list]) -> DataFrame | None:
        """A table that each step has, over the steps that files name."""
        paths = [p for v in sorted({f[0] for f in files.values()}) if self._fs.exists(self._path(p := f"{self.root}/{kind}/{v}"))]
        return self.spark.read.parquet(*paths) if paths else None

    def _rows(self, files: list[str]) -> DataFrame:
        data = self.spark.read.parquet(*[f"{self.root}/runs/{f}" for f in files])
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([^/]+/[^/]+)$", 1)
        return data.select(self.key, "seq", *STATE, name.alias("_file"))

    def _live(self, files: dict[str, list], dead: DataFrame | None) -> DataFrame:
        """The rows of the files that no newer row replaces. Only files with such rows meet the list of them."""
        whole, struck = [f for f, x in files.items() if not x[2]], [f for f, x in files.items() if x[2]]
        out = self._rows(whole) if whole else None
        if struck:
            rest = self._rows(struck).join(dead.select("_file", self.key), ["_file", self.key], "left_anti")
            out = rest if out is None else out.unionByName(rest)
        return out

    def _dead(self, now: dict) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/dead/{v}" for v in now["dead"]]) if now["dead"] else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """One row a key, as of a version (the newest if none is named)."""
        now = self.snapshot(version)
        return self._live(now["files"], self._dead(now)).drop("_file") if now["files"] else None

    def _files(self, rows: int) -> int:
        return max(1, -(-rows // self.rows_per_file))

    def _write_run(self, rows: DataFrame, step: str, most: int | None) -> dict[str, list]:
        """Writes rows, at most `most` (None: they lie in ranges already), in order of key, then the summary and the bitmaps of the files."""
        rows = rows if most is None else rows.repartitionByRange(self._files(most), self.key)
        rows.sortWithinPartitions(self.key).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/runs/{step}")
        keys = self.spark.read.parquet(f"{self.root}/runs/{step}").select(self.key, F.regexp_extract(F.col("_metadata.file_path"), r"/runs/([^/]+/[^/]+)$", 1).alias("_file"))
        each = keys.groupBy("_file").agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count(F.lit(1)).alias("n"))
        each.write.mode("overwrite").parquet(f"{self.root}/summary/{step}")
        summary = self.spark.read.parquet(f"{self.root}/summary/{step}")
        fresh = sorted(summary.filter("low is not null").collect(), key=lambda r: r["low"])  # a row a file
        if any(a["high"] >= b["low"] for a, b in zip(fresh, fresh[1:])):
            raise ValueError(f"files of {step} overlap: keys would not be found")
        placed = keys.join(summary.select("_file", "n"), "_file").select("_file", *self._bit())
        blooms = placed.groupBy("_file", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
        blooms.write.mode("overwrite").parquet(f"{self.root}/blooms/{step}")
        return {r["_file"]: [step, r["n"], 0] for r in summary.select("_file", "n").collect()}  # a row a file

    def _bit(self) -> tuple:
        """bitmap, bit: where the key is marked in the bitmaps of a file of n rows."""
        count = F.ceil(F.col("n") * BITS / BITMAP)
        at = F.pmod(F.xxhash64(self.key), count * BITMAP)
        return F.floor(at / BITMAP).cast("int").alias("bitmap"), F.pmod(at, F.lit(BITMAP)).alias("bit")

    # changes
    def holders(self, keys: DataFrame, files: dict[str, list]) -> DataFrame:
        """_file and key of each file that may hold a key: one file a run by range, if its bitmaps have the key."""
        summary = self._tables("summary", files)
        names = self.spark.createDataFrame([(f, v[0]) for f, v in files.items()], "_file string, run string")
        summary = summary.join(names, "_file")
        limits = summary.select("run", F.col("low").alias(self.key), F.lit(0).alias("asked"), F.struct("_file", "high", "n").alias("file"))
        runs = sorted({x[0] for x in files.values()})
        asked = keys.select(self.key).withColumn("run", F.explode(F.lit(runs))).select("run", self.key, F.lit(1).alias("asked"), F.lit(None).cast(limits.schema["file"].dataType).alias("file"))
        found = Scan(limits.unionByName(asked), ["run"], [self.key, "asked"]).running(of=("last", F.col("file")))
        found = found.filter((F.col("asked") == 1) & (F.col(self.key) <= F.col("of.high"))).select(self.key, "of._file", "of.n").select("_file", self.key, *self._bit())
        blooms = self._tables("blooms", files)
        byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        marked = found.join(blooms, ["_file", "bitmap"]).filter(F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)), F.lit(2)) == 1)
        return marked.select("_file", self.key)

    def _known(self, touched: dict[str, list], dead: DataFrame | None, batch: DataFrame, most: int) -> tuple[DataFrame, int]:
        """The rows of the touched files that meet the batch, and how many rows they and the batch are at most. Whole rows of the
        store are not moved for this alone: a batch of few keys is broadcast as hashes (others that share one come out
        unchanged); of a large one all rows of its files go along, as they are moved once then."""
        known, stored = self._live(touched, dead), sum(n - struck for _, n, struck in touched.values())
        if most <= KEYS:
            hashes = batch.select(F.xxhash64(self.key).alias("_hash")).distinct()
            return known.withColumn("_hash", F.xxhash64(self.key)).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash"), most
        if stored <= ALONG * most:
            return known, stored + most
        return known.join(batch.select(self.key), self.key, "left_semi"), most

    def upsert(self, live: DataFrame) -> DataFrame:
        """Merges live (key, seq and fields, several rows a key or none) into the store as a new version. Returns the rows that
        changed: key, change (new or updated), before and now, structs of seq and the fields. A sighting that changes no field
        is not written, so its row keeps its seq. A batch without changes makes no version. `touched` counts files. What was is read from the files that held it:
        use the result before the next expire()."""
        now = self.snapshot()
        version = now["version"] + 1
        step, known, touched = f"{version}-{uuid.uuid4().hex[:12]}", None, {}
        batch, most = merged(live, self.key).drop("n_seen"), None
        if now["files"]:
            batch.write.option("compression", "zstd").parquet(f"{self.root}/batches/{step}")
            batch = self.spark.read.parquet(f"{self.root}/batches/{step}")
            most = batch.count()
            self.holders(batch, now["files"]).write.parquet(f"{self.root}/holders/{step}")
            holders = self.spark.read.parquet(f"{self.root}/holders/{step}")
            touched = {r[0]: now["files"][r[0]] for r in holders.select("_file").distinct().collect()}  # a row a file
            if touched:
                known, rows = self._known(touched, self._dead(now), batch, most)
        self.touched = {"read": len(touched), "of": len(now["files"]), "written": 0}
        if known is None:
            changed = batch.withColumns({"change": F.lit("new"), "replaces": F.lit(None).cast("string")})
        else:
            changed = upsert(known, batch, self.key, unique=True, ranges=self._files(rows), replaces=F.max("_file")).filter("change <> 'unchanged'")
        changed = changed.select(self.key, "seq", *STATE, "change", "replaces")
        fresh = self._write_run(changed, step, None if known is not None else live.count() if most is None else most)
        run = self.spark.read.parquet(f"{self.root}/runs/{step}")
        files, dead = dict(now["files"]), list(now["dead"])
        if touched:
            gone = run.filter("replaces is not null").select(F.col("replaces").alias("_file"), self.key)
            gone.write.parquet(f"{self.root}/dead/{step}")
            for r in self.spark.read.parquet(f"{self.root}/dead/{step}").groupBy("_file").count().collect():  # a row a file
                v, n, struck = files[r[0]]
                files[r[0]] = [v, n, struck + r[1]]
            files = {f: x for f, x in files.items() if x[2] < x[1]}  # a file without a living row is no longer named
            dead.append(step)
        if fresh:
            self.touched["written"] = len(fresh)
            self._commit(version, files | fresh, dead)
        for kind in ("batches", "holders"):
            self._fs.delete(self._path(f"{self.root}/{kind}/{step}"), True)
        state = F.struct("seq", *STATE)
        out = run.select(self.key, "change", state.alias("now"))
        if not touched:
            return out.select(self.key, "change", F.lit(None).cast(out.schema["now"].dataType).alias("before"), "now")
        before = self._live(touched, self._dead(now)).select(self.key, state.alias("before"))
        return out.join(before, self.key, "left").select(self.key, "change", "before", "now")

    def compact(self, most_dead: float = 0.3) -> dict[str, int]:
        """Rewrites the files of small runs with the files that their ranges overlap, and files with more than most_dead struck
        rows, as one run; returns how many files were rewritten, carried over and written."""
        now = self.snapshot()
        files, runs = now["files"], {}
        for v, n, _ in files.values():
            runs[v] = runs.get(v, 0) + n
        largest = max(runs.values(), default=0)
        few = {v for v, n in runs.items() if n < min(largest, self.small * self.rows_per_file)}
        names = self.spark.createDataFrame([(f, x[0] in few) for f, x in files.items()], "_file string, chosen boolean")
        summary = self._tables("summary", files)
        if summary is None:
            return {"rewritten": 0, "carried": 0, "written": 0}
        ranges = summary.join(names, "_file").select("_file", "low", "high", "chosen")
        # limits in order of key: how many chosen files have begun, and how far those reach
        begun = ranges.filter("chosen").select(F.col("low").alias("at"), F.lit(0).alias("kind"), "_file", F.lit(1).alias("add"), F.col("high").alias("end"))
        limits = [ranges.select(F.col(c).alias("at"), F.lit(k).alias("kind"), "_file", F.lit(0).alias("add"), F.lit(None).cast("string").alias("end")) for k, c in ((1, "low"), (2, "high"))]
        sweep = Scan(begun.unionByName(limits[0]).unionByName(limits[1]), [], ["at", "kind", "_file"]).running(n=("sum", F.col("add")), reach=("max", F.col("end")))
        at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        met = sweep.groupBy("_file").agg((F.coalesce(at(1, "reach") >= at(1, "at"), F.lit(False)) | (at(2, "n") > at(1, "n"))).alias("met"))
        picked = met.filter("met").select("_file")
        # a row a file; files with many struck rows need none of those that they overlap
        chosen = {r[0]: files[r[0]] for r in picked.collect()} | {f: x for f, x in files.items() if x[2] > most_dead * x[1]}
        if len(chosen) < 2 and not any(x[2] for x in chosen.values()):
            return {"rewritten": 0, "carried": len(files), "written": 0}
        version = now["version"] + 1
        rows = self._live(chosen, self._dead(now)).drop("_file").withColumns({"change": F.lit("compacted"), "replaces": F.lit(None).cast("string")})
        fresh = self._write_run(rows, f"{version}-{uuid.uuid4().hex[:12]}", sum(x[1] - x[2] for x in chosen.values()))
        carried = {f: x for f, x in files.items() if f not in chosen}
        struck, dead = [f for f, x in carried.items() if x[2]], self._dead(now)
        still = dead.filter(F.col("_file").isin(struck)).select(F.regexp_extract(F.col("_metadata.file_path"), r"/dead/([^/]+)/", 1).alias("v")).distinct() if struck else None
        self._commit(version, carried | fresh, sorted(r[0] for r in still.collect()) if struck else [])  # a row a version
        return {"rewritten": len(chosen), "carried": len(files) - len(chosen), "written": len(fresh)}

    def expire(self, keep: int = 2) -> list[int]:
        """Removes all snapshots but the newest `keep`, and what no kept one names (what dead writers left, too); returns the versions that are left."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/snapshots/{v}.json"), False)
        kept = [self.snapshot(v) for v in known[-keep:]]
        named = {x[0] for k in kept for x in k["files"].values()} | {v for k in kept for v in k["dead"]}
        for kind in ("runs", "summary", "blooms", "dead", "batches", "holders"):
            at = self._path(f"{self.root}/{kind}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                name = s.getPath().getName()
                if int(name.split("-")[0]) <= known[-1] and name not in named:
                    self._fs.delete(s.getPath(), True)
        return known[-keep:]
