"""A keyed table in the shared folder that batches of rows are merged into: last write wins, commits are atomic, work is resumed from it.

Rows are dealt into buckets by a hash of their key. A commit writes its rows as a delta and then one manifest, a small file whose
name is the next version; readers take the highest version and never see half a commit, and of two writers of one version
one fails and changes nothing. When deltas have gathered, the buckets that they touch are merged with theirs of before and
written anew; the others stay as they are. What a crash leaves behind is in no manifest, so nothing reads it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import delete
from .files import exists


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class KeyedStore:
    """keys: the key's columns; schema: of key and value columns. The number of buckets is fixed when the store is made."""

    def __init__(self, spark: SparkSession, at: str, keys: list[str], schema: str, buckets: int = 64, most_deltas: int = 4):
        self.spark, self.at, self.keys, self.most_deltas = spark, at.rstrip("/"), keys, most_deltas
        self.schema = spark.createDataFrame([], schema).schema
        self.buckets = (self._manifest() or {}).get("buckets", buckets)

    def _versions(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/manifests")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self) -> dict | None:
        versions = self._versions()
        if not versions:
            return None
        text = self.spark.read.text(f"{self.at}/manifests/{versions[-1]}.json", wholetext=True).first()["value"]
        return json.loads(text)

    def _switch(self, manifest: dict) -> None:
        """Writes the manifest under another name and renames it, which fails if the version is there."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.at}/manifests/{name}")
        draft, final = path(f"draft-{uuid.uuid4().hex}"), path(f"{manifest['version']}.json")
        fs = draft.getFileSystem(conf)
        out = fs.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, final, none)
        except Exception as e:
            fs.delete(draft, False)
            if exists(self.spark, final.toString()):
                raise Conflict(f"version {manifest['version']} of {self.at} is there already") from e
            raise

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema) + ", _commit long, _gone boolean, _bucket int"

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.at}/data/{name}")
        return name

    def _base(self, manifest: dict, of: list[int] | None = None) -> DataFrame | None:
        """The merged rows, of some buckets; each bucket lies in the folder that last merged it."""
        by_folder: dict[str, list[int]] = {}
        for b, folder in manifest["base"].items():
            if of is None or int(b) in of:
                by_folder.setdefault(folder, []).append(int(b))
        out = None
        for folder, bs in by_folder.items():
            rows = self.spark.read.schema(self._stored()).parquet(f"{self.at}/data/{folder}").where(F.col("_bucket").isin(bs))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _deltas(self, manifest: dict) -> DataFrame | None:
        """The last row of each key in the deltas; a commit holds a key once."""
        out = None
        for name in manifest["deltas"]:
            rows = self.spark.read.schema(self._stored()).parquet(f"{self.at}/data/{name}")
            out = rows if out is None else out.unionByName(rows)
        if out is None or len(manifest["deltas"]) == 1:
            return out
        values = [c for c in out.columns if c not in (*self.keys, "_bucket")]
        last = out.groupBy("_bucket", *self.keys).agg(F.max_by(F.struct(*values), "_commit").alias("x"))
        return last.select(*self.keys, "_bucket", "x.*").select(*out.columns)

    def _merged(self, manifest: dict, of: list[int] | None = None) -> DataFrame | None:
        """Last writes, tombstones included."""
        base, deltas = self._base(manifest, of), self._deltas(manifest)
        if deltas is not None and of is not None:
            deltas = deltas.where(F.col("_bucket").isin(of))
        if base is None or deltas is None:
            return deltas if base is None else base
        same = base["_bucket"] == deltas["_bucket"]
        for k in self.keys:
            same = same & base[k].eqNullSafe(deltas[k])
        return base.join(deltas, same, "left_anti").unionByName(deltas)

    def rows(self) -> DataFrame:
        """All rows as of the last commit."""
        manifest = self._manifest()
        merged = self._merged(manifest) if manifest else None
        if merged is None:
            return self.spark.createDataFrame([], self.schema)
        return merged.where(~F.col("_gone")).select(*self.schema.names)

    def get(self, **key) -> list:
        """The row of one key, if there is one; reads its bucket only."""
        manifest = self._manifest()
        if not manifest:
            return []
        one = self.spark.createDataFrame([tuple(key[k] for k in self.keys)], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema if f.name in self.keys))
        b = one.select(self.bucket().alias("b")).first()["b"]
        merged = self._merged(manifest, [b])
        if merged is None:
            return []
        for k in self.keys:
            merged = merged.where(F.col(k).eqNullSafe(F.lit(key[k])))
        return merged.where(~F.col("_gone")).select(*self.schema.names).collect()

    def _commit(self, rows: DataFrame, gone: bool, facts: dict | None = None) -> int:
        manifest = self._manifest() or {"version": 0, "buckets": self.buckets, "base": {}, "deltas": [], "facts": {}}
        version = manifest["version"] + 1
        named = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema])
        delta = self._write(named.withColumns({"_commit": F.lit(version).cast("long"), "_gone": F.lit(gone), "_bucket": self.bucket()}))
        new = manifest | {"version": version, "deltas": [*manifest["deltas"], delta], "facts": manifest["facts"] | (facts or {})}
        if len(new["deltas"]) > self.most_deltas:
            new |= self._compacted(new)
        self._switch(new)
        return version

    def _compacted(self, manifest: dict) -> dict:
        """base and deltas after the touched buckets are merged and written anew; tombstones go."""
        touched = [r["_bucket"] for r in self._deltas(manifest).select("_bucket").distinct().collect()]  # at most `buckets` numbers
        folder = self._write(self._merged(manifest, touched).where(~F.col("_gone")))
        left = {b: f for b, f in manifest["base"].items() if int(b) not in touched}
        return {"base": left | {str(b): folder for b in touched}, "deltas": []}

    def upsert(self, rows: DataFrame, order: list[str] | None = None, facts: dict | None = None) -> int:
        """Commits rows (key and value columns; others are dropped) and gives the version. Of rows that share a key the last in
        `order` counts (without an order: any one). facts: small values kept with the version, for progress."""
        values = [c for c in rows.columns if c not in self.keys]
        rank = F.struct(*order) if order else F.lit(0)
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(0).alias("_"), *values), rank).alias("x"))
        return self._commit(last.select(*self.keys, *[F.col(f"x.{c}").alias(c) for c in values]), False, facts)

    def remove(self, keys: DataFrame) -> int:
        return self._commit(keys.select(*self.keys).distinct(), True)

    def facts(self) -> dict:
        return (self._manifest() or {}).get("facts", {})

    def clean(self) -> None:
        """Deletes data and drafts that no manifest of the last version names, and older manifests. No reader of them may be running."""
        manifest, versions = self._manifest(), self._versions()
        if not manifest:
            return
        live = {*manifest["deltas"], *manifest["base"].values()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(f"{self.at}/data")
        for s in data.getFileSystem(conf).listStatus(data):
            if s.getPath().getName() not in live:
                delete(self.spark, s.getPath().toString())
        for v in versions[:-1]:
            delete(self.spark, f"{self.at}/manifests/{v}.json")


def resume(work: DataFrame, store: KeyedStore, solve: Callable[[DataFrame], DataFrame], parts: int = 8) -> int:
    """Solves the rows of work whose key the store lacks, a part (by the key's hash) at a time, each committed before the next is
    begun; gives how many parts were solved. A run that is stopped and started again solves only the parts that weren't committed.

    solve: from rows of work to rows of the store with the same keys.
    """
    part = F.pmod(F.xxhash64(*store.keys, F.lit(3)), F.lit(parts))
    solved = 0
    for p in range(parts):
        done = store.rows().select(*store.keys)
        todo = work.where(part == p).join(done, store.keys, "left_anti")
        if todo.limit(1).count():
            store.upsert(solve(todo))
            solved += 1
    return solved
