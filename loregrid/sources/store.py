"""Bucketed tables with a commit file for each version: a change rewrites the buckets it touches."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import lifecycle

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one wanted to."""


@dataclass
class Version:
    """What a commit file says: the schema, the key, and the folders that make up each bucket.

    Every folder belongs to a tag, the write that made it; ``info`` holds what a write said of itself.
    """

    number: int
    schema: str
    key: str | None
    buckets: int
    parts: dict[str, list[str]]
    info: dict[str, dict] = field(default_factory=dict)

    def folders(self) -> set[str]:
        return {p for paths in self.parts.values() for p in paths}


def bucket_of(value: str | None, buckets: int) -> int:
    """The bucket of a key, as ``bucket`` has it."""
    return zlib.crc32((value or "").encode()) % buckets


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int")


class Store:
    """Named tables below ``root``; a table's rows are dealt to buckets by a hash of its key.

    A writer writes new folders beside the others and then publishes a commit file with the
    next number, which either happens or not: readers see one version or the next, and a
    plan may read the table that it changes. A commit file is made only where none is: by a
    hard link on the local file system, elsewhere by a rename that does not overwrite. So of
    two writers that began from the same version, the later one to finish gets ``Conflict``
    and its folders are deleted. The ``keep`` latest versions stay, for plans that began before.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 4, buckets: int = 16):
        self.spark, self.root, self.keep, self.buckets = spark, root.rstrip("/"), keep, buckets
        self._seen: dict[str, int] = {}

    # files
    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, fs = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        at, fs = self._fs(path)
        fs.delete(at, True)

    def _text(self, path: str) -> str:
        at, fs = self._fs(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, path: str, text: str) -> bool:
        """Make a file that is not there yet, whole or not at all; false if it is there."""
        folder, _, name = path.rpartition("/")
        at, fs = self._fs(folder)
        fs.mkdirs(at)
        at = fs.resolvePath(at)  # behind mount points
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        source, target = (jvm.org.apache.hadoop.fs.Path(at, n) for n in (f".draft-{uuid.uuid4().hex}", name))
        stream = fs.create(source, False)
        stream.write(text.encode())
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, source)])
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(source, target, gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Exception:
            if fs.exists(target):
                return False
            raise
        finally:
            fs.delete(source, False)
        return True

    # versions
    def version(self, name: str) -> Version | None:
        """The current version of a table."""
        found = max((n for n in self._names(f"{self.root}/{name}/log") if n.endswith(".json") and not n.startswith(".")), default=None)
        return Version(**json.loads(self._text(f"{self.root}/{name}/log/{found}"))) if found else None

    def _known(self, name: str) -> Version:
        if (found := self.version(name)) is None:
            raise KeyError(name)
        return found

    def exists(self, name: str) -> bool:
        return self.version(name) is not None

    def _commit(self, name: str, base: Version | None, new: Version, made: list[str]) -> None:
        if (began := self._seen.pop(name, None)) is not None and base and base.number != began:
            ok = False
        else:
            ok = self._publish(f"{self.root}/{name}/log/{new.number:012d}.json", json.dumps(asdict(new)))
        if not ok:
            for folder in made:
                self._delete(f"{self.root}/{name}/{folder}")
            raise Conflict(f"{name} has been changed meanwhile")
        self._expire(name, new)

    def _expire(self, name: str, new: Version) -> None:
        """Delete the versions before the latest ``keep`` and the folders that only they had."""
        log = f"{self.root}/{name}/log"
        numbers = sorted(n for n in self._names(log) if n.endswith(".json") and not n.startswith("."))
        if not (old := numbers[: -self.keep]):
            return
        read = lambda n: Version(**json.loads(self._text(f"{log}/{n}")))
        kept = set().union(*(read(n).folders() for n in numbers[-self.keep :]))
        for n in old:
            for folder in read(n).folders() - kept:
                self._delete(f"{self.root}/{name}/{folder}")
            self._delete(f"{log}/{n}")

    def _write(self, name: str, rows: DataFrame, key: str | None, buckets: int, tag: str, sort: tuple[str, ...] = (), after: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, list[str]]:
        """Write rows to a new folder for each bucket; returns those that have rows."""
        folder = f"data/{tag}"
        dealt = rows.withColumn(_BUCKET, F.lit(0) if key is None else bucket(key, buckets))
        if key is not None and after is None:
            dealt = dealt.hint("rebalance", _BUCKET)  # splits what is large, whatever the key
        if sort:
            dealt = dealt.sortWithinPartitions(_BUCKET, *sort)
        if after is not None:
            dealt = after(dealt)
        dealt.write.partitionBy(_BUCKET).option("parquet.writer.version", "PARQUET_2_0").parquet(f"{self.root}/{name}/{folder}")
        return {n.rpartition("=")[2]: [f"{folder}/{n}"] for n in self._names(f"{self.root}/{name}/{folder}") if n.startswith(f"{_BUCKET}=")}

    # reading
    def read(self, name: str, buckets: Iterable[int] | None = None, tags: Iterable[str] | None = None) -> DataFrame:
        """The current rows; of some buckets or writes alone, only their folders are listed and read."""
        now = self._known(name)
        self._seen.setdefault(name, now.number)
        return self._rows(name, now, buckets, tags)

    def _rows(self, name: str, now: Version, buckets: Iterable[int] | None = None, tags: Iterable[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.schema))
        wanted = now.parts if buckets is None else [str(b) for b in sorted(set(buckets)) if str(b) in now.parts]
        folders = [p for b in wanted for p in now.parts[b]]
        if tags is not None:
            live = set(tags)
            folders = [p for p in folders if p.split("/")[1] in live]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{p}" for p in folders])

    def version_columns(self, name: str) -> list[str]:
        return StructType.fromJson(json.loads(self._known(name).schema)).names

    def lookup(self, name: str, *values: str) -> DataFrame:
        """The rows of the given keys, from their buckets."""
        now = self._known(name)
        return self.read(name, [bucket_of(v, now.buckets) for v in values]).where(F.col(now.key).isin(*values))

    # writing
    def create(self, name: str, schema: str, key: str) -> None:
        """An empty table, if there is none."""
        if not self.exists(name):
            empty = Version(0, StructType.fromDDL(schema).json(), key, self.buckets, {})
            self._publish(f"{self.root}/{name}/log/{0:012d}.json", json.dumps(asdict(empty)))

    def replace(self, name: str, rows: DataFrame, key: str | None = None) -> None:
        """All rows of a table; the first time it is made, with its key."""
        base = self.version(name)
        key, buckets = (base.key, base.buckets) if base else (key, self.buckets if key else 1)
        tag = uuid.uuid4().hex
        parts = self._write(name, rows, key, buckets, tag)
        self._commit(name, base, Version(base.number + 1 if base else 0, rows.schema.json(), key, buckets, parts), [f"data/{tag}"])

    def append(self, name: str, rows: DataFrame | None, tag: str | None = None, sort: tuple[str, ...] = (), forget: Iterable[str] = (), after: Callable[[DataFrame], DataFrame] | None = None, **info) -> None:
        """Add rows, if any, beside the others, as a write named ``tag``; the writes in ``forget`` go.

        With ``after`` rows are not shuffled: each task sorts its own, makes their last columns by
        it, and writes its own files.
        """
        base = self._known(name)
        tag = tag or uuid.uuid4().hex
        made = {} if rows is None else self._write(name, rows, base.key, base.buckets, tag, sort, after)
        gone = set(forget)
        parts = {b: left for b, p in base.parts.items() if (left := [x for x in p if x.split("/")[1] not in gone])}
        for b, p in made.items():
            parts[b] = parts.get(b, []) + p
        says = {t: i for t, i in base.info.items() if t not in gone} | {tag: info}
        self._commit(name, base, Version(base.number + 1, base.schema, base.key, base.buckets, parts, says), [f"data/{tag}"])

    def rewrite(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Change the buckets that hold any of ``keys``: their rows become what ``change`` makes of them.

        Returns the buckets. Rows that ``change`` adds must have one of the keys.
        """
        base = self._known(name)
        touched = sorted(r.b for r in keys.select(bucket(base.key, base.buckets).alias("b")).distinct().collect())
        if not touched:
            self._seen.pop(name, None)
            return []
        old = self._rows(name, base, touched)
        new = change(old)
        more = [f for f in new.schema.fields if f.name not in old.columns]
        schema = StructType(old.schema.fields + more)
        tag = uuid.uuid4().hex
        made = self._write(name, new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]), base.key, base.buckets, tag)
        parts = {b: p for b, p in base.parts.items() if int(b) not in touched} | made
        self._commit(name, base, Version(base.number + 1, schema.json(), base.key, base.buckets, parts, base.info), [f"data/{tag}"])
        return touched

    def upsert(self, name: str, rows: DataFrame, *keys: str) -> None:
        """Rows in place of those of the same ``keys``, the first of which is the table's own."""
        if not self.exists(name):
            self.replace(name, rows, keys[0])
            return
        self.rewrite(name, rows, lambda old: lifecycle.upsert(old, rows, *keys))

    def append_new(self, name: str, rows: DataFrame, *keys: str) -> None:
        """Add the rows whose keys are not stored yet."""
        once = rows.dropDuplicates(list(keys))
        if not self.exists(name):
            self.replace(name, once, keys[0])
            return
        self.rewrite(name, once, lambda old: old.unionByName(once.join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True))

    def delete(self, name: str, ids: DataFrame | None = None, where: Column | None = None, key: str | None = None) -> None:
        """Delete by ids, by a condition, or both; with neither nothing happens."""
        if ids is None and where is None:
            return
        own = self._known(name).key
        key = key or own
        hit = self.read(name)
        hit = hit if ids is None else hit.join(ids.select(key).distinct(), key, "left_semi")
        keys = ids if where is None and key == own else (hit if where is None else (hit if ids is None else self.read(name)).where(where)).select(own)
        if ids is not None and where is not None:
            keys = keys.unionByName(hit.select(own))
        self.rewrite(name, keys, lambda old: lifecycle.delete(old, ids, where, key))

    # intermediate tables
    def held(self, rows: DataFrame, call: str) -> DataFrame:
        """``rows`` written below ``root`` and read again, until ``release`` of the same call: lineage ends there."""
        path = f"{self.root}/_held/{call}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def release(self, call: str) -> None:
        """Delete what one call holds; nothing may read it any more."""
        self._delete(f"{self.root}/_held/{call}")
