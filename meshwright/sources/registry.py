"""Versions of a table: immutable snapshots, a log of commits, and a registry that is the log folded.

A snapshot is a Parquet folder that is never changed; a version starts as a second name for its parent's snapshot, so making one copies
nothing. Every change is a commit: a file with the next number, created only if no other writer took that number (optimistic, no
lock). A writer that loses looks at what was committed meanwhile and gives up if that touched what it read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators import versions as ops

DEFAULT = "default"
STATUSES = ("Design", "Review", "Approved", "Posted")
ACCESS = ("Public", "Protected", "Private")
REGISTRY = "name string, description string, owner string, status string, access string, work_order string, parent string, created string, modified string, posted string, posted_counts string"
SLUG_LENGTH = 40


class VersionError(ValueError):
    """A request that the registry refuses."""


class Conflict(VersionError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Branch:
    """One version, or the default: its snapshot, and the parent's snapshot that it was last reconciled with."""

    name: str
    snapshot: str
    base: str | None = None
    parent: str | None = None
    description: str = ""
    owner: str = ""
    status: str = "Design"
    access: str = "Public"
    work_order: str = ""
    created: str = ""
    modified: str = ""
    posted: str | None = None
    posted_counts: str | None = None


def slug(name: str | None) -> str:
    """The name as the registry keeps it: letters, digits and underlines, lower case, up to 40."""
    marks = [x if x.isascii() and x.isalnum() else "_" for x in (name or "").strip()]
    text = "_".join(part for part in "".join(marks).split("_") if part)
    if not text:
        raise VersionError("Give the version a name (letters and digits).")
    return text.lower()[:SLUG_LENGTH]


class Store:
    """A versioned table in a folder that all executors share. ``keys`` name a row, ``fields`` are compared."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], fields: Sequence[str], clock: Callable[[], str] | None = None) -> None:
        self.spark, self.root, self.keys, self.fields = spark, root.rstrip("/"), list(keys), list(fields)
        self._clock = clock or (lambda: str(spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("t")).first().t))
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = path
        conf = spark._jsc.hadoopConfiguration()
        self._files = path(self.root).getFileSystem(conf)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._context = hadoop.FileContext.getFileContext(self._files.makeQualified(path(self.root)).toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)

    # ------------------------------------------------------------ the log

    def _commits(self) -> list[dict]:
        """All commits in order; a few bytes each."""
        log = self._path(f"{self.root}/_log")
        if not self._files.exists(log):
            return []
        out = []
        for n in sorted(s.getPath().getName() for s in self._files.listStatus(log) if s.getPath().getName().endswith(".json")):
            source = self._files.open(self._path(f"{self.root}/_log/{n}"))
            try:
                text = bytes(source.readAllBytes()).decode()
            finally:
                source.close()
            out.append(json.loads(text))
        return out

    def _commit(self, number: int, entry: dict) -> bool:
        """Write commit ``number`` as a whole; false if another writer has it. The store's file system must refuse to rename onto a file."""
        log = self._path(f"{self.root}/_log")
        self._files.mkdirs(log)
        draft, name = self._path(f"{self.root}/_log/.draft-{uuid.uuid4().hex}"), self._path(f"{self.root}/_log/{number:012d}.json")
        sink = self._files.create(draft, False)
        sink.write(bytearray(json.dumps(entry).encode()))
        sink.close()
        try:
            self._context.rename(draft, name, self._plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._files.delete(draft, False)
            return False
        return True

    def _branches(self, commits: list[dict]) -> dict[str, Branch]:
        out: dict[str, Branch] = {}
        for x in commits:
            if x.get("dropped"):
                out.pop(x["dropped"], None)
            for b in x.get("branches", []):
                out[b["name"]] = Branch(**b)
        return out

    def _change(self, change: Callable[[dict[str, Branch]], dict]) -> None:
        """Commit what ``change`` makes of the branches; if another writer took the number, ``change`` looks at what that one left, and may refuse."""
        while True:
            commits = self._commits()
            if self._commit(len(commits) + 1, change(self._branches(commits))):
                return

    def _snapshot(self, df: DataFrame) -> str:
        name = f"s-{uuid.uuid4().hex}"
        df.select(*self.keys, *self.fields).write.parquet(f"{self.root}/{name}")
        return name

    def _rows(self, snapshot: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{snapshot}")

    # ------------------------------------------------------------ versions

    def empty(self) -> bool:
        return not self._commits()

    def branch(self, name: str = DEFAULT) -> Branch:
        found = self._branches(self._commits()).get(name)
        if found is None:
            raise VersionError(f"There is no version named {name}.")
        return found

    def read(self, name: str = DEFAULT) -> DataFrame:
        return self._rows(self.branch(name).snapshot)

    def begin(self, df: DataFrame) -> None:
        """The first state of the default."""
        first = Branch(DEFAULT, self._snapshot(df), created=self._clock())

        def change(now: dict[str, Branch]) -> dict:
            if now:
                raise VersionError("The store has a default already.")
            return {"branches": [first.__dict__]}

        self._change(change)

    def versions(self, user: str | None = None) -> DataFrame:
        """The registry, oldest first; private versions of others are left out for a user."""
        found = [b for b in self._branches(self._commits()).values() if b.name != DEFAULT and (user is None or b.access != "Private" or b.owner == user)]
        names = [f.split()[0] for f in REGISTRY.split(", ")]
        rows = [tuple(getattr(b, n) for n in names) for b in sorted(found, key=lambda b: (b.created, b.name))]
        return self.spark.createDataFrame(rows, REGISTRY)

    def create(self, name: str, parent: str = DEFAULT, description: str = "", access: str = "Public", owner: str = "", work_order: str = "") -> str:
        """A new version of the default or of another version; returns its name."""
        kept, time = slug(name), self._clock()

        def change(now: dict[str, Branch]) -> dict:
            if kept in now:
                raise VersionError(f"A version named {kept} already exists.")
            if parent not in now:
                raise VersionError(f"There is no version named {parent}.")
            at = now[parent].snapshot
            known = access if access in ACCESS else "Public"
            made = Branch(kept, at, at, parent, description, owner, "Design", known, work_order, time, time)
            return {"branches": [made.__dict__]}

        self._change(change)
        return kept

    def update(self, name: str, **values: str) -> None:
        """Set status, description, access, work_order or owner."""
        if values.get("status", STATUSES[0]) not in STATUSES:
            raise VersionError(f"Unknown status {values['status']}.")
        unknown = set(values) - {"status", "description", "access", "work_order", "owner"}
        if unknown:
            raise VersionError(f"Not to be set: {', '.join(sorted(unknown))}.")
        time = self._clock()

        def change(now: dict[str, Branch]) -> dict:
            if name not in now:
                raise VersionError(f"There is no version named {name}.")
            return {"branches": [replace(now[name], **values, modified=time).__dict__]}

        self._change(change)

    def delete(self, name: str) -> None:
        """Take a version out of the registry, unless others were made from it."""

        def change(now: dict[str, Branch]) -> dict:
            if name == DEFAULT or name not in now:
                raise VersionError(f"There is no version named {name}.")
            kids = sorted(b.name for b in now.values() if b.parent == name)
            if kids:
                raise VersionError(f"Delete the versions made from {name} first: {', '.join(kids)}")
            return {"dropped": name}

        self._change(change)

    def write(self, name: str, df: DataFrame, note: str | None = None) -> None:
        """A new state of a version or of the default; refused if another writer changed it meanwhile. ``note`` marks a commit (a batch of a stream)."""
        before, snapshot, time = self.branch(name).snapshot, self._snapshot(df), self._clock()

        def change(now: dict[str, Branch]) -> dict:
            if now[name].snapshot != before:
                raise Conflict(f"another writer committed to {name} first")
            return {"branches": [replace(now[name], snapshot=snapshot, modified=time).__dict__], "note": note}

        self._change(change)

    def noted(self, note: str) -> bool:
        return any(x.get("note") == note for x in self._commits())

    def root_of(self, name: str) -> str:
        """The version at the top of a version's tree."""
        now = self._branches(self._commits())
        for _ in range(50):
            if name not in now:
                break
            if now[name].parent is None:
                return name
            name = now[name].parent
        raise VersionError("The version tree is broken (a version is missing).")

    # ------------------------------------------------------------ reconcile and post

    def diff(self, name: str) -> DataFrame:
        b = self.branch(name)
        return ops.diff(self._rows(b.base), self._rows(b.snapshot), self.read(b.parent), self.keys, self.fields)

    def reconcile(self, name: str, favor: str = "version") -> None:
        """Take the parent's changes into the version."""
        b = self.branch(name)
        parent = self.branch(b.parent)
        merged = ops.reconcile(self._rows(b.base), self._rows(b.snapshot), self._rows(parent.snapshot), self.keys, self.fields, favor)
        snapshot, time = self._snapshot(merged), self._clock()

        def change(now: dict[str, Branch]) -> dict:
            if now[name].snapshot != b.snapshot:
                raise Conflict(f"another writer committed to {name} first")
            return {"branches": [replace(now[name], snapshot=snapshot, base=parent.snapshot, modified=time).__dict__]}

        self._change(change)

    def post(self, name: str) -> dict[str, int]:
        """Bring the version's changes into its parent; refused if the parent moved since the last reconcile, before or during the post."""
        b = self.branch(name)
        if b.parent is None:
            raise VersionError("The default can't be posted.")
        parent = self.branch(b.parent)
        after, time = self._rows(b.snapshot), self._clock()
        if parent.snapshot != b.base:
            n = ops.changes(self._rows(b.base), self._rows(parent.snapshot), self.keys, self.fields).count()
            if n:
                raise Conflict(f"The parent changed since the last reconcile ({n} feature(s)): reconcile the version first.")
        log = ops.audit(self._rows(parent.snapshot), after, self.keys, self.fields)
        rows = log.select(F.lit(time).alias("changed_at"), F.lit(name).alias("version"), *self.keys, "action", "field", "old_value", "new_value")
        history = f"h-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{history}")
        found = self.spark.read.parquet(f"{self.root}/{history}").select(*self.keys, "action").distinct().groupBy("action").count().collect()
        counts = {k: next((r["count"] for r in found if r.action == k), 0) for k in (ops.INSERT, ops.UPDATE, ops.DELETE)}
        text = f"{counts[ops.INSERT]} inserted, {counts[ops.UPDATE]} updated, {counts[ops.DELETE]} deleted"

        def change(now: dict[str, Branch]) -> dict:
            if now[b.parent].snapshot != parent.snapshot or now[name].snapshot != b.snapshot:
                raise Conflict(f"another writer committed to {b.parent} or {name} first")
            moved = replace(now[b.parent], snapshot=b.snapshot, modified=time)
            done = replace(now[name], base=b.snapshot, status="Posted", posted=time, posted_counts=text, modified=time)
            return {"branches": [moved.__dict__, done.__dict__], "history": history}

        self._change(change)
        return counts

    def history(self) -> DataFrame:
        """The audit rows of all posts."""
        key = dict(self.read().dtypes)
        schema = "changed_at string, version string, " + ", ".join(f"{k} {key[k]}" for k in self.keys) + ", action string, field string, old_value string, new_value string"
        folders = [f"{self.root}/{x['history']}" for x in self._commits() if x.get("history")]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def prune(self) -> int:
        """Delete snapshots that no version stands on; returns how many. Not while others write."""
        commits = self._commits()
        used = {s for b in self._branches(commits).values() for s in (b.snapshot, b.base)} | {x.get("history") for x in commits}
        gone = [s.getPath() for s in self._files.listStatus(self._path(self.root)) if s.isDirectory() and s.getPath().getName()[:2] in ("s-", "h-") and s.getPath().getName() not in used]
        for path in gone:
            self._files.delete(path, True)
        return len(gone)
