"""Derived tables and fitted values kept for reuse across analyses.

A table is written once to the shared checkpoint folder and read from there:
unlike ``persist`` the files outlive executors, and unlike an RDD checkpoint the
scan keeps column pruning and filter pushdown. What is kept is known by its kind
and by the content of its input: the names, sizes and times of the source files.
A changed file gives another key, so nothing stale is read.

One table is physical, ``profiles``; the analysis base and the load path are
projections over it, with fitted values (medians, centroids: a few numbers) as
literals.

Each session that uses an entry holds a reference. ``release`` drops a session's
references and removes the files that nobody holds any more; when the
application ends, its whole folder goes (``session.ensure_checkpoint_dir``).
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loanlens.session import ensure_checkpoint_dir, file_system, table_path

#: The tables that ``profiles`` is derived from.
SOURCES = ("customer", "nation", "orders", "lineitem", "events")


@dataclass
class Held:
    application: str
    path: str | None = None
    value: object = None
    frames: dict[str, DataFrame] = field(default_factory=dict)  # by session
    sessions: set[str] = field(default_factory=set)


_HELD: dict[tuple, Held] = {}
_LOCK = threading.RLock()


def session_id(spark: SparkSession) -> str:
    return f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"


def content_version(spark: SparkSession, sf_dir: str, tables: Sequence[str] = SOURCES) -> str:
    """The source files' names, sizes and times, hashed. The files are listed,
    not read."""
    seen = []
    for t in tables:
        path, fs = file_system(spark, table_path(sf_dir, t))
        files = fs.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().getName()
            if not name.startswith(("_", ".")):
                seen.append(f"{t}|{status.getPath()}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def _entry(kind: str, spark: SparkSession, sf_dir: str) -> Held:
    application = spark.sparkContext.applicationId
    key = (application, kind, sf_dir, content_version(spark, sf_dir))
    for old in [k for k in _HELD if k[0] != application]:  # of an application that has ended
        del _HELD[old]
    held = _HELD.setdefault(key, Held(application))
    held.sessions.add(session_id(spark))
    return held


def stored_table(kind: str, spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` derives from ``sf_dir``, written once for its
    content and read by every session of the application."""
    with _LOCK:
        held, me = _entry(kind, spark, sf_dir), session_id(spark)
        if held.path is None:
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{kind}-{uuid.uuid4().hex}"
            build().write.mode("errorifexists").parquet(path)
            held.path = path
        if me not in held.frames:
            held.frames[me] = spark.read.parquet(held.path)
        return held.frames[me]


def stored_value(kind: str, spark: SparkSession, sf_dir: str, build: Callable[[], object]):
    """A fitted value (bounded by the schema or by k), computed once for the
    content of ``sf_dir``."""
    with _LOCK:
        held = _entry(kind, spark, sf_dir)
        if held.value is None:
            held.value = build()
        return held.value


def release(spark: SparkSession) -> None:
    """Drop the session's references; remove what nobody holds any more."""
    with _LOCK:
        me = session_id(spark)
        for key, held in list(_HELD.items()):
            held.sessions.discard(me)
            held.frames.pop(me, None)
            if not held.sessions:
                del _HELD[key]
                if held.path is not None:
                    path, fs = file_system(spark, held.path)
                    fs.delete(path, True)


def held_paths() -> list[str]:
    return [h.path for h in _HELD.values() if h.path is not None]
