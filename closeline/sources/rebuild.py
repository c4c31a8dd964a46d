"""A store built again from its raw payloads: beside the old one, then put in its place.

A version is a folder of segments (a season, a purchase wave). Each segment is staged,
made one row per identity and written on its own; Spark's success mark says that it is
whole, so a run that was stopped goes on with the first segment without one and replaces
what it had half written. When all are there, rows and content are counted from the files,
and the version becomes the store by one rename of its manifest. Until then readers see the
version before; a refused rebuild changes nothing.

Two guards, each with its own written reason to pass it: fewer rows than the store had,
and a store whose manifest can't be read, so that there is nothing to compare with. A
version without rows is always refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from closeline.sources import stores as S

MANIFESTS, VERSIONS = "_manifests", "versions"


class RebuildRefused(RuntimeError):
    """The new version stays beside the store, which is as it was."""


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Names of the manifests, oldest first: each version that was put in force has the next number."""
    fs, folder = _filesystem(spark, f"{root}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(folder)) if re.fullmatch(r"\d{8}\.json", n))


def _put(spark: SparkSession, root: str, text: str) -> None:
    """The next manifest appears whole: it is written as a draft and renamed, and none is ever replaced."""
    held = _manifests(spark, root)
    name = f"{root}/{MANIFESTS}/{int(held[-1][:8]) + 1 if held else 1:08}.json"
    fs, draft = _filesystem(spark, f"{name}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)):
        raise OSError(f"{name} could not be put in place")


def manifest(spark: SparkSession, root: str) -> dict | None:
    """The manifest of the store in force; None where there is no store. Raises if it can't be read."""
    held = _manifests(spark, root)
    if not held:
        return None
    text = "\n".join(r[0] for r in spark.read.text(f"{root}/{MANIFESTS}/{held[-1]}").collect())  # one small file
    found = json.loads(text)
    return {"version": str(found["version"]), "rows": int(found["rows"]), "segments": dict(found["segments"]), "reasons": dict(found.get("reasons", {}))}


def read(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the version in force, with the ``part`` (segment) they are in."""
    held = manifest(spark, root)
    if held is None:
        raise FileNotFoundError(f"{root} holds no store")
    return _version(spark, root, held["version"], list(held["segments"]))


def _version(spark: SparkSession, root: str, version: str, segments: Sequence[str]) -> DataFrame:
    # The segments that belong to the version by name: others in its folder are of another plan.
    parts = [spark.read.parquet(_segment(root, version, s)).withColumn("part", F.lit(s)) for s in segments]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _segment(root: str, version: str, name: str) -> str:
    return f"{root}/{VERSIONS}/{version}/{name}"


def rebuild(spark: SparkSession, root: str, version: str, segments: Mapping[str, Callable[[], DataFrame]], keys: Sequence[str], order: Sequence[str] = (), allow_shrink: str = "", allow_unreadable: str = "") -> dict:
    """Build ``version`` out of its segments and put it in force; returns its manifest.

    ``segments`` maps a name to a function that gives its staged rows; rows of one identity
    (``keys``) must be in one segment, and the first by ``order`` stays. Running it again
    after a stop gives the same store; a version that is in force already is left as it is.
    """
    try:
        before = manifest(spark, root)
    except Exception as e:  # whatever is wrong with the file, the store can't be counted
        if not allow_unreadable:
            raise RebuildRefused(f"the manifest of {root} can't be read, so there is nothing to compare with: {e}") from e
        before = None
    if before and before["version"] == version and set(before["segments"]) == set(segments):
        return before
    for name, staged in segments.items():
        path = _segment(root, version, name)
        if not S.exists(spark, f"{path}/_SUCCESS"):
            rows = staged()
            one = S.unseen(rows, rows.filter("false"), keys, order)
            one.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    written = {r["part"]: {"rows": r["rows"], "content": r["content"]} for r in S.fingerprint(_version(spark, root, version, list(segments)), ["part"]).collect()}  # one row per segment
    found = {name: written.get(name, {"rows": 0, "content": "0"}) for name in segments}
    total = sum(s["rows"] for s in found.values())
    if not total:
        raise RebuildRefused(f"version {version} has no rows")
    if before and total < before["rows"] and not allow_shrink:
        raise RebuildRefused(f"version {version} has {total} rows, {before['rows'] - total} fewer than {before['version']}")
    made = {"version": version, "rows": total, "segments": found, "reasons": {k: v for k, v in (("shrink", allow_shrink), ("unreadable", allow_unreadable)) if v}}
    _put(spark, root, json.dumps(made, sort_keys=True))
    return made
