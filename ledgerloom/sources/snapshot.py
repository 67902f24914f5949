"""Publishing a store as a snapshot directory and reading it back: range files named by content, manifests never replaced,
a pointer written last, so that it names only what is there."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import IntegrityError
from ledgerloom.operators import tiers, verify
from ledgerloom.plans.runtime import publish
from ledgerloom.sources import blobs

_ENTRY = (
    "start_height bigint, end_height bigint, end_hash string, sapling bigint, orchard bigint, ironwood bigint, sapling_frontier string, "
    "orchard_frontier string, ironwood_frontier string, blob_digest string, blob_len bigint, epoch_end boolean"
)


def entry(fields: dict) -> tuple:
    """A manifest entry in the order of its columns. What is missing, unknown, of another type or out of bounds is named."""
    kinds = {"bigint": int, "string": str, "boolean": bool}
    columns = dict(c.split() for c in _ENTRY.split(", "))
    start = fields.get("start_height")
    if extra := sorted(fields.keys() - columns.keys()):
        raise IntegrityError("entry_unknown_field", start, extra[0])
    for name, kind in columns.items():
        if name not in fields:
            raise IntegrityError("entry_missing_field", start, name)
        if type(fields[name]) is not kinds[kind]:
            raise IntegrityError("entry_type", start, name)
        if kind == "bigint" and not 0 <= fields[name] < 2**63:
            raise IntegrityError("entry_range", start, name)
        if name in ("end_hash", "blob_digest") and not re.fullmatch("[0-9a-f]{64}", fields[name]):
            raise IntegrityError("entry_digest", start, name)
    return tuple(fields[name] for name in columns)


class SnapshotDirectory:
    """A directory that Spark can write. ``key`` authenticates manifests (HMAC stands in for a public-key signature)."""

    def __init__(self, spark: SparkSession, root: str, key: bytes):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        self._fs = path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _put(self, name: str, body: bytes, replace: bool = False) -> None:
        """Readers see the old file or the new one, never none."""
        try:
            publish(self.spark, body, f"{self.root}/{name}", replace)
        except FileExistsError as e:
            raise IntegrityError("manifest exists", detail=name) from e

    def _get(self, name: str) -> bytes:
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{name}").first()["content"])

    def present(self) -> DataFrame:
        """``(start_height, blob_len)`` of the range files that are there."""
        if not self._fs.exists(self._path(f"{self.root}/ranges")):
            return self.spark.createDataFrame([], "start_height bigint, blob_len bigint")
        files = self.spark.read.schema("start_height bigint, blob_len bigint").parquet(f"{self.root}/ranges")
        return files.select("start_height", "blob_len")

    def export(self, packed: DataFrame, entries: DataFrame, sealed_through: int, now: datetime) -> dict:
        """Writes what is missing of the ranges, then the manifest of ``now``, then the pointer to it.

        ``packed`` is what blobs.pack_ranges gives. Ranges that are there with the right length are not written again;
        one whose blob does not fit its entry is refused.
        """
        name = f"manifests/{now.astimezone(timezone.utc):%Y-%m-%dT%H%M%SZ}.json"
        if self._fs.exists(self._path(f"{self.root}/{name}")):
            raise IntegrityError("manifest exists", detail=name)
        wrong = entries.join(packed.select("start_height", F.col("blob_digest").alias("d"), F.col("blob_len").alias("n")), "start_height", "left")
        bad = wrong.where("d is null or d <> blob_digest or n <> blob_len").agg(F.min("start_height")).first()[0]
        if bad is not None:
            raise IntegrityError("range_blob", bad)
        if not (rules := verify.manifest_violations(entries, sealed_through)).isEmpty():
            raise IntegrityError("manifest", rules.first()["start_height"], rules.first()["check"])
        todo = tiers.missing_ranges(entries.select("start_height", "blob_len"), self.present())
        fresh = packed.join(todo.select("start_height"), "start_height", "left_semi").select("start_height", "blob", "blob_digest", "blob_len")
        written = todo.count()
        if written:
            fresh.write.mode("append").parquet(f"{self.root}/ranges")
        body = json.dumps({"sealed_through": sealed_through, "manifest_version": 1, "entries": [r.asDict() for r in entries.orderBy("start_height").collect()]}).encode()  # one row per thousand blocks
        self._put(name, body)
        pointer = {"manifest": name, "sealed_through": sealed_through, "digest": hashlib.sha256(body).hexdigest()}
        text = json.dumps(pointer, sort_keys=True)
        self._put("latest.json", json.dumps({"latest": pointer, "signature": hmac.new(self.key, text.encode(), "sha256").hexdigest()}).encode(), replace=True)
        return {"manifest": name, "written": written}

    def manifest(self) -> tuple[DataFrame, int]:
        """Entries of the latest manifest and the height it is sealed through; pointer and manifest are verified."""
        signed = json.loads(self._get("latest.json"))
        text = json.dumps(signed["latest"], sort_keys=True)
        if not hmac.compare_digest(signed["signature"], hmac.new(self.key, text.encode(), "sha256").hexdigest()):
            raise IntegrityError("signature")
        body = self._get(signed["latest"]["manifest"])
        if hashlib.sha256(body).hexdigest() != signed["latest"]["digest"]:
            raise IntegrityError("manifest_digest")
        return self.spark.createDataFrame([entry(e) for e in json.loads(body)["entries"]], _ENTRY), signed["latest"]["sealed_through"]

    def blocks(self) -> DataFrame:
        """Blocks of the ranges of the latest manifest; a blob that does not fit its entry fails the query."""
        entries, _ = self.manifest()
        files = self.spark.read.schema("start_height bigint, blob binary, blob_digest string").parquet(f"{self.root}/ranges")
        named = files.select("start_height", "blob").join(F.broadcast(entries.select("start_height", "blob_digest", "blob_len")), "start_height")
        fits = (F.sha2("blob", 256) == F.col("blob_digest")) & (F.octet_length("blob") == F.col("blob_len"))
        checked = named.withColumn("blob", F.when(fits, F.col("blob")).otherwise(F.raise_error(F.lit("range_blob")).cast("binary")))
        return blobs.unpack_ranges(checked)


def listing(range_meta: DataFrame, start: int) -> DataFrame:
    """Ranges that a peer offers: those not rejected, from a height on, in order."""
    return range_meta.where((F.col("state") != "rejected") & (F.col("start_height") >= start)).orderBy("start_height")


def resume_point(tip_height: int, tip_hash: str | None, entries: DataFrame, canonical_hash: str | None) -> dict:
    """Where an import goes on: after the entry that ends at the tip. If the tip is no entry's end or its hash differs, the
    node's hash at that height says whether our tip is still canonical (a sealed tip) or was left behind."""
    if tip_height < 0:
        return {"action": "start", "from": 0}
    end = entries.where(F.col("end_height") == tip_height).select("end_hash").first()
    last = entries.agg(F.max("end_height")).first()[0]
    if last is None or tip_height >= last:
        return {"action": "done", "from": tip_height + 1}
    if end is not None and end["end_hash"] == tip_hash:
        return {"action": "resume", "from": tip_height + 1}
    return {"action": "sealed tip" if canonical_hash == tip_hash else "reorganised tip", "from": tip_height + 1}
