"""A store of the log in Parquet, with generations.

A generation is a small JSON file that lists the folders of its tables, each with the height that it counts up to;
folders are never changed once written, so a reader of an old generation goes on reading it, and a reorganisation lowers
the heights of the folders it reaches into and writes none of them anew. A commit writes new folders and then puts the
file of the next generation in its place in one step, which fails if there is one: of two writers from one base only one
commits, and no reader meets half a file. ``compact`` brings many folders together.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.errors import IntegrityError, OutOfRange
from ledgerloom.operators import tiers, verify
from ledgerloom.operators.windows import broken_links
from ledgerloom.plans.runtime import publish
from ledgerloom.schema import BLOCK, RANGE_SIZE, SCHEMA_VERSION, SEAL_DEPTH, SHIELDED
from ledgerloom.sources.blobs import CheckedRanges, unpack_ranges

_META = "start_height bigint, end_hash string, sapling bigint, orchard bigint, ironwood bigint, state string"


@dataclass(frozen=True)
class Snapshot:
    """One generation, as it stays."""

    generation: int
    state: dict
    sealed: DataFrame
    mutable: DataFrame
    hash_index: DataFrame
    range_meta: DataFrame

    @property
    def tip(self) -> int:
        return self.state["tip_height"]

    def blocks(self) -> DataFrame:
        return self.sealed.drop("range_id").unionByName(self.mutable)

    def sealed_range(self, start: int) -> DataFrame:
        if start % RANGE_SIZE:
            raise OutOfRange(f"{start} does not begin a range")
        return self.sealed.where(F.col("range_id") == start // RANGE_SIZE)


def _lowered(folders: list, height: int) -> list:
    """The folders, none of which counts beyond ``height``."""
    return [[f, height] if isinstance(f, str) else [f[0], min(f[1], height)] for f in folders]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _generations(self) -> list[int]:
        folder = self._path(f"{self.root}/generations")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _state(self, generation: int) -> dict:
        if generation == 0:
            return {"schema_version": SCHEMA_VERSION, "tip_height": -1, "tip_hash": None, "sealed_through": -1, "verified_through": -1, "sealed": [], "mutable": [], "hash_index": [], "range_meta": []}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/generations/{generation}.json").first()[0])

    def _table(self, folders: list, schema: str) -> DataFrame:
        """Folders as one table: whole ones are plain paths, others (path, last height that counts)."""
        whole = [f for f in folders if isinstance(f, str)]
        out = self.spark.read.schema(schema).parquet(*whole) if whole else self.spark.createDataFrame([], schema)
        for path, through in (f for f in folders if not isinstance(f, str)):
            out = out.unionByName(self.spark.read.schema(schema).parquet(path).where(F.col("height") <= through))
        return out

    def snapshot(self, generation: int | None = None) -> Snapshot:
        known = self._generations()
        generation = (known[-1] if known else 0) if generation is None else generation
        state = self._state(generation)
        sealed = self._table(state["sealed"], f"{BLOCK}, range_id bigint")
        return Snapshot(generation, state, sealed, self._table(state["mutable"], BLOCK), self._table(state["hash_index"], "hash string, height bigint"), self._table(state["range_meta"], _META))

    def _write(self, df: DataFrame, name: str, by_range: bool = False, dealt: bool = False) -> str:
        """A new folder. ``by_range`` puts rows into range order first; ``dealt`` rows have whole ranges in one task already."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        if by_range:
            # a file holds whole ranges in height order, so bounds on range_id and height skip the others
            df = df.repartitionByRange("range_id").sortWithinPartitions("range_id", "height")
        elif dealt:
            # as above but for the order of ranges over the files: each holds some from everywhere, and its pages are skipped
            df = df.repartition("range_id").sortWithinPartitions("range_id", "height")
        df.write.option("compression", "zstd").parquet(folder)
        return folder

    def _commit(self, base: int, state: dict) -> Snapshot:
        try:
            publish(self.spark, json.dumps(state).encode(), f"{self.root}/generations/{base + 1}.json")
        except FileExistsError as e:
            raise IntegrityError("stale_batch", detail=f"generation {base + 1} exists") from e
        return self.snapshot(base + 1)

    def append(self, base: Snapshot, batch: DataFrame) -> Snapshot:
        """Blocks that continue the tip; whole ranges SEAL_DEPTH below the new tip are sealed.

        A batch with a column ``range_id``, by which it is dealt, is sealed without another shuffle.
        """
        if self._generations()[-1:] not in ([], [base.generation]):
            raise IntegrityError("stale_batch")
        ranged = "range_id" in batch.columns
        misplaced = F.count_if(~F.col("range_id").eqNullSafe(F.floor(F.col("height") / RANGE_SIZE))) if ranged else F.lit(0)
        ends = batch.agg(F.min_by(F.struct("height", "prev_hash"), "height").alias("a"), F.max_by(F.struct("height", "hash"), "height").alias("z"), F.count("*").alias("n"), misplaced.alias("misplaced")).first()
        if not ends["n"]:
            return base
        low, high = ends["a"], ends["z"]
        if low["height"] != base.tip + 1 or (base.tip >= 0 and low["prev_hash"] != base.state["tip_hash"]):
            raise IntegrityError("continuity", low["height"])
        if high["height"] - low["height"] + 1 != ends["n"]:
            raise IntegrityError("continuity", broken_links(batch).agg(F.min("height")).first()[0])
        if ends["misplaced"]:
            raise IntegrityError("range_id", low["height"])
        # the batch is made once, into the new folders; it is checked there, and they stay unnamed if it fails
        mutable = base.mutable.unionByName(batch.drop("range_id")) if base.state["mutable"] or not ranged else batch
        state = self._sealed(base, mutable, [], high["height"], high["hash"])
        fresh = Snapshot(base.generation, state, self._table(state["sealed"][len(base.state["sealed"]) :], f"{BLOCK}, range_id bigint"), self._table(state["mutable"], BLOCK), base.hash_index, base.range_meta)
        written = fresh.blocks().where(F.col("height") > base.tip).select("height", "hash", "prev_hash")
        if not (bad := broken_links(written)).isEmpty():
            raise IntegrityError("continuity", bad.agg(F.min("height")).first()[0])
        if not verify.duplicate_hashes(base.hash_index.join(written.select("hash"), "hash", "left_semi"), written).isEmpty():
            raise IntegrityError("duplicate_hash")
        index = [*base.state["hash_index"], self._write(written.select("hash", "height"), "hash_index")]
        return self._commit(base.generation, state | {"hash_index": index})

    def _sealed(self, base: Snapshot, mutable: DataFrame, index: list[str], tip: int, tip_hash: str | None) -> dict:
        done, rest = tiers.seal(mutable, tip - SEAL_DEPTH)
        through = max(base.state["sealed_through"], (tip - SEAL_DEPTH + 1) // RANGE_SIZE * RANGE_SIZE - 1 if tip >= SEAL_DEPTH else -1)
        sealed = base.state["sealed"]
        if through > base.state["sealed_through"]:
            if "range_id" in mutable.columns:
                # made once, with what is not sealed yet; that is taken from the new folder, which counts up to what is sealed
                folder = self._write(mutable.select(*done.columns), "sealed", dealt=True)
                rest = self._table([folder], f"{BLOCK}, range_id bigint").where(F.col("height") > through).drop("range_id")
                sealed = [*sealed, [folder, through]]
            else:
                sealed = [*sealed, self._write(done, "sealed", by_range=True)]
        return base.state | {"tip_height": tip, "tip_hash": tip_hash, "sealed_through": through, "sealed": sealed, "mutable": [self._write(rest, "mutable")], "hash_index": index}

    def replace_suffix(self, base: Snapshot, ancestor: int, replacement: DataFrame) -> Snapshot:
        """Mutable rows above ``ancestor`` give way to ``replacement``; an empty one rolls back."""
        if ancestor > base.tip:
            raise IntegrityError("replacement", ancestor)
        if ancestor < base.state["sealed_through"]:
            raise IntegrityError("sealed", ancestor)
        return self._replaced(base, ancestor, replacement, base.state["sealed"], base.state["range_meta"])

    def replace_deep(self, base: Snapshot, ancestor: int, replacement: DataFrame) -> Snapshot:
        """Below the sealed height too: ranges from that of the ancestor on are opened again and their metadata dropped."""
        if ancestor > base.tip:
            raise IntegrityError("replacement", ancestor)
        keep = (ancestor + 1) // RANGE_SIZE * RANGE_SIZE
        sealed = _lowered(base.state["sealed"], keep - 1) if keep else []
        kept = self._table(sealed, f"{BLOCK}, range_id bigint")
        opened = base.sealed.where((F.col("range_id") >= keep // RANGE_SIZE) & (F.col("height") <= ancestor)).drop("range_id")
        meta = [self._write(base.range_meta.where(F.col("start_height") < keep), "range_meta")]
        state = base.state | {"sealed": sealed, "sealed_through": keep - 1, "verified_through": min(base.state["verified_through"], keep - 1)}
        lower = Snapshot(base.generation, state, kept, opened.unionByName(base.mutable), base.hash_index, base.range_meta)
        return self._replaced(lower, ancestor, replacement, sealed, meta)

    def _replaced(self, base: Snapshot, ancestor: int, replacement: DataFrame, sealed: list[str], meta: list[str]) -> Snapshot:
        kept = base.mutable.where(F.col("height") <= ancestor)
        joined = kept.unionByName(replacement)
        top = joined.agg(F.max_by(F.struct("height", "hash"), "height")).first()[0]
        if top is None:
            top = base.sealed.agg(F.max_by(F.struct("height", "hash"), "height")).first()[0]
        tip, tip_hash = (top["height"], top["hash"]) if top else (-1, None)
        if not (bad := broken_links(base.sealed.where(F.col("height") == ancestor).drop("range_id").unionByName(joined))).isEmpty():
            raise IntegrityError("continuity", bad.agg(F.min("height")).first()[0])
        index = [*_lowered(base.state["hash_index"], ancestor), self._write(replacement.select("hash", "height"), "hash_index")]
        state = self._sealed(base, joined, index, tip, tip_hash)
        return self._commit(base.generation, state | {"range_meta": meta})

    def install(self, base: Snapshot, ranges: CheckedRanges) -> Snapshot:
        """Checked ranges that continue a log of sealed ranges alone: they are sealed as they come, with their metadata."""
        if not isinstance(ranges, CheckedRanges):
            raise TypeError("only checked ranges are installed")
        ends = ranges.entries.agg(F.min("start_height").alias("a"), F.max_by(F.struct("start_height", "end_hash"), "start_height").alias("z"), F.count("*").alias("n")).first()
        if not ends["n"]:
            return base
        top = ends["z"]["start_height"] + RANGE_SIZE - 1
        if base.tip != base.state["sealed_through"] or ends["a"] != base.tip + 1 or top - base.tip != ends["n"] * RANGE_SIZE:
            raise IntegrityError("continuity", ends["a"])
        # a range comes out of its blob whole and in height order: its file is written where it is unpacked
        folder = self._write(unpack_ranges(ranges.blobs()).withColumn("range_id", F.floor(F.col("height") / RANGE_SIZE)), "sealed")
        fresh = self.spark.read.schema(f"{BLOCK}, range_id bigint").parquet(folder)
        if fresh.count() != ends["n"] * RANGE_SIZE:
            raise IntegrityError("continuity", ends["a"])
        if base.tip >= 0 and fresh.where(F.col("height") == ends["a"]).first()["prev_hash"] != base.state["tip_hash"]:
            raise IntegrityError("start_link", ends["a"])
        if not verify.duplicate_hashes(base.hash_index.join(fresh.select("hash"), "hash", "left_semi"), fresh).isEmpty():
            raise IntegrityError("duplicate_hash")
        columns = [F.col(f"{p}_size").alias(p) for p in SHIELDED]
        meta = base.range_meta.unionByName(ranges.entries.select("start_height", "end_hash", *columns, F.lit("checked").alias("state")))
        index = [*base.state["hash_index"], self._write(fresh.select("hash", "height"), "hash_index")]
        state = base.state | {"tip_height": top, "tip_hash": ends["z"]["end_hash"], "sealed_through": top, "hash_index": index}
        return self._commit(base.generation, state | {"sealed": [*base.state["sealed"], folder], "range_meta": [self._write(meta, "range_meta")]})

    def compact(self, base: Snapshot, most: int = 64) -> Snapshot:
        """Tables of more than ``most`` folders are written as one; the log stays the same."""
        state = dict(base.state)
        for name, table in (("sealed", base.sealed), ("hash_index", base.hash_index)):
            if len(state[name]) > most:
                state[name] = [self._write(table, name, by_range=name == "sealed")]
        return self._commit(base.generation, state) if state != base.state else base

    def put_range_meta(self, base: Snapshot, rows: DataFrame) -> Snapshot:
        """Upsert of range metadata: ranges must be sealed and end as the log says."""
        ends = base.sealed.select((F.col("height") - RANGE_SIZE + 1).alias("start_height"), F.col("hash").alias("_hash"))
        wrong = rows.join(ends, "start_height", "left").where("_hash is null or _hash <> end_hash")
        if (bad := wrong.agg(F.min("start_height")).first()[0]) is not None:
            raise IntegrityError("range_end_hash", bad)
        merged = base.range_meta.join(rows.select("start_height"), "start_height", "left_anti").unionByName(rows)
        return self._commit(base.generation, base.state | {"range_meta": [self._write(merged, "range_meta")]})
