"""The registered queries over the log, and for each the SQL that gives the same rows from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import address, mempool, project, reads, stats, tiers, verify, windows
from ledgerloom.plans import derive
from ledgerloom.schema import RANGE_SIZE, SHIELDED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_SIZES = [f"{p}_size" for p in SHIELDED]
_SIZE_OF = {p: f"{p}_size" for p in SHIELDED}

# --- the log in SQL

_HEADERS = """headers AS (
  SELECT o_orderkey AS height, sha256(CAST(o_orderkey AS VARCHAR)) AS hash,
         CASE WHEN o_orderkey = 0 THEN repeat('0', 64) ELSE sha256(CAST(o_orderkey - 1 AS VARCHAR)) END AS prev_hash,
         CAST(epoch(o_orderdate) AS BIGINT) AS time FROM orders)"""
_ITEMS = """items AS (
  SELECT *, sha256('item:' || height || ':' || tx || ':' || place) AS id FROM (
    SELECT l_orderkey AS height, CAST(l_linenumber AS BIGINT) AS tx,
           CASE l_returnflag WHEN 'A' THEN 'sapling' WHEN 'N' THEN 'orchard' ELSE 'ironwood' END AS pool,
           CASE WHEN l_returnflag <> 'A' THEN 'action' WHEN l_linestatus = 'F' THEN 'spend' ELSE 'output' END AS kind,
           CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice,
             l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS BIGINT) AS place FROM lineitem))"""
_ADDED = f"""{_HEADERS}, {_ITEMS}, added AS (
  SELECT h.*, coalesce(i.sapling, 0) AS sapling, coalesce(i.orchard, 0) AS orchard, coalesce(i.ironwood, 0) AS ironwood
  FROM headers h LEFT JOIN (
    SELECT height, CAST(count(*) FILTER (kind = 'output') AS BIGINT) AS sapling,
           CAST(count(*) FILTER (pool = 'orchard') AS BIGINT) AS orchard, CAST(count(*) FILTER (pool = 'ironwood') AS BIGINT) AS ironwood
    FROM items GROUP BY height) i USING (height))"""
_SIZED = f"""{_ADDED}, sized AS (
  SELECT *, CAST(sum(sapling) OVER w AS BIGINT) AS sapling_size, CAST(sum(orchard) OVER w AS BIGINT) AS orchard_size,
         CAST(sum(ironwood) OVER w AS BIGINT) AS ironwood_size FROM added WINDOW w AS (ORDER BY height))"""
_RANGES = f"""{_SIZED}, ranges AS (
  SELECT height // 1000 * 1000 AS start_height, max(height) AS end_height, CAST(count(*) AS BIGINT) AS n_blocks, max(sapling_size) AS sapling,
         max(orchard_size) AS orchard, max(ironwood_size) AS ironwood FROM sized GROUP BY 1)"""
_OUTPUTS = """outputs AS (
  SELECT o_orderkey AS height, sha256('t:' || o_orderkey) AS txid, CAST(o_custkey AS VARCHAR) AS address,
         CAST(round(o_totalprice * 100) AS BIGINT) AS value, o_orderstatus = 'F' AS spent FROM orders)"""
_PENDING = "pending AS (SELECT sha256('m:' || event_id) AS txid, event_id, user_id FROM events WHERE event_type = 'purchase')"
_TIP = "(SELECT max(o_orderkey) FROM orders)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with what each block adds to the pools and the cumulative sizes."""
    return derive.named(windows.running_sums(derive.counts(spark, sf_dir), _SIZE_OF))


def dealt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested blocks with cumulative sizes taken from what their transactions hold, dealt by their ``range_id``."""
    placed = derive.placed_blocks(spark, sf_dir)
    counted = placed.withColumns(project.additions(F.col("vtx")))
    totals = derive.counts(spark, sf_dir).select("height", *SHIELDED)
    return derive.named_blocks(windows.running_sums(counted, _SIZE_OF, group="range_id", totals=totals), *SHIELDED, *_SIZES, "range_id")


def sized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_blocks(spark, sf_dir).drop("range_id")


def _tip(spark: SparkSession, sf_dir: str) -> int:
    return derive.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]


def _flat(blocks: DataFrame, *more: str) -> DataFrame:
    """One row per transaction, its lists as counts and as one digest of all ids in order."""
    rows = blocks.select("height", *more, F.explode("vtx").alias("t"))
    ids = lambda a, f: F.array_join(F.transform(f"t.{a}", lambda x: x[f]), ",")
    text = F.concat_ws(";", ids("spends", "nf"), ids("outputs", "cmu"), ids("actions", "nullifier"), ids("ironwood_actions", "nullifier"))
    counts = [F.size(f"t.{a}").cast("bigint").alias(n) for a, n in (("spends", "n_spends"), ("outputs", "n_outputs"), ("actions", "n_actions"), ("ironwood_actions", "n_ironwood"))]
    return rows.select("height", *more, F.col("t.index").alias("tx"), F.col("t.txid").alias("txid"), *counts, F.sha2(text, 256).alias("items_digest"))


def _flat_sql(keep: str = "TRUE", outputs: str = "TRUE", having: str = "count(*) > 0", where: str = "TRUE") -> str:
    """Transactions from items: ``keep`` chooses items, ``outputs`` whether outputs are among them."""
    part = lambda c: f"coalesce(string_agg(id, ',' ORDER BY place) FILTER ({c}), '')"
    s, o, a, i = "kind = 'spend' AND k", f"kind = 'output' AND k AND {outputs}", "pool = 'orchard' AND k", "pool = 'ironwood' AND k"
    n = lambda c: f"CAST(count(*) FILTER ({c}) AS BIGINT)"
    return f"""SELECT height, tx, sha256('tx:' || height || ':' || tx) AS txid, {n(s)} AS n_spends, {n(o)} AS n_outputs, {n(a)} AS n_actions,
      {n(i)} AS n_ironwood, sha256({part(s)} || ';' || {part(o)} || ';' || {part(a)} || ';' || {part(i)}) AS items_digest
      FROM (SELECT *, {keep} AS k FROM items) WHERE {where} GROUP BY height, tx HAVING {having}"""


# --- reads


@query("block_by_height", f"WITH {_HEADERS} SELECT * FROM headers WHERE height = 1005")
def _(spark, sf_dir):
    return reads.lookup(derive.headers(spark, sf_dir), height=1005)


@query("block_by_hash", f"WITH {_HEADERS} SELECT * FROM headers WHERE hash = sha256('777')")
def _(spark, sf_dir):
    import hashlib

    return reads.lookup(derive.headers(spark, sf_dir), hash_hex=hashlib.sha256(b"777").hexdigest())


@query("block_by_hash_index", f"WITH {_HEADERS} SELECT hash, height, prev_hash, time FROM headers WHERE height % 97 = 0")
def _(spark, sf_dir):
    blocks = derive.headers(spark, sf_dir)
    index = blocks.select("hash", "height")
    return reads.by_hash_index(blocks, index, index.where(F.col("height") % 97 == 0).select("hash"))


@query("block_range_asc", f"WITH {_SIZED}, t AS ({_flat_sql(where='height BETWEEN 950 AND 1049')}) SELECT t.*, s.sapling_size, s.orchard_size, s.ironwood_size, s.height - 950 AS pos FROM t JOIN sized s USING (height)")
def _(spark, sf_dir):
    # sizes run over the whole chain, on flat counts; transactions are nested for the range alone
    blocks = reads.scan(derive.nested_blocks(spark, sf_dir), 950, 1049)
    sizes = reads.scan(sized(spark, sf_dir).select("height", *_SIZES), 950, 1049)
    rows = reads.numbered(project.by_pool(blocks.join(sizes, "height"), []), 950, 1049)
    return _flat(rows, *_SIZES, "pos")


@query("block_range_desc", f"WITH {_HEADERS} SELECT *, 1049 - height AS pos FROM headers WHERE height BETWEEN 950 AND 1049")
def _(spark, sf_dir):
    return reads.numbered(reads.scan(derive.headers(spark, sf_dir), 1049, 950), 1049, 950)


@query("latest_block", f"WITH {_HEADERS} SELECT height, hash FROM headers ORDER BY height DESC LIMIT 1")
def _(spark, sf_dir):
    return reads.tip(derive.headers(spark, sf_dir))


@query("stream_continuity", f"WITH {_HEADERS} SELECT height, hash FROM (SELECT *, lag(hash) OVER (ORDER BY height) AS b, lag(height) OVER (ORDER BY height) AS p FROM headers WHERE height % 1009 <> 5) WHERE p IS NOT NULL AND (b <> prev_hash OR p <> height - 1)")
def _(spark, sf_dir):
    return reads.breaks(derive.headers(spark, sf_dir).where(F.col("height") % 1009 != 5))


@query("volatile_first_lookup", f"WITH {_HEADERS} SELECT height, CASE WHEN height > {_TIP} - 25 THEN 'head:' || hash ELSE hash END AS hash FROM headers WHERE height > {_TIP} - 60")
def _(spark, sf_dir):
    tip = _tip(spark, sf_dir)
    durable = derive.headers(spark, sf_dir).where(F.col("height") > tip - 60).select("height", "hash")
    head = durable.where(F.col("height") > tip - 25).withColumn("hash", F.concat(F.lit("head:"), "hash"))
    return reads.volatile_first(head, durable, "height")


@query("lightd_info", f"SELECT {_TIP} AS tip_height, CASE WHEN {_TIP} < 1000 THEN 1000 WHEN {_TIP} < 20000 THEN 20000 WHEN {_TIP} < 900000 THEN 900000 END AS next_height, CASE WHEN {_TIP} < 1000 THEN 'first' WHEN {_TIP} < 20000 THEN 'second' WHEN {_TIP} < 900000 THEN 'third' END AS next_name")
def _(spark, sf_dir):
    activations = spark.createDataFrame([(1000, "first"), (20000, "second"), (900000, "third")], "height bigint, name string")
    return reads.next_activation(reads.tip(derive.headers(spark, sf_dir)), activations)


@query("address_range_clamp", f"""SELECT l_orderkey AS a, l_partkey AS b, least(x, y) AS from_height, greatest(x, y) AS to_height FROM (
  SELECT *, least(CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_orderkey END, {_TIP}) AS x, least(CASE WHEN l_partkey % 5 = 0 THEN {_TIP} ELSE l_partkey END, {_TIP}) AS y
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))""")
def _(spark, sf_dir):
    asked = derive.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    start = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey"))
    end = F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey")).otherwise(0)
    rows = asked.select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), start.alias("start"), end.alias("end"))
    return reads.clamp_range(rows, _tip(spark, sf_dir)).drop("start", "end")


# --- projections


def _pool_query(pool: str, keep: str) -> None:
    @query(f"pool_projection_{pool}", f"WITH {_ITEMS} {_flat_sql(keep=keep, having='count(*) FILTER (k) > 0')}")
    def _(spark, sf_dir):
        return _flat(project.by_pool(derive.nested_blocks(spark, sf_dir), [pool]))


for _pool in SHIELDED:
    _pool_query(_pool, f"pool = '{_pool}'")


@query("block_nullifiers", f"WITH {_ITEMS} {_flat_sql(outputs='FALSE')}")
def _(spark, sf_dir):
    return _flat(project.nullifiers(derive.nested_blocks(spark, sf_dir)))


@query("drop_empty_tx", f"WITH {_ITEMS} SELECT height, CAST(count(DISTINCT tx) AS BIGINT) AS n_tx FROM items WHERE kind <> 'spend' OR place >= 0 GROUP BY height")
def _(spark, sf_dir):
    rows = project.drop_empty(derive.nested_blocks(spark, sf_dir)).where(F.size("vtx") > 0)
    return rows.select("height", F.size("vtx").cast("bigint").alias("n_tx"))


@query("transparent_merge", f"""WITH {_ITEMS}, s AS (SELECT height, tx, CAST(count(*) AS BIGINT) AS n_items FROM items GROUP BY height, tx),
  t AS (SELECT o_orderkey AS height, CAST(o_orderkey % 9 AS BIGINT) AS tx, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS n_vin, CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS BIGINT) AS n_vout FROM orders WHERE o_orderstatus <> 'O')
  SELECT coalesce(s.height, t.height) AS height, coalesce(s.tx, t.tx) AS tx, coalesce(n_items, 0) AS n_items, coalesce(n_vin, 0) AS n_vin, coalesce(n_vout, 0) AS n_vout
  FROM s FULL OUTER JOIN t ON s.height = t.height AND s.tx = t.tx""")
def _(spark, sf_dir):
    shielded = derive.items(spark, sf_dir).groupBy("height", F.col("tx").alias("index")).agg(F.count("*").alias("n_items"))
    o = derive.table(spark, sf_dir, "orders")
    point = F.struct(F.when(F.col("o_orderstatus") == "F", derive.digest("t:", F.col("o_orderkey"))).alias("prevout_txid"), F.lit(0).alias("prevout_index"))
    out = F.struct(F.round(F.col("o_totalprice") * 100).cast("bigint").alias("value"))
    transparent = o.select(
        F.col("o_orderkey").alias("height"), (F.col("o_orderkey") % 9).alias("index"), F.array(point).alias("vin"),
        F.when(F.col("o_orderstatus") != "O", F.array(out)).otherwise(F.array().cast("array<struct<value: bigint>>")).alias("vout"),
    )
    merged = project.add_transparent(shielded, transparent)
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).cast("bigint")
    return merged.select("height", F.col("index").alias("tx"), F.coalesce("n_items", F.lit(0)).alias("n_items"), count("vin").alias("n_vin"), count("vout").alias("n_vout"))


@query("additions", f"WITH {_ADDED} SELECT height, sapling, orchard, ironwood, sapling + orchard + ironwood AS total FROM added")
def _(spark, sf_dir):
    rows = derive.nested_blocks(spark, sf_dir).withColumns(project.additions(F.col("vtx")))
    return rows.select("height", *SHIELDED, scalars.total(F.col(p) for p in SHIELDED).alias("total"))


@query("encoded_size_bound", f"""WITH {_HEADERS}, {_ITEMS} SELECT h.height, CAST(192 + coalesce(b, 0) AS BIGINT) AS bound FROM headers h LEFT JOIN (
  SELECT height, 64 * count(DISTINCT tx) + 36 * count(*) FILTER (kind = 'spend') + 128 * count(*) FILTER (kind = 'output') + 160 * count(*) FILTER (kind = 'action') AS b FROM items GROUP BY height) i USING (height)""")
def _(spark, sf_dir):
    return derive.nested_blocks(spark, sf_dir).select("height", project.encoded_size_bound(F.col("vtx")).alias("bound"))


# --- running values and chains


@query("tree_sizes", f"WITH {_SIZED} SELECT height, sapling_size, orchard_size, ironwood_size FROM sized")
def _(spark, sf_dir):
    return sized(spark, sf_dir).select("height", *_SIZES)


@query("range_rollup", f"WITH {_RANGES} SELECT * FROM ranges")
def _(spark, sf_dir):
    rows = windows.range_rollup(sized(spark, sf_dir), _SIZES)
    return rows.withColumnsRenamed({v: k for k, v in _SIZE_OF.items()})


@query("range_start", "SELECT o_orderkey AS height, o_orderkey // 1000 * 1000 AS start_height, o_orderkey % 1000 = 0 AS aligned FROM orders")
def _(spark, sf_dir):
    h = F.col("height")
    start = scalars.range_start(h)
    return derive.headers(spark, sf_dir).select("height", start.alias("start_height"), (h == start).alias("aligned"))


@query("hash_chain_check", f"""WITH {_HEADERS}, b AS (SELECT height, CASE WHEN height % 1013 = 7 THEN sha256('x' || height) ELSE hash END AS hash, prev_hash FROM headers WHERE height % 2003 <> 999)
  SELECT height, CASE WHEN p IS NULL OR p <> height - 1 THEN 'height' ELSE 'link' END AS "check" FROM (SELECT *, lag(hash) OVER (ORDER BY height) AS b, lag(height) OVER (ORDER BY height) AS p FROM b)
  WHERE height > 0 AND (p <> height - 1 OR b <> prev_hash)""")
def _(spark, sf_dir):
    h = F.col("height")
    blocks = derive.headers(spark, sf_dir).where(h % 2003 != 999)
    damaged = blocks.withColumn("hash", F.when(h % 1013 == 7, derive.digest("x", h)).otherwise(F.col("hash")))
    return windows.broken_links(damaged)


@query("monotonic_sizes", f"""WITH {_SIZED}, d AS (SELECT height, CASE WHEN height % 701 = 3 THEN sapling_size - 50 ELSE sapling_size END AS sapling_size, orchard_size, CASE WHEN height % 999 = 1 THEN ironwood_size + 9 ELSE ironwood_size END AS ironwood_size FROM sized)
  SELECT height, pool FROM (SELECT height, 'sapling_size' AS pool, sapling_size < lag(sapling_size) OVER w AS f FROM d WINDOW w AS (ORDER BY height) UNION ALL
  SELECT height, 'orchard_size', orchard_size < lag(orchard_size) OVER w FROM d WINDOW w AS (ORDER BY height) UNION ALL
  SELECT height, 'ironwood_size', ironwood_size < lag(ironwood_size) OVER w FROM d WINDOW w AS (ORDER BY height)) WHERE f""")
def _(spark, sf_dir):
    h = F.col("height")
    rows = sized(spark, sf_dir)
    rows = rows.withColumn("sapling_size", F.when(h % 701 == 3, F.col("sapling_size") - 50).otherwise(F.col("sapling_size")))
    rows = rows.withColumn("ironwood_size", F.when(h % 999 == 1, F.col("ironwood_size") + 9).otherwise(F.col("ironwood_size")))
    return windows.falling_sizes(rows, _SIZES)


@query("contiguous_prefix", f"""WITH {_HEADERS}, seen AS (SELECT height, hash, height - row_number() OVER (ORDER BY height) AS run FROM headers WHERE height NOT IN (777, 1200))
  SELECT height, hash FROM seen WHERE run = (SELECT min(run) FROM seen)""")
def _(spark, sf_dir):
    rows = derive.headers(spark, sf_dir).where("height <> 777 and height <> 1200").select("height", "hash")
    return windows.contiguous_prefix(rows)


@query("linked_prefix", f"""WITH {_HEADERS}, offered AS (SELECT height, hash, CASE WHEN height = 900 THEN repeat('f', 64) ELSE prev_hash END AS prev_hash FROM headers WHERE height >= 500),
  linked AS (SELECT o.*, o.prev_hash IS DISTINCT FROM b.hash AS broken FROM offered o LEFT JOIN headers b ON b.height = o.height - 1)
  SELECT height, hash, prev_hash FROM (SELECT *, count(*) FILTER (broken) OVER (ORDER BY height) AS breaks FROM linked) WHERE breaks = 0""")
def _(spark, sf_dir):
    blocks = derive.headers(spark, sf_dir).select("height", "hash", "prev_hash")
    offered = blocks.where("height >= 500").withColumn("prev_hash", F.when(F.col("height") == 900, F.lit("f" * 64)).otherwise(F.col("prev_hash")))
    return windows.linked_prefix(blocks.where("height < 500").select("height", "hash"), offered)


def _fork(spark, sf_dir, at: int, top: int) -> tuple[DataFrame, DataFrame]:
    """The log, and a branch of it from ``at`` on that ends at ``top``."""
    old = derive.headers(spark, sf_dir).select("height", "hash", "prev_hash")
    h = F.col("height")
    mark = lambda n, c: F.when(n > at, derive.digest("branch:", n)).otherwise(c)
    return old, old.where(h <= top).select("height", mark(h, F.col("hash")).alias("hash"), mark(h - 1, F.col("prev_hash")).alias("prev_hash"))


@query("common_ancestor", f"""WITH {_HEADERS}, branch AS (SELECT height, CASE WHEN height > 1234 THEN sha256('branch:' || height) ELSE hash END AS hash FROM headers WHERE height <= 1399),
  compared AS (SELECT height, h.hash = b.hash AS same FROM headers h JOIN branch b USING (height))
  SELECT max(height) AS ancestor FROM compared WHERE same AND height < coalesce((SELECT min(height) FROM compared WHERE NOT same), 9223372036854775807)""")
def _(spark, sf_dir):
    return windows.common_ancestor(*_fork(spark, sf_dir, 1234, 1399))


def _replace_sql(at: int, top: int) -> str:
    return f"""WITH {_HEADERS} SELECT height, CASE WHEN height > {at} THEN sha256('branch:' || height) ELSE hash END AS hash,
      CASE WHEN height - 1 > {at} THEN sha256('branch:' || (height - 1)) ELSE prev_hash END AS prev_hash FROM headers WHERE height <= {top}"""


@query("suffix_replace", _replace_sql(1234, 1399))
def _(spark, sf_dir):
    old, new = _fork(spark, sf_dir, 1234, 1399)
    return windows.replace_suffix(old, windows.common_ancestor(old, new), new)


@query("deep_replace", f"""{_replace_sql(321, 1450).replace('SELECT height', 'SELECT height // 1000 AS range_id, height', 1)}""")
def _(spark, sf_dir):
    old, new = _fork(spark, sf_dir, 321, 1450)
    rebuilt = windows.replace_suffix(old, windows.common_ancestor(old, new), new)
    return rebuilt.withColumn("range_id", F.floor(F.col("height") / RANGE_SIZE))


@query("subtree_spans", f"""WITH {_SIZED}, x AS (SELECT height, sapling_size // 1024 AS hi, (sapling_size - sapling) // 1024 AS lo FROM sized)
  SELECT height, unnest(range(lo, hi)) AS subtree FROM x WHERE hi > lo""")
def _(spark, sf_dir):
    rows = sized(spark, sf_dir).withColumn("before", F.col("sapling_size") - F.col("sapling"))
    return windows.subtree_spans(rows, "before", "sapling_size", 1024).select("height", "subtree")


@query("subtree_roots_slice", f"""WITH {_SIZED}, x AS (SELECT height, hash, sapling_size // 256 AS hi, (sapling_size - sapling) // 256 AS lo FROM sized),
  r AS (SELECT height, hash, unnest(range(lo, hi)) AS subtree FROM x WHERE hi > lo) SELECT subtree, height, hash, sha256('root:' || subtree) AS root FROM r WHERE subtree >= 1 ORDER BY subtree LIMIT 5""")
def _(spark, sf_dir):
    rows = sized(spark, sf_dir).withColumn("before", F.col("sapling_size") - F.col("sapling"))
    spans = windows.subtree_spans(rows, "before", "sapling_size", 256).select("subtree", "height", "hash")
    return spans.withColumn("root", derive.digest("root:", F.col("subtree"))).where("subtree >= 1").orderBy("subtree").limit(5)


# --- tiers


def _three(spark, sf_dir) -> DataFrame:
    tip = _tip(spark, sf_dir)
    rows = derive.headers(spark, sf_dir).select("height", "hash")
    part = lambda t: rows.where(tiers.tier_of(F.col("height"), tip) == t)
    return tiers.unite(part("sealed"), part("mutable"), part("volatile"))


_TIER = f"CASE WHEN height <= ({_TIP} - 100 + 1) // 1000 * 1000 - 1 THEN 'sealed' WHEN height <= {_TIP} - 10 THEN 'mutable' ELSE 'volatile' END"


@query("tier_union", f"WITH {_HEADERS} SELECT height, hash, {_TIER} AS tier FROM headers")
def _(spark, sf_dir):
    return _three(spark, sf_dir)


@query("tier_coverage", f"WITH {_HEADERS} SELECT {_TIER} AS tier, CAST(count(*) AS BIGINT) AS n_blocks, min(height) AS first_height, max(height) AS last_height FROM headers GROUP BY 1")
def _(spark, sf_dir):
    return tiers.coverage(_three(spark, sf_dir))


@query("export_missing_ranges", f"""WITH {_RANGES} SELECT start_height, CASE WHEN start_height % 3000 = 0 THEN 'missing' ELSE 'wrong length' END AS reason FROM ranges WHERE n_blocks = 1000 AND (start_height % 3000 = 0 OR start_height % 2000 = 1000)""")
def _(spark, sf_dir):
    rows = windows.range_rollup(sized(spark, sf_dir), _SIZES).where(F.col("n_blocks") == RANGE_SIZE)
    wanted = rows.select("start_height", (F.col("sapling_size") + 100).alias("blob_len"))
    s = F.col("start_height")
    present = wanted.where(s % 3000 != 0).withColumn("blob_len", F.when(s % 2000 == 1000, F.col("blob_len") + 1).otherwise(F.col("blob_len")))
    return tiers.missing_ranges(wanted, present)


@query("blob_chunks", f"""WITH {_RANGES}, b AS (SELECT start_height, sapling * 40 AS n FROM ranges), c AS (SELECT start_height, n, unnest(range(0, (n - 10000 + 8191) // 8192)) AS chunk FROM b WHERE n > 10000)
  SELECT start_height, chunk, 10000 + chunk * 8192 AS "at", least(8192, n - 10000 - chunk * 8192) AS size FROM c""")
def _(spark, sf_dir):
    rows = windows.range_rollup(sized(spark, sf_dir), _SIZES).select("start_height", (F.col("sapling_size") * 40).alias("n"))
    return tiers.byte_chunks(rows, "n", 8192, 10000).drop("n")


@query("frame_reassembly", """WITH f AS (SELECT user_id AS message, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_type, event_id,
    count(*) OVER (PARTITION BY user_id) AS n FROM events), g AS (SELECT message, place, CASE WHEN message % 10 = 3 AND place = 2 THEN 9 ELSE 1 END AS kind, event_type AS body, place < n - 1 OR message % 10 = 4 AS more FROM f WHERE NOT (message % 10 = 5 AND place = 1))
  SELECT message, CASE WHEN problem IS NULL THEN body END AS body, problem FROM (
    SELECT message, string_agg(body, '' ORDER BY place) AS body, CASE WHEN count(DISTINCT kind) > 1 THEN 'kind changes' WHEN max(place) <> count(*) - 1 THEN 'frame missing' WHEN bool_and(more) THEN 'no last frame' END AS problem FROM g GROUP BY message)""")
def _(spark, sf_dir):
    m = F.col("user_id")
    own = Window.partitionBy("user_id").orderBy("event_id")
    rows = derive.table(spark, sf_dir, "events").withColumn("place", (F.row_number().over(own) - 1).cast("bigint")).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    kind = F.when((m % 10 == 3) & (F.col("place") == 2), 9).otherwise(1)
    parts = rows.where(~((m % 10 == 5) & (F.col("place") == 1))).select(m.alias("message"), "place", kind.alias("kind"), ((F.col("place") < F.col("n") - 1) | (m % 10 == 4)).alias("more"), F.col("event_type").alias("body"))
    return tiers.frames(parts)


# --- verification


@query("hash_index_check", f"""WITH {_HEADERS} SELECT height, CASE WHEN height % 500 = 1 THEN 'not indexed' ELSE 'other height' END AS "check" FROM headers WHERE height % 500 = 1 OR height % 500 = 2""")
def _(spark, sf_dir):
    h = F.col("height")
    blocks = derive.headers(spark, sf_dir)
    index = blocks.where(h % 500 != 1).select("hash", F.when(h % 500 == 2, h + 1).otherwise(h).alias("height"))
    return verify.index_violations(blocks, index)


@query("duplicate_hash", f"WITH {_HEADERS} SELECT hash, CAST(2 AS BIGINT) AS n FROM headers WHERE height BETWEEN 1000 AND 1004")
def _(spark, sf_dir):
    blocks = derive.headers(spark, sf_dir)
    return verify.duplicate_hashes(blocks.where("height < 1005"), blocks.where("height >= 1000"))


def _entries(spark, sf_dir) -> DataFrame:
    """Manifest entries of the whole ranges."""
    rows = windows.range_rollup(sized(spark, sf_dir), _SIZES).where(F.col("n_blocks") == RANGE_SIZE)
    rows = rows.withColumnsRenamed({v: k for k, v in _SIZE_OF.items()}).withColumn("end_hash", derive.digest(F.col("end_height")))
    frontiers = {f"{p}_frontier": F.when(F.col(p) > 0, derive.digest(f"{p}:", F.col(p))).otherwise("") for p in SHIELDED}
    return rows.withColumns(frontiers)


_ENTRIES = f"""{_RANGES}, entries AS (SELECT start_height, end_height, sapling, orchard, ironwood, sha256(CAST(end_height AS VARCHAR)) AS end_hash,
  CASE WHEN sapling > 0 THEN sha256('sapling:' || sapling) ELSE '' END AS sapling_frontier, CASE WHEN orchard > 0 THEN sha256('orchard:' || orchard) ELSE '' END AS orchard_frontier,
  CASE WHEN ironwood > 0 THEN sha256('ironwood:' || ironwood) ELSE '' END AS ironwood_frontier FROM ranges WHERE n_blocks = 1000)"""
_EPOCHS = f"""{_ENTRIES}, a AS (SELECT start_height, sapling + orchard + ironwood - coalesce(lag(sapling + orchard + ironwood) OVER (ORDER BY start_height), 0) AS w, row_number() OVER (ORDER BY start_height) AS k FROM entries),
  f AS (WITH RECURSIVE r AS (SELECT k, start_height, 0 AS g, 1 AS n, w, 1 >= 4 OR w >= 15000 AS done FROM a WHERE k = 1
    UNION ALL SELECT a.k, a.start_height, CASE WHEN r.done THEN r.g + 1 ELSE r.g END, CASE WHEN r.done THEN 1 ELSE r.n + 1 END, CASE WHEN r.done THEN a.w ELSE r.w + a.w END,
    CASE WHEN r.done THEN 1 ELSE r.n + 1 END >= 4 OR CASE WHEN r.done THEN a.w ELSE r.w + a.w END >= 15000 FROM r JOIN a ON a.k = r.k + 1) SELECT * FROM r)"""


@query("epoch_groups", f"""WITH {_EPOCHS} SELECT start_height, CAST(g AS BIGINT) AS "group", done AS by_rule, done OR start_height = max(start_height) OVER () AS ends FROM f""")
def _(spark, sf_dir):
    return verify.epoch_groups(_entries(spark, sf_dir), 4, 15_000)


@query("epoch_part_after", f"""WITH {_EPOCHS} SELECT start_height, CAST(g AS BIGINT) AS "group" FROM f WHERE start_height > 5999 AND g = (SELECT g FROM f WHERE start_height = 6000)""")
def _(spark, sf_dir):
    return verify.epoch_part_after(verify.epoch_groups(_entries(spark, sf_dir), 4, 15_000), 5999).select("start_height", "group")


@query("epoch_commitments", f"""WITH {_EPOCHS} SELECT CAST(g AS BIGINT) AS epoch, min(f.start_height) AS start_height, max(f.start_height) + 999 AS end_height, CAST(count(*) AS BIGINT) AS n_ranges, CAST(sum(a.w) AS BIGINT) AS commitments, least(CAST(sum(a.w) AS BIGINT) * 64, 2000000) AS budget FROM f JOIN a USING (k) GROUP BY g""")
def _(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    total = scalars.total(F.col(p) for p in SHIELDED)
    added = entries.select("start_height", (total - F.coalesce(F.lag(total).over(Window.orderBy("start_height")), F.lit(0))).alias("w"))
    rows = verify.epoch_groups(entries, 4, 15_000).join(added, "start_height")
    sums = rows.groupBy(F.col("group").alias("epoch")).agg(F.min("start_height").alias("start_height"), (F.max("start_height") + 999).alias("end_height"), F.count("*").alias("n_ranges"), F.sum("w").alias("commitments"))
    return sums.withColumn("budget", F.least(F.col("commitments") * 64, F.lit(2_000_000)))


@query("manifest_entries", f"WITH {_ENTRIES} SELECT * FROM entries")
def _(spark, sf_dir):
    return _entries(spark, sf_dir).drop("n_blocks")


@query("manifest_violations", f"""WITH {_ENTRIES}, d AS (SELECT start_height, CASE WHEN start_height = 0 THEN end_height - 1 ELSE end_height END AS end_height, CASE WHEN start_height % 4000 = 3000 THEN 0 ELSE sapling END AS sapling, orchard, ironwood,
    CASE WHEN start_height % 5000 = 2000 THEN '' ELSE orchard_frontier END AS orchard_frontier FROM entries), l AS (SELECT *, lag(end_height) OVER w AS be, lag(sapling) OVER w AS bs, lag(orchard_frontier) OVER w AS bo, lead(start_height) OVER w AS af FROM d WINDOW w AS (ORDER BY start_height))
  SELECT start_height, "check" FROM (SELECT start_height, CASE WHEN start_height <> coalesce(be + 1, 0) THEN 'start' WHEN end_height <> start_height + 999 THEN 'length' WHEN sapling < coalesce(bs, 0) THEN 'sizes fall'
    WHEN coalesce(bo, '') <> '' AND orchard_frontier = '' THEN 'pool ends' WHEN af IS NULL THEN 'epoch end' END AS "check" FROM l) WHERE "check" IS NOT NULL""")
def _(spark, sf_dir):
    s = F.col("start_height")
    rows = _entries(spark, sf_dir).withColumn("epoch_end", F.lit(False))
    rows = rows.withColumn("end_height", F.when(s == 0, F.col("end_height") - 1).otherwise(F.col("end_height")))
    rows = rows.withColumn("sapling", F.when(s % 4000 == 3000, 0).otherwise(F.col("sapling")))
    rows = rows.withColumn("orchard_frontier", F.when(s % 5000 == 2000, "").otherwise(F.col("orchard_frontier")))
    return verify.manifest_violations(rows, 14_999)


@query("verified_prefix", f"""WITH {_RANGES}, verified AS (SELECT start_height FROM ranges WHERE n_blocks = 1000 AND start_height <> 7000)
  SELECT start_height FROM (SELECT start_height, start_height // 1000 - row_number() OVER (ORDER BY start_height) AS run FROM verified) WHERE run = -1""")
def _(spark, sf_dir):
    rows = windows.range_rollup(sized(spark, sf_dir), _SIZES).where(F.col("n_blocks") == RANGE_SIZE)
    verified = rows.where("start_height <> 7000").select("start_height")
    return windows.contiguous_prefix(verified, 0, "start_height", RANGE_SIZE)


@query("range_check_first_failure", f"""WITH {_RANGES} SELECT start_height, start_height + CASE WHEN start_height % 2000 = 0 THEN 17 ELSE 999 END AS height, CASE WHEN start_height % 2000 = 0 THEN 'orchard_size' ELSE 'end_hash' END AS "check" FROM ranges WHERE n_blocks = 1000 AND (start_height % 2000 = 0 OR start_height % 3000 = 0)""")
def _(spark, sf_dir):
    h, s = F.col("height"), F.col("start_height")
    blocks = sized(spark, sf_dir).withColumnsRenamed({p: f"add_{p}" for p in SHIELDED})
    damaged = blocks.withColumn("orchard_size", F.when(h % 2000 == 17, F.col("orchard_size") + 1).otherwise(F.col("orchard_size")))
    entries = _entries(spark, sf_dir).withColumn("end_hash", F.when(s % 3000 == 0, F.lit("0" * 64)).otherwise(F.col("end_hash")))
    return verify.range_violations(damaged, entries)


@query("startup_check", f"""WITH {_HEADERS} SELECT height, 'not indexed' AS "check" FROM headers WHERE height % 640 = 9""")
def _(spark, sf_dir):
    blocks = derive.headers(spark, sf_dir)
    return verify.startup(blocks, blocks.where(F.col("height") % 640 != 9).select("hash", "height"))


@query("sample_heights", f"WITH {_HEADERS} SELECT start_height, height FROM (SELECT height // 1000 * 1000 AS start_height, height, row_number() OVER (PARTITION BY height // 1000 ORDER BY sha256('seed:' || height)) AS k FROM headers) WHERE k <= 3")
def _(spark, sf_dir):
    return verify.sampled_heights(derive.headers(spark, sf_dir), 3, "seed")


@query("attest_roots", f"""WITH {_RANGES}, r AS (SELECT 'sapling' AS pool, start_height, sha256('r' || sapling) AS root FROM ranges UNION ALL SELECT 'orchard', start_height, sha256('r' || orchard) FROM ranges)
  SELECT pool, min(start_height) AS start_height, CASE WHEN pool = 'sapling' THEN 'differs' ELSE 'not answered' END AS kind FROM r WHERE (pool = 'sapling' AND start_height % 5000 = 1000) OR (pool = 'orchard' AND start_height % 7000 = 0) GROUP BY pool""")
def _(spark, sf_dir):
    rows = windows.range_rollup(sized(spark, sf_dir), _SIZES)
    s = F.col("start_height")
    of = lambda p: rows.select(F.lit(p).alias("pool"), "start_height", derive.digest("r", F.col(f"{p}_size")).alias("root"))
    ours = of("sapling").union(of("orchard"))
    theirs = ours.where((F.col("pool") == "sapling") | (s % 7000 != 0))
    theirs = theirs.withColumn("root", F.when((F.col("pool") == "sapling") & (s % 5000 == 1000), F.lit("?")).otherwise(F.col("root")))
    return verify.root_mismatch(ours, theirs, ["start_height"])


@query("subtree_multiset", f"""WITH {_SIZED}, x AS (SELECT sapling_size // 512 AS hi, (sapling_size - sapling) // 512 AS lo FROM sized), r AS (SELECT unnest(range(lo, hi)) AS subtree FROM x WHERE hi > lo)
  SELECT 'only first' AS side, subtree FROM r WHERE subtree % 3 = 0 UNION ALL SELECT 'only second', subtree + 100000 FROM r WHERE subtree % 3 = 0""")
def _(spark, sf_dir):
    rows = sized(spark, sf_dir).withColumn("before", F.col("sapling_size") - F.col("sapling"))
    spans = windows.subtree_spans(rows, "before", "sapling_size", 512).select("subtree")
    n = F.col("subtree")
    return verify.same_multiset(spans, spans.select(F.when(n % 3 == 0, n + 100000).otherwise(n).alias("subtree")))


_LEAVES = f"""{_SIZED}, leaves AS (SELECT s.sapling_size - s.sapling + row_number() OVER (PARTITION BY i.height ORDER BY i.tx, i.place) - 1 AS position, sha256(i.id || 'c') AS leaf
  FROM items i JOIN sized s USING (height) WHERE i.kind = 'output')"""


@query("subtree_rebuild", f"""WITH {_LEAVES}, a AS (SELECT position // 2 AS position, sha256(string_agg(leaf, '' ORDER BY position)) AS node, count(*) AS n FROM leaves GROUP BY 1)
  SELECT position // 2 AS subtree, sha256(string_agg(node, '' ORDER BY position)) AS root FROM a WHERE n = 2 GROUP BY 1 HAVING count(*) = 2""")
def _(spark, sf_dir):
    """Roots of subtrees of four commitments, from the chain order of the commitments themselves."""
    from ledgerloom.operators import merkle

    before = sized(spark, sf_dir).select("height", (F.col("sapling_size") - F.col("sapling")).alias("before"))
    place = F.row_number().over(Window.partitionBy("height").orderBy("tx", "place")) - 1
    made = derive.items(spark, sf_dir).where("kind = 'output'").withColumn("k", place).join(before, "height")
    leaves = made.select((F.col("before") + F.col("k")).alias("position"), derive.digest(F.col("id"), "c").alias("leaf"))
    return merkle.subtree_roots(leaves, 2)


@query("range_listing", f"WITH {_RANGES} SELECT start_height, CASE WHEN start_height % 3000 = 0 THEN 'verified' ELSE 'unverified' END AS state FROM ranges WHERE start_height >= 2000 AND start_height % 4000 <> 0")
def _(spark, sf_dir):
    from ledgerloom.sources.snapshot import listing

    s = F.col("start_height")
    rows = windows.range_rollup(sized(spark, sf_dir), _SIZES).select("start_height")
    state = F.when(s % 4000 == 0, "rejected").when(s % 3000 == 0, "verified").otherwise("unverified")
    return listing(rows.withColumn("state", state), 2000)


@query("mined_answers", f"WITH {_OUTPUTS} SELECT txid AS asked, txid, height FROM outputs WHERE height % 5 > 1")
def _(spark, sf_dir):
    from ledgerloom.service import mined_answer

    h = F.col("height")
    rows = derive.outputs(spark, sf_dir).select(F.col("txid").alias("asked"), "txid", F.when(h % 5 == 0, F.lit(-1)).when(h % 5 > 1, h).alias("height"))
    return mined_answer(rows)


# --- addresses


def _wanted(spark, sf_dir) -> DataFrame:
    rows = derive.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 == 0)
    listed = rows.select(F.col("c_custkey").cast("string").alias("address"))
    return listed.union(listed)


_ASKED = "asked AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS address FROM customer WHERE c_custkey % 3 = 0)"


def _unspent(spark, sf_dir) -> DataFrame:
    return address.unspent(derive.outputs(spark, sf_dir), derive.spends(spark, sf_dir))


@query("address_balance", f"WITH {_OUTPUTS}, {_ASKED} SELECT a.address, CAST(coalesce(sum(value) FILTER (NOT spent), 0) AS BIGINT) AS balance FROM asked a LEFT JOIN outputs o USING (address) GROUP BY a.address")
def _(spark, sf_dir):
    return address.balances(_unspent(spark, sf_dir), _wanted(spark, sf_dir))


@query("address_balance_distinct", f"WITH {_OUTPUTS}, {_ASKED} SELECT CAST(coalesce(sum(value), 0) AS BIGINT) AS balance FROM outputs JOIN asked USING (address) WHERE NOT spent")
def _(spark, sf_dir):
    # all addresses of the table; the limit of a client's request (address.limited) is none of the log's
    return address.balance(_unspent(spark, sf_dir), _wanted(spark, sf_dir))


@query("address_utxos", f"WITH {_OUTPUTS}, {_ASKED} SELECT height, CAST(0 AS BIGINT) AS tx_index, txid, CAST(0 AS BIGINT) AS out_index, address, value FROM outputs JOIN asked USING (address) WHERE NOT spent AND height >= 250 ORDER BY height LIMIT 100")
def _(spark, sf_dir):
    return address.utxos(_unspent(spark, sf_dir), _wanted(spark, sf_dir), 250, 100)


@query("address_transactions", f"WITH {_OUTPUTS}, {_ASKED} SELECT txid, height, CAST(0 AS BIGINT) AS tx_index FROM outputs JOIN asked USING (address) WHERE height BETWEEN 100 AND 1200")
def _(spark, sf_dir):
    mined = derive.outputs(spark, sf_dir)
    history = mined.join(_wanted(spark, sf_dir).distinct(), "address", "left_semi").where(F.col("height").between(100, 1200)).select("txid", "height", "tx_index")
    return address.transactions(history, mined)


@query("transaction_lookup", f"""WITH {_OUTPUTS}, {_PENDING}, w AS (SELECT sha256('t:' || o_orderkey) AS txid FROM orders WHERE o_orderkey % 100 = 1 UNION ALL SELECT sha256('m:' || event_id) FROM events WHERE event_id % 50 = 2)
  SELECT txid, height FROM w JOIN outputs USING (txid) UNION ALL SELECT txid, 0 FROM w JOIN pending USING (txid)""")
def _(spark, sf_dir):
    o, e = derive.table(spark, sf_dir, "orders"), derive.table(spark, sf_dir, "events")
    wanted = o.where(F.col("o_orderkey") % 100 == 1).select(derive.digest("t:", F.col("o_orderkey")).alias("txid"))
    wanted = wanted.union(e.where(F.col("event_id") % 50 == 2).select(derive.digest("m:", F.col("event_id"))))
    return address.find_transaction(derive.outputs(spark, sf_dir), derive.pending(spark, sf_dir), wanted)


# --- pending transactions


@query("mempool_exclude_suffix", f"""WITH {_PENDING}, s AS (SELECT right(txid, 5) AS suffix FROM pending WHERE event_id % 4 = 1 UNION SELECT 'a' UNION SELECT 'zz'), h AS (SELECT suffix, count(*) AS n, min(txid) AS txid FROM s JOIN pending ON ends_with(txid, suffix) GROUP BY suffix)
  SELECT txid, event_id, user_id FROM pending WHERE txid NOT IN (SELECT txid FROM h WHERE n = 1)""")
def _(spark, sf_dir):
    waiting = derive.pending(spark, sf_dir)
    few = spark.createDataFrame([("a",), ("zz",), ("0" * 66,)], "suffix string")
    return mempool.remaining(waiting, waiting.where("event_id % 4 = 1").select(F.expr("right(txid, 5)").alias("suffix")).union(few))


@query("mempool_retain", f"WITH {_PENDING} SELECT * FROM pending WHERE event_id % 3 <> 0")
def _(spark, sf_dir):
    waiting = derive.pending(spark, sf_dir)
    return mempool.retain(waiting, waiting.where("event_id % 3 <> 0"))


@query("mempool_compact", f"""WITH {_ITEMS} SELECT sha256('tx:' || height || ':' || tx) AS txid, CAST(0 AS BIGINT) AS "index", CAST(count(*) FILTER (pool = 'orchard') AS BIGINT) AS n_actions, CAST(count(*) FILTER (pool = 'ironwood') AS BIGINT) AS n_ironwood
  FROM items GROUP BY height, tx HAVING count(*) FILTER (pool <> 'sapling') > 0""")
def _(spark, sf_dir):
    waiting = derive.transactions(spark, sf_dir).select(F.col("tx.txid").alias("txid"), "tx")
    rows = project.compact_mempool(waiting, ["orchard", "ironwood"])
    return rows.select("txid", F.col("tx.index").alias("index"), F.size("tx.actions").cast("bigint").alias("n_actions"), F.size("tx.ironwood_actions").cast("bigint").alias("n_ironwood"))


# --- statistics


def _samples(spark, sf_dir) -> DataFrame:
    e = derive.table(spark, sf_dir, "events")
    phase = F.when(F.col("event_id") % 10 == 0, "warmup").otherwise("measure")
    status = F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "error").when((F.col("event_type") == "signup") & (F.col("event_id") % 70 == 0), "error").otherwise("ok")
    return e.select(
        F.col("event_type").alias("scenario"), "event_id", phase.alias("phase"), status.alias("status"), (F.col("user_id") + 1).alias("blocks"),
        F.round(F.col("value") * 100).cast("bigint").alias("complete_us"), F.col("event_id").alias("start_height"), (F.col("event_id") + F.col("user_id")).alias("end_height"),
    )


_SAMPLES = """samples AS (SELECT event_type AS scenario, event_id, CASE WHEN event_id % 10 = 0 THEN 'warmup' ELSE 'measure' END AS phase,
  CASE WHEN (event_type = 'error' AND event_id % 3 = 0) OR (event_type = 'signup' AND event_id % 70 = 0) THEN 'error' ELSE 'ok' END AS status,
  user_id + 1 AS blocks, CAST(round(value * 100) AS BIGINT) AS complete_us, event_id AS start_height, event_id + user_id AS end_height FROM events)"""


@query("scenario_summary", f"""WITH {_SAMPLES}, s AS (SELECT scenario, CAST(count(*) FILTER (phase = 'measure') AS BIGINT) AS attempts, CAST(count(*) FILTER (phase = 'measure' AND status = 'ok') AS BIGINT) AS successes,
    CAST(count(*) FILTER (phase = 'measure' AND status <> 'ok') AS BIGINT) AS errors, count(*) FILTER (phase = 'warmup' AND status <> 'ok') AS we, min(least(start_height, end_height)) FILTER (phase = 'measure') AS min_height, max(greatest(start_height, end_height)) FILTER (phase = 'measure') AS max_height,
    CAST(coalesce(sum(blocks) FILTER (phase = 'measure' AND status = 'ok'), 0) AS BIGINT) AS blocks, CAST(coalesce(sum(complete_us) FILTER (phase = 'measure' AND status = 'ok'), 0) AS BIGINT) AS busy_us FROM samples GROUP BY scenario)
  SELECT * EXCLUDE (we), CASE WHEN we > 0 THEN 'warmup_failed' WHEN errors > 0 THEN 'failed' WHEN attempts = 0 THEN 'no_samples' ELSE 'ok' END AS status,
    CASE WHEN we = 0 AND errors = 0 AND attempts > 0 AND busy_us > 0 THEN blocks * 1000000.0::DOUBLE / busy_us END AS blocks_per_s FROM s""")
def _(spark, sf_dir):
    return stats.scenario_summary(_samples(spark, sf_dir), ["scenario"])


@query("percentiles_nearest_rank", f"WITH {_SAMPLES} SELECT scenario, CAST(quantile_disc(complete_us, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(complete_us, 0.95) AS BIGINT) AS p95, CAST(quantile_disc(complete_us, 0.99) AS BIGINT) AS p99, max(complete_us) AS max FROM samples GROUP BY scenario")
def _(spark, sf_dir):
    found = stats.nearest_rank(_samples(spark, sf_dir), ["scenario"], "complete_us", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.withColumns({p: F.col(p).cast("bigint") for p in ("p50", "p95", "p99")})


@query("percentiles_floor_index", f"""WITH {_SAMPLES}, r AS (SELECT scenario, complete_us, row_number() OVER (PARTITION BY scenario ORDER BY complete_us) - 1 AS k, count(*) OVER (PARTITION BY scenario) AS n FROM samples)
  SELECT scenario, max(complete_us) FILTER (k = n // 2) AS p50, max(complete_us) FILTER (k = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95 FROM r GROUP BY scenario""")
def _(spark, sf_dir):
    return stats.floor_index(_samples(spark, sf_dir), ["scenario"], "complete_us", {"p50": 0.5, "p95": 0.95})


def _marks(spark, sf_dir) -> DataFrame:
    e = derive.table(spark, sf_dir, "events")
    rows = e.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("at"), F.when(F.col("event_id") % 13 != 0, F.col("event_id")).alias("height"), F.col("user_id").alias("reads"))
    return stats.first_per_band(rows, "height", "at", 250)


_MARKS = """marks AS (SELECT * FROM (SELECT event_id // 250 AS band, epoch_us(ts) // 1000 AS "at", event_id AS height, user_id AS reads, row_number() OVER (PARTITION BY event_id // 250 ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events WHERE event_id % 13 <> 0) WHERE k = 1)"""


@query("band_marks", f"""WITH {_MARKS} SELECT band, "at", height, reads FROM marks""")
def _(spark, sf_dir):
    return _marks(spark, sf_dir)


@query("band_deltas", f"""WITH {_MARKS}, d AS (SELECT band, lead("at") OVER w - "at" AS seconds, lead(height) OVER w - height AS d_height, lead(reads) OVER w - reads AS d_reads FROM marks WINDOW w AS (ORDER BY band))
  SELECT *, CAST(d_height AS DOUBLE) / seconds AS rate_height, CAST(d_reads AS DOUBLE) / seconds AS rate_reads FROM d WHERE seconds > 0""")
def _(spark, sf_dir):
    return stats.band_deltas(_marks(spark, sf_dir), "at", ["height", "reads"])


@query("band_labels", f"""WITH {_MARKS}, n AS (SELECT band, lead(band) OVER (ORDER BY band) AS nb FROM marks WHERE band % 7 <> 3), l AS (SELECT *, CASE WHEN band * 250 % 1000 = 0 THEN (band * 250 // 1000) || 'k' ELSE CAST(band * 250 AS VARCHAR) END AS a,
  CASE WHEN nb * 250 % 1000 = 0 THEN (nb * 250 // 1000) || 'k' ELSE CAST(nb * 250 AS VARCHAR) END AS z FROM n) SELECT band, CASE WHEN nb IS NULL THEN a || '+' WHEN nb = band + 1 THEN a ELSE a || '-' || z END AS label FROM l""")
def _(spark, sf_dir):
    marks = _marks(spark, sf_dir).where("band % 7 <> 3").select("band")
    following = F.lead("band").over(Window.orderBy("band"))
    return marks.withColumn("nb", following).select("band", scalars.band_label(F.col("band"), F.col("nb"), 250).alias("label"))


@query("carry_forward", "SELECT event_id, event_type, coalesce(last_value(CASE WHEN event_id % 4 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id), 0.0::DOUBLE) AS value FROM events")
def _(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))
    return stats.carry_forward(rows, ["event_type"], "event_id", "value")


@query("asof_next", """WITH s AS (SELECT event_id AS t, value FROM events WHERE event_type = 'error'), m AS (SELECT max(t) AS t FROM s)
  SELECT e.event_id, coalesce(n.t, m.t) AS next_time, coalesce(n.value, (SELECT value FROM s WHERE t = (SELECT t FROM m))) AS next_value FROM events e CROSS JOIN m ASOF LEFT JOIN s n ON e.event_id <= n.t WHERE e.event_type <> 'error'""")
def _(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events")
    samples = e.where("event_type = 'error'").select("event_id", "value")
    return stats.next_sample(e.where("event_type <> 'error'").select("event_id"), samples, "event_id", "value", 16)


_STATUS = """CASE WHEN i % 11 = 0 THEN CASE WHEN l_quantity < 10 THEN 'absent' ELSE 'MISMATCH' END WHEN i % 11 = 1 THEN 'not-computed' WHEN i % 11 = 2 THEN 'match-reversed' WHEN i % 11 = 3 THEN 'MISMATCH' ELSE 'match' END"""


@query("pool_status", f"""WITH x AS (SELECT l_orderkey AS height, l_returnflag AS pool, l_partkey + l_suppkey AS i, l_quantity FROM lineitem) SELECT pool, status, CAST(count(*) AS BIGINT) AS n, min(height) AS first_height FROM (SELECT *, {_STATUS} AS status FROM x) GROUP BY pool, status""")
def _(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("height"), F.col("l_returnflag").alias("pool"), (F.col("l_partkey") + F.col("l_suppkey")).alias("i"), "l_quantity")
    i = F.col("i") % 11
    ours = F.when(i != 1, derive.digest(F.col("i")))
    theirs = F.when(i == 0, F.lit(None)).when(i == 2, scalars.display_order(ours)).when(i == 3, derive.digest("other")).otherwise(derive.digest(F.col("i")))
    size = F.when(F.col("l_quantity") < 10, 0).otherwise(1)
    return stats.status_counts(rows.withColumn("status", stats.pool_status(size, ours, theirs)), ["pool"], "status", "height")


@query("worker_stats", "SELECT event_type AS stage, CAST(count(*) AS BIGINT) AS calls, CAST(sum(user_id) AS BIGINT) AS blocks, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS micros FROM events GROUP BY 1")
def _(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum("user_id").alias("blocks"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("micros"))


@query("chunk_cumulative", f"WITH {_SAMPLES} SELECT event_id, CAST(sum(complete_us) OVER (ORDER BY event_id) AS BIGINT) AS elapsed_us FROM samples")
def _(spark, sf_dir):
    return windows.running_sums(_samples(spark, sf_dir).select("event_id", "complete_us"), {"complete_us": "elapsed_us"}, "event_id").select("event_id", "elapsed_us")


@query("cpu_windows", """WITH RECURSIVE a AS (SELECT user_id AS worker, event_id AS o, CAST(round(value) AS BIGINT) AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  r AS (SELECT worker, k, o, 0 AS g, w, w >= 100 AS done FROM a WHERE k = 1 UNION ALL SELECT a.worker, a.k, a.o, CASE WHEN r.done THEN r.g + 1 ELSE r.g END, CASE WHEN r.done THEN a.w ELSE r.w + a.w END, CASE WHEN r.done THEN a.w ELSE r.w + a.w END >= 100 FROM r JOIN a ON a.worker = r.worker AND a.k = r.k + 1)
  SELECT worker, CAST(g AS BIGINT) AS "window", CAST(count(*) AS BIGINT) AS n, max(o) AS last_sample, bool_or(done) AS complete FROM r GROUP BY worker, g""")
def _(spark, sf_dir):
    rows = derive.table(spark, sf_dir, "events").select(F.col("user_id").alias("worker"), "event_id", F.round("value").cast("bigint").alias("w"))
    groups = windows.greedy_groups(rows, "event_id", "w", 1 << 40, 100, "worker")
    return groups.groupBy("worker", F.col("group").alias("window")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_sample"), F.max("by_rule").alias("complete"))


@query("metric_lines", """SELECT event_id, event_type AS metric, CAST(user_id AS VARCHAR) AS label, CAST(event_id AS DOUBLE) AS value FROM events""")
def _(spark, sf_dir):
    e = derive.table(spark, sf_dir, "events")
    line = F.concat("event_type", F.lit('_total{kind="x", worker="'), F.col("user_id").cast("string"), F.lit('"} '), F.col("event_id").cast("string"))
    rows = e.select("event_id", line.alias("line"))
    return rows.select("event_id", scalars.metric_name(F.col("line")).alias("metric"), scalars.metric_label(F.col("line"), "worker").alias("label"), scalars.metric_value(F.col("line")).alias("value"))


@query("scalar_functions", """SELECT o_orderkey AS height, strftime(o_orderdate, '%Y-%m-%dT%H%M%SZ') AS path_time, least(200 * CAST(power(2, o_orderkey % 12) AS BIGINT), 2000) AS backoff_ms,
  CASE WHEN o_orderkey % 1000 = 0 THEN (o_orderkey // 1000) || 'k' ELSE CAST(o_orderkey AS VARCHAR) END AS label FROM orders""")
def _(spark, sf_dir):
    h = F.col("height")
    return derive.headers(spark, sf_dir).select("height", scalars.path_time(F.col("time")).alias("path_time"), scalars.backoff(h % 12).alias("backoff_ms"), scalars.height_label(h).alias("label"))


@query("late_rows", f"""SELECT o_orderkey AS height, CASE WHEN o_orderkey <= (1388 - 99) // 1000 * 1000 - 1 THEN 'deep recovery' WHEN o_orderkey <= 1378 THEN 'replace' WHEN o_orderkey <= 1388 THEN 'head' ELSE 'ahead' END AS action FROM orders""")
def _(spark, sf_dir):
    from ledgerloom.streaming.head import late_rows

    return late_rows(derive.headers(spark, sf_dir).select("height"), 1388)


@query("fill_range_meta", f"WITH {_ENTRIES} SELECT start_height, end_hash, 'unverified' AS state FROM entries WHERE start_height % 2000 = 0")
def _(spark, sf_dir):
    from ledgerloom.streaming.head import fill_range_meta

    entries = _entries(spark, sf_dir).select("start_height", "end_hash")
    return fill_range_meta(entries, entries.where("start_height % 2000 <> 0"))


@query("health_status", "SELECT event_id, CASE WHEN user_id % 2 = 0 AND value < 20 THEN 'SERVING' ELSE 'NOT_SERVING' END AS status FROM events")
def _(spark, sf_dir):
    from ledgerloom.streaming.head import health

    rows = derive.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("ready"), (F.col("value") < 20).alias("fresh"))
    return health(rows).select("event_id", "status")


# --- beyond SQL


@query("stream_dedup", f"WITH {_PENDING} SELECT DISTINCT user_id FROM pending")
def _(spark, sf_dir):
    """Pending transactions through a stream: each sender once."""
    from ledgerloom.plans.runtime import fresh_path
    from ledgerloom.streaming.head import pending_once

    rows = derive.table(spark, sf_dir, "events")
    live = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/events.parquet*")
    once = pending_once(live.where("event_type = 'purchase'").select("user_id"), "user_id")
    out = fresh_path(spark, "stream_dedup")
    run = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}_progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("user_id bigint").parquet(out)


# --- round trips and streams


@query("seal_boundaries", "SELECT o_orderkey AS tip, CASE WHEN o_orderkey >= 100 THEN (o_orderkey - 99) // 1000 * 1000 - 1 ELSE -1 END AS sealed, greatest(o_orderkey - 10, -1) AS durable FROM orders")
def _(spark, sf_dir):
    t = F.col("o_orderkey")
    sealed = F.when(t >= 100, F.floor((t - 99) / RANGE_SIZE) * RANGE_SIZE - 1).otherwise(-1).cast("bigint")
    return derive.table(spark, sf_dir, "orders").select(t.alias("tip"), sealed.alias("sealed"), F.greatest(t - 10, F.lit(-1)).alias("durable"))


@query("blob_roundtrip", f"WITH {_SIZED} SELECT height, hash, prev_hash, sapling_size, orchard_size, ironwood_size FROM sized WHERE height < ({_TIP} + 1) // 1000 * 1000")
def _(spark, sf_dir):
    """All complete ranges through the packed binary form and back; a range that the tip has not filled is never packed."""
    from ledgerloom.sources import blobs

    tip = derive.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    blocks = dealt_blocks(spark, sf_dir).drop(*SHIELDED).where(F.col("height") < (tip + 1) // RANGE_SIZE * RANGE_SIZE)
    back = blobs.unpack_ranges(blobs.pack_ranges(blocks))
    return back.select("height", "hash", "prev_hash", *_SIZES)


@query("wire_roundtrip", f"WITH {_SIZED} SELECT height, hash, prev_hash, time, sapling_size, orchard_size, ironwood_size FROM sized")
def _(spark, sf_dir):
    """All blocks through the wire format and back."""
    from ledgerloom.sources import wire

    return wire.from_wire(wire.to_wire(sized_blocks(spark, sf_dir).drop(*SHIELDED))).drop("vtx")


@query("stream_depth_late_data", f"SELECT o_orderkey AS height, CASE WHEN o_orderkey <= ({_TIP} - 99) // 1000 * 1000 - 1 THEN 'deep recovery' WHEN o_orderkey <= {_TIP} - 10 THEN 'replace' WHEN o_orderkey <= {_TIP} THEN 'head' ELSE 'ahead' END AS action FROM orders")
def _(spark, sf_dir):
    """All rows, arriving on a stream, sorted out by depth below the table's own tip."""
    from ledgerloom.plans.runtime import fresh_path
    from ledgerloom.streaming.head import late_rows

    orders = derive.table(spark, sf_dir, "orders")
    live = spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parquet*")
    late = late_rows(live.select(F.col("o_orderkey").alias("height")), orders.agg(F.max("o_orderkey")).first()[0])
    out = fresh_path(spark, "stream_late")
    late.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}_progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("height bigint, action string").parquet(out)


def _packed_entries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All complete ranges, packed whenever they are read, and what a manifest says of them, written."""
    from ledgerloom.plans.runtime import stage
    from ledgerloom.sources import blobs

    full = (_tip(spark, sf_dir) + 1) // RANGE_SIZE * RANGE_SIZE
    packed = blobs.pack_ranges(dealt_blocks(spark, sf_dir).drop(*SHIELDED).where(F.col("height") < full))
    ends = sized(spark, sf_dir).where(F.col("height") % RANGE_SIZE == RANGE_SIZE - 1)
    ends = ends.select((F.col("height") - RANGE_SIZE + 1).alias("start_height"), F.col("hash").alias("end_hash"), *_SIZES)
    return packed, stage(ends.join(packed.select("start_height", "blob_len", "blob_digest"), "start_height"), "entries")


@query("checked_ranges", f"""WITH {_RANGES}, d AS (SELECT start_height, start_height // 1000 % 7 AS k FROM ranges WHERE n_blocks = 1000)
  SELECT start_height, start_height + CASE WHEN k IN (3, 5) THEN 999 ELSE 0 END AS height,
         CASE k WHEN 1 THEN 'blob_length' WHEN 2 THEN 'blob_digest' WHEN 3 THEN 'end_hash' WHEN 4 THEN 'start_link' WHEN 5 THEN 'end_tree_sizes' ELSE 'tree_sizes' END AS "check"
  FROM d WHERE k > 0""")
def _(spark, sf_dir):
    """Every complete range against a manifest that is wrong in a way of its own for six of seven ranges."""
    from ledgerloom.sources import blobs

    packed, entries = _packed_entries(spark, sf_dir)
    k = F.floor(F.col("start_height") / RANGE_SIZE) % 7
    wrong = {
        "blob_len": F.col("blob_len") + F.when(k == 1, 1).otherwise(0), "blob_digest": F.when(k == 2, F.lit("0" * 64)).otherwise(F.col("blob_digest")),
        "end_hash": F.when(k == 3, F.lit("f" * 64)).otherwise(F.col("end_hash")), "orchard_size": F.col("orchard_size") + F.when(k == 5, 1).otherwise(0),
    }
    return blobs.failures(packed, entries.withColumns(wrong))


@query("store_install", f"WITH {_RANGES} SELECT r.start_height, h.hash AS end_hash, r.sapling, r.orchard, r.ironwood, 'checked' AS state, CAST(1000 AS BIGINT) AS n_blocks FROM ranges r JOIN headers h ON h.height = r.end_height WHERE n_blocks = 1000")
def _(spark, sf_dir):
    """Complete ranges, checked and installed in an empty store: its metadata and how many blocks it has of each."""
    from ledgerloom.plans.runtime import fresh_path
    from ledgerloom.sources import blobs
    from ledgerloom.sources.store import Store

    store = Store(spark, fresh_path(spark, "store"))
    done = store.install(store.snapshot(), blobs.CheckedRanges.check(*_packed_entries(spark, sf_dir)))
    counts = done.sealed.groupBy((F.col("range_id") * RANGE_SIZE).alias("start_height")).agg(F.count("*").alias("n_blocks"))
    return done.range_meta.join(counts, "start_height")


@query("store_reorganised", f"{_replace_sql(321, 1450)}")
def _(spark, sf_dir):
    """The log in a store, and a branch from far below its sealed height: what the store serves then."""
    from ledgerloom.plans.runtime import fresh_path
    from ledgerloom.sources.store import Store

    blocks = dealt_blocks(spark, sf_dir).drop(*SHIELDED)
    store = Store(spark, fresh_path(spark, "store"))
    old = store.append(store.snapshot(), blocks)
    _, new = _fork(spark, sf_dir, 321, 1450)
    branch = old.blocks().drop("hash", "prev_hash").join(new.where("height > 321"), "height").select(*blocks.drop("range_id").columns)
    return store.replace_deep(old, 321, branch).blocks().select("height", "hash", "prev_hash")
