"""Row types and the fixed numbers of the log."""



# fixed values: they are part of the format that other readers of such a log expect
RANGE_SIZE = 1_000
PERSIST_DEPTH = 10
SEAL_DEPTH = 100
SCHEMA_VERSION = 1
MAX_RANGES = 10
MAX_COMMITMENTS = 1_000_000
SUBTREE_LEAVES = 1 << 16
MAX_LISTED_ADDRESSES = 1_000
MAX_DISTINCT_ADDRESSES = 10_000
CHUNK_BYTES = 1 << 20
MAX_U32 = 2**32 - 1
GENESIS_PREV = "0" * 64
SHIELDED = ("sapling", "orchard", "ironwood")
POOLS = ("transparent", *SHIELDED)

_ACTION = "array<struct<nullifier: string, cmx: string>>"
VTX = (
    "array<struct<index: bigint, txid: string, spends: array<struct<nf: string>>, outputs: array<struct<cmu: string>>, "
    f"actions: {_ACTION}, ironwood_actions: {_ACTION}>>"
)
BLOCK = f"height bigint, hash string, prev_hash string, time bigint, vtx {VTX}, sapling_size bigint, orchard_size bigint, ironwood_size bigint"
