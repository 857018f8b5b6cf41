"""Exact duplicates through an extendible-hash index on shared files.

Native plan only (DataFrame functions).  The index has three parts, each a
table in the shared folder:

* **keys** – one light row per document: its number, 64-bit hash and SHA-256
  of the normalised text, no text;
* **directory** – entries of the global depth, each pointing to a bucket.  It
  starts as one bucket; a bucket with more than ``capacity`` distinct hashes
  splits on its next hash bit, and the directory doubles until no bucket is
  overfull (or ``MAX_DEPTH`` bits are used; such a bucket just stays longer).
  At most 2**MAX_DEPTH entries, so its broadcast is bounded (about 1 MB);
* **entries** – one row per bucket and hash with the chain of its texts (their
  SHA-256, copies and largest id), in files that each hold a contiguous range
  of (bucket, hash).

Entries are made by owner tasks.  The texts are dealt by ranges of (bucket,
hash); a task owns its range, groups it by the texts themselves, byte for byte,
and chains different texts of one hash.  There is no further exchange: the
range dealing already has each key in one place.  Hashes with more rows than a
small share of the table (found from the light keys; at most ``HOT`` of them)
are combined on the map side first, so a group that holds a third of all rows
reaches its owner as one row per map task.

A lookup goes from a key's hash through the directory to the bucket, to the
entry of (bucket, hash), and along the chain to the key's text.

Rows: a null text is the empty text.  A null ``doc_id`` is smaller than any
other.  Rows that repeat a ``doc_id`` and text are copies; exactly one of them
stays.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import common

MAX_DEPTH = 16
#: Hashes that are combined before they are dealt: those with more rows than
#: 1 / HOT of the table, and COPIES at least.
HOT = 1_000_000
COPIES = 1_000
Hash = Callable[[Column], Column]


def _slot(h: Column, depth: int = MAX_DEPTH) -> Column:
    return F.shiftrightunsigned(h, 64 - depth).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str, hash_of: Hash) -> DataFrame:
    norm = common.ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", hash_of(F.col("norm")).alias("h"))


def directory(hashes: DataFrame, capacity: int) -> DataFrame:
    """(entry, bucket, depth): entry is a MAX_DEPTH-bit hash prefix, depth the
    local depth of its bucket, bucket the bucket's first entry.  Buckets
    without a hash are left out.

    The counts of all prefixes come from those one bit longer.  A bucket is a
    prefix that fits while the one a bit shorter is overfull, so each prefix
    meets its one parent."""
    count = hashes.distinct().groupBy(_slot(F.col("h")).alias("prefix")).agg(F.count("*").alias("held"))
    level = common.stash(count, "index-prefixes")
    tree = level.select(F.lit(MAX_DEPTH).alias("depth"), "prefix", "held")
    for depth in range(MAX_DEPTH - 1, -1, -1):
        level = level.groupBy(F.expr("shiftright(prefix, 1)").alias("prefix")).agg(F.sum("held").alias("held"))
        tree = tree.unionByName(level.select(F.lit(depth).alias("depth"), "prefix", "held"))
        if depth % 4 == 0:
            tree = common.stash(tree, "index-tree")
            level = tree.where(F.col("depth") == depth).select("prefix", "held")
    overfull = (F.col("held") > capacity) & (F.col("depth") < MAX_DEPTH)
    parents = tree.where(overfull).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    fits = tree.where(~overfull).withColumn("parent", F.expr("shiftright(prefix, 1)"))
    leaves = fits.join(parents, ["depth", "parent"], "left_semi").unionByName(fits.where("depth = 0")).select(
        F.expr(f"shiftleft(prefix, {MAX_DEPTH} - depth)").alias("bucket"), "depth")
    spread = F.explode(F.expr(f"sequence(bucket, bucket + shiftleft(1, {MAX_DEPTH} - depth) - 1)"))
    return leaves.select(spread.alias("entry"), "bucket", "depth")


def _entries(rows: DataFrame, book: DataFrame, hot: DataFrame) -> DataFrame:
    """(bucket, h, chain) by owner tasks over ranges of (bucket, h)."""
    one = rows.join(hot, "h", "left_anti").select("h", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    many = rows.join(hot, "h", "left_semi").groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies"))
    placed = one.unionByName(many).withColumn("entry", _slot(F.col("h"))).join(F.broadcast(book.select("entry", "bucket")), "entry").drop("entry")
    owned = placed.repartitionByRange("bucket", "h")
    texts = owned.groupBy("bucket", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("copies").alias("copies"))
    texts = texts.select("bucket", "h", F.struct(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "copies").alias("text"))
    return texts.groupBy("bucket", "h").agg(F.collect_list("text").alias("chain")).sortWithinPartitions("bucket", "h")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hash_of: Hash = F.xxhash64) -> dict[str, DataFrame]:
    """The three stored tables of the index, as {'keys', 'directory', 'entries'}."""
    rows = _keyed(docs, id_col, text_col, hash_of)
    keys = rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    keys = common.stash(keys, "index-keys")
    book = common.stash(directory(keys.select("h"), capacity).coalesce(1), "index-directory")
    least = max(COPIES, keys.count() // HOT)
    hot = common.stash(keys.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > least).select("h"), "index-hot")
    entries = _entries(rows, book, F.broadcast(hot))     # at most HOT hashes of eight bytes
    return {"keys": keys, "directory": book, "entries": common.stash(entries, "index-entries")}


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, hash_of: Hash = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    bucket.  Texts are equal when identical after lower-casing A-Z."""
    index = build_index(docs, id_col, text_col, capacity, hash_of)
    slots = F.broadcast(index["directory"].select("entry", "bucket"))
    found = index["keys"].withColumn("entry", _slot(F.col("h"))).join(slots, "entry").join(index["entries"], ["bucket", "h"])
    at = F.filter("chain", lambda t: t["sha"] == F.col("sha"))[0]
    found = found.select("bucket", "h", "sha", "doc_id", "row", at["keep_id"].alias("keep_id"), at["copies"].alias("group_size"))
    # of the rows that carry the kept id, the first one stays
    ties = found.where("group_size > 1 AND doc_id <=> keep_id").groupBy("h", "sha").agg(F.min("row").alias("stays"))
    twins = found.where("group_size > 1").join(ties, ["h", "sha"])
    alone = found.where("group_size = 1").withColumn("stays", F.col("row"))
    return twins.unionByName(alone, allowMissingColumns=True).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("stays")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket")
