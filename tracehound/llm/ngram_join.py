"""Exact n-gram Jaccard self-join with a prefix tree, and its components.

A document is the set of its distinct word n-grams (64-bit hashes).  Two link
when 100 * intersection >= percent * union.  Steps:

1. **Classes.**  Rows with equal sets are one class; only one row of its
   smallest id goes on, so exact copies never meet again, whether they repeat
   an id or not.
2. **Rare n-grams first.**  Of two linked sets x and y, the first
   |x| - ceil(t|x|) + 1 n-grams of x and of y in any global order share one.
   The order here: n-grams with a hash in the lowest ``LOW`` of the range come
   first, the rarest of them (counted exactly over all classes) at the front;
   the others follow by hash.  Counting only the low part makes the count a
   third of the corpus, and a set whose n-grams are mostly its own meets
   nobody.
3. **Blocks.**  Sets that share a prefix n-gram are tied to the smallest such
   set (a star, not all pairs); the components of these ties are blocks, and
   every linked pair lies within one block.  Common lines tie many short sets
   that do not link into one block, which grows faster than the corpus.  So in
   a block of more than ``CHUNK / WIDE`` n-grams all n-grams are counted.  A set
   of which fewer than ceil(t|x|) are in another set of the block links with
   none and goes; the others are counted again, ``ROUNDS`` times.  What is left
   is tied anew, by parts (see ``part_keys``): linked sets differ in so few
   n-grams that, dealt into parts by hash, some part is equal in both.  Those
   components replace the block.
4. **Tree join.**  A block's sets go into a trie of globally ordered n-grams
   (commonest of the chunk first, so that near copies share long paths).  A set
   walks the trie once: the overlap with a path is counted once for all sets
   below it, and a subtree is left when even all remaining n-grams could not
   reach the threshold.  Sets already joined are skipped, so a task emits a
   spanning forest, never all pairs.
   A block of more than ``CHUNK`` n-grams is cut into hashed chunks.  Each is
   joined by itself together with the block's smallest set id, which ties the
   chunks of a dense group to each other; then only the sets outside the
   block's largest component so far are joined with every chunk.  So a group of
   near copies is shipped once however large it is; a large block whose sets
   do not link costs (sets outside) x (chunks).
5. **Components** of the class members and the links.

Rows: null or wordless texts have an empty set and link with nothing.  Rows
that share a ``doc_id`` are one document: each distinct set of it has its own
prefix and place in the trie, and their links add up.  A row with a null ``doc_id`` gets its set size and a null component and links nothing.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import common, words, worker

LOW = 0.25
CHUNK = 1_000_000
#: A block of more than CHUNK / WIDE n-grams is counted at most ROUNDS times and tied anew by parts.
WIDE = 4
ROUNDS = 2
#: What names a set: its document, the hash of its text, and whether other rows repeat both.
SET = ("doc", "th", "again")


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; with fewer
    words, of the whole sequence; none without words."""
    h = words.word_hashes(text)
    return np.unique(words.gram_hashes(h, min(n, len(h)))) if len(h) else h


def need(size: int, percent: int) -> int:
    """Smallest overlap with which a set of this size can link at all."""
    return -(-percent * size // 100)


@functools.lru_cache(4096)
def _parts(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(class, parts, most) for both classes in which a set of this size is
    compared.  Class c takes sizes up to a last one, and a set that links is in
    the same class or the one beside it: so c is for its own sizes and the next
    class's.  ``most`` is how many n-grams two sets that link there can differ
    in; there are some more parts than that."""
    last, own = [], 0
    while own < size:
        last.append(own := 100 * (own + 1) // percent)
    out = []
    for c in range(max(0, len(last) - 2), len(last)):
        most = (last[c] + 100 * last[c] // percent) * (100 - percent) // (100 + percent)
        out.append((c, most + 2 + most // 5, most))
    return out


def part_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """64-bit keys of a sorted set; two sets that link share one.

    The n-grams are dealt into parts by hash and a key names a part with all it
    holds.  Each n-gram that only one set has spoils one part at most, so of
    more than ``most`` parts with n-grams one is equal in both sets.  Sets with
    fewer such parts also have their prefix as keys, and two of these share an
    n-gram of it."""
    found, poor = [], False
    for c, parts, most in _parts(len(grams), percent):
        part = grams % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        held, first = np.unique(part[order], return_index=True)
        found.append(words.chain(words.mix(np.uint64(c << 32) + held), np.add.reduceat(words.mix(grams[order]), first)))
        poor |= len(held) <= most
    if poor:
        found.append(grams[: len(grams) - need(len(grams), percent) + 1])
    return np.unique(np.concatenate(found))


def _signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: doc_id, row (a number of its own once stored), th (hash of the
    text), n (set size), k1, k2 (hash of the set), low (its n-grams in the low
    range), rest (further n-grams if the low ones are fewer than the prefix),
    short (prefix length)."""
    edge = np.uint64(int(LOW * 2**64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in words.texts(b, 3):
                s = shingles(text, n)
                p = len(s) - need(len(s), percent) + 1 if len(s) else 0
                cut = int(np.searchsorted(s, edge))
                out.append((len(s), *words.sequence_key(s), p, s[:cut].view(np.int64), s[cut : max(cut, p)].view(np.int64)))
            cols = list(zip(*out, strict=True))
            longs = pa.list_(pa.int64())
            arrays = [*b.columns[:3], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], longs), pa.array(cols[5], longs)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "th", "n", "k1", "k2", "short", "low", "rest"])

    schema = "doc_id long, row long, th long, n int, k1 long, k2 long, short int, low array<long>, rest array<long>"
    named = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("th"), "text")
    return worker.map_batches(named, rows, schema)


def _postings(reps: DataFrame) -> DataFrame:
    """(gram, doc): prefix n-grams that may be shared, from one row per class.
    A low n-gram that only one class has ties nothing; it just takes its place
    in the prefix."""
    low = reps.select("row", F.explode("low").alias("gram"))
    shared = low.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    held = low.join(shared, "gram").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("held"))
    size = reps.select("row", "doc", "short", "n_low")
    # the lone ones come first; shared ones fill what is left of the prefix
    first = held.join(size, "row").select("doc", F.expr("slice(held, 1, greatest(0, short - greatest(0, n_low - size(held))))").alias("held"))
    picked = first.select("doc", F.explode("held.gram").alias("gram"))
    return picked.unionByName(reps.select("doc", F.explode("rest").alias("gram")))


class Trie:
    """Path-compressed prefix tree of sorted integer sets, as preorder arrays.

    Node i holds ``cells[start[i]:start[i + 1]]``; the nodes below it are those
    up to ``last[i]``.  ``below`` is its longest remaining path, ``least`` and
    ``most`` the set sizes in its subtree, ``node_of`` where each set ends."""

    TOP = 64  # cells of a path that are tested before the rest is touched
    RUNS = 12

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        lcp = np.zeros(len(order), np.int64)
        for k in range(1, len(order)):
            a, b = sets[order[k - 1]], sets[order[k]]
            m = min(len(a), len(b))
            diff = np.flatnonzero(a[:m] != b[:m])
            lcp[k] = diff[0] if len(diff) else m
        parent, depth, parts, self.node_of = [], [], [], np.empty(len(sets), np.int64)
        todo = [(0, len(order), 0, -1)]
        while todo:
            lo, hi, at, up = todo.pop()
            path = sets[order[lo]]
            end = len(path) if hi - lo == 1 else min(int(lcp[lo + 1 : hi].min()), len(path))
            me = len(parent)
            parent.append(up)
            depth.append(at)
            parts.append(path[at:end])
            while lo < hi and len(sets[order[lo]]) == end:  # sets that end here sort first
                self.node_of[order[lo]] = me
                lo += 1
            if lo < hi:
                cut = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == end)).tolist(), hi]
                todo += [(a, b, end, me) for a, b in zip(cut, cut[1:], strict=False)][::-1]
        n = len(parent)
        self.n, self.cells = n, np.concatenate(parts)
        lens = np.array([len(x) for x in parts])
        self.start = np.concatenate([[0], np.cumsum(lens)])
        self.last, self.below = np.arange(1, n + 1), np.zeros(n, np.int64)
        self.least, self.most = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        np.minimum.at(self.least, self.node_of, sizes)
        np.maximum.at(self.most, self.node_of, sizes)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            self.last[p] = max(self.last[p], self.last[i])
            self.below[p] = max(self.below[p], self.below[i] + lens[i])
            self.least[p], self.most[p] = min(self.least[p], self.least[i]), max(self.most[p], self.most[i])
        # the top of the tree, and runs of deeper nodes that hang below one top node
        top = np.array(depth) < self.TOP
        self.top = np.flatnonzero(top)
        self.top_cells = np.concatenate([parts[i] for i in self.top])
        self.top_start = np.concatenate([[0], np.cumsum(lens[self.top])])
        self.top_last = np.searchsorted(self.top, self.last[self.top])
        self.runs: list[tuple[int, int, int]] = []
        i = 0
        deep = np.flatnonzero(~top)
        while i < len(deep):
            j, head = i, parent[deep[i]]
            while j < len(deep) and deep[j] == deep[i] + j - i and (not top[parent[deep[j]]] or parent[deep[j]] == head):
                j += 1
            self.runs.append((int(deep[i]), int(deep[i]) + j - i, int(np.searchsorted(self.top, head))))
            i = j
        self.heads = np.array([r[2] for r in self.runs], np.int64)

    @staticmethod
    def _sums(hit: np.ndarray, start: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hits on the path from the first node down to each node."""
        run = np.concatenate([[0], np.cumsum(hit)])
        own = run[start[1:] - start[0]] - run[start[:-1] - start[0]]
        over = np.bincount(last, own, len(own) + 1)[: len(own)]
        return np.cumsum(own - over).astype(np.int64)

    def overlaps(self, mask: np.ndarray, kept: int, size: int, percent: int) -> np.ndarray:
        """Overlap of the query (its cells set in ``mask``, ``kept`` of them)
        with the path to each node; -1 in subtrees that cannot reach the
        threshold."""
        out = np.full(self.n, -1, np.int64)
        o = self._sums(mask[self.top_cells], self.top_start, self.top_last)
        best = o + np.minimum(self.below[self.top], kept - o)
        least, most = self.least[self.top], self.most[self.top]
        live = (100 * best >= percent * (size + least - best)) & (100 * most >= percent * size) & (100 * size >= percent * least)
        out[self.top] = np.where(live, o, -1)
        go = np.flatnonzero(live[self.heads])
        if len(go) > self.RUNS:  # cheaper in one sweep
            return self._sums(mask[self.cells], self.start, self.last)
        for k in go:
            a, b, head = self.runs[k]
            hit = mask[self.cells[self.start[a] : self.start[b]]]
            out[a:b] = o[head] + self._sums(hit, self.start[a : b + 1], self.last[a:b] - a)
        return out


def tree_join(grams: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of the sets: of all of them if
    ``side`` is all 0, else of links between side 0 and side 1."""
    both = bool(side.any())
    flat = np.concatenate(grams)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    cell = np.where(count[inverse] > 1, rank[inverse], -1)
    cells = [np.sort(c[c >= 0]) for c in np.split(cell, np.cumsum([len(g) for g in grams])[:-1])]
    root = list(range(len(grams)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    stored = np.flatnonzero(side == int(both))
    tree = Trie([cells[i] for i in stored], sizes[stored])
    mask, links, groups = np.zeros(int((count > 1).sum()) + 1, bool), [], len(grams)
    for q in np.flatnonzero(side == 0):
        if groups == 1:
            break
        mask[cells[q]] = True
        o = tree.overlaps(mask, len(cells[q]), int(sizes[q]), percent)[tree.node_of]
        mask[cells[q]] = False
        for k in np.flatnonzero((o >= 0) & (100 * o >= percent * (sizes[q] + sizes[stored] - o))):
            i, j = find(q), find(int(stored[k]))
            if i != j:
                root[i] = j
                groups -= 1
                links.append((int(q), int(stored[k])))
    return links


def _linked(percent: int):
    def join(rows: pa.Table) -> pa.Table:
        """Joins every (block, i, j) of the task: side 0 with side 1, or with
        itself where there is no side 1."""
        out: list[tuple[int, int]] = []
        parts: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(rows["block"].to_pylist(), rows["i"].to_pylist(), rows["j"].to_pylist(), strict=True)):
            parts.setdefault(key, []).append(k)
        docs, sides = rows["doc"].to_numpy(), rows["side"].to_numpy()
        sets = rows["grams"].combine_chunks()
        values, offsets = sets.values.to_numpy(zero_copy_only=False), sets.offsets.to_numpy()
        for members in parts.values():
            side = sides[members]
            if len(members) < 2 or side.all():
                continue
            grams = [values[offsets[k] : offsets[k + 1]] for k in members]
            sizes = np.array([len(g) for g in grams])
            out += [(int(docs[members[a]]), int(docs[members[b]])) for a, b in tree_join(grams, sizes, side, percent)]
        cols = list(zip(*out, strict=True)) or [(), ()]
        return pa.table({"u": pa.array(cols[0], pa.int64()), "v": pa.array(cols[1], pa.int64())})

    return join


def _sets(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """``members`` (doc, th, again, ...) with ``grams``, the sets of their
    texts; a text that several rows of the document hold is read once."""
    keep = [c for c in members.columns if c not in ("th", "again")]
    names = [*keep, "grams"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = pa.array([shingles(t, n).view(np.int64) for t in words.texts(b, 0)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], grams], names)

    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text").join(common.bounded(members, 80), ["doc", "th"])
    if not members.where("again").isEmpty():
        texts = texts.where("NOT again").unionByName(texts.where("again").dropDuplicates(members.columns))
    schema = T.StructType([*[members.schema[c] for c in keep], T.StructField("grams", T.ArrayType(T.LongType()))])
    return worker.map_batches(texts.select("text", *keep), rows, schema)


def _finer(docs: DataFrame, held: DataFrame, n: int, percent: int) -> DataFrame:
    """``held`` (doc, th, again, block, n) with the wide blocks cut into the
    components of sets that may link."""
    wide = held.groupBy("block").agg(F.sum("n").alias("all")).where(F.col("all") > CHUNK // WIDE).select("block")
    if wide.isEmpty():
        return held
    wide = common.bounded(wide, 16)
    sets = common.stash(_sets(docs, held.join(wide, "block").select(*SET, "block", "n", F.col("th").alias("set")), n), "ngram-wide")
    left, count = sets, -1
    for _ in range(ROUNDS):
        each = left.select("doc", "set", "block", "n", F.explode("grams").alias("gram"))
        shared = each.groupBy("block", "gram").agg(F.count("*").alias("df")).where("df > 1").select("block", "gram")
        may = each.join(shared, ["block", "gram"]).groupBy("doc", "set", "n").agg(F.count("*").alias("shared"))
        may = common.stash(may.where(100 * F.col("shared") >= percent * F.col("n")).select("doc", "set"), "ngram-may-link")
        before, count = count, may.count()
        if count == before:
            break
        left = sets.join(common.bounded(may, 32, count), ["doc", "set"], "left_semi")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [part_keys(x.values.to_numpy().view(np.uint64), percent).view(np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc", "keys"])

    keyed = common.stash(worker.map_batches(left.select("doc", "grams"), keys, "doc long, keys array<long>"), "ngram-parts")
    keyed = keyed.select("doc", F.explode("keys").alias("key"))
    star = keyed.groupBy("key").agg(F.min("doc").alias("v"), F.max("doc").alias("w")).where("v < w").select("key", "v")
    tied = common.components(keyed.join(star, "key").select(F.col("doc").alias("u"), "v"), "ngram-finer")
    cut = held.join(wide, "block").drop("block").join(may.withColumnRenamed("set", "th"), ["doc", "th"], "left_semi")
    cut = cut.join(tied.select(F.col("node").alias("doc"), F.col("label").alias("block")), "doc")
    return common.stash(held.join(wide, "block", "left_anti").unionByName(cut.select(held.columns)), "ngram-finer-members")


def _tasks(sets: DataFrame, percent: int) -> DataFrame:
    """Links of rows (doc, block, i, j, side, task, grams)."""
    return sets.groupBy("task").applyInArrow(worker.per_group(_linked(percent)), "u long, v long")


def _across_chunks(docs: DataFrame, members: DataFrame, first: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between the chunks of large blocks, given the links within them:
    every set outside its block's largest component against every chunk."""
    label = common.components(first.join(members.select(F.col("doc").alias("u")), "u", "left_semi"), "ngram-chunk-links")
    named = members.join(label.select(F.col("node").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    named = common.stash(named, "ngram-chunk-labels")
    largest = named.groupBy("block", "label").agg(F.sum("n").alias("held")).groupBy("block").agg(F.max_by("label", F.struct("held", "label")).alias("main"))
    outside = named.join(largest, "block").where("label <> main").select(*SET, "block", "n", "chunks")
    size = outside.groupBy("block").agg((F.floor(F.sum("n") / CHUNK) + 1).cast("long").alias("parts"))
    outside = common.stash(outside.join(size, "block").withColumn("part", F.pmod(F.xxhash64("doc", "th"), F.col("parts"))), "ngram-outside")
    task = F.concat_ws(":", "block", "i", "j").alias("task")
    inside = members.join(size, "block").select(*SET, "block", F.col("chunk").alias("i"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("j"), F.lit(0).alias("side"))
    others = outside.select(*SET, "block", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("i"), F.col("part").alias("j"), F.lit(1).alias("side"))
    return _tasks(_sets(docs, common.stash(inside.unionByName(others).select("*", task), "ngram-pairs"), n), percent)


def links(docs: DataFrame, sig: DataFrame, light: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): links between class representatives that span their
    components.  ``sig`` and ``light`` are stored."""
    first = F.min(F.struct("doc_id", "row", "th")).alias("first")
    classes = light.groupBy("k1", "k2").agg(first, F.max("n").alias("n"))
    classes = common.stash(
        classes.select("k1", "k2", "n", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("rep"), F.col("first.th").alias("rep_th")), "ngram-classes"
    )
    copies = light.join(classes.drop("n"), ["k1", "k2"]).where("row <> rep")
    copies = common.stash(copies.select("doc_id", "row", "doc", "rep", F.expr("doc_id = doc AND th = rep_th").alias("same")), "ngram-copies")
    reps = sig.where("n > 0 AND doc_id IS NOT NULL").join(common.bounded(copies.select("row"), 16), "row", "left_anti")
    reps = reps.select("row", F.col("doc_id").alias("doc"), "short", F.size("low").alias("n_low"), "low", "rest")
    postings = common.stash(_postings(reps), "ngram-prefixes")
    star = postings.groupBy("gram").agg(F.min("doc").alias("v"), F.max("doc").alias("w")).where("v < w").select("gram", "v")
    blocks = common.components(postings.join(star, "gram").select(F.col("doc").alias("u"), "v"), "ngram-blocks")
    again = copies.where("same").select("rep", F.lit(True).alias("again")).distinct()
    sets = classes.join(again, "rep", "left").select("doc", F.col("rep_th").alias("th"), F.coalesce("again", F.lit(False)).alias("again"), "n")
    held = blocks.select(F.col("node").alias("doc"), F.col("label").alias("block")).join(sets, "doc")
    held = _finer(docs, common.stash(held.select(*SET, "block", "n"), "ngram-members"), n, percent)
    buckets = int((held.agg(F.sum("n")).first()[0] or 0) // CHUNK + 1)
    lead = F.min(F.when(F.col("doc") == F.col("block"), F.col("th"))).alias("lead")
    room = held.groupBy("block").agg((F.floor(F.sum("n") / CHUNK) + 1).cast("long").alias("chunks"), lead)
    members = held.join(room, "block").withColumn("chunk", F.pmod(F.xxhash64("doc", "th"), F.col("chunks")))
    members = common.stash(members.select(*SET, "block", "n", "chunk", "chunks", "lead"), "ngram-chunks")
    # small blocks share a task; every chunk of a large one has its own, and
    # one set of the block's smallest document (its label) is in all of them
    pivot = F.expr("CASE WHEN doc = block AND th = lead THEN sequence(0L, chunks - 1) ELSE array(chunk) END")
    task = F.when(F.col("chunks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("block"), F.lit(buckets)))).otherwise(F.concat_ws(":", "block", "i"))
    dealt = members.select(*SET, "block", "chunks", F.explode(pivot).alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"))
    found = common.stash(_tasks(_sets(docs, dealt.select(*SET, "block", "i", "j", "side", task.alias("task")), n), percent), "ngram-found")
    large = members.where("chunks > 1")
    if not large.isEmpty():
        found = found.unionByName(_across_chunks(docs, large, found, n, percent))
    return found.unionByName(copies.select(F.col("doc_id").alias("u"), F.col("doc").alias("v")))


def components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id that can be reached by links, itself included)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = common.stash(_signatures(docs, n, percent), "ngram-sets")
    light = sig.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "row", "th", "n", "k1", "k2")
    label = common.components(links(docs, sig, light, n, percent), "ngram-links").select(F.col("node").alias("doc_id"), "label")
    return sig.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(label, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id")
    )
