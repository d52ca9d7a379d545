"""N-gram Jaccard join with prefix trees.

A document is the set of its distinct ``k``-word shingles (64-bit hashes).
Documents link when the Jaccard similarity of their sets reaches
``percent`` / 100.  No link between different texts is lost:

1. *Sets.*  Each row's set size and a hash of the whole set.  Rows of equal
   sets are one set from here on.
2. *Shared shingles.*  Tasks send every distinct shingle hash once per block of
   text, packed by bucket, so a very common one is pre-counted like any other.
   Buckets write the shingles that occur in two or more rows, with a class of
   their frequency, as sorted hash files.
3. *Candidates.*  Rows look their shingles up in the mapped files.  A set whose
   shared shingles are fewer than its share of any link is linked with
   nothing; the others keep their shared shingles in a global order (rare
   before common, then by hash).
4. *Prefix components.*  Linked sets share a shingle in the first
   ``n - ceil(t n) + 1`` places of the order; unshared ones come first.  The
   first shingle that two linked sets share, at place p of a set of n, leaves n - p for their
   overlap, which bounds the partner's size (its *reach*); places whose reach no set
   of that shingle has are dropped.  Sets that share a place that is left form
   components (stars, then label propagation).
5. *Prefix trees.*  A component of up to ``CELL`` sets is one cell and is compared
   whole.  A larger one is dealt at random to blocks of about ``CELL``,
   ``PASSES`` times; a block is a cell, so these passes take each set ``PASSES``
   times, however large the component.  What is left are prefix shingles
   whose sets still carry several labels: their sets are compared by shingle, those outside the
   most frequent label among themselves and with that label's sets, but these not with each other.
   The sets of a cell are stored in a radix trie of their ordered
   shingles.  For a set, the trie is walked level by level: overlap is counted
   once for all sets below a node, and a subtree is pruned when the overlap so
   far plus the most that can still come cannot reach the threshold, or its
   set sizes cannot match.  Linked sets are visited once (breadth first among the sets not yet
   reached), so a large group of near copies gives one star of links, not all pairs.
6. *Components* of the links, by label propagation over the stars.

Defined results: words stand between ASCII white space, A-Z in lower case; a
text with fewer than ``k`` words is one shingle of them all; a NULL or empty text has
no shingle, links with nothing and is its own component.  Rows repeated with
one id are one document's.  A component's id is its smallest id, NULL only if
all are NULL.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm import arrays as A
from sidelines.llm import files
from sidelines.llm.catalog import register
from sidelines.llm.common import table
from sidelines.session import cut_lineage

U64 = np.uint64
FLUSH, TOGETHER, CELL = 1 << 21, 1 << 19, 1000
#: Times that a component of more than CELL sets is dealt to blocks at random.
PASSES = 3


def needed(n: int, percent: int) -> int:
    """Least size of an intersection (and of a partner) with a set of ``n``."""
    return -(-n * percent // 100)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each shingle, its hash): distinct within a row, ordered by (row, hash)."""
    salts = A.mix(np.arange(1, k + 1, dtype=U64)) | U64(1)
    for at, data, off in A.slices(texts):
        n = len(off) - 1
        start, end, doc = A.words(data, off)
        h = A.word_hashes(data, start, end)
        cut = A.doc_bounds(doc, n)
        words = np.diff(cut)
        count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
        row = np.repeat(np.arange(n), count)
        first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + cut[row]
        size = np.minimum(words, k)[row]
        total = np.zeros(len(row), U64)
        for j in range(k):
            part = h[np.minimum(first + j, max(len(h) - 1, 0))] * salts[j] if len(h) else total
            total += np.where(j < size, part, U64(0))
        total = A.mix(total + size.astype(U64))
        by = np.lexsort((total, row))
        row, total = row[by], total[by]
        keep = np.ones(len(row), bool)
        keep[1:] = (row[1:] != row[:-1]) | (total[1:] != total[:-1])
        yield at, n, row[keep], total[keep]


def _set_hash(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and hash of each row's set, whatever its order."""
    size = np.bincount(row, minlength=n)
    total = np.zeros(n, U64)
    used = np.flatnonzero(size)
    if len(used):
        total[used] = np.add.reduceat(A.mix(h + U64(0x5E7)), (np.cumsum(size) - size)[used])
    return size, A.mix(total * U64(3) + size.astype(U64)).view(np.int64)


def set_table(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, n (set size), sid (hash of the set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_all, sid_all = [], []
            for _, n, row, h in shingle_sets(b.column(1), k):
                size, sid = _set_hash(row, h, n)
                n_all.append(size), sid_all.append(sid)
            cat = (lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cat(n_all)), pa.array(cat(sid_all))], names=["id", "n", "sid"])

    return (docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
            .mapInArrow(run, "id bigint, n bigint, sid bigint"))


def _pack(hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (hashes % U64(buckets)).astype(np.int64)
    once = counts == 1
    cols: list[list] = [[], [], []]
    lone = hashes[once]
    lone = lone[np.argsort(bucket[once], kind="stable")]
    cut = np.searchsorted(np.sort(bucket[once]), np.arange(buckets + 1))
    by = np.argsort(bucket[~once], kind="stable")
    more, times = hashes[~once][by], counts[~once][by].astype(np.uint32)
    cut2 = np.searchsorted(bucket[~once][by], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cut) + np.diff(cut2))
    for b in used:
        cols[0].append(lone[cut[b]:cut[b + 1]].tobytes())
        cols[1].append(more[cut2[b]:cut2[b + 1]].tobytes())
        cols[2].append(times[cut2[b]:cut2[b + 1]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]],
                                      names=["bucket", "once", "more", "times"])


def shared_shingles(docs: DataFrame, k: int, text_col: str, buckets: int) -> str:
    """Write the shingles of two or more rows with their frequency class; returns the folder."""
    uri = files.new_folder(docs.sparkSession, "shingles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for _, _, _, h in shingle_sets(b.column(0), k):
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield _pack(*np.unique(np.concatenate(held), return_counts=True), buckets)
                    held, size = [], 0
        if size:
            yield _pack(*np.unique(np.concatenate(held), return_counts=True), buckets)

    def merge(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        def whole(name, kind):
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(name)])
        lone, more, times = whole("once", U64), whole("more", U64), whole("times", np.uint32)
        h, back = np.unique(np.concatenate([lone, more]), return_inverse=True)
        n = np.bincount(back[:len(lone)], minlength=len(h)) + np.bincount(back[len(lone):], weights=times, minlength=len(h))
        many = n > 1
        klass = np.minimum(63, 4 * np.log2(n[many])).astype(np.uint8)
        files.save(uri, f"shared-{bucket}", h[many], klass[:, None])
        return pa.table({"bucket": pa.array([bucket], pa.int32())})

    (docs.select(text_col).mapInArrow(count, "bucket int, once binary, more binary, times binary")
     .groupBy("bucket").applyInArrow(merge, "bucket int").write.format("noop").mode("overwrite").save())
    return uri


def candidate_sets(docs: DataFrame, uri: str, buckets: int, k: int, percent: int, text_col: str) -> DataFrame:
    """Sets that may link: sid, n, keys (shared shingles as ordered whole numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = files.Lookup(uri, buckets)

        def emit(held):
            klass = lookup.get("shared", np.concatenate([h for _, _, h in held]), 1)[:, 0]
            at, out = 0, ([], [], [])
            for n, row, h in held:
                c = klass[at:at + len(h)]
                at += len(h)
                size, sid = _set_hash(row, h, n)
                shared = c > 0
                m = np.bincount(row[shared], minlength=n)
                some = np.flatnonzero((size > 0) & (100 * m >= percent * size))
                # class first, then 58 bits of the hash: numeric order is the global order
                key = ((c[shared].astype(U64) << U64(57)) | (h[shared] >> U64(7))).view(np.int64)
                r = row[shared]
                by = np.lexsort((key, r))
                key, r = key[by], r[by]
                cut = np.searchsorted(r, np.arange(n + 1))
                for i in some:
                    out[0].append(int(sid[i])), out[1].append(int(size[i])), out[2].append(key[cut[i]:cut[i + 1]])
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                               pa.array(out[2], pa.list_(pa.int64()))], names=["sid", "n", "keys"])

        for b in batches:
            held, size = [], 0
            for _, n, row, h in shingle_sets(b.column(0), k):
                held.append((n, row, h))
                size += len(h)
                if size >= TOGETHER:
                    yield emit(held)
                    held, size = [], 0
            if held:
                yield emit(held)

    rows = docs.select(text_col).mapInArrow(run, "sid bigint, n bigint, keys array<bigint>")
    return rows.groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(v, c): every vertex of the edges (a, b) with the smallest vertex it reaches.

    Label propagation with pointer jumping; each round's labels are written to
    the shared checkpoint folder.
    """
    both = cut_lineage(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                       .unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    lab = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("c")))
    for _ in range(max_rounds):
        near = (both.join(lab.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m")))
        new = lab.join(near, "u").select("u", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = lab.select(F.col("u").alias("c"), F.col("c").alias("up"))
        new = cut_lineage(new.join(up, "c").select("u", "old", F.least("c", "up").alias("c")))
        changed = new.filter("old <> c").limit(1).count()
        lab = new.select("u", "c")
        if not changed:
            return lab.withColumnRenamed("u", "v")
    raise RuntimeError("labels still change: more rounds are needed")


class Trie:
    """Radix trie of ordered sets as flat arrays, level by level."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i8").tobytes())
        self.order = np.array(order)
        # nodes: (set that spells it, from depth, to depth, parent); sets end at nodes
        spell, lo, hi, parent, end_of = [], [], [], [], np.empty(len(sets), np.int64)
        path: list[int] = []                   # nodes from the root to the last set
        for at, i in enumerate(order):
            s = sets[i]
            common = 0
            if at:
                p = sets[order[at - 1]]
                m = min(len(p), len(s))
                diff = np.flatnonzero(p[:m] != s[:m])
                common = int(diff[0]) if len(diff) else m
                while path and lo[path[-1]] >= common and hi[path[-1]] > common:
                    path.pop()
                if path and hi[path[-1]] > common:           # split the node at the common depth
                    node = path.pop()
                    spell.append(spell[node]), lo.append(lo[node]), hi.append(common), parent.append(parent[node])
                    parent[node], lo[node] = len(spell) - 1, common
                    path.append(len(spell) - 1)
            if len(s) > common or not path:
                spell.append(i), lo.append(common), hi.append(len(s)), parent.append(path[-1] if path else -1)
                path.append(len(spell) - 1)
            end_of[i] = path[-1]
        self.parent, self.lo, self.hi, self.spell = (np.array(x, np.int64) for x in (parent, lo, hi, spell))
        n = len(spell)
        self.end_of = end_of
        depth = np.zeros(n, np.int64)
        for v in np.argsort(self.lo, kind="stable"):           # parents end where children begin
            if self.parent[v] >= 0:
                depth[v] = depth[self.parent[v]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)] if n else []
        # over the sets below each node: smallest and largest set, longest key list
        self.low, self.high, self.long = np.full(n, 1 << 60), np.zeros(n, np.int64), np.zeros(n, np.int64)
        lengths = np.array([len(s) for s in sets])
        np.minimum.at(self.low, end_of, sizes)
        np.maximum.at(self.high, end_of, sizes)
        np.maximum.at(self.long, end_of, lengths)
        for level in reversed(self.levels[1:]):
            np.minimum.at(self.low, self.parent[level], self.low[level])
            np.maximum.at(self.high, self.parent[level], self.high[level])
            np.maximum.at(self.long, self.parent[level], self.long[level])
        self.flat = np.concatenate([sets[i][a:b] for i, a, b in zip(spell, lo, hi)]) if n else np.zeros(0, np.int64)
        self.size = self.hi - self.lo
        self.begin = np.cumsum(self.size) - self.size
        ends = np.maximum(self.begin + self.size - 1, 0)
        self.last_key = np.where(self.size > 0, self.flat[np.minimum(ends, max(len(self.flat) - 1, 0))] if len(self.flat) else 0, -(1 << 62))

    def overlaps(self, query: np.ndarray, n_query: int, percent: int, inside: np.ndarray) -> np.ndarray:
        """Overlap with the query at the nodes that can reach the threshold, else -1.

        ``inside``: scratch of False for every key number, restored on return."""
        out = np.full(len(self.size), -1, np.int64)
        inside[query] = True
        alive = self.levels[0] if self.levels else np.zeros(0, np.int64)
        above = np.zeros(len(alive), np.int64)
        depth = 0
        while len(alive):
            # sizes below the node must lie within [t n, n / t]
            fits = (100 * self.high[alive] >= percent * n_query) & (100 * n_query >= percent * self.low[alive])
            alive, above = alive[fits], above[fits]
            if not len(alive):
                break
            length = self.size[alive]
            total = np.cumsum(length)
            at = np.arange(total[-1]) - np.repeat(total - length - self.begin[alive], length)
            got = np.concatenate([[0], np.cumsum(inside[self.flat[at]])])
            here = above + got[total] - got[total - length]
            rest = np.minimum(len(query) - np.searchsorted(query, self.last_key[alive], "right"), self.long[alive] - self.hi[alive])
            # intersection >= t / (1 + t) (n + other), other at least the least size below
            least = np.maximum(self.low[alive], -(-percent * n_query // 100))
            can = (100 + percent) * (here + rest) >= percent * (n_query + least)
            alive, here = alive[can], here[can]
            out[alive] = here
            depth += 1
            if depth == len(self.levels):
                break
            nxt = self.levels[depth]
            ok = out[self.parent[nxt]] >= 0
            alive = nxt[ok]
            above = out[self.parent[alive]]
        inside[query] = False
        return out


def trie_links(sids: np.ndarray, sizes: np.ndarray, keys: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of the given sets (a star around each component's first set)."""
    g = len(sids)
    if g < 2:
        return []
    all_keys, numbers = np.unique(np.concatenate(keys), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    sets = [numbers[cut[i]:cut[i + 1]] for i in range(g)]
    trie = Trie(sets, sizes)
    inside = np.zeros(len(all_keys), bool)
    left = np.ones(g, bool)
    out = []
    for root in np.argsort(-sizes, kind="stable"):
        if not left[root]:
            continue
        left[root] = False
        queue = [int(root)]
        while queue and left.any():
            q = queue.pop()
            over = trie.overlaps(sets[q], int(sizes[q]), percent, inside)[trie.end_of]
            near = left & (over >= 0) & (100 * over >= percent * (sizes[q] + sizes - over))
            found = np.flatnonzero(near)
            left[found] = False
            queue += found.tolist()
            out += [(int(sids[root]), int(sids[i])) for i in found]
    return out


def _cells(group: pa.Table, percent: int) -> pa.Table:
    """Links of the cells (groups of sets) in a bucket."""
    cell = np.stack([group.column(c).to_numpy() for c in ("c", "i", "j")], 1)
    sid, n = group.column("sid").to_numpy(), group.column("n").to_numpy()
    keys = group.column("keys").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    flat, off = keys.values.to_numpy(), keys.offsets.to_numpy()
    by = np.lexsort((sid, cell[:, 2], cell[:, 1], cell[:, 0]))
    new = np.flatnonzero(np.concatenate([[True], (cell[by][1:] != cell[by][:-1]).any(1)]))
    out = []
    for a, b in zip(new, [*new[1:], len(by)]):
        rows = by[a:b]
        out += trie_links(sid[rows], n[rows], [flat[off[r]:off[r + 1]] for r in rows], percent)
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def prefix_places(cand: DataFrame, percent: int) -> DataFrame:
    """(key, sid, n) of the prefix shingles at which a set can have its first shingle in common with a linked one."""
    need = F.expr(f"(n * {percent} + 99) div 100")
    heads = (cand.select("sid", "n", F.size("keys").alias("m"), F.posexplode(F.slice("keys", F.lit(1), (F.size("keys") - need + 1).cast("int"))).alias("at", "key"))
             .select("key", "sid", "n", F.expr(f"(m - at) * {100 + percent} div {percent} - n").alias("reach")))
    # the smaller of two linked sets reaches one of its own size or more
    least = heads.groupBy("key").agg(F.min(F.when(F.col("reach") >= F.col("n"), F.col("n"))).alias("least"),
                                     F.min("sid").alias("a"), F.max("sid").alias("z")).filter("a < z and least is not null")
    return heads.join(least.select("key", "least"), "key").filter("reach >= least").select("key", "sid", "n")


def block_cells(near: DataFrame, large: DataFrame) -> DataFrame:
    """(c, i, j, sid): the blocks of the prefix components; i is the pass, j the block."""
    return (near.join(large, "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("blocks") > 1, PASSES - 1).otherwise(0))))
            .withColumn("j", F.pmod(F.xxhash64("v", "i"), F.col("blocks")).cast("int"))
            .select("c", "i", "j", F.col("v").alias("sid")))


def shingle_cells(places: DataFrame) -> DataFrame:
    """(c, i, j, sid): cells of the prefix shingles (c) whose sets have several labels.

    Blocks 0, 1.. hold the sets outside the most frequent label, -1, -2.. those of it."""
    by_label = places.groupBy("key", "label").agg(F.count("*").alias("count"))
    keys = (by_label.groupBy("key").agg(F.count("*").alias("labels"), F.sum("count").alias("m"), F.max(F.struct("count", "label")).alias("top"))
            .filter("labels > 1").select("key", "m", F.col("top.label").alias("top"), F.col("top.count").alias("most")))
    def blocks(n):
        return F.ceil(n / CELL).cast("int")
    p = (places.join(keys, "key").withColumn("one", F.col("m") <= CELL).withColumn("others", blocks(F.col("m") - F.col("most"))).withColumn("tops", blocks(F.col("most")))
         .withColumn("block", F.when(F.col("label") == F.col("top"), -1 - F.pmod(F.xxhash64("sid"), F.col("tops"))).otherwise(F.pmod(F.xxhash64("sid"), F.col("others"))).cast("int")))
    partner = (F.when(F.col("one"), F.array(F.lit(0))).when(F.col("block") < 0, F.sequence(F.lit(0), F.col("others") - 1))
               .otherwise(F.concat(F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(-1), -F.col("tops"), F.lit(-1)))))
    p = p.withColumn("block", F.when(F.col("one"), 0).otherwise(F.col("block"))).withColumn("other", F.explode(partner))
    return p.select(F.col("key").alias("c"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid")


def cell_links(cells: DataFrame, rows: int, cand: DataFrame, percent: int) -> DataFrame:
    """Links within the cells, dealt to groups of about 2 x ``CELL`` of the cells' rows."""
    parts = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // (2 * CELL))
    dealt = cells.join(cand, "sid").withColumn("bucket", F.pmod(F.xxhash64("c", "i", "j"), F.lit(parts)).cast("int"))
    return cut_lineage(dealt.groupBy("bucket").applyInArrow(lambda t: _cells(t, percent), "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    buckets: int | None = None) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links reach)."""
    spark = docs.sparkSession
    buckets = buckets or max(8, 2 * docs.rdd.getNumPartitions())
    sets = cut_lineage(set_table(docs, k, id_col, text_col))
    uri = shared_shingles(docs, k, text_col, buckets)
    cand = cut_lineage(candidate_sets(docs, uri, buckets, k, percent, text_col))

    # sets that share a prefix shingle, as stars; prefixes of one set only say nothing
    places = prefix_places(cand, percent)
    first = places.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).filter("a < z")
    stars = places.join(first, "key").filter("sid <> a").select("a", F.col("sid").alias("b")).distinct()
    near = components(stars)

    size = near.groupBy("c").count()
    large = cut_lineage(size.filter(F.col("count") > CELL).select("c", "count", F.ceil(F.col("count") / CELL).cast("int").alias("blocks")))
    many = large.agg(F.sum("count")).first()[0] or 0
    links = cell_links(block_cells(near, large.select("c", "blocks")), near.count() + (PASSES - 1) * many, cand, percent)
    comp = components(links)
    if many:
        # only components of more than CELL sets have pairs that no block held
        label = near.join(large, "c", "left_semi").select(F.col("v").alias("sid")).join(comp.select(F.col("v").alias("sid"), F.col("c").alias("label")), "sid", "left")
        cells = cut_lineage(shingle_cells(places.join(label, "sid").select("key", "sid", F.coalesce("label", "sid").alias("label"))))
        rows = cells.count()
        if rows:
            comp = components(links.unionByName(cell_links(cells, rows, cand, percent)))

    named = sets.join(comp.select(F.col("v").alias("sid"), "c"), "sid", "left").withColumn("c", F.coalesce("c", "sid"))
    some = named.filter("n > 0")
    smallest = some.groupBy("c").agg(F.min("id").alias("component_id"))
    return (some.join(smallest, "c").select("id", F.col("n").alias("n_shingles"), "component_id")
            .unionByName(named.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))))


@register("op8_jaccard_join")
def op8_jaccard_join(spark, sf_dir):
    """Components of all documents linked by 4-word shingles at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85).withColumnRenamed("id", "doc_id")
