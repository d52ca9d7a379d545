"""Interpolated modified Kneser-Ney n-gram model.

Words (Spark): counted first, and numbered by their frequency; n-grams are of
these numbers, which pack well.

Counting (Spark): every task counts the n-grams of its texts in blocks of about
``FLUSH`` tokens and sends each distinct one of a block, packed behind its
context, to the bucket of its context (a packet holds each different word once,
n-grams name it by its place); so a bucket sees whole contexts.  Contexts that hold
a large share of all tokens (found with the words, by counts of what is frequent in a
block; at most ``8 x buckets`` of them) are spread over all buckets by the whole n-gram
instead, and the sums of their parts are added up at the end.  From each bucket the
next lower order's counts go on the same way.

    top order:    p(w | h) = max(c(hw) - D(c), 0) / c(h.) + gamma(h) p(w | h')
    lower orders: the same with the number of different words before in place of counts
    below order 1: 1 / (V + 1)

with D1, D2, D3+ per order from the counts of counts (modified Kneser-Ney) and
gamma(h) = (D1 N1(h.) + D2 N2(h.) + D3 N3+(h.)) / c(h.).

Storage: files per order and bucket, in the folder in spark.checkpoint.dir,
which all executors share.  Contexts are sorted by their last words, then by their
first, the words after each by their numbers; numbers have the narrowest type that
holds the largest, counts one byte (those of 255 and more stand in a second file).  What a
context's counts add up to is kept for contexts of ``LONG`` and more words, else
added up when asked.  Only bucket sums and the frequent contexts pass through the driver.

Scoring: workers memory-map the files, look up each n-gram of a batch once in
them, and add up log10 probabilities.

Inside a block, bucket or batch, n-grams are places in its own sorted list of words, so
that they pack into one number each, which sorts them.

A model's memory in a worker is what the page cache holds; its disk grows with
the distinct n-grams of the corpus.  Nothing is pruned, capped or sampled.

Tokens: words between ASCII white space, A-Z in lower case, then one end token
per text; ``order - 1`` start tokens stand before (never predicted).  Words are
told apart by 64-bit hashes.  Defined results: a NULL or empty text is one end token.  A
NULL id counts as training.  A model of no text gives every token 1 / (V + 1)
with V = 0, that is probability 1.  Repeated rows count and are scored each;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidelines.llm import arrays as A
from sidelines.llm import files
from sidelines.llm.catalog import register
from sidelines.llm.common import crc_mod, table
from sidelines.session import cut_lineage

U64 = np.uint64
START, END = U64(0x5354415254), U64(0x454E44)
#: Order of the registered query's model.
ORDER = 3
#: Tokens that a task counts before it sends them on.
FLUSH = 1 << 19
#: Bytes of text for a bucket.
BUCKET_BYTES = 1 << 24
#: Words after a context from which on the sums of its counts are stored.
LONG = 8
#: Number of the start token, and of a word that was not learned.
FIRST, UNKNOWN = U64(0), U64(0xFFFFFFFFFFFFFFFF)


def _tokens(texts: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, document of each token, place of each token, hashes of all start tokens, words and ends)."""
    for at, data, off in A.slices(texts):
        n = len(off) - 1
        start, end, doc = A.words(data, off)
        h = A.word_hashes(data, start, end)
        words = np.bincount(doc, minlength=n)
        size = words + order                       # starts, words, end
        base = np.cumsum(size) - size
        flat = np.full(int(size.sum()), START, U64)
        within = np.arange(len(h)) - np.repeat(np.cumsum(words) - words, words)
        flat[base[doc] + order - 1 + within] = h
        flat[base + size - 1] = END
        token_doc = np.repeat(np.arange(n), words + 1)
        pos = np.arange(len(token_doc)) - np.repeat(np.cumsum(words + 1) - (words + 1), words + 1) + base[token_doc] + order - 1
        yield at, n, token_doc, pos, flat


def _coded(held: list[tuple[np.ndarray, np.ndarray]], order: int, words: files.Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the different words of a block, how often these occur, and [tokens, order] places of the words ending in each token."""
    distinct, code, pos = _joined(held)
    number, occurs = words.get("word", distinct, 2).T
    number = np.where(distinct == START, FIRST, np.where(number == 0, UNKNOWN, number.astype(U64)))
    names, at = np.unique(number, return_inverse=True)
    times = np.zeros(len(names))
    times[at] = occurs
    return names, times, _ending(at.astype(np.uint32)[code], pos, order)


def _joined(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes of a block's words, the place there of each word, and the places of the tokens."""
    sizes = [len(flat) for flat, _ in held]
    code = pa.array(np.concatenate([flat for flat, _ in held])).dictionary_encode()
    return code.dictionary.to_numpy(), code.indices.to_numpy(), np.concatenate([pos + at for (_, pos), at in zip(held, np.cumsum(sizes) - sizes)])


def _ending(flat: np.ndarray, pos: np.ndarray, order: int) -> np.ndarray:
    return np.stack([flat[pos - k] for k in range(order - 1, -1, -1)], 1)


def gram_hash(words: np.ndarray) -> np.ndarray:
    """Hash of the n-grams in the rows of ``words``; of length 0: a constant."""
    h = np.full(len(words), U64(words.shape[1] + 1), U64)
    for k in range(words.shape[1]):
        h = A.mix(h * U64(0x9E3779B97F4A7C15) + words[:, k])
    return h


def _key(words: np.ndarray) -> np.ndarray:
    """A whole number for each row of ``words``, in order of the rows and equal only for equal ones."""
    key, used = np.zeros(len(words), U64), 0
    for c in words.T:
        bits = int(c.max(initial=0)).bit_length()
        if used + bits > 64:                      # ranks are below 2^32
            (key, used), (c, bits) = (((r := np.unique(x, return_inverse=True)[1]), int(r.max(initial=0)).bit_length()) for x in (key, c))
        key = (key.astype(U64) << U64(bits)) | c.astype(U64)
        used += bits
    return key


def _distinct(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words``, and where in it each different one begins."""
    key = _key(words)
    by = np.argsort(key)
    key = key[by]
    return by, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _contexts(words: np.ndarray) -> np.ndarray:
    """Where in sorted rows each context (all but the last word) begins."""
    new = np.ones(len(words), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in words[:, :-1].T])
    return np.flatnonzero(new)


def _runs(start: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(start, n))


def _merge(words: np.ndarray, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of ``words`` in order, where their contexts begin, and the sums of ``values`` (None: how often each stands)."""
    by, first = _distinct(words)
    if values is None:
        sums = _runs(first, len(by))
    else:
        sums = np.add.reduceat(values[by], first, axis=0, dtype=np.int64) if len(by) else values[:0].astype(np.int64)
    words = words[by[first]]
    return words, _contexts(words), sums


def _turned(n: int) -> list[int]:
    """Columns of an n-gram in the order of the files: the context's words from the last to the first, then the word."""
    return [*range(n - 2, -1, -1), n - 1]


def _deal(words: np.ndarray, start: np.ndarray, heavy: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted n-grams of places in ``names``: the hash that chooses the bucket (the context's, or the n-gram's own if the context is
    frequent), the n-grams in frequent contexts, and these contexts' places in ``heavy``."""
    context, runs = gram_hash(names[words[start, :-1]]), _runs(start, len(words))
    deal = np.repeat(context, runs)
    at = np.minimum(np.searchsorted(heavy, context), len(heavy) - 1) if len(heavy) else np.zeros(0, np.int64)
    hot = np.flatnonzero(np.repeat(heavy[at] == context, runs)) if len(heavy) else at
    deal[hot] = gram_hash(names[words[hot]])
    return deal, hot, np.repeat(at, runs)[hot] if len(hot) else hot


COLUMNS = ("contexts", "runs", "last", "vals", "words")
BLOBS = "bucket int, " + ", ".join(f"{c} binary" for c in COLUMNS) + ", kind int"
_BLOBS = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in COLUMNS], ("kind", pa.int32())])


def _blobs(words: np.ndarray, start: np.ndarray, values: np.ndarray, buckets: int, heavy: np.ndarray,
           names: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket: its n-grams, each context once with the words after it, and their values.

    ``words`` are sorted places in ``names`` (None: the words' numbers), their contexts begin at ``start``."""
    if names is None:
        names, places = np.unique(words, return_inverse=True)
        words = places.reshape(words.shape)
    bucket = (_deal(words, start, heavy, names)[0] % U64(buckets)).astype(np.min_scalar_type(buckets))
    by = np.argsort(bucket, kind="stable")                              # contexts stay together
    context = np.repeat(np.arange(len(start)), _runs(start, len(words)))[by]
    w, v, bucket = words[by], np.ascontiguousarray(values[by]), bucket[by]
    new = np.ones(len(w), bool)
    new[1:] = (context[1:] != context[:-1]) | (bucket[1:] != bucket[:-1])
    first = np.flatnonzero(new)
    runs = _runs(first, len(w)).astype(np.uint32)
    heads, last = w[first, :-1], w[:, -1]
    cut, cut_heads = (np.searchsorted(x, np.arange(buckets + 1)) for x in (bucket, bucket[first]))
    used = np.flatnonzero(np.diff(cut))
    cols: list[list[bytes]] = [[] for _ in COLUMNS]
    here, place = np.zeros(len(names), bool), np.zeros(len(names), np.uint32)
    for b in used:
        one, many = slice(cut_heads[b], cut_heads[b + 1]), slice(cut[b], cut[b + 1])
        # each different word once; n-grams name it by its place
        here[heads[one]] = here[last[many]] = True
        known = np.flatnonzero(here)
        here[known] = False
        place[known] = np.arange(len(known))
        kind = _place(len(known))
        for col, x in zip(cols, (place[heads[one]].astype(kind), runs[one], place[last[many]].astype(kind), v[many],
                                 np.diff(names[known], prepend=U64(0)))):
            col.append(_packed(x))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(c, pa.binary()) for c in cols],
                                       pa.array(np.ones(len(used)), pa.int32())], schema=_BLOBS)


def _place(words: int) -> type:
    """The type of a place among so many words."""
    return np.uint16 if words <= 1 << 16 else np.uint32


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, all their first bytes first, compressed behind their length."""
    x = np.ascontiguousarray(x).ravel()
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(x: pa.Scalar, dtype) -> np.ndarray:
    x = x.as_py()
    raw = np.frombuffer(pa.decompress(x[8:], int(np.frombuffer(x[:8], np.int64)[0]), codec="zstd"), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _places(group: pa.Table, order: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the different words of packets, their n-grams as places there in :func:`_turned` columns, and the values."""
    words = [np.cumsum(_unpacked(x, U64), dtype=U64) for x in group.column("words")]
    names = np.sort(np.concatenate([np.zeros(0, U64), *words]))
    names = names[np.append(True, names[1:] != names[:-1])] if len(names) else names
    place = [np.searchsorted(names, x).astype(np.uint32) for x in words]

    def whole(name, dtype):
        return np.concatenate([np.zeros(0, dtype), *(_unpacked(x, dtype) for x in group.column(name))])

    def placed(name):
        return np.concatenate([np.zeros(0, np.uint32), *(p[_unpacked(x, _place(len(p)))] for x, p in zip(group.column(name), place))])

    runs = whole("runs", np.uint32)
    heads = placed("contexts").reshape(len(runs), order - 1)
    grams = np.empty((int(runs.sum()), order), np.uint32)
    for to, k in enumerate(_turned(order)[:-1]):
        grams[:, to] = np.repeat(heads[:, k], runs)
    grams[:, -1] = placed("last")
    return names, grams, whole("vals", kind)


def _unpack(group: pa.Table, order: int, kind, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`_places` with the words' numbers."""
    names, words, values = _places(group, order, kind)
    return names[words[:, np.argsort(_turned(order))]], values.reshape(-1, width)


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))


@dataclass(frozen=True)
class Model:
    uri: str
    order: int
    buckets: int
    vocabulary: int
    train_tokens: int
    discounts: dict       # order -> [0, D1, D2, D3+]
    heavy: dict           # order -> sorted hashes of its frequent contexts
    sums: dict            # order -> their sums, like those in the files


#: Least distance of a discount D(k) from 0 and from k.
EDGE = 0.01


def _discounts(n: list[float]) -> np.ndarray:
    """D(1), D(2), D(3+) from the numbers of n-grams that occur once, twice, three and four times.

    The estimate of D(k) can leave (0, k) in small or odd corpora; a discount of 0 would give unseen words no
    probability at all, one of k would give seen ones none of their own.  It is kept ``EDGE`` inside."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 > 0 else 0.5
    d = [k - (k + 1) * y * b / a if a > 0 else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0] + [min(max(x, EDGE), k - EDGE) for k, x in enumerate(d, 1)])


_FOUND = pa.schema([("bucket", pa.int32()), ("order", pa.int32()), ("h", pa.binary()), ("n", pa.binary())])


def learn_words(docs: DataFrame, text_col: str, order: int, buckets: int, uri: str) -> tuple[int, int, dict[int, np.ndarray]]:
    """Write the words' numbers and counts; returns tokens, different words, and for each order the frequent contexts' hashes.

    A context is frequent that may hold 1 / ``share`` of all tokens, with ``share`` = 4 x ``buckets``: at most 2 x ``share``
    are.  A block sends what makes up half that share of it: what a context loses in
    the blocks where it is rarer is at most half the share.
    """
    share = 4 * buckets

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND.types)], schema=_FOUND)

    def dealt(h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        by = np.argsort(h % U64(buckets), kind="stable")
        cut = np.searchsorted(h[by] % U64(buckets), np.arange(buckets + 1).astype(U64))
        return batch([(int(b), 0, h[by[cut[b]:cut[b + 1]]].tobytes(), _packed(c[by[cut[b]:cut[b + 1]]])) for b in np.flatnonzero(np.diff(cut))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block():
            distinct, code, pos = _joined(held)
            held.clear()
            grams = _ending(code.astype(np.uint32), pos, order)
            c = np.bincount(grams[:, -1], minlength=len(distinct))
            known.append((distinct[c > 0], c[c > 0]))
            often = np.bincount(code, minlength=len(distinct)) * (2 * share) >= len(grams)        # a context is at most as frequent as its words
            rows = []
            for n in range(2, order + 1):
                contexts = grams[np.logical_and.reduce([often[grams[:, k]] for k in range(order - n, order - 1)]), order - n:-1]
                by, first = _distinct(contexts)
                times = _runs(first, len(by))
                for i in np.flatnonzero(times * (2 * share) >= len(grams)):
                    words = distinct[contexts[by[first[i]]]]
                    rows.append((int(gram_hash(words[None, :])[0] % U64(buckets)), n, words.tobytes(), _packed(times[i:i + 1].astype(np.int64))))
            return rows

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, _, c = _merge(np.concatenate([h for h, _ in known])[:, None], np.concatenate([c for _, c in known]))
            known[:] = [(h[:, 0], c)]
            return known[0]

        size = 0
        for b in batches:
            for _, _, _, pos, flat in _tokens(b.column(0), order):
                held.append((flat, pos))
                size += len(pos)
                if size >= FLUSH:
                    size = 0
                    if rows := block():
                        yield batch(rows)
                    if sum(len(h) for h, _ in known) >= 4 * FLUSH and len(merged()[0]) >= 2 * FLUSH:
                        yield dealt(*known.pop())
        if size and (rows := block()):
            yield batch(rows)
        if known:
            yield dealt(*merged())

    def number(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        kind = group.column("order").to_numpy()
        words = group.filter(pa.array(kind == 0))
        h = np.concatenate([np.zeros(0, U64), *(np.frombuffer(x.as_buffer(), U64) for x in words.column("h"))])
        c = np.concatenate([np.zeros(0, np.int64), *(_unpacked(x, np.int64) for x in words.column("n"))])
        h, back = np.unique(h, return_inverse=True)
        c = np.bincount(back, c, len(h)).astype(np.int64)
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((h, -c))] = np.arange(len(h))                  # frequent words have small numbers
        files.save(uri, f"word-{bucket}", h, _small(np.stack([1 + rank * buckets + bucket, c], 1)))
        rest = group.filter(pa.array(kind > 0))
        return pa.table({"order": pa.array([0, 1, *rest.column("order").to_pylist()], pa.int32()),
                         "h": pa.array([b"", b"", *rest.column("h").to_pylist()], pa.binary()),
                         "n": pa.array([int(c.sum()), len(h), *(int(_unpacked(x, np.int64)[0]) for x in rest.column("n"))], pa.int64())})

    found = docs.select(text_col).mapInArrow(count, "bucket int, order int, h binary, n binary") \
                .groupBy("bucket").applyInArrow(number, "order int, h binary, n bigint")
    found = cut_lineage(found.groupBy("order", "h").agg(F.sum("n").alias("n")))
    whole = {r["order"]: r["n"] for r in found.filter("order < 2").collect()}
    tokens, words = whole.get(0, 0), whole.get(1, 0)
    lookup = files.Lookup(uri, buckets)
    heavy = {1: gram_hash(np.zeros((1, 0), U64))}                       # single words have one, empty, context
    rows = found.filter((F.col("order") > 1) & (F.col("n") * (2 * share) >= tokens)).collect()
    for n in range(2, order + 1):
        ctx = np.array([np.frombuffer(r["h"], U64) for r in rows if r["order"] == n], U64).reshape(-1, n - 1)
        number_of = lookup.get("word", ctx.ravel(), 2)[:, 0].astype(U64).reshape(ctx.shape)           # 0 of the start token
        heavy[n] = np.sort(gram_hash(number_of))
    return tokens, words, heavy


def _ends(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the last words and first word of the contexts in the rows of ``words``."""
    if not words.shape[1]:
        return np.zeros(len(words), U64), np.zeros(len(words), U64)
    tail = words[:, 1:]
    return tail[:, 0] if tail.shape[1] == 1 else gram_hash(tail) if tail.shape[1] else np.zeros(len(words), U64), words[:, 0]


#: Contexts whose places are counted from a common one.
SPAN = 256


def _save_grams(uri: str, n: int, bucket: int, names: np.ndarray, w: np.ndarray, start: np.ndarray, c: np.ndarray,
                heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a bucket's n-grams (sorted, of :func:`_turned` columns, contexts beginning at ``start``) and their counts.

    Returns the hashes of its ``heavy`` contexts and of each: sum, how many occur once, twice, more often."""
    context, last, runs = names[w[start, :-1][:, ::-1]], _small(names)[w[:, -1]], _runs(start, len(w))
    if n > 3:                                                             # several last words are told apart by their hash
        by = np.lexsort(_ends(context)[::-1])
        at = np.repeat(start[by] - (np.cumsum(runs[by]) - runs[by]), runs[by]) + np.arange(len(w))
        context, runs, last, c = context[by], runs[by], last[at], c[at]
        start = np.cumsum(runs) - runs
    h = gram_hash(context)
    hot = np.flatnonzero(np.isin(h, heavy))
    h = h[hot]
    tail, first = (_small(x) for x in _ends(context))
    del context
    at = np.flatnonzero(np.append(True, tail[1:] != tail[:-1]))
    files.save(uri, f"tail{n}-{bucket}", _small(tail[at]), _small(np.append(at, len(start))))
    edge = np.append(start, len(w))
    base = edge[::SPAN]
    files.save(uri, f"ctx{n}-{bucket}", first, _small(edge - np.repeat(base, SPAN)[:len(edge)]))
    long = np.flatnonzero(runs >= LONG)
    many = np.concatenate([long, hot])
    facts = np.stack([np.add.reduceat(x, start, dtype=np.int64)[many] for x in (c, c == 1, c == 2, c >= 3)], 1)
    files.save(uri, f"base{n}-{bucket}", base, np.zeros(0, np.uint8))
    files.save(uri, f"long{n}-{bucket}", long, _small(facts[:len(long)]))
    files.save(uri, f"gram{n}-{bucket}", _small(last), np.minimum(c, 255).astype(np.uint8))
    files.save(uri, f"large{n}-{bucket}", np.flatnonzero(c >= 255), c[c >= 255])
    return h, facts[len(long):]


def train(docs: DataFrame, text_col: str = "text", order: int = 2, buckets: int | None = None) -> Model:
    """Count ``docs`` and write the model's files; returns where they are."""
    uri = files.new_folder(docs.sparkSession, "ngram_lm")
    if not buckets:
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        buckets = max(8, -(-size // BUCKET_BYTES))
    tokens, words, heavy = learn_words(docs, text_col, order, buckets, uri)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = files.Lookup(uri, buckets)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def block():
            names, _, grams = _coded(held, order, known)
            held.clear()
            w, start, c = _merge(grams)
            return _blobs(w, start, c.astype(np.uint32), buckets, heavy[order], names)

        for b in batches:
            for _, _, _, pos, flat in _tokens(b.column(0), order):
                held.append((flat, pos))
                size += len(pos)
                if size >= FLUSH:
                    yield block()
                    size = 0
        if size:
            yield block()

    def merged(n: int):
        def run(group: pa.Table) -> pa.Table:
            bucket = group.column("bucket")[0].as_py()
            kind = group.column("kind").to_numpy()
            passed = group.filter(pa.array(kind == 2))               # sums of the order above
            names, w, v = _places(group.filter(pa.array(kind == 1)), n, np.uint32 if n == order else np.int64)
            w, start, c = _merge(w, v)
            del v
            rows = [passed.to_batches()[0]] if passed.num_rows else []
            ch, facts = np.zeros(0, U64), np.zeros((0, 4), np.int64)
            if len(w):
                ch, facts = _save_grams(uri, n, bucket, names, w, start, c, heavy[n])
                if n > 1:
                    rows.append(_blobs(*_merge(w[:, np.argsort(_turned(n))[1:]]), buckets, heavy[n - 1], names))
            seen = np.array([n, *[int((c == k).sum()) for k in (1, 2, 3, 4)]], np.int64)
            rows.append(pa.RecordBatch.from_arrays([
                pa.array([bucket], pa.int32()), pa.array([ch.tobytes()], pa.binary()), pa.array([b""], pa.binary()),
                pa.array([facts.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary()), pa.array([b""], pa.binary()),
                pa.array([2], pa.int32())], schema=_BLOBS))
            return pa.Table.from_batches([r.cast(_BLOBS) for r in rows])
        return run

    def facts(group: pa.Table) -> pa.Table:
        """The last merge and the sums of all: in one function, as a second one in its stage doubles the Python workers."""
        parts, rows = [], merged(1)(group)
        for contexts, last, vals in zip(*(rows.column(c).to_pylist() for c in ("contexts", "last", "vals"))):
            n, *counts = np.frombuffer(vals, np.int64).tolist()
            h, v = np.frombuffer(contexts, np.int64), np.frombuffer(last, np.int64).reshape(-1, 4)
            # the counts of the order stand under places 0 to 3, the sums of its frequent contexts under their hashes
            what = np.concatenate([np.zeros(len(counts), np.int32), np.ones(len(h), np.int32)])
            vs = np.concatenate([np.array([[c, 0, 0, 0] for c in counts], np.int64), v])
            parts.append(pa.table({"n": np.full(len(what), n, np.int32), "what": what, "h": np.concatenate([np.arange(len(counts)), h])}
                                  | {f"s{k}": vs[:, k].copy() for k in range(4)}))
        return pa.concat_tables(parts)

    ddl = "n int, what int, h bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    level = docs.select(text_col).mapInArrow(count, BLOBS)
    for n in range(order, 1, -1):
        level = level.groupBy("bucket").applyInArrow(merged(n), BLOBS)
    found = (level.groupBy("bucket").applyInArrow(facts, ddl).groupBy("n", "what", "h")
             .agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)]).collect())          # as many rows as frequent contexts
    seen = {n: np.zeros(4, np.int64) for n in range(1, order + 1)}
    sums = {n: np.zeros((len(heavy[n]), 4), np.int64) for n in range(1, order + 1)}
    for r in found:
        if r["what"] == 0:
            seen[r["n"]][r["h"]] = r["s0"]
        else:
            at = np.searchsorted(heavy[r["n"]], np.array([r["h"]], np.int64).view(U64))[0]
            sums[r["n"]][at] = [r[f"s{k}"] for k in range(4)]
    return Model(uri, order, buckets, words, tokens, {n: _discounts(x.tolist()) for n, x in seen.items()}, heavy, sums)


class _Grams:
    """Memory-mapped n-grams of an order and bucket."""

    def __init__(self, uri: str, n: int, bucket: int):
        def two(name):
            return tuple(x.view(np.ndarray) for x in files.load(uri, f"{name}{n}-{bucket}"))
        (self.tails, self.tail_at), (self.first, self.off), (self.base, _) = two("tail"), two("ctx"), two("base")
        (self.last, self.count), (self.large, self.large_count), (self.long, self.facts) = two("gram"), two("large"), two("long")

    def _edge(self, ctx: np.ndarray) -> np.ndarray:
        return self.base[ctx // SPAN] + self.off[ctx]

    def _counts(self, at: np.ndarray) -> np.ndarray:
        c = self.count[at].astype(np.int64)
        many = np.flatnonzero(c == 255)
        if len(many):
            c[many] = self.large_count[np.searchsorted(self.large, at[many])]
        return c

    def get(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the n-grams in the rows of ``words``, the place of each one's context, and these contexts' sums and counts of counts.

        Equal contexts stand together; what is absent counts 0."""
        start = _contexts(words)
        context = np.repeat(np.arange(len(start)), _runs(start, len(words)))
        tail, first = _ends(words[start, :-1])
        most = np.iinfo(self.tails.dtype).max
        t = np.minimum(np.searchsorted(self.tails, np.minimum(tail, U64(most)).astype(self.tails.dtype)), len(self.tails) - 1)
        known = np.flatnonzero(self.tails[t].astype(U64) == tail)
        ctx, hit = _search(self.first, self.tail_at[t[known]].astype(np.int64), self.tail_at[t[known] + 1].astype(np.int64), first[known])
        known, ctx = known[hit], ctx[hit]
        lo, hi, facts = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros((len(start), 4))
        lo[known], hi[known] = self._edge(ctx), self._edge(ctx + 1)
        counts = np.zeros(len(words), np.int64)
        at, hit = _search(self.last, lo[context], hi[context], words[:, -1])
        counts[hit] = self._counts(at[hit])
        size = (hi - lo)[known]
        long = size >= LONG
        facts[known[long]] = self.facts[np.searchsorted(self.long, ctx[long])]
        few, size = known[~long], size[~long]
        row = np.repeat(np.arange(len(few)), size)
        c = self._counts(np.arange(len(row)) + np.repeat(lo[few] - (np.cumsum(size) - size), size))
        facts[few] = np.stack([np.bincount(row, x, len(few)) for x in (c, c == 1, c == 2, c >= 3)], 1)
        return counts, context, facts


#: Numbers in a range, and equal ranges in a row, from which on these are searched together.
MANY = 16


def _search(numbers: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of ``want`` in the sorted ``numbers`` from ``lo`` to before ``hi``, and whether it is there."""
    out = lo.copy()
    start = _contexts(np.column_stack([lo, hi, lo]))
    runs = _runs(start, len(lo))
    together = (runs >= MANY) & ((hi - lo)[start] >= MANY)
    least = np.minimum(want, U64(np.iinfo(numbers.dtype).max)).astype(numbers.dtype)
    for a, n in zip(start[together], runs[together]):
        out[a:a + n] += np.searchsorted(numbers[lo[a]:hi[a]], least[a:a + n])
    rows = np.flatnonzero((lo < hi) & ~np.repeat(together, runs))
    a, b, x = lo[rows], hi[rows], least[rows]
    while len(rows):
        middle = (a + b) >> 1
        below = numbers[middle] < x
        a, b = np.where(below, middle + 1, a), np.where(below, b, middle)
        going = a < b
        if not going.all():
            out[rows[~going]] = a[~going]
            rows, a, b, x = rows[going], a[going], b[going], x[going]
    there = np.zeros(len(lo), bool)
    hit = np.flatnonzero(out < hi)
    there[hit] = numbers[out[hit]] == want[hit]
    return out, there


class Reader:
    """Memory-mapped files of a model."""

    def __init__(self, model: Model):
        self.model, self.words, self.grams = model, files.Lookup(model.uri, model.buckets), {}

    def _found(self, n: int, names: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sorted n-grams of :func:`_turned` columns: counts, their contexts' sums, and what discounts take from these."""
        m, w = self.model, w[:, np.argsort(_turned(n))]
        counts, total, left = np.zeros(len(w), np.int64), np.zeros(len(w)), np.zeros(len(w))
        deal, hot, at = _deal(w, _contexts(w), m.heavy[n], names)
        bucket = (deal % U64(m.buckets)).astype(np.min_scalar_type(m.buckets))
        by = np.argsort(bucket, kind="stable")                                     # neighbours are looked up together
        cut = np.searchsorted(bucket[by], np.arange(m.buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            if f"gram{n}-{b}.h.npy" not in self.words.names:
                continue
            if (n, b) not in self.grams:
                self.grams[n, b] = _Grams(m.uri, n, b)
            rows = by[cut[b]:cut[b + 1]]
            counts[rows], context, facts = self.grams[n, b].get(names[w[rows]])
            total[rows], left[rows] = facts[:, 0][context], self._taken(n, facts)[context]
        total[hot], left[hot] = m.sums[n][at, 0], self._taken(n, m.sums[n])[at]
        return counts, total, left

    def _taken(self, n: int, facts: np.ndarray) -> np.ndarray:
        return sum(facts[:, k] * self.model.discounts[n][k] for k in (1, 2, 3))

    def probabilities(self, names: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """Of the words in the last column, given those before; ``grams`` are places in the words' numbers ``names``."""
        m = self.model
        rows, levels = grams, []
        for n in range(m.order, 0, -1):                                            # each n-gram once
            turned = rows[:, _turned(n)]
            by, first = _distinct(turned)
            back = np.empty(len(by), np.int64)
            back[by] = np.repeat(np.arange(len(first)), _runs(first, len(by)))
            levels.append((turned[by[first]], back))
            rows = levels[-1][0][:, np.argsort(_turned(n))[1:]]
        p = np.array(1.0 / (m.vocabulary + 1))
        for n, (w, back) in enumerate(reversed(levels), 1):
            c, total, taken = self._found(n, names, w)
            sure = np.maximum(total, 1)
            p = np.where(total > 0, (c - m.discounts[n][np.minimum(c, 3)]) / sure + taken / sure * p, p)[back]
        return p


SCHEMA = "id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
_OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                  ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
#: Tokens that are looked up together.
TOGETHER = 1 << 19


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: tokens, known tokens, unigram base score, log10 probability, perplexity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        scale = np.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
        for b in batches:
            held, docs_of, rows, size, first = [], [], 0, 0, 0

            def flush():
                names, times, grams = _coded(held, model.order, reader.words)
                doc = np.concatenate(docs_of)
                occurs = times[grams[:, -1]]
                p = np.log10(reader.probabilities(names, grams))
                base = np.log10(occurs + 0.5) - scale
                n = np.bincount(doc, minlength=rows)
                total = np.bincount(doc, weights=p, minlength=rows)
                known = np.bincount(doc, weights=occurs > 0, minlength=rows).astype(np.int64)
                return pa.RecordBatch.from_arrays([
                    b.column(0).slice(first, rows), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(rows, model.train_tokens), pa.int64()),
                    pa.array(np.bincount(doc, weights=base, minlength=rows)), pa.array(total), pa.array(10.0 ** np.minimum(-total / n, 300.0))], schema=_OUT)

            for _, n, doc, pos, flat in _tokens(b.column(1), model.order):
                held.append((flat, pos))
                docs_of.append(doc + rows)
                rows, size = rows + n, size + len(doc)
                if size >= TOGETHER:
                    yield flush()
                    first, held, docs_of, rows, size = first + rows, [], [], 0, 0
            if rows:
                yield flush()

    d = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, SCHEMA)


@register("op2_ngram_lm")
def op2_ngram_lm(spark, sf_dir):
    """Kneser-Ney of ``ORDER`` words and unigram base scores of every text, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    model = train(docs.filter(~held), order=ORDER)
    return (score(docs, model).withColumnRenamed("id", "doc_id")
            .select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"))
