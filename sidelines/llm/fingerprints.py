"""Document fingerprints by consistent weighted sampling.

Native: DataFrame functions only.

A document is a weighted set: its words (between ASCII white space, lower
case), each with its number of occurrences.  For each of ``samples`` draws and
each term, hashes of (term, draw) give r, c ~ Gamma(2, 1) and b ~ U(0, 1); with
weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r.  The draw's
sample is the (term, t) of least a.  Two documents agree in a draw with
probability equal to the generalised Jaccard similarity
sum(min w) / sum(max w), so the share of equal draws estimates it.

Work: documents are dealt once, with their texts, into id ranges (explicit
bounds, so that every branch sees the same ranges).  Neighbours, word counts and
samples are then computed inside that partitioning; no other exchange carries
tokens.  A range's last document needs the first of the next range: a copy of
that one row per range ("ghost") is added.  ln a (31 bits, as whole number) and
a 32-bit hash of (term, t) are packed in a long, so that a draw's sample is a
plain ``min`` in the generated code.

Defined results: a NULL text counts as empty.  The next document is the next
smaller id, NULL ids last, equal ids by text; after the last comes the first
(a lone document is its own next).  A text without words has an empty
fingerprint; its likeness is 1 to another such text, else 0.  Repeated rows are
neighbours of each other; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sidelines.llm.catalog import register
from sidelines.llm.common import table, text_or_empty

#: Draws of a fingerprint (a multiple of BLOCK): a likeness has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES, BLOCK = 32, 4
CELL_BITS = 14
_SEP = r"[\x20\x09-\x0D]+"


def _range_number(col: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are smaller: in two steps, by blocks of bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    every = F.lit(bounds)
    ends = F.lit(bounds[step - 1::step])
    block = F.size(F.filter(ends, lambda x: x < col))
    inside = F.slice(every, block * step + 1, step)
    return block * step + F.size(F.filter(inside, lambda x: x < col))


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int, tasks: int) -> DataFrame:
    """(part, rn, ghost, id, text, next_text): dealt to ``tasks`` partitions by ``part``, ``rn`` in descending id."""
    d = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    probs = [(i + 1) / ranges for i in range(ranges - 1)]
    found = d.agg(F.percentile_approx("id", probs, 10000).alias("b")).first()["b"] if probs else None
    bounds = sorted(set(found or []))      # one id per range
    part = _range_number(F.col("id"), bounds)
    d = d.withColumn("part", part)
    # each range's first row in descending order, then its text (one row per range)
    heads = d.groupBy("part").agg(F.max("id").alias("head")).withColumnRenamed("part", "of")
    first = (d.join(F.broadcast(heads), (F.col("part") == F.col("of")) & F.col("id").eqNullSafe(F.col("head")))
             .groupBy("part").agg(F.max("id").alias("id"), F.max("text").alias("text")))
    in_order = Window.orderBy("part")      # one row per range: a bounded table
    ghosts = first.select("part", F.struct("id", "text").alias("own")).select(
        "part", F.lag("own").over(in_order).alias("below"),
        F.last("own").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("top"))
    ghosts = ghosts.select(F.coalesce("below", "top").alias("g"), "part").select("g.id", "g.text", "part")
    both = d.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True))).repartition(tasks, "part")
    w = Window.partitionBy("part").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("text").desc())
    return both.select("part", F.row_number().over(w).alias("rn"), "ghost", "id", "text", F.lead("text").over(w).alias("next_text"))


def gamma_quantiles(spark: SparkSession) -> DataFrame:
    """One row, one array: quantiles of Gamma(2, 1) in the middles of 2 ** CELL_BITS equal cells.

    Newton's method on 1 - exp(-x) (1 + x) = p from the inflection point
    x = 1, whence it converges monotonically for every p.
    """
    cells = 1 << CELL_BITS

    def step(x, p):
        return x - (1 - F.exp(-x) * (1 + x) - p) / (x * F.exp(-x))

    def quantile(i):
        p = (i + F.lit(0.5)) / float(cells)
        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(1.0), lambda x, _: step(x, p))

    return spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), quantile).alias("x"))


def _draws(h: Column, block: Column, weights: list[str], spark: SparkSession) -> tuple[list[Column], list[Column]]:
    """r, ln c, b of the draws of one block; and the packed sample of every draw and weight column.

    r and c come from the quantile table by bits of the hash (a table look-up
    costs a fraction of a logarithm); the lowest cell of c, which decides
    among very many terms, is refined by 16 more bits (there x is close to sqrt(2 p) (1 + sqrt(2 p) / 3)).
    """
    cells = 1 << CELL_BITS
    table_r = gamma_quantiles(spark).scalar()
    table_c = gamma_quantiles(spark).select(F.transform("x", lambda x: F.log(x))).scalar()

    def bits(g, shift, n):
        return F.shiftrightunsigned(g, shift).bitwiseAND(F.lit((1 << n) - 1).cast("bigint")).cast("int")

    first, packed = [], []
    for k in range(BLOCK):
        g = F.xxhash64(h, block * BLOCK + k)
        ci = bits(g, CELL_BITS, CELL_BITS)
        tail = F.sqrt(2.0 * (bits(g, 2 * CELL_BITS, 16) + 0.5) / float(cells << 16))
        first += [F.get(table_r, bits(g, 0, CELL_BITS)).alias(f"r{k}"),
                  F.when(ci == 0, F.log(tail) + tail / 3.0).otherwise(F.get(table_c, ci)).alias(f"c{k}"),
                  ((bits(g, 2 * CELL_BITS + 16, 20) + 0.5) / float(1 << 20)).alias(f"b{k}")]
        r, c, beta = F.col(f"r{k}"), F.col(f"c{k}"), F.col(f"b{k}")
        for x in weights:
            t = F.floor(F.col(f"ln_{x}") / r + beta)
            a = (c - r * (t - beta) - r + 64) * float(1 << 24)       # ln a lies within (-64, 64)
            packed.append(F.shiftleft(a.cast("bigint"), 32).bitwiseOR(
                F.hash(h, t).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias(f"{x}{k}"))
    return first, packed


def signatures(terms: DataFrame, keys: list[str], weights: list[str], samples: int = SAMPLES) -> DataFrame:
    """Per ``keys``: for each weight column an array ``sig_<weight>`` of packed samples.

    ``terms``: keys, ``h`` (term hash) and weight columns; a weight of 0 means
    that the term is not in that set.  Draws are worked off ``BLOCK`` at a time,
    one row for each block, so that the generated code stays small enough to be compiled.
    """
    lns = [F.when(F.col(x) > 0, F.log(F.col(x).cast("double"))).alias(f"ln_{x}") for x in weights]
    blocks = F.explode(F.lit(list(range(samples // BLOCK)))).alias("block")
    first, packed = _draws(F.col("h"), F.col("block"), weights, terms.sparkSession)
    drawn = (terms.select(*keys, "h", *lns, blocks)
             .select(*keys, "h", "block", *[f"ln_{x}" for x in weights], *first).select(*keys, "block", *packed))
    mins = drawn.groupBy(*keys, "block").agg(*[F.min(f"{x}{k}").alias(f"{x}{k}") for x in weights for k in range(BLOCK)])
    whole = mins.groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.struct("block", F.array(*[f"{x}{k}" for k in range(BLOCK)]).alias("s")))).alias(x)
        for x in weights])
    return whole.select(*keys, *[F.flatten(F.transform(x, lambda b: b["s"])).alias(f"sig_{x}") for x in weights])


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal draws; NULL signatures stand for texts without words."""
    equal = sum((F.coalesce((a[k] == b[k]).cast("int"), F.lit(0)) for k in range(samples)), F.lit(0))
    return (F.when(a[0].isNull() & b[0].isNull(), F.lit(1.0)).otherwise(equal.cast("double") / float(samples)))


def as_text(sig: Column, samples: int = SAMPLES) -> Column:
    low = [F.lpad(F.lower(F.hex(sig[k].bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))), 8, "0") for k in range(samples)]
    return F.when(sig[0].isNull(), F.lit("")).otherwise(F.concat(*low))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
                 ranges: int | None = None) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, signatures (own, edited, next) as arrays."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(tasks, min(16 * tasks, 4096))     # many small ranges spread evenly over the tasks
    rows = with_next(docs, id_col, text_col, ranges, 2 * tasks)
    n = F.char_length("text").cast("bigint")
    half = F.expr("cast(char_length(text) div 2 as int)")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(char_length(text) div 2 as int))"),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("part", "rn", "ghost", "id", "text", n.alias("n_chars"), F.coalesce(edited, F.lit("")).alias("edited"))
    facts = rows.select("part", "rn", "ghost", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    sides = F.explode(F.array(F.struct(F.lit(1).alias("o"), F.col("text").alias("t")),
                              F.struct(F.lit(0).alias("o"), F.when(~F.col("ghost"), F.col("edited")).alias("t"))))
    words = (rows.select("part", "rn", sides.alias("s"))
             .select("part", "rn", F.col("s.o").alias("o"), F.explode(F.split(F.lower("s.t"), _SEP)).alias("word"))
             .filter("word <> ''")
             .select("part", "rn", F.xxhash64("word").alias("h"), "o"))
    terms = words.groupBy("part", "rn", "h").agg(F.sum("o").alias("own"), F.sum(F.lit(1) - F.col("o")).alias("edit"))
    sig = signatures(terms, ["part", "rn"], ["own", "edit"], samples)
    out = facts.join(sig, ["part", "rn"], "left")
    w = Window.partitionBy("part").orderBy("rn")
    return (out.withColumn("sig_next", F.lead("sig_own").over(w)).filter("not ghost")
            .select("id", "n_chars", "edited_sha256", "sig_own", "sig_edit", "sig_next"))


@register("op3_fingerprints")
def op3_fingerprints(spark, sf_dir):
    """Weighted-sampling fingerprints of every text, its edited text, and their likeness."""
    f = fingerprints(table(spark, sf_dir, "documents"))
    own, edit, nxt = F.col("sig_own"), F.col("sig_edit"), F.col("sig_next")
    return f.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(own).alias("fingerprint"),
                    as_text(edit).alias("edited_fingerprint"), likeness(own, edit).alias("near_edited"),
                    likeness(own, nxt).alias("near_next"))
