"""Operator 8: mixing sources to target weights, by DataFrame and SQL functions only.

Each source's target is its share of all words by weight, stopped at a multiple
of its own size, the excess reshared. Documents are cut into blocks of words and
permuted within their source by a hash; whole passes and one partial pass over
the permutation give exactly the (rounded) target. The numbers of blocks per
source are then split among output shards by a tree of multivariate
hypergeometric draws, each shard gets disjoint ranges of each permutation, and
orders its blocks by another hash.

Edge cases: null text has size 0; a null source is a source of its own, the last;
sources without words have target 0; rows without a doc_id, and repeated rows,
count and are returned each (equal ones are numbered, so each has its own place);
very long texts are many blocks; ties in the permutation are broken by doc_id,
number and block; other columns are ignored, and kept whatever their names (but
for names that end in two underscores) by ``mixed_documents``; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import Workspace, table

WORD_RE = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, BLOCK_WORDS, SHARD_WORDS, BUCKET_BLOCKS, SEED = (1, 2, 3), 3, 256, 2_000_000, 2048, 8


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, copy (numbers repeated rows)."""
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"))
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("doc_id")))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sid, source, source_size, n_blocks, target: shares by weight, none above ``most`` times its size.

    With sources in the order of cap/weight, those before the water level are
    full; the level is where the caps so far and the weights left meet the total.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / BLOCK_WORDS)).alias("n_blocks"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumns({"w": w.cast("long"), "cap": F.col("source_size") * most})
    by, whole = Window.orderBy(F.col("cap") / F.col("w"), "sid"), Window.partitionBy()
    per = per.withColumns({"caps": F.sum("cap").over(by), "ws": F.sum("w").over(by), "all": F.sum("source_size").over(whole), "all_w": F.sum("w").over(whole)})
    reached = F.col("caps") + F.col("cap") / F.col("w") * (F.col("all_w") - F.col("ws")) >= F.col("all")
    level = (F.col("all") - F.col("caps") + F.col("cap")) / (F.col("all_w") - F.col("ws") + F.col("w"))
    per = per.withColumn("level", F.min_by(F.when(reached, level), F.when(reached, F.struct(F.col("cap") / F.col("w"), F.col("sid")))).over(whole))
    return per.select("sid", "source", "source_size", "n_blocks", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(n_all: str, k_all: str, n: str, u: str) -> str:
    """SQL for a draw of how many of ``k_all`` marked among ``n_all`` fall into ``n``: inverse of the
    distribution function from the mode outwards, over ten standard deviations (beyond, less than 1e-20)."""
    up = "(c.k - j) * (c.n - j) / ((j + 1D) * (c.a - c.k - c.n + j + 1D))"
    down = "j * (c.a - c.k - c.n + j) / ((c.k - j + 1D) * (c.n - j + 1D))"
    ups, downs = "if(c.hi > c.mode, sequence(c.mode, c.hi - 1), cast(array() as array<bigint>))", "if(c.mode > c.lo, sequence(c.mode, c.lo + 1, -1L), cast(array() as array<bigint>))"
    total = lambda seq, f: f"aggregate({seq}, named_struct('w', 1D, 's', 0D), (q, j) -> named_struct('w', q.w * {f}, 's', q.s + q.w * {f}), q -> q.s)"
    walk = lambda seq, f, to, start: f"aggregate({seq}, {start}, (q, j) -> named_struct('w', q.w * {f}, 't', q.t - q.w * {f}, 'k', if(q.k is null and q.t < q.w * {f}, {to}, q.k)))"
    first = "named_struct('w', 1D, 't', c.u * (1 + c.us + c.ds) - 1, 'k', if(c.u * (1 + c.us + c.ds) < 1, c.mode, cast(null as bigint)))"
    pick = _let(walk(ups, up, "j + 1", first), "r", f"if(r.k is not null, r.k, {walk(downs, down, 'j - 1', 'named_struct(' + chr(39) + 'w' + chr(39) + ', 1D, ' + chr(39) + 't' + chr(39) + ', r.t, ' + chr(39) + 'k' + chr(39) + ', cast(null as bigint))')}.k)")
    more = _let(f"named_struct('a', c.a, 'k', c.k, 'n', c.n, 'u', c.u, 'mode', c.mode, 'lo', c.lo, 'hi', c.hi, 'us', {total(ups, up)}, 'ds', {total(downs, down)})", "c", f"coalesce({pick}, c.mode)")
    width = "cast(ceil(10 * sqrt(c.n * (c.k / greatest(c.a, 1D)) * (1 - c.k / greatest(c.a, 1D)))) + 3 as bigint)"
    edges = _let(f"named_struct('a', c.a, 'k', c.k, 'n', c.n, 'u', c.u, 'mode', c.mode, 'lo', greatest(0L, c.n + c.k - c.a, c.mode - {width}), 'hi', least(c.n, c.k, c.mode + {width}))", "c", more)
    mode = "cast(floor((c.n + 1D) * (c.k + 1D) / (c.a + 2D)) as bigint)"
    return _let(f"named_struct('a', {n_all}, 'k', {k_all}, 'n', {n}, 'u', {u})", "c", _let(f"named_struct('a', c.a, 'k', c.k, 'n', c.n, 'u', c.u, 'mode', least(c.n, c.k, greatest(0L, c.n + c.k - c.a, {mode})))", "c", edges))


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """shard, sid, quota: exact quotas (sid, quota) split over shards of equal size.

    A node holds one number per source. Its left half draws its number of blocks
    of each source in turn, without replacement, from what the node has left.
    """
    level = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", "quota"))), lambda x: x.quota).alias("q")).select("q", F.lit(0).alias("shard"), F.lit(shards).alias("shards"))
    draw = _hypergeometric("s.a", "element_at(q, i + 1)", "s.n", f"pmod(xxhash64({seed}L, shard, shards, i), 1L << 53) / 9007199254740992D")
    fold = f"""aggregate(if(size(q) > 0, sequence(0, size(q) - 1), cast(array() as array<int>)),
        named_struct('a', total, 'n', cast(round(total * (shards div 2) / shards) as bigint), 'left', cast(array() as array<bigint>)),
        (s, i) -> {_let(draw, 'd', "named_struct('a', s.a - element_at(q, i + 1), 'n', s.n - d, 'left', concat(s.left, array(d)))")}, s -> s.left)"""
    for _ in range((shards - 1).bit_length()):
        node = level.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x)")).withColumn("left", F.when(F.col("shards") > 1, F.expr(fold)))
        halves = F.when(F.col("shards") > 1, F.expr("array(named_struct('q', left, 'shard', shard, 'shards', shards div 2), named_struct('q', transform(q, (x, i) -> x - element_at(left, i + 1)), 'shard', shard + shards div 2, 'shards', shards - shards div 2))")).otherwise(F.expr("array(named_struct('q', q, 'shard', shard, 'shards', shards))"))
        level = node.select(F.inline(halves))
    return level.select("shard", F.posexplode("q").alias("sid", "quota"))


def _md5_key(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts]))


def _near(small: DataFrame, bound: int = 100_000) -> DataFrame:
    """A side to broadcast where its count is small; otherwise left to the planner and its skew handling."""
    return F.broadcast(small) if small.count() <= bound else small


def mix_blocks(spark: SparkSession, rows: DataFrame, per: DataFrame, ws: Workspace, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per block taken: doc_id, copy, source, block, first_word, n_words, epoch, shard, position.

    ``rows`` as by ``sized`` and ``per`` as by ``targets``, both stored.
    """
    want = F.floor(F.col("target") + 0.5)
    plan = per.filter("source_size > 0").select("*", F.floor(want / F.col("source_size")).alias("epochs")).withColumn("rest", want - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("buckets", F.ceil(F.col("n_blocks") / BUCKET_BLOCKS))
    cut = rows.filter("size > 0").join(_near(plan), rows.source.eqNullSafe(plan.source)).drop(plan.source)
    cut = cut.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK_WORDS))))
    cut = cut.withColumn("words", F.least(F.lit(BLOCK_WORDS).cast("long"), F.col("size") - F.col("block") * BLOCK_WORDS)).withColumn("key", _md5_key(F.lit(str(seed)), "doc_id", "copy", "block"))
    cut = cut.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets"), 32))
    cut = ws.save(cut.select("sid", "doc_id", "copy", "source", "block", "words", "key", "bucket", "epochs", "rest", "n_blocks"), "blocks")

    before = cut.groupBy("sid", "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("sid").orderBy("bucket")
    before = before.select("sid", "bucket", (F.sum("w").over(run) - F.col("w")).alias("w0"), (F.sum("n").over(run) - F.col("n")).alias("n0"))
    inner = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "copy", "block").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumns({"w1": F.sum("words").over(inner) - F.col("words"), "n1": F.count(F.lit(1)).over(inner) - 1}).join(before, ["sid", "bucket"])
    placed = placed.withColumns({"rank": F.col("n0") + F.col("n1"), "part": F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("rest") - F.col("w0") - F.col("w1")))})
    passes = F.when(F.col("part") > 0, F.col("epochs") + 1).otherwise(F.col("epochs"))
    placed = placed.filter(passes > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), passes - 1)))
    placed = placed.withColumns({"n_words": F.when(F.col("epoch") < F.col("epochs"), F.col("words")).otherwise(F.col("part")), "at": F.col("epoch") * F.col("n_blocks") + F.col("rank")})
    placed = ws.save(placed.select("sid", "doc_id", "copy", "source", "block", "epoch", "n_words", "at", "key"), "placed")

    quotas = ws.save(placed.groupBy("sid").agg(F.count(F.lit(1)).alias("quota")), "quotas")
    total = placed.agg(F.sum("n_words").alias("n")).first().n or 0
    shards = max(1, -(-total // shard_words))
    numbered = quotas.select("sid", "quota", (F.row_number().over(Window.orderBy("sid")) - 1).alias("i"))
    tree = splitting_tree(quotas, shards, seed).withColumnRenamed("sid", "i").join(numbered.select("sid", "i"), "i")
    ends = tree.withColumn("end", F.sum("quota").over(Window.partitionBy("sid").orderBy("shard"))).groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x.end).alias("ends"))
    ends = ws.save(ends, "ends")
    # First shard whose end lies beyond the block's place, by bisection.
    steps = max(1, shards.bit_length())
    shard = F.expr(f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size(ends) - 1), (s, i) -> if(element_at(ends, cast((s.lo + s.hi) div 2 + 1 as int)) > at, named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 as int)), named_struct('lo', least(cast((s.lo + s.hi) div 2 + 1 as int), s.hi), 'hi', s.hi)), s -> s.lo)")
    dealt = placed.join(_near(ends), "sid").withColumn("shard", shard)
    local = Window.partitionBy("shard").orderBy(_md5_key(F.lit(f"{seed}s"), "key", "epoch"), "doc_id", "copy", "block", "epoch")
    return dealt.withColumn("position", F.row_number().over(local) - 1).select("doc_id", "copy", "source", "block", (F.col("block") * BLOCK_WORDS).alias("first_word"), "n_words", "epoch", "shard", "position")


def mixed(spark: SparkSession, docs: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with sizes, sources with targets, and the blocks of the mix."""
    rows = ws.save(sized(docs), "rows")
    per = ws.save(targets(rows), "sources")
    return rows, per, mix_blocks(spark, rows, per, ws)


def taken_words(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """doc_id, source, copy, size, source_size, target, taken of every row."""
    rows, per, blocks = mixed(spark, docs, ws)
    held = ws.save(blocks, "mix").groupBy("doc_id", "source", "copy").agg(F.sum("n_words").alias("words"))
    held = held.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("copy").alias("c"), "words")
    all_rows = rows.join(held, rows.doc_id.eqNullSafe(held.d) & rows.source.eqNullSafe(held.s) & (rows.copy == held.c) & (rows["size"] > 0), "left")
    small = per.select(F.col("source").alias("s2"), "source_size", "target")
    out = all_rows.join(_near(small), all_rows.source.eqNullSafe(small.s2))
    return out.select("doc_id", "source", "copy", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` as the mix takes them: one row for each pass over a document, with its text (and ``n_chars``, if there is one).

    A partial pass has the words of the blocks taken, in order, one space apart.
    Rows lie by output shard and in the order of places within it; a text of several
    blocks stays whole and lies where its first block was dealt.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    numbered = docs.withColumn("size__", words).withColumn("copy__", F.row_number().over(Window.partitionBy("doc_id", "source", "size__").orderBy("text")))
    held = ws.save(numbered, "numbered")
    rows = held.select("doc_id", "source", F.col("size__").alias("size"), F.col("copy__").alias("copy"))
    per = ws.save(targets(rows), "sources")
    blocks = mix_blocks(spark, rows, per, ws).groupBy("doc_id", "source", "copy", "epoch")
    where = F.min_by(F.struct("shard", "position"), "first_word")
    passes = blocks.agg(F.sum("n_words").alias("words__"), F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("blocks__"), where.alias("where__"))
    passes = ws.save(passes.withColumnsRenamed({"doc_id": "d__", "source": "s__", "copy": "c__", "epoch": "epoch__"}), "passes")
    taken = held.filter("size__ > 0").join(passes, held.doc_id.eqNullSafe(passes.d__) & held.source.eqNullSafe(passes.s__) & (held.copy__ == passes.c__))
    # The words of a partly taken text are found once, not once a block.
    part = F.expr(_let(rf"regexp_extract_all(text, r'{WORD_RE}', 0)", "w", "array_join(transform(blocks__, b -> array_join(slice(w, cast(b.first_word + 1 as int), cast(b.n_words as int)), ' ')), ' ')"))
    out = taken.withColumn("text", F.when(F.col("words__") == F.col("size__"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    laid = out.repartition("where__.shard").sortWithinPartitions("where__.shard", "where__.position", "epoch__")
    return laid.select(docs.columns)


def op8_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(spark, table(spark, sf_dir, "documents"), Workspace(spark, "op8")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, (sid % 3 + 1)::BIGINT AS w, 3 * source_size AS cap FROM p),
c AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, sum(source_size) OVER () AS alls, sum(w) OVER () AS allw FROM w WINDOW o AS (ORDER BY cap / w, sid)),
l AS (SELECT *, caps::DOUBLE + (cap / w) * (allw - ws)::DOUBLE >= alls AS reached, (alls - caps + cap)::DOUBLE / (allw - ws + w)::DOUBLE AS level FROM c),
t AS (SELECT l.*, least(cap::DOUBLE, w * (SELECT level FROM l WHERE reached ORDER BY cap / w, sid LIMIT 1)) AS target FROM l),
e AS (SELECT *, floor(target + 0.5)::BIGINT AS want, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs FROM t),
b AS (SELECT doc_id, d.source, size, epochs, want - epochs * source_size AS rest, b, least({BLOCK_WORDS}, size - b * {BLOCK_WORDS}) AS words FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source, unnest(range((size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) AS x(b)),
s AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY md5('{SEED}|' || doc_id || '|1|' || b), doc_id, b ROWS UNBOUNDED PRECEDING) - words AS before FROM b),
k AS (SELECT doc_id, sum(epochs * words + greatest(0, least(words, rest - before)))::BIGINT AS taken FROM s GROUP BY doc_id)
SELECT d.doc_id, d.size, e.source_size, e.target, coalesce(k.taken, 0)::BIGINT AS taken FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN k USING (doc_id)
"""
