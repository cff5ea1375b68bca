"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents stand in a seeded order, and its stream of words is cut
into ``BLOCKS`` blocks of equal length (a document may lie across blocks). A source's
target gives an exact quota of block draws: whole passes over its blocks and part of
one more. The quotas of all sources are split recursively among the output shards:
each node of a binary tree draws, without replacement, how many of every source's
draws go left. A shard then owns a range of each source's draws; within a pass, draws
follow a permutation of the blocks, so shards get disjoint blocks. Rows of a shard are
put in a local order by hash.

Only DataFrame expressions are used. Running word counts come from cells of the seeded
order, so a source with a third of all rows is spread like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logweft.llm.common import WORD, boxed, keyed, unboxed
from logweft.operators.ranking import hash_cells, running_totals
from logweft.session import materialize

BLOCKS = 256  # blocks of one pass over a source
SHARDS = 16  # output shards, a power of two
MOST_REPEATS = 3  # a target is at most this many times its source's size
WEIGHTS = (1, 2, 3)  # of the sources in code-point order, repeating
SEED = 20


def sized_documents(docs: DataFrame, seed: int = SEED, key: Column | None = None) -> DataFrame:
    """A stored row per document: its words, its source's key and its seeded order.
    ``key`` is a unique long, by default a new number."""
    return materialize(
        docs.select(
            "doc_id",
            F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("source_key"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("order_hash"),
            (F.monotonically_increasing_id() if key is None else key).alias("row_id"),
        ),
        "mix-sizes",
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """A row per source: size, weight, target and quota of draws.

    Sorted by (limit / weight), a source is at its limit if even the level that
    remains for it and those after it, per weight, is above its own.
    """
    sources = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source_key") == "n", "source_key")
    limit = F.col("source_size") * MOST_REPEATS
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("source_rank") - 1) % len(WEIGHTS)).cast("int") + 1)
    named = sources.withColumn("source_rank", F.row_number().over(by_name)).withColumns(
        {"weight": weight, "limit": limit}
    )
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    free = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    marked = named.withColumn("full", free / F.sum("weight").over(after) >= F.col("limit") / F.col("weight"))
    rest = F.sum("source_size").over(everything) - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(everything)
    level = F.try_divide(rest, F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level * F.col("weight"))
    quota = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * BLOCKS).otherwise(0.0)
    return marked.withColumn("target", target).select(
        "source_key",
        "source_rank",
        "source_size",
        "weight",
        "target",
        F.floor(quota).alias("whole_draws"),
        (quota - F.floor(quota)).alias("part_draw"),
    )


def _hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """How many of ``marked`` among ``total`` are in ``drawn``, for a uniform number:
    the distribution's logarithms follow from each other, from the least count on."""
    low = f"greatest(0L, {drawn} - ({total} - {marked}))"
    counts = f"sequence({low}, least({marked}, {drawn}))"
    rise = (
        f"ln(double({marked} - k + 1) * double({drawn} - k + 1)"
        f" / (double(k) * double({total} - {marked} - {drawn} + k)))"
    )
    step = f"CASE WHEN k = {low} THEN 0D ELSE w.log + {rise} END"
    peak = f"aggregate({counts}, named_struct('log', 0D, 'top', 0D), (w, k) -> named_struct('log', {step}, 'top', greatest(w.top, {step})), w -> w.top)"
    mass = f"aggregate({counts}, named_struct('log', 0D, 'sum', 0D), (w, k) -> named_struct('log', {step}, 'sum', w.sum + exp({step} - top)), w -> w.sum)"
    passed = f"w.sum + exp({step} - top)"
    found = (
        f"aggregate({counts}, named_struct('log', 0D, 'sum', 0D, 'at', -1L), (w, k) -> named_struct('log', {step},"
        f" 'sum', {passed}, 'at', CASE WHEN w.at < 0 AND {passed} >= {uniform} * mass THEN k ELSE w.at END),"
        f" w -> CASE WHEN w.at < 0 THEN least({marked}, {drawn}) ELSE w.at END)"
    )
    return f"transform(array({peak}), top -> transform(array({mass}), mass -> {found})[0])[0]"


def _left_counts(seed: int) -> str:
    """Draws of every source that go to the left half of a node, one source after the other."""
    uniform = f"(shiftrightunsigned(xxhash64({seed}, first_shard, last_shard, i), 11) / 9007199254740992D)"
    draw = _hypergeometric("acc.others", "counts[i]", "acc.need", uniform)
    return (
        "aggregate(sequence(0, size(counts) - 1),"
        " named_struct('left', cast(array() AS array<bigint>), 'others', total, 'need', left_total),"
        f" (acc, i) -> transform(array({draw}), x -> named_struct('left', concat(acc.left, array(x)),"
        " 'others', acc.others - counts[i], 'need', acc.need - x))[0], acc -> acc.left)"
    )


def shard_quotas(targets: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``source_rank`` and, per source, the number of draws before each shard's own."""
    draws = F.col("whole_draws") + F.when(F.col("part_draw") > 0, 1).otherwise(0)
    node = targets.agg(F.array_sort(F.collect_list(F.struct("source_rank", draws.alias("draws")))).alias("all"))
    node = node.filter(F.size("all") > 0).select(
        F.lit(0).alias("first_shard"),
        F.lit(shards).alias("last_shard"),
        F.transform("all", lambda s: s["draws"].cast("bigint")).alias("counts"),
        F.expr("aggregate(all, 0L, (n, s) -> n + s.draws)").alias("draws"),
    )
    width = shards
    while width > 1:
        middle = "first_shard + (last_shard - first_shard) div 2"
        up_to = lambda shard: f"(draws * ({shard}) div {shards})"
        node = node.selectExpr("*", f"{middle} AS middle", "aggregate(counts, 0L, (n, c) -> n + c) AS total")
        node = node.withColumn("left_total", F.expr(f"{up_to('middle')} - {up_to('first_shard')}"))
        node = node.withColumn("left", F.expr(_left_counts(seed)))
        halves = (
            "array(named_struct('a', first_shard, 'b', middle, 'c', left),"
            " named_struct('a', middle, 'b', last_shard, 'c', zip_with(counts, left, (n, x) -> n - x)))"
        )
        node = node.select("draws", F.explode(F.expr(halves)).alias("h")).select(
            F.col("h.a").alias("first_shard"), F.col("h.b").alias("last_shard"), F.col("h.c").alias("counts"), "draws"
        )
        width //= 2
    shares = node.select("first_shard", F.posexplode("counts").alias("place", "n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_shard", "n"))), lambda s: s["n"])
    ends = "transform(ns, (x, j) -> aggregate(slice(ns, 1, j + 1), 0L, (a, b) -> a + b))"
    return shares.groupBy((F.col("place") + 1).alias("source_rank")).agg(listed.alias("ns")).select(
        "source_rank", F.expr(ends).alias("shard_ends")
    )


def block_draws(targets: DataFrame, quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """A row per draw: source, block, its words [lo, hi) in the source's stream, pass and shard."""
    passes = F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("whole_draws") / BLOCKS))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(BLOCKS - 1).cast("bigint"))
    rows = targets.filter("source_size > 0").withColumn("pass", F.explode(passes)).withColumn("block", F.explode(blocks))
    shuffled = Window.partitionBy("source_key", "pass").orderBy(
        F.md5(F.concat_ws("|", F.lit(str(seed)), "source_key", F.col("pass").cast("string"), F.col("block").cast("string")))
    )
    draw = F.col("pass") * BLOCKS + F.row_number().over(shuffled) - 1
    cut = lambda block: F.floor(F.expr(f"({block}) * source_size div {BLOCKS}"))
    rows = rows.withColumns({"draw": draw, "lo": cut("block"), "hi": cut("block + 1")})
    part = F.floor(F.col("part_draw") * (F.col("hi") - F.col("lo")) + 0.5)
    end = F.when(F.col("draw") < F.col("whole_draws"), F.col("hi")).otherwise(F.col("lo") + part)
    taken = rows.filter((F.col("draw") <= F.col("whole_draws"))).withColumn("hi", end).filter("hi > lo")
    shard = F.least(F.size(F.filter("shard_ends", lambda e: e <= F.col("draw"))), F.size("shard_ends") - 1)
    return taken.join(quotas, "source_rank").select("source_key", "block", "lo", "hi", "pass", shard.alias("shard"))


def placed_documents(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents with their words [start, end) in their source's stream, stored."""
    summed = running_totals(
        sized, ["source_key"], hash_cells("order_hash"), ["order_hash", "size", "row_id"], {"end": F.col("size")}
    )
    found = summed.join(targets.select("source_key", "source_size", "target"), "source_key")
    return materialize(found.withColumn("start", F.col("end") - F.col("size")), "mix-places")


def pieces(placed: DataFrame, draws: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: a row per document and draw that takes words of it, with the words'
    place in the document, the shard and the order within the shard."""
    block = lambda word: f"(({word} + 1) * {BLOCKS} - 1) div source_size"
    cut = placed.filter("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence({block('start')}, {block('(end - 1)')})"))
    )
    first, last = F.greatest("start", "lo"), F.least("end", "hi")
    both = cut.join(draws, ["source_key", "block"]).filter(last > first)
    return both.select(
        "row_id",
        "doc_id",
        "source_key",
        "pass",
        "shard",
        F.xxhash64(F.lit(seed), "shard", "row_id", "pass", "block").alias("shard_order"),
        (first - F.col("start")).alias("first_word"),
        (last - first).alias("n_words"),
    )


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed documents, pieces of the mix).

    Null texts have no words and are never taken; a null source is a source of its
    own, the last; repeated rows are documents of their own; an empty table gives
    empty tables. Other columns are not read. Sources are taken to be as many as a
    mix names by hand: their counts fit in one row.
    """
    sized = sized_documents(docs, seed, key)
    targets = materialize(source_targets(sized), "mix-targets")
    placed = placed_documents(sized, targets)
    draws = block_draws(targets, shard_quotas(targets, shards, seed), seed)
    return placed, pieces(placed, draws, seed)


def taken_words(docs: DataFrame) -> DataFrame:
    """Per document: size, its source's size and target, and the words that the mix takes."""
    placed, parts = mix(docs)
    taken = parts.groupBy("row_id").agg(F.sum("n_words").alias("taken"))
    return placed.join(taken, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix with the documents' own columns: a row per document and pass that draws words
    of it. Where a pass draws all of them the document is whole, otherwise the row has the
    drawn words in the document's order, joined by one space. Rows are in the order of
    their shards, and within a shard in its local order; a document across blocks goes to
    the shard of its first drawn words."""
    rows = keyed(boxed(docs).withColumn("source", F.col("doc")["source"]), ["doc", "doc_id", "text", "source"])
    placed, parts = mix(rows, key=F.col("row_key"))
    spans = F.array_sort(F.collect_list(F.struct("first_word", "n_words", "shard", "shard_order")))
    drawn = parts.groupBy(F.col("row_id").alias("row_key"), "pass").agg(spans.alias("spans"), F.sum("n_words").alias("taken"))
    sizes = placed.select(F.col("row_id").alias("row_key"), "size")
    copies = rows.select("row_key", "doc").join(drawn.join(sizes, "row_key"), "row_key")
    first = F.col("spans")[0]
    ordered = copies.orderBy(first["shard"], first["shard_order"], "row_key", "pass")
    words = F.array(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)))
    span = lambda w, s: F.slice(w, (s["first_word"] + 1).cast("int"), s["n_words"].cast("int"))
    part = F.transform(words, lambda w: F.array_join(F.flatten(F.transform("spans", lambda s: span(w, s))), " "))[0]
    return unboxed(ordered, F.when(F.col("taken") == F.col("size"), F.col("doc")["text"]).otherwise(part))


def taken_sql(seed: int = SEED) -> str:
    """The same per-document result in SQL (shards don't change what is taken)."""
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', '{seed}', doc_id::VARCHAR)) AS order_hash
  FROM documents),
sources AS (SELECT source_key, sum(size)::BIGINT AS source_size FROM sized GROUP BY source_key),
named AS (
  SELECT *, (ARRAY[{", ".join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY source_key = 'n', source_key) - 1) % {len(WEIGHTS)} + 1] AS weight,
         row_number() OVER (ORDER BY source_key = 'n', source_key) AS source_rank,
         source_size * {MOST_REPEATS} AS ceiling
  FROM sources),
marked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source_rank
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ceiling / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
            >= ceiling / weight AS is_full
  FROM named),
targets AS (
  SELECT *, CASE WHEN is_full THEN ceiling::DOUBLE
            ELSE (sum(source_size) OVER () - sum(CASE WHEN is_full THEN ceiling ELSE 0 END) OVER ())::DOUBLE
                 / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM marked),
quotas AS (
  SELECT source_key, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size * {BLOCKS} ELSE 0 END AS quota FROM targets),
ranked AS (
  SELECT source_key, source_size, quota, block,
         (floor(quota)::BIGINT // {BLOCKS}) * {BLOCKS} + row_number() OVER (PARTITION BY source_key
            ORDER BY md5(concat_ws('|', '{seed}', source_key, (floor(quota)::BIGINT // {BLOCKS})::VARCHAR, block::VARCHAR))) - 1 AS draw
  FROM quotas, range({BLOCKS}) AS r(block) WHERE source_size > 0),
blocks AS (
  SELECT source_key, block, floor(quota)::BIGINT // {BLOCKS} AS passes, draw < floor(quota) AS once_more, draw = floor(quota) AS in_part,
         block * source_size // {BLOCKS} AS lo, (block + 1) * source_size // {BLOCKS} AS hi, quota - floor(quota) AS part
  FROM ranked),
placed AS (
  SELECT s.*, sum(size) OVER (PARTITION BY s.source_key ORDER BY order_hash, size, s.rowid
              ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" , row_number() OVER () AS row_id
  FROM (SELECT *, row_number() OVER () AS rowid FROM sized) s),
cuts AS (
  SELECT p.row_id, p.size, "end" - size AS start, "end", p.source_key,
         unnest(range((("end" - size + 1) * {BLOCKS} - 1) // source_size, ("end" * {BLOCKS} - 1) // source_size + 1)) AS block
  FROM placed p JOIN sources USING (source_key) WHERE size > 0),
taken AS (
  SELECT row_id, sum(
           (passes + once_more::INT) * greatest(0, least("end", hi) - greatest(start, lo))
           + in_part::INT * greatest(0, least("end", lo + floor(part * (hi - lo) + 0.5)::BIGINT) - greatest(start, lo))
         )::BIGINT AS taken
  FROM cuts JOIN blocks USING (source_key, block) GROUP BY row_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM placed LEFT JOIN taken USING (row_id) JOIN quotas USING (source_key)"""
