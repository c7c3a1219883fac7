"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in code point order, NULL last, weigh 5, 2, 1, 5, 2, 1, ... and share the words of all documents;
no source gives more than three times its words, what exceeds that is shared by the others by weight.

A source's documents are dealt by key hash into blocks, about as many as a block has documents, so
that neither a source's list of blocks nor a block's list of documents is more than the square root of
all rows. A source gives its blocks in order, several times if its target is above its words; within
the block where the target falls, documents are taken until the middle of the next would pass it.

The blocks taken are dealt to output shards by a tree: each node holds an exact number of blocks of
every source and room for as many; urn draws decide how many of each source go to its left half. A
shard then takes the next so many blocks of each source, disjoint from all others, and orders its
documents by a hash. All draws are hashes of place and seed, so reruns agree. A tree node is a row with one number for
each source, and sources are ranked in one task: both grow with the number of sources, not of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.storage import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3  # a source's words are taken so often at most
SEED = 7
SHARD_WORDS = 1 << 22


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _placed(docs: DataFrame, key: str, text: str, source: str, blocks: int, seed: int) -> DataFrame:
    """All columns of ``docs`` in one struct, and source, size, hash and block of each row."""
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text)), F.lit(""))
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), name))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(source).cast("string").alias("source"),
        # equal keys for equal sources, also for NULL, so that joins need not compare NULLs
        F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source))).alias("src"),
        word_count(F.col(text)).alias("size"),
        digest.alias("hash"),
        F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(blocks)).alias("block"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to one row per source (``src``, ``source``, ``source_size``)."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    most = MOST * F.col("source_size")
    ranked = sources.withColumn("place", place).withColumn("weight", weight).withColumn("ratio", most / F.col("weight"))
    # the sources that stop at their most are the first by most words per weight
    order = Window.orderBy("ratio", "place")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("share", (F.sum("source_size").over(everything) - before) / rest)
    stops = F.col("share") * F.col("weight") > most
    first_free = F.min(F.when(~stops, F.struct("ratio", "place", "share"))).over(everything)
    ahead = F.struct("ratio", "place") < F.struct("free.ratio", "free.place")
    return filled.withColumn("free", first_free).select(
        "src", "source", "source_size", "place",
        F.when(stops & ahead, most.cast("double"))
        .otherwise(F.coalesce(F.col("free.share") * F.col("weight"), F.lit(0.0))).alias("target"),
    )


_DRAW = """
aggregate(
  sequence(1, size(counts)),
  named_struct('taken', cast(array() as array<bigint>), 'room', room, 'total', total),
  (node, s) -> transform(array(aggregate(
    sequence(1L, greatest(1L, counts[s - 1])),
    named_struct('x', 0L, 'room', node.room, 'total', node.total),
    (urn, i) -> if(i > counts[s - 1], urn, if(
      pmod(xxhash64({seed}, low, high, s, i), 1000000007L) * urn.total < urn.room * 1000000007L,
      named_struct('x', urn.x + 1L, 'room', urn.room - 1L, 'total', urn.total - 1L),
      named_struct('x', urn.x, 'room', urn.room, 'total', urn.total - 1L)))
  )), urn -> named_struct('taken', concat(node.taken, array(urn.x)), 'room', urn.room, 'total', urn.total))[0]
).taken
"""


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Rows (place, shard, blocks, first): how many blocks of each source a shard gets, and from which on.

    ``quotas`` has ``place`` (0, 1, ... by source) and ``quota``. Every shard gets the same number of blocks,
    give or take one; each source's blocks are given out exactly.
    """
    nodes = quotas.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "quota"))), lambda x: x["quota"]).alias("counts")
    ).where(F.size("counts") > 0).select(F.lit(0).alias("low"), F.lit(shards).alias("high"), "counts")
    total = F.expr("aggregate(counts, 0L, (a, x) -> a + x)")
    while shards > 1:
        # the left half's room: its share of the blocks, rounded alike everywhere
        room = F.expr("total * ((low + high) div 2 - low) div (high - low)")
        nodes = nodes.withColumn("total", total).withColumn("room", room).withColumn("left", F.expr(_DRAW.format(seed=seed)))
        middle = F.expr("(low + high) div 2").cast("int")
        rest = F.transform("counts", lambda c, i: c - F.col("left")[i])
        nodes = nodes.select(F.explode(F.array(
            F.struct(F.col("low").alias("low"), middle.alias("high"), F.col("left").alias("counts")),
            F.struct(middle.alias("low"), F.col("high").alias("high"), rest.alias("counts")),
        )).alias("n")).select("n.low", "n.high", "n.counts")
        shards //= 2
    given = nodes.select(F.col("low").alias("shard"), F.posexplode("counts").alias("place", "blocks"))
    earlier = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return given.withColumn("first", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))


def mix_plan(
    docs: DataFrame, shards: int | None = None, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Per row: ``doc`` (a struct of all its columns), ``size``, ``source_size``, ``target``, ``draws``.

    ``draws`` lists the copies taken: epoch, shard and place within the shard. ``shards`` is a power of two, by
    default so many that one holds about 4 million words. NULL text has no words; a row without key is
    dealt by its text; a NULL source is a source; an empty table gives no row. Rows with equal keys
    share a block and are each taken on their own.
    """
    rows, words = docs.agg(F.count(F.lit(1)), F.sum(word_count(F.col(text)))).first()
    blocks = int(max(1, rows) ** 0.5 - 1e-9) + 1
    shards = shards or 1 << (max(0, (words or 0) - 1) // SHARD_WORDS).bit_length()
    placed = _placed(docs, key, text, source, blocks, seed)
    sums = staged(placed.groupBy("src", "source", "block").agg(F.sum("size").alias("words")), "blocks")
    sources = staged(targets(sums.groupBy("src", "source").agg(F.sum("words").alias("source_size"))), "sources")
    # a source's stream of blocks: whole rounds, then the blocks up to where the target falls
    ordered = Window.partitionBy("src").orderBy("block")
    times = F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))
    rounds = F.when(F.col("source_size") > 0, times).otherwise(0).cast("int")
    stream = (
        sums.drop("source").join(sources, "src")
        .withColumn("rounds", rounds)
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
        .withColumn("start", F.sum("words").over(ordered) - F.col("words"))
        .withColumn("at", F.row_number().over(ordered) - 1)
        .withColumn("in_round", F.count(F.lit(1)).over(Window.partitionBy("src")))
        .withColumn("more", (F.col("start") < F.col("rest")).cast("int"))
    )
    stream = staged(stream, "stream")
    quotas = stream.groupBy("place").agg(F.sum(F.col("rounds") + F.col("more")).alias("quota"))
    cuts = splitting_tree(quotas, shards, seed).groupBy("place").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shard", "first"))), lambda x: x["first"]).alias("firsts")
    )
    unit = "cast(e as bigint) * in_round + at"
    copies = F.expr(
        f"transform(sequence(0, rounds), e -> named_struct('epoch', e, 'shard', size(filter(firsts, f -> f <= {unit})) - 1))"
    )
    plan = staged(
        stream.join(cuts, "place").select(
            "src", "block", "source_size", "target", "rounds", "rest", "start", "words", copies.alias("copies")
        ),
        "plan",
    )
    within = Window.partitionBy("src", "block").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(plan, ["src", "block"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    once_more = (F.col("start") < F.col("rest")) & (F.col("before") + F.col("size") / 2 <= F.col("rest"))
    taken = F.slice("copies", F.lit(1), F.col("rounds") + once_more.cast("int"))
    return joined.select(
        "doc", "size", "source_size", "target",
        F.transform(
            taken,
            lambda c: F.struct(
                c["epoch"].alias("epoch"), c["shard"].alias("shard"),
                F.xxhash64(F.lit(seed), c["shard"], c["epoch"], F.col("hash")).alias("place"),
            ),
        ).alias("draws"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy taken, with ``mix_epoch``, ``mix_shard`` and ``mix_place``.

    Rows of a shard lie together in the order of their place. Columns of ``docs`` of the same names are replaced.
    """
    drawn = mix_plan(docs, **options).select("doc", F.explode("draws").alias("draw"))
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in ("mix_epoch", "mix_shard", "mix_place")]
    out = drawn.select(
        *kept, F.col("draw.epoch").alias("mix_epoch"), F.col("draw.shard").alias("mix_shard"), F.col("draw.place").alias("mix_place")
    )
    return out.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_place")
