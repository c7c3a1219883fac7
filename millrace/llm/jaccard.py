"""N-gram Jaccard join: components of documents whose shingle sets are similar.

1. Frequent tokens are found from counts that tasks have made over all their documents.
2. Every document is indexed by the signatures of ``prefixes``; signatures of one document alone go. Documents of
   equal sets are linked to the smallest of them, which alone goes on.
3. A document's home is, of the smallest documents of its signatures that it could be similar to, the one it
   shares most of them with; homes form trees, the clusters. Documents of a cluster are compared in blocks.
4. Documents of different clusters that meet in as many signatures as similar sets must are compared too,
   around the smaller of the two; one of them is outside the cluster of the signature's smallest document.
5. Every comparison is exact. Blocks return only links that join something new within the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.components import components
from millrace.llm.prefixes import signatures
from millrace.llm.storage import keyed, staged
from millrace.llm.words import SHINGLE, mixed, rows_of, shingle_set, signed, slices

PERCENT = 80
FREQUENT = 32  # a token in so many sets is indexed in combinations
FREQUENT_MOST = 1 << 17  # bound of the broadcast list (1 MB); tokens beyond it count as rare, which is as exact
LOCAL_TOKENS = 1 << 21  # tokens a task counts before it hands on its counts
LOCAL_LEAST = 3  # a count within a task that is handed on
BLOCK = 256  # documents of a block
_SET = np.uint64(0x5E7)


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _set_hash(tokens: np.ndarray) -> np.uint64:
    ranks = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    return mixed((mixed(tokens + _SET) * (ranks * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64).reshape(1))[0]


def _sizes_and_counts(k: int):
    """Rows (is_doc, key, n): the set size of each document, and counts of tokens met often in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}  # by a hash of the set: a collision would only change a count
        waiting = 0

        def counts() -> Iterator[pa.RecordBatch]:
            tokens, n = np.unique(np.concatenate(list(kept.values())), return_counts=True)
            often = n >= LOCAL_LEAST
            yield _table(is_doc=np.zeros(often.sum(), bool), key=signed(tokens[often]), n=n[often].astype(np.int64))

        for batch in slices(batches):
            ids, sizes = [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                tokens = shingle_set(text, k)
                ids.append(doc_id)
                sizes.append(len(tokens))
                if len(tokens) and (at := int(_set_hash(tokens))) not in kept:
                    kept[at] = tokens
                    waiting += len(tokens)
                    if waiting >= LOCAL_TOKENS:
                        yield from counts()
                        kept, waiting = {}, 0
            yield _table(is_doc=np.ones(len(ids), bool), key=pa.array(ids, pa.int64()), n=pa.array(sizes, pa.int64()))
        if kept:
            yield from counts()

    return run


def _indexed(k: int, percent: int, frequent):
    """Rows (sig, doc, n, need, whole). One more signature stands for the whole set; of equal sets met together the smallest id is indexed fully.

    The smallest id of all equal sets is the smallest of its batch too, so the document that goes on has all signatures.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in slices(batches):
            sigs, docs, sizes, needs, counts = [], [], [], [], []
            rows = [(doc_id, shingle_set(text, k)) for doc_id, text in rows_of(batch, "doc_id", "text") if doc_id is not None]
            rows = [(doc_id, tokens, _set_hash(tokens)) for doc_id, tokens in rows if len(tokens)]
            smallest: dict[int, int] = {}
            for doc_id, _, whole in rows:
                smallest[int(whole)] = min(doc_id, smallest.get(int(whole), doc_id))
            for doc_id, tokens, whole in rows:
                need = 1
                own = np.array([whole], np.uint64)
                if doc_id == smallest[int(whole)]:
                    found, need = signatures(tokens, often, percent)
                    own = np.concatenate([own, np.unique(found)])
                sigs.append(own)
                counts.append(len(own))
                docs.append(doc_id)
                sizes.append(len(tokens))
                needs.append(need)
            if sigs:
                yield _table(
                    sig=signed(np.concatenate(sigs)),
                    doc=np.repeat(np.array(docs, np.int64), counts),
                    n=np.repeat(np.array(sizes, np.int32), counts),
                    need=np.repeat(np.array(needs, np.int32), counts),
                    whole=np.concatenate([np.arange(c) == 0 for c in counts]),
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, found = [], []
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                ids.append(doc_id)
                found.append(signed(shingle_set(text, k)))
            yield _table(doc=pa.array(ids, pa.int64()), tokens=pa.array(found, pa.list_(pa.int64())))

    return run


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar to which: a square table of booleans."""
    sizes = np.array([len(s) for s in sets])
    tokens, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = n[where] > 1
    place = np.cumsum(n > 1) - 1
    column, owner = place[where[shared]], owner[shared]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = 8192
    for low in range(0, int(n.size and (n > 1).sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = np.rint(both).astype(np.int64)
    np.fill_diagonal(both, sizes)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def forest(ids: list[int], linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that suffice to connect what ``linked`` connects; rows of one id are connected as they are."""
    same: dict[int, list[int]] = {}
    for i, doc in enumerate(ids):
        same.setdefault(doc, []).append(i)
    left, out = set(range(len(ids))), []
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            for j in [j for j in [*np.flatnonzero(linked[i]).tolist(), *same[ids[i]]] if j in left]:
                left.discard(j)
                todo.append(j)
                if ids[i] != ids[j]:
                    out.append((ids[i], ids[j]))
    return out


def _links(percent: int):
    """Rows sorted by task: compare the documents of each task with one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = None, {}  # sets by document and hash: rows of one id may have different texts

        def compared() -> list[tuple[int, int]]:
            ids = [doc for doc, _ in group]
            return forest(ids, similar(list(group.values()), percent)) if len(set(ids)) > 1 else []

        for batch in batches:
            out = []
            docs = batch.column(batch.schema.get_field_index("doc")).to_pylist()
            tasks = batch.column(batch.schema.get_field_index("task")).to_pylist()
            tokens = batch.column(batch.schema.get_field_index("tokens"))
            for row, (at, doc) in enumerate(zip(tasks, docs, strict=True)):
                if at != task:
                    out += compared()
                    task, group = at, {}
                own = tokens[row].values.to_numpy().copy()
                group[doc, int(_set_hash(own.view(np.uint64)))] = own
            yield _table(a=pa.array([x for x, _ in out], pa.int64()), b=pa.array([x for _, x in out], pa.int64()))
        out = compared()
        yield _table(a=pa.array([x for x, _ in out], pa.int64()), b=pa.array([x for _, x in out], pa.int64()))

    return run


def _tasks(matched: DataFrame, percent: int, block: int) -> DataFrame:
    """Rows (task, doc): which documents are compared with one another."""
    fit = f"100 * least({{0}}n, {{1}}n) >= {percent} * greatest({{0}}n, {{1}}n)"
    facts = staged(matched.select("doc", "n", "need").distinct(), "facts")
    lead = facts.select(F.col("doc").alias("leader"), F.col("n").alias("lead_n"), F.col("need").alias("lead_need"))
    led = staged(matched.where("doc <> leader").groupBy("doc", "leader").count(), "led")
    homes = (
        led.join(lead, "leader").join(facts, "doc")
        .where("count >= least(need, lead_need) and " + fit.format("", "lead_"))
        .groupBy("doc").agg(F.max_by("leader", "count").alias("home"))
    )
    cluster = staged(components(homes.select(F.col("doc").alias("a"), F.col("home").alias("b"))), "clusters")
    cluster = cluster.withColumnRenamed("node", "doc").withColumnRenamed("component", "cluster")
    # blocks of a cluster, of which every two meet in one task
    sizes = staged(cluster.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "sizes")
    own = cluster.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    within = own.select(
        "doc", "cluster", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select(
        F.concat_ws("-", F.lit("w"), "cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "doc"
    )
    # pairs across clusters: at least one of the two is a stray, outside the cluster of the signature's leader
    placed = matched.join(cluster, "doc", "left").withColumn("cluster", F.coalesce("cluster", "doc"))
    leading = cluster.select(F.col("doc").alias("leader"), F.col("cluster").alias("leading"))
    placed = staged(placed, "placed").join(leading, "leader", "left")
    placed = placed.withColumn("is_stray", F.col("cluster") != F.coalesce("leading", "leader")).drop("leader", "leading")
    placed = staged(placed, "placed")
    stray = placed.where("is_stray").select("sig", *[F.col(c).alias(f"stray_{c}") for c in ("doc", "n", "need", "cluster")])
    across = (
        placed.join(staged(stray, "strays"), "sig")
        .where("cluster <> stray_cluster and (not is_stray or stray_doc < doc) and " + fit.format("", "stray_"))
        .groupBy(F.least("stray_doc", "doc").alias("a"), F.greatest("stray_doc", "doc").alias("b"), F.least("need", "stray_need").alias("least"))
        .count().where("count >= least").select("a", "b")
    )
    across = staged(across, "across")
    star = F.concat_ws("-", F.lit("s"), "a", F.pmod(F.xxhash64("b"), F.lit(64)).cast("string")).alias("task")
    stars = across.select(star, F.col("b").alias("doc")).unionByName(across.select(star, F.col("a").alias("doc")).distinct())
    return within.unionByName(stars)


def ngram_components(
    docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, frequent: int = FREQUENT, block: int = BLOCK
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Texts that are NULL, empty or white space have no shingle and are linked with nothing. A row
    without ``doc_id`` has a size but no component. Repeated ids give as many rows, in one component.
    ``percent`` is the least similarity, 60 to 100; sets are compared exactly whatever ``frequent`` and ``block`` are.
    """
    spark = docs.sparkSession
    whole = keyed(docs)
    measured = staged(whole.mapInArrow(_sizes_and_counts(k), "is_doc boolean, key long, n long"), "measured")
    often = (
        measured.where("not is_doc").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent)
        .orderBy(F.desc("n"), "key").limit(FREQUENT_MOST)
    )
    listed = np.sort(np.array([r[0] for r in often.select("key").collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(listed)
    indexed = whole.mapInArrow(_indexed(k, percent, shared), "sig long, doc long, n int, need int, whole boolean")
    repeated = indexed.groupBy("sig").agg(F.min("doc").alias("leader"), F.count("*").alias("met")).where("met > 1")
    repeated = staged(repeated.select("sig", "leader"), "repeated")
    matched = staged(indexed.join(repeated, "sig"), "matched")
    equal = staged(matched.where("whole and doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")), "equal")
    matched = staged(matched.where("not whole").drop("whole").join(equal.select(F.col("b").alias("doc")), "doc", "left_anti"), "matched")
    tasks = staged(_tasks(matched, percent, block), "tasks")
    needed = tasks.select(F.col("doc").alias("doc_id")).distinct()
    # no side of these joins has a bound, so they are merged at every size
    sets = staged(whole.join(needed.hint("merge"), "doc_id").mapInArrow(_sets(k), "doc long, tokens array<long>"), "sets")
    parts = max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = (
        tasks.join(sets.hint("merge"), "doc").repartition(parts, "task").sortWithinPartitions("task")
        .mapInArrow(_links(percent), "a long, b long")
    )
    groups = components(staged(links.unionByName(equal), "links")).withColumnRenamed("node", "doc_id")
    sizes = measured.where("is_doc").select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"))
    return sizes.join(groups, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, that with the smallest id; rows without an id stay."""
    found = ngram_components(docs, **options)
    goes = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti")
