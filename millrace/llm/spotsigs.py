"""Document fingerprints from SpotSigs: chains of content words after common-word anchors.

Every anchor gives one signature, the anchor and the next ``CHAIN`` content words among the ``REACH`` words
after it. Where no common word is among the last ``REACH`` words, as in tables, codes and at the start, any word is
an anchor. A text without any chain has one signature, of all its words. The fingerprint is a digest of the
sorted set of signatures; likeness is the Jaccard similarity of the sets, pruned where their lengths
alone rule it out. Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.storage import staged

CHAIN = 2
REACH = 8
BLOCK = 1024  # ids of a block of neighbours
# fixed values: common words of four languages that start a chain and are in none
ANCHORS = tuple(
    "the of and to in a is that it for on with as was be by are this at from or an which not "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "le la les du et un une que est pour qui dans ce il au sur par avec "
    "el los las y se del por con no para su lo como".split()
)  # end of fixed values


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def contents(words_column: str) -> Column:
    """The words, NULL for each common one: the only look at the list of common words."""
    return F.transform(words_column, lambda x: F.when(~x.isin(*ANCHORS), x))


def commons(contents_column: str) -> Column:
    return F.transform(contents_column, lambda x: x.isNull())


def signatures(words_column: str, contents_column: str, commons_column: str) -> Column:
    """Sorted distinct signatures of an array of words; the columns must be read from a row, not computed in place.

    Most chains are the next two words. A hash over a word and an array is the hash over the word and the array's elements.
    """
    w, content, common = F.col(words_column), F.col(contents_column), F.col(commons_column)

    def spot(x: Column, i: Column) -> Column:
        near = F.array_contains(F.slice(common, F.greatest(F.lit(1), i - REACH + 2), F.least(F.lit(REACH), i + 1)), True)
        following = [F.get(content, i + j) for j in range(1, CHAIN + 1)]
        chain = F.slice(F.array_compact(F.slice(content, i + 2, REACH)), 1, CHAIN)
        further = F.transform(F.array(chain), lambda c: F.when(F.size(c) > 0, F.xxhash64(x, c)))[0]
        return F.when(F.get(common, i) | ~near, F.when(reduce(and_, [c.isNotNull() for c in following]), F.xxhash64(x, *following)).otherwise(further))

    whole = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(w)))
    found = F.array_compact(F.transform(w, spot))
    return F.sort_array(F.array_distinct(F.when(F.size(found) > 0, found).otherwise(whole)))


def fingerprint(signatures_column: str) -> Column:
    """32 hex digits; equal sets have equal ones."""
    parts = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(i), F.col(signatures_column)))), 16, "0") for i in (1, 2)]
    return F.concat(*parts)


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets, 0 below ``least``.

    The shorter set's share of the longer one is an upper bound, so pairs of too unlike lengths are not compared.
    Two empty sets are equal.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    value = shared / (small + large - shared)
    return (
        F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < least * large), F.lit(0.0))
        .otherwise(F.when(value >= least, value).otherwise(0.0))
    )


def with_signatures(df: DataFrame, texts: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Add a signature column for each text column named in ``texts`` (new name by text column)."""
    split = df.select("*", *[words(F.col(text)).alias(f"__w_{name}") for text, name in texts.items()]).drop(*drop)
    for step, before, kind in ((contents, "w", "c"), (commons, "c", "a")):
        split = split.select("*", *[step(f"__{before}_{name}").alias(f"__{kind}_{name}") for name in texts.values()])
    made = [f"__{kind}_{name}" for kind in "wca" for name in texts.values()]
    return split.select("*", *[signatures(*[f"__{kind}_{name}" for kind in "wca"]).alias(name) for name in texts.values()]).drop(*made)


def _neighbours(docs: DataFrame) -> DataFrame:
    """Rows by blocks of ids, each block with a copy (``extra``) of the row that follows its last in descending order of ids.

    After the last row comes the first. Rows without id have no place in the order and lie apart, dealt by text.
    """
    apart = F.lit(-1) - F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    block = F.when(F.col("doc_id").isNull(), F.concat(F.lit("-"), apart.cast("string"))).otherwise(
        F.floor(F.col("doc_id") / BLOCK).cast("string")
    )
    placed = docs.select("doc_id", "text", block.alias("block"), F.lit(False).alias("extra"))
    tops = (
        docs.where("doc_id is not null").groupBy(F.floor(F.col("doc_id") / BLOCK).alias("number"))
        .agg(F.max("doc_id").alias("doc_id"))
    )
    # two numbers for each block; the block before the first is the last
    order = Window.orderBy(F.desc("number"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = staged(
        tops.select("doc_id", F.coalesce(F.lag("number").over(order), F.min("number").over(everything)).cast("string").alias("block")), "tops"
    )
    extras = docs.select("doc_id", "text").join(tops, "doc_id").select("doc_id", "text", "block", F.lit(True).alias("extra"))
    return placed.unionByName(extras)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. In the edited text the
    last third (rounded down) of the code points gives way to as many first ones of the next document in
    descending order of ids. NULL text is empty. Rows with one id follow each other by text hash; a row
    without id has an empty next document.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("block").orderBy("extra", F.desc("doc_id"), "tie")
    ordered = _neighbours(rows).withColumn("tie", F.xxhash64("text"))
    following = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.coalesce(F.lead("text").over(order), F.lit("")))
    ordered = ordered.withColumn("next_text", following)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    ordered = ordered.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    signed = with_signatures(ordered.drop("next_text"), {"text": "own", "edited": "changed"}, drop=["text", "edited"])
    empty = F.array().cast("array<bigint>")
    after = F.when(F.col("doc_id").isNull(), empty).otherwise(F.coalesce(F.lead("own").over(order), empty))
    return signed.withColumn("after", after).where("not extra").select(
        "doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "after").alias("near_next"),
    )


def near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Links (a, b, likeness) of documents with the smallest document they share a signature with, ``least`` alike or more.

    Sets are partitioned by length so that alike sets lie in one partition or in neighbouring ones; a set is indexed by
    the smallest signatures of which two alike sets must share one. Every document is compared with one other
    for each such signature, never all with all.
    """
    step = F.lit(1.0 / least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    sets = staged(with_signatures(rows, {"text": "sigs"}, drop=["text"]).where(F.size("sigs") > 0), "sigs")
    length = F.floor(F.log(F.size("sigs").cast("double")) / F.log(step)).cast("int")
    kept = F.size("sigs") - F.ceil(F.size("sigs") * F.lit(least) - 1e-9).cast("int") + 1
    indexed = sets.select("doc_id", F.explode(F.array(length, length + 1)).alias("part"), F.slice("sigs", F.lit(1), kept).alias("some"))
    indexed = indexed.select("doc_id", "part", F.explode("some").alias("sig"))
    first = staged(indexed.groupBy("part", "sig").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").drop("z"), "first")
    pairs = staged(indexed.join(first, ["part", "sig"]).where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("sigs").alias(f"{x}_sigs")) for x in "ab")
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", likeness("a_sigs", "b_sigs", least).alias("likeness"))
    return compared.where("likeness > 0")
