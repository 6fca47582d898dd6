"""Mixing sources to target weights with fixed-length blocks, using DataFrame and SQL functions only.

1. The words of a source's documents form one stream, in a hashed order of doc_id, cut into blocks of
   `block_words` words.
2. Sources in code point order (null last) weigh 5, 2, 1, repeating. They share all words by weight; a target
   stops at `max_passes` times its source and the excess goes to the others by weight (water filling).
3. Output shards have a fixed number of slots. Each shard draws its source counts from a multinomial over the
   targets. Over all shards a source's count strays from its share by about the root of it; so that small sources too
   come near their targets, surplus slots are void and adjustment slots make up what is missing.
4. A source's slots are numbered across shards. Slot i reads block perm(i mod blocks), a swap-or-not permutation
   keyed by seed, source and pass, so a pass reads every block once before any comes again. Slots beyond
   `max_passes` passes are void.
5. Slots join blocks by (source, block index); adding up the words per document gives what the mix takes of it.

All randomness is hashed from `seed`, so reruns agree. Only per-source and per-shard sums are windowed whole;
a hot source's documents are summed in about sqrt(n) chunks.

Cases: null or empty texts have size 0 and nothing is taken of them; a null source is a source of its own;
repeated rows are documents of their own; sources without words get target 0; an empty table gives no rows. Rows of
one doc_id come in the order of their sizes and texts. Very long texts are cut by words, as short ones are. mix keeps
other columns, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import numbering
from . import common

BLOCK_WORDS = 32
SHARD_SLOTS = 1024
MAX_PASSES = 3
WEIGHTS = (5, 2, 1)
SEED = 7
_ROUNDS = 12
#: Parts into which the slots' range is cut to look up the source of a drawn one.
_CELLS = 4096
#: A few thousand counts become this many slots; their tasks are dealt by slots, not by bytes.
_SLOTS_PER_TASK = 200_000


class Plan(NamedTuple):
    sources: DataFrame  # sid, source, source_size, weight, target, blocks, slots
    documents: DataFrame  # doc_id, source, size, mark, sid, start
    slots: DataFrame  # shard, sid, slot, pass, block
    segments: DataFrame  # sid, start, block, at, n: words [at, at + n) of a document lie in the block


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash of the text, by which rows of one doc_id are told apart."""
    text = common.text_of()
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"), F.xxhash64(text).alias("mark"))


def source_targets(rows: DataFrame, block_words: int, max_passes: int) -> DataFrame:
    """One row a source. Numbers and running sums go over ranges of sources, so there may be as many as hosts."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    s = numbering.dense(s, "sid", "_last", "source").withColumn("sid", F.col("sid").cast("int"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("sid") % len(WEIGHTS) + 1).cast("long"))
    s = s.withColumns({"cap": F.col("source_size") * max_passes, "_ratio": F.col("source_size") * max_passes / F.col("weight"), "_all": F.lit(0)})
    # whole sums: a source is full if an even share by weight of what the fuller ones leave reaches its cap
    s = numbering.dense(s, "_turn", "_ratio", "sid")
    s = numbering.running(numbering.running(s, "_full", "cap", ["_all"], "_turn"), "_weighed", "weight", ["_all"], "_turn")
    s = common.stage(s, "mix-levels")
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(total) - F.col("_full")) / (F.lit(weights) - F.col("_weighed"))
    best = s.agg(F.max(level)).first()[0] or 0.0
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(best))))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.lit(float(block_words))).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(F.lit(0.0))
    return s.withColumn("slots", slots.cast("long")).select("sid", "source", "source_size", F.col("weight").cast("double").alias("weight"), "target", "blocks", "slots")


def shard_counts(sources: DataFrame, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """(shard, sid, c): how many of a shard's slots each source fills; and the number of slots.

    Every slot of a shard draws its source by its own uniform number, so a shard's counts are a multinomial's. Slots
    of a source beyond its share of all slots are void, and where draws fall short of it, one shard more a source,
    numbered below zero, makes them up: each source has exactly `slots` slots.
    """
    spark = sources.sparkSession
    some = common.stage(numbering.running(sources.filter("slots > 0").withColumn("_all", F.lit(0)), "lo", "slots", ["_all"], "sid"), "mix-shares")
    n_slots = some.agg(F.sum("slots")).first()[0] or 0
    if not n_slots:
        return spark.createDataFrame([], "shard long, sid int, c long"), 0
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(2**53))
    draws = spark.range(n_slots).select(F.expr(f"id div {shard_slots}").alias("shard"), F.floor(uniform * n_slots).alias("u"))
    cell = n_slots // _CELLS + 1
    cells = some.select("sid", "lo", (F.col("lo") + F.col("slots")).alias("hi"), F.explode(F.expr(f"sequence(lo div {cell}, (lo + slots - 1) div {cell})")).alias("cell"))
    drawn = draws.withColumn("cell", F.expr(f"u div {cell}")).join(cells, "cell").filter("u >= lo AND u < hi")
    counts = common.stage(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("c")), "mix-draws")
    got = counts.groupBy("sid").agg(F.sum("c").alias("got"))
    short = some.join(got, "sid", "left").select((-1 - F.col("sid")).cast("long").alias("shard"), "sid", (F.col("slots") - F.coalesce("got", F.lit(0))).alias("c"))
    return counts.union(short.filter("c > 0")), n_slots


def permuted(index: str, size: str, keys: str) -> F.Column:
    """A pseudorandom permutation of 0 .. size - 1: each round swaps an index with its mirror image, or not."""
    mirror = f"pmod(pmod(xxhash64({keys}, r), {size}) - i, {size})"
    step = f"if(xxhash64({keys}, r, greatest(i, {mirror})) < 0, {mirror}, i)"
    return F.expr(f"aggregate(sequence(1, {_ROUNDS}), {index}, (i, r) -> {step})")


def plan(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_passes: int = MAX_PASSES, seed: int = SEED) -> Plan:
    """rows: doc_id, source, size, mark, as sizes() returns them."""
    rows = common.stage(rows, "mix-sizes")
    sources = common.stage(source_targets(rows, block_words, max_passes), "mix-sources")
    s = sources.select("sid", F.col("source").alias("_source"))
    known = rows.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    documents = common.stage(common.running_start(known, "sid", "doc_id", "size", "start", rows.count(), ("mark",)), "mix-documents")
    first, last = f"start div {block_words}", f"(start + size - 1) div {block_words}"
    cut = documents.filter("size > 0").select("sid", "start", "size", F.explode(F.expr(f"sequence({first}, {last})")).alias("block"))
    segments = cut.select("sid", "start", "block", F.expr(f"greatest(block * {block_words} - start, 0)").alias("at"), F.expr(f"least((block + 1) * {block_words}, start + size) - greatest(block * {block_words}, start)").alias("n"))
    counts, n_slots = shard_counts(sources, shard_slots, seed)
    counts = common.running_start(counts, "sid", "shard", "c", "first", n_slots // shard_slots + 1)
    counts = counts.repartition(n_slots // _SLOTS_PER_TASK + 1, "shard", "sid")
    slots = counts.select("shard", "sid", F.explode(F.expr("sequence(first, first + c - 1)")).alias("slot")).join(sources.select("sid", "blocks", "slots"), "sid")
    slots = slots.filter((F.col("slot") < F.col("slots")) & (F.col("slot") < max_passes * F.col("blocks"))).withColumn("pass", F.expr("slot div blocks")).withColumn("at", F.expr("slot % blocks"))
    slots = slots.withColumn("block", permuted("at", "blocks", f"{seed}, sid, pass")).select("shard", "sid", "slot", "pass", "block")
    return Plan(sources, documents, slots, segments)


def taken(p: Plan) -> DataFrame:
    """(sid, start, taken, parts) for each document of which something is taken; parts: at, n, times."""
    times = p.slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    return p.segments.join(times, ["sid", "block"])


def per_document(p: Plan) -> DataFrame:
    """documents with source_size, target and taken."""
    words = taken(p).groupBy("sid", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    documents = p.documents.join(p.sources.select("sid", "source_size", "target"), "sid")
    got = F.when(F.col("size") > 0, F.col("taken"))
    return documents.join(words, ["sid", "start"], "left").withColumn("taken", F.coalesce(got, F.lit(0)).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: copy c of a document holds the words that are taken at least c times, in
    their order and with the white space between them; n_chars, if there is such a column, follows the text."""
    p = plan(sizes(docs), **options)
    parts = taken(p).groupBy("sid", "start").agg(F.array_sort(F.collect_list(F.struct("at", "n", "times"))).alias("_parts"))
    key = F.xxhash64("doc_id", "source", "mark").alias("_key")
    known = p.documents.filter("size > 0").join(parts, ["sid", "start"]).select(key, F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), "start", "_parts")
    # rows alike in doc_id, source and text are numbered; a lone row needs no number, and its text is shuffled once
    nth = Window.partitionBy("_key", "_doc_id", "_source", "_mark")
    known = common.stage(known.withColumns({"_alike": F.count(F.lit(1)).over(nth), "_nth": F.row_number().over(nth.orderBy("start"))}).drop("start"), "mix-parts")
    full = docs.select("doc_id", "source", common.text_of().alias("text"), F.struct(*docs.columns).alias("row")).withColumn("mark", F.xxhash64("text"))
    full = full.select(key, "*")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("mark") == F.col("_mark"))
    lone = full.join(known.filter("_alike = 1"), "_key").filter(same).select("text", "row", "_parts")
    numbered = full.join(known.filter("_alike > 1").select("_key").distinct(), "_key", "left_semi")
    numbered = numbered.withColumn("_row", F.row_number().over(Window.partitionBy("_key", "doc_id", "source", "mark").orderBy("text")))
    several = numbered.join(known.filter("_alike > 1"), "_key").filter(same & (F.col("_row") == F.col("_nth"))).select("text", "row", "_parts")
    out = lone.union(several).withColumn("_words", F.regexp_count("text", F.lit(common.WORD)).cast("long"))
    out = out.withColumn("_copy", F.explode(F.expr("sequence(1, array_max(transform(_parts, p -> p.times)))")))
    out = out.withColumn("_held", F.expr("filter(_parts, p -> p.times >= _copy)"))
    pieces = r"regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0)"
    whole = F.expr("aggregate(_held, 0L, (s, p) -> s + p.n) = _words")
    part = F.expr(f"ltrim(' \n\t\r', array_join(flatten(transform(array({pieces}), w -> flatten(transform(_held, p -> slice(w, int(p.at + 1), int(p.n)))))), ''))")
    out = out.withColumn("_text", F.when(whole, F.col("text")).otherwise(part)).withColumn("row", F.col("row").withField("text", F.col("_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType)))
    return out.select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return per_document(plan(sizes(docs))).select("doc_id", "size", "source_size", "target", "taken")
