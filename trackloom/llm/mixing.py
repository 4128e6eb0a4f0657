"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in a pseudorandom order, form one stream of words that is packed into blocks of a fixed
length.  The mix is a row of slots of one block each, dealt over output shards.  How many slots of a shard each
source gets is a multinomial draw, conditioned on the sources' totals: all slots of all sources are laid out once
and sent to shards by a keyed permutation of their numbers, so every shard's counts follow the weights by chance, with
the multinomial's variance, and the totals meet the targets exactly.  The slots of a source, numbered through the shards, are mapped to
its blocks by a permutation of the source's own, and blocks are joined by (source, block).

Neither a source nor a shard is ever gathered: streams are numbered within hashed buckets of bounded expected size
and the buckets' sums are added up.  Only the table of sources (one row each) is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.store import keep, summed_before

#: ``[^\x20\x09-\x0D]+``
WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SHARD_SLOTS, BUCKET_ROWS, SEED = 64, 4096, 4096, 11
#: Of the permutations' networks.
ROUNDS = 6


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def shares(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes split by the weights, dealt to sources in code-point
    order with null last; a source above ``most`` times its size stops there and the excess is split by weight among
    the others until none is above.

    The level at which weights are served is found directly: sources are ordered by the level at which each stops;
    the stopped ones are the longest prefix whose stops lie below the level that the rest would then get.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)).withColumn("stop", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("total", F.sum("source_size").over(everything) * float(share))
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("level", left / weight_left).withColumn("nth", F.row_number().over(by_stop))
    t = t.withColumn("level", F.min(F.when(F.col("stop") > F.col("level"), F.struct("nth", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("level"), F.col("most"))).alias("target"))


def _permuted(i: Column, n: Column, *seed: Column | int) -> Column:
    """A keyed pseudorandom permutation of 0 .. n-1, for n below 2^53.

    Numbers are pairs of a left part below a, the root of n, and a right part below b = n / a, rounded up.  Rounds of a
    Feistel network add to each part in turn a hash of seed, round and the other part.  That permutes 0 .. a b - 1; what
    falls on n or above (less than one in b) is permuted again until it is below.  A walk of the sixteen steps given to
    it always ends for n up to 256, as fewer than sixteen numbers lie above; beyond, a longer one has a chance below
    2^-64.
    """
    key = [F.lit(x) if isinstance(x, int) else x for x in seed]
    a = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("long")
    b = F.ceil(n / a).cast("long")

    def turned(pair: Column, k: Column) -> Column:
        left, right = pair["l"], pair["r"]
        even = k % 2 == 0
        return F.struct(
            F.when(even, (left + F.pmod(F.xxhash64(*key, k, right), a)) % a).otherwise(left).alias("l"),
            F.when(even, right).otherwise((right + F.pmod(F.xxhash64(*key, k, left), b)) % b).alias("r"),
        )

    def once(x: Column) -> Column:
        start = F.struct((x % a).alias("l"), ((x - x % a) / a).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turned, lambda pair: pair["r"] * a + pair["l"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(16)), once(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))


def _numbered(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int) -> DataFrame:
    """The sources: sid, source, source_size, n_docs, target, and how their slots are laid out."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    t = shares(sources, weights, share, most).join(sources.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    t = t.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    whole = F.floor(F.col("target") + 0.5).cast("long")
    t = t.withColumn("full", F.floor(F.col("source_size") / block)).withColumn("turn", F.ceil(F.col("source_size") / block))
    t = t.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)).withColumn("rest", whole - F.col("passes") * F.col("source_size"))
    t = t.withColumn("n_slots", F.col("passes") * F.col("turn") + F.ceil(F.col("rest") / block))
    t = t.withColumn("first_slot", F.sum("n_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_slots"))
    return t.withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy()))


def _exploded(df: DataFrame, n: str, name: str, by: int = 4096) -> DataFrame:
    """Each row once for every 0 <= ``name`` < n, made by many tasks however large n is."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't coalesced: rows are few before and many after
    spread = df.where(F.col(n) > 0).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / by)))).repartition(tasks, "sid", "part")
    to = F.least(F.col("part") * by + by, F.col(n)) - 1
    return spread.withColumn(name, F.explode(F.sequence(F.col("part") * by, to))).drop("part")


def draws(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(sid, shard, n, first): how many slots of each output shard each source gets, and its number of the first."""
    slots = _exploded(sources.select("sid", "n_slots", "first_slot", "all_slots"), "n_slots", "j")
    dealt = _permuted(F.col("first_slot") + F.col("j"), F.col("all_slots"), seed)
    counts = slots.select("sid", F.floor(dealt / shard_slots).alias("shard")).groupBy("sid", "shard").agg(F.count("*").alias("n"))
    return summed_before(keep(counts, "draws"), ["sid"], "shard", "n", "first")


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """(sid, block, take, shard, place): the block that each slot holds, and how many of its words."""
    drawn = draws(sources, shard_slots, seed).join(sources.select("sid", "full", "turn", "passes", "rest"), "sid")
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = drawn.repartition(tasks, "sid", "shard").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    each = each.withColumn("j", F.col("first") + F.col("k")).withColumn("turn_no", F.floor(F.col("j") / F.col("turn"))).withColumn("i", F.col("j") % F.col("turn"))
    index = F.when(F.col("i") < F.col("full"), _permuted(F.col("i"), F.greatest(F.col("full"), F.lit(1)), F.col("sid"), F.col("turn_no"), seed)).otherwise(F.col("full"))
    take = F.when(F.col("turn_no") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("i") * block))
    return each.select("sid", index.cast("long").alias("block"), take.cast("long").alias("take"), "shard", F.col("k").alias("place"))


def blocks(placed: DataFrame, block: int) -> DataFrame:
    """(sid, block, row, lo, hi, skip): the words of documents in each block of their source's stream."""
    each = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    hi = F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block))
    return each.select("sid", "block", "row", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).cast("long").alias("skip"))


class Mix:
    """A mix of ``docs`` (text, source, doc_id, ...); see the module.

    The sources' sizes are counted in words (null text: none), a null source is a source of its own, and documents
    without words are in no block.  Every source's words in the mix are its target, rounded.  A document's words are
    taken at most ``most`` times each, for ``most`` a whole number.  Where a document stands in its source's stream is
    decided by a hash of doc_id and text, so reruns agree; rows equal in doc_id, text and source may change places.
    No rows give no mix.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> None:
        mark = F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])
        made = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), mark.alias("mark"))
        self.sized = keep(made.withColumn("row", F.monotonically_increasing_id()), "sizes")
        self.sources = keep(_numbered(self.sized, weights, share, most, block), "sources")
        named = self.sources.select("sid", F.col("source").alias("s"), "source_size", "target", "n_docs")
        rows = self.sized.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        heavy = keep(self.sized.groupBy("mark").agg(F.count("*").alias("copies")).where(F.col("copies") > BUCKET_ROWS), "repeated")
        rows = rows.join(heavy, "mark", "left").withColumn("salt", F.when(F.col("copies").isNotNull(), F.col("row")).otherwise(0)).drop("copies")
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("mark", "salt", F.lit(seed)), F.ceil(F.col("n_docs") / BUCKET_ROWS))).drop("salt")
        sums = keep(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("held")), "buckets")
        starts = summed_before(sums, ["sid"], "bucket", "held", "start").drop("held")
        within = Window.partitionBy("sid", "bucket").orderBy("mark", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
        inner = rows.withColumn("inner", F.sum("size").over(within) - F.col("size"))
        placed = inner.join(starts, ["sid", "bucket"])
        self.placed = keep(placed.select("row", "doc_id", "mark", "sid", "size", "source_size", "target", (F.col("start") + F.col("inner")).alias("at")), "places")
        self.slots, self.blocks = slots(self.sources, block, shard_slots, seed), blocks(self.placed, block)

    def pieces(self) -> DataFrame:
        """(sid, block, take, shard, place, row, lo, hi, skip): what each slot of the mix takes of which document."""
        # Spark estimates both sides as what they are exploded from, and would broadcast one of them whole
        both = self.slots.hint("merge").join(self.blocks.hint("merge"), ["sid", "block"]).where("lo < take")
        return both.withColumn("hi", F.least("hi", "take"))

    def taken(self) -> DataFrame:
        """Every row of the documents: doc_id, mark, size, source_size, target, taken (words, repeats counted) and
        starts (how often the mix takes its first word)."""
        words = self.pieces().groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.count_if(F.col("skip") == 0).alias("starts"))
        zero = F.lit(0).cast("long")
        return self.placed.join(words, "row", "left").select("doc_id", "mark", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("starts", zero).alias("starts"))

    def packed(self, docs: DataFrame) -> DataFrame:
        """(shard, place, source, text): the blocks of the mix themselves, words joined by single spaces."""
        words = docs.select(docs["doc_id"].alias("d"), F.xxhash64(F.lit(SEED), docs["doc_id"], docs["text"]).alias("m"), F.regexp_extract_all(docs["text"], F.lit(f"({WORDS})"), F.lit(1)).alias("words")).dropDuplicates(["d", "m"])
        rows = self.pieces().join(self.placed.select("row", "doc_id", "mark"), "row")
        text = F.array_join(F.slice("words", (F.col("skip") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
        each = rows.join(words, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("shard", "place", "sid", "lo", text.alias("part"))
        whole = each.groupBy("sid", "shard", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", "part"))), lambda x: x["part"]), " ").alias("text"))
        return whole.join(self.sources.select("sid", "source"), "sid").select("shard", "place", "source", "text")


def mixed_documents(docs: DataFrame, block: int = 2048, seed: int = SEED) -> DataFrame:
    """Whole rows of ``docs``, each as often as the mix takes its first word: not at all, once or twice.

    Blocks are long here, so that a source's rows hold about its target of words.  Rows equal in doc_id, text and
    source all come as often as the most frequent of them.
    """
    counts = Mix(docs, block=block, seed=seed).taken().where("starts > 0").groupBy(F.col("doc_id").alias("mix_doc"), F.col("mark").alias("mix_mark")).agg(F.max("starts").alias("mix_copies"))
    columns = docs.columns
    rows = docs.select(F.struct(*columns).alias("r")).withColumn("mix_id", F.col("r.doc_id")).withColumn("mix_own", F.xxhash64(F.lit(seed), F.col("r.doc_id"), F.col("r.text")))
    found = rows.join(counts, F.col("mix_id").eqNullSafe(F.col("mix_doc")) & (F.col("mix_own") == F.col("mix_mark")))
    return found.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("r.*")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, starts) of every row of ``docs``; null and blank texts have size 0 and nothing
    is taken of them.  Repeated rows give a row each, a null source is one of its own, and no rows give no rows."""
    return Mix(docs).taken().drop("mark")
