"""A two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters records by seeded hashes: the law ``key`` gives each its shard (the highest of one hash of the
key per shard, so that one more shard only takes records into itself), and a hash of key and text spreads each
shard over buckets of bounded expected rows and bytes; rows that repeat more often than a bucket's worth are spread
by their place in the input as well.  Pass two shuffles each bucket in memory by Fisher and Yates'
method, with hashes of (seed, shard, bucket, step) as the random draws, and lays the buckets of a shard end to end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.store import keep, summed_before

SHARDS, SEED, LAW = 24, 5, "key"
#: Expected rows and bytes of a bucket; a bucket is held in memory by one task.
BUCKET_ROWS, BUCKET_BYTES = 512, 16 << 20
#: Rows of a table that is broadcast; a longer one is joined by a shuffle.
MOST_BROADCAST = 100_000


def _scores(key: Column, shards: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.xxhash64(F.lit(seed), k, key).alias("score"), k.alias("shard")))


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of a key; from n to n + 1 shards, a key stays or goes to the new one.  Null keys share a shard."""
    return F.array_max(_scores(key, shards, seed))["shard"]


def fisher_yates(n: Column, *seed: Column) -> Column:
    """A shuffle of 0 .. n-1: step i puts i at a drawn place j <= i, and what stood there at the end."""

    def step(done: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seed, i), i + 1).cast("int")
        swapped = F.concat(F.slice(done, F.lit(1), j), F.array(i), F.slice(done, j + 2, F.greatest(i - j - 1, F.lit(0))), F.array(F.get(done, j)))
        return F.when(j == i, F.concat(done, F.array(i))).otherwise(swapped)

    none = F.array().cast("array<int>")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), none, step)).otherwise(none)


def shuffled(records: DataFrame, key: str, mark: str, size: str, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``records`` as a struct ``r``, with shard, grown_shard and slot (gapless from 0 in each shard).

    ``mark`` is a long that tells rows with equal keys apart, ``size`` their bytes; rows equal in key and mark may
    change places.  No rows give no rows.
    """
    light = records.select(F.col(key).alias("key"), F.col(mark).alias("mark"), F.col(size).alias("size"))
    rows, total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, -(-rows // (shards * bucket_rows)), -(-total // (shards * bucket_bytes)))
    heavy = light.groupBy("key", "mark").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > bucket_rows) | (F.col("bytes") > bucket_bytes) & (F.col("n") > 1))
    heavy = keep(heavy.select(F.col("key").alias("heavy_key"), F.col("mark").alias("heavy_mark"), F.lit(1).alias("heavy")), "repeated")
    repeated = heavy.count()
    numbered = records.select(F.struct(*records.columns).alias("r"), (F.monotonically_increasing_id() if repeated else F.lit(0).cast("long")).alias("nth"))
    if repeated:  # written, so that a row has one number in both scans and in retried tasks
        numbered = keep(numbered, "numbered")

    def dealt(df: DataFrame, key: Column, mark: Column) -> DataFrame:
        """The shard and bucket of rows with a number nth."""
        df = df.withColumn("shard", shard_of(key, shards, seed).cast("int")).withColumn("salt", F.lit(0).cast("long"))
        if repeated:
            few = F.broadcast(heavy) if repeated <= MOST_BROADCAST else heavy
            df = df.join(few, key.eqNullSafe(F.col("heavy_key")) & mark.eqNullSafe(F.col("heavy_mark")), "left").withColumn("salt", F.when(F.col("heavy") == 1, F.col("nth") + 1).otherwise(0)).drop("heavy", "heavy_key", "heavy_mark")
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), mark, key, F.col("salt")), F.lit(buckets)).cast("int"))

    r = dealt(numbered, F.col("r")[key], F.col("r")[mark])
    light = numbered.select(F.col("r")[key].alias("key"), F.col("r")[mark].alias("mark"), "nth")
    order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    own = F.xxhash64(F.lit(seed), F.col("r")[key], F.col("r")[mark])
    grown = shard_of(F.col("r")[key], shards + 1, seed)
    held = r.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct(own.alias("o"), grown.alias("grown"), "r")), order).alias("held")).withColumn("n", F.size("held"))
    counts = keep(dealt(light, F.col("key"), F.col("mark")).groupBy("shard", "bucket").agg(F.count("*").alias("rows")), "counts")
    first = summed_before(counts, ["shard"], "bucket", "rows", "first").drop("rows")
    turned = held.withColumn("turn", fisher_yates(F.col("n"), F.lit(seed), F.col("shard"), F.col("bucket"))).join(first, ["shard", "bucket"])
    each = turned.select("shard", "first", F.posexplode(F.transform("turn", lambda i: F.get(F.col("held"), i))).alias("pos", "x"))
    return each.select(F.col("x.r").alias("r"), F.col("shard").cast("int").alias("shard"), F.col("x.grown").cast("int").alias("grown_shard"), (F.col("first") + F.col("pos")).cast("long").alias("slot"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) and eight for the key."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; a null text is empty, null ids share a shard,
    repeated rows have a slot each, and no rows give no rows."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    light = keep(docs.select("doc_id", text_size(docs["text"]).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "records")
    out = shuffled(light, "doc_id", "text_crc32", "size", shards)
    return out.select("r.doc_id", "r.size", "r.text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs`` and the columns shard and slot (with underscores behind a name that ``docs`` has)."""
    names = []
    for c in ("shard", "slot", "shard_mark", "shard_size"):
        while c in docs.columns:
            c += "_"
        names.append(c)
    shard, slot, mark, size = names
    marked = docs.withColumn(mark, F.xxhash64("text")).withColumn(size, text_size(docs["text"]))
    out = shuffled(marked, "doc_id", mark, size, shards)
    return out.select(*[F.col("r")[c].alias(c) for c in docs.columns], F.col("shard").alias(shard), F.col("slot").alias(slot))
