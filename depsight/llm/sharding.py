"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets by seeded hashes, as many buckets as keep each near BUCKET_BYTES
and BUCKET_ROWS. Pass two brings each bucket together, permutes it by Fisher-Yates with seeded draws and writes it;
the buckets lie end to end, and shards are equal runs of that order, so their row counts differ by at most one. Only
DataFrame and SQL functions run.

A record's place hangs on the seed and the records alone, not on files or partitions: the hash covers all columns, and
the copies of a repeated row are numbered, so that any number of equal rows spreads evenly. Which copy has which number
does not matter, as they are equal.

Defined results: null text has size 16 and the checksum of no bytes; null ids and repeated rows are rows like any
other; an empty table gives an empty result; other columns stay in ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import free, spool

BUCKET_ROWS, BUCKET_BYTES, SUPER = 4096, 16 << 20, 4096


def _permutation(seed: int) -> tuple[str, str, str]:
    """Fisher-Yates over 0..n-1 for each (bucket, n): for i = n-1 .. 1 swap places i and draws[i-1], 0 <= draw <= i.

    Arrays are values here, so a swap copies; the places lie in blocks of ``b``, about the root of n, and a swap
    copies two blocks only.
    """
    draws = f"transform(sequence(1, n), i -> int(pmod(xxhash64({seed}L, bucket, i), i + 1)))"
    blocks = "transform(sequence(0, (n - 1) div b), p -> sequence(p * b, least((p + 1) * b, n) - 1))"
    inner = "transform(blk, (x, q) -> CASE WHEN p * b + q = s.i THEN get(get(a, int(s.j div b)), int(s.j % b)) WHEN p * b + q = s.j THEN get(get(a, int(s.i div b)), int(s.i % b)) ELSE x END)"
    swap = f"transform(a, (blk, p) -> CASE WHEN p = s.i div b OR p = s.j div b THEN {inner} ELSE blk END)"
    steps = "transform(filter(sequence(n - 1, 0, -1), i -> i > 0), i -> named_struct('i', i, 'j', get(draws, i - 1)))"
    return "cast(greatest(1, ceil(sqrt(n))) as int)", draws, f"flatten(aggregate({steps}, {blocks}, (a, s) -> {swap}))"


def _numbered(df: DataFrame, seed: int) -> DataFrame:
    """row (a struct of all columns), tie (a hash of them) and copy: 0, 1, ... among equal rows."""
    hashed = [F.to_json(F.col(f"`{c}`")) if isinstance(df.schema[c].dataType, MapType) else F.col(f"`{c}`") for c in df.columns]
    keyed = df.select(F.xxhash64(F.lit(seed), *hashed).alias("tie"), F.struct("*").alias("row"))
    again = spool(keyed.groupBy("tie").count().where("count > 1").select("tie"))
    if not again.limit(1).count():
        return keyed.withColumn("copy", F.lit(0).cast("long"))
    kept = spool(keyed.withColumn("at", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    few = kept.select("tie", "at", F.shiftright("at", 33).alias("part")).join(again, "tie", "left_semi")
    before = Window.partitionBy("tie").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = few.groupBy("tie", "part").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("tie", "part", "base")
    inside = few.withColumn("k", F.row_number().over(Window.partitionBy("tie", "part").orderBy("at")) - 1)
    copies = inside.join(parts, ["tie", "part"]).select("at", (F.col("base") + F.col("k")).alias("copy"))
    return kept.join(copies, "at", "left").select("tie", "row", F.coalesce("copy", F.lit(0)).alias("copy"))


def shuffled(df: DataFrame, seed: int = 17, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """All rows of df as struct ``row`` with ``pos``, their place in a seeded random order, as the written buckets hold
    them; and their number."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, kind in df.dtypes if kind in ("string", "binary")]
    total, size = df.agg(F.count("*"), F.sum(sum(sizes, F.lit(8 * len(df.columns)).cast("long")))).first()
    buckets = max(1, -(-total // bucket_rows), -(-(size or 0) // bucket_bytes))
    named = _numbered(df, seed)
    scattered = named.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "tie", "copy"), F.lit(buckets)).cast("int"))

    counts = spool(scattered.groupBy("bucket").agg(F.count("*").cast("int").alias("n")).withColumn("super", F.floor(F.col("bucket") / SUPER)))
    before = Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SUPER buckets
    supers = counts.groupBy("super").agg(F.sum("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))
    inside = Window.partitionBy("super").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    block, draws, fold = _permutation(seed)
    perms = spool(
        counts.join(supers, "super")
        .withColumn("offset", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .repartition(max(1, -(-buckets // 4)), "bucket")  # a fixed number: these small rows cost much time each
        .withColumns({"b": F.expr(block), "draws": F.expr(draws)})
        .select("bucket", "offset", F.expr(fold).alias("perm"))
    )
    ranked = scattered.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 2), "tie", "copy"), "tie", "copy")) - 1)
    placed = ranked.join(perms, "bucket").select("row", (F.col("offset") + F.get("perm", F.col("r"))).alias("pos"))
    written = spool(placed.sortWithinPartitions("pos"), "buckets")
    free(counts, perms)
    return written, total


def place(pos: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place in the order: equal runs, the longer ones first."""
    q, longer = divmod(total, shards)
    split = longer * (q + 1)
    head, tail = pos < split, F.greatest(pos - F.lit(split), F.lit(0))
    shard = F.when(head, F.floor(pos / (q + 1))).otherwise(longer + F.floor(tail / max(q, 1)))
    slot = F.when(head, pos % (q + 1)).otherwise(tail % max(q, 1))
    return shard.cast("int"), slot.cast("long")


def assign(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """row (the input's columns), shard, slot: law `rows`."""
    mixed, total = shuffled(docs, seed, bucket_rows)
    shard, slot = place(F.col("pos"), total, shards)
    return mixed.select("row", shard.alias("shard"), slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17) -> str:
    """Parquet under path/shard=N with the input's columns; the rows of a file lie in slot order. Returns the folder's
    column, which is another name where the input has a column of this one."""
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("shard", "slot"):
        while name in taken:
            name += "_"
        names.append(name)
    shard, slot = names
    out = assign(docs, shards, seed).select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)
    return shard


def digest(assigned: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return assigned.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
