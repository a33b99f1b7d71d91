"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits; two documents link when their fingerprints differ in at most two. Cut in two segments, a
linked pair either differs in at most one bit of the low segment, or in two of it and then in none of the high one.
So the low segment is indexed with one bit deleted, for every bit, and the high one whole: 33 keys of a fingerprint,
of which a linked pair shares one; an equality join finds the pair and the whole fingerprints are compared.
Documents with one fingerprint are one node.

A key that more than `hot` fingerprints share is refined before it is joined: a further bit is deleted (of the other
segment; two where the shared segment is equal) and everything else must be equal, so that a refined key has at most
four fingerprints. Index, equality join and verification are the same at both steps and exact; the rows grow with the
fingerprints, not with their pairs.

Defined results: words are runs of non-white-space after lower-casing A-Z; a text with fewer than
`width` words is one shingle, one without words (or null) has fingerprint zero and links like any
other. Null keys come after all others. Repeated rows give repeated result rows. Only key and
text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import map_arrow, stored, texts_of, unused
from panelwright.llm.components import connected_components

SEED = 42
#: Keys that more fingerprints than this share are refined.
HOT = 256
SEGMENT_BITS = 32
LOW = (1 << SEGMENT_BITS) - 1
#: The place of keys that hold the whole high segment; places before it are deleted bits of the low one.
WHOLE = 32


def fingerprint(text: str, width: int = 3) -> int:
    """The bits set in more than half of the shingles' hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    all_hashes = hashes.astype(">u8")
    for i in range(0, len(all_hashes), 1 << 16):
        part = all_hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, others: tuple[str, ...] = ()) -> DataFrame:
    """(key, others, fp bigint): the signed 64-bit form of each document's fingerprint."""

    def rows(batch):
        found = np.array([fingerprint(t, width) for t in texts_of(batch, text)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, *others)], pa.array(found, pa.int64())], names=[key, *others, "fp"])

    docs = docs.select(key, text, *others)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (key, *others))
    return map_arrow(docs, rows, f"{kinds}fp bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _index(fp: Column) -> Column:
    """array<long> of keys: place << 32 | what has to be equal. Places are the deleted bit of the low segment, then WHOLE."""
    low = [fp.bitwiseAND(F.lit(LOW & ~(1 << bit))).bitwiseOR(F.lit(bit << SEGMENT_BITS)) for bit in range(SEGMENT_BITS)]
    return F.array(*low, F.shiftrightunsigned(fp, SEGMENT_BITS).bitwiseOR(F.lit(WHOLE << SEGMENT_BITS)))


def _place(a: Column, b: Column) -> Column:
    """The place at which a linked pair is reported, the only one or the first of those that both fingerprints share."""
    low = a.bitwiseXOR(b).bitwiseAND(F.lit(LOW))
    return F.when(low == 0, 0).when(F.bit_count(low) == 1, F.bit_count(low - 1)).otherwise(WHOLE)


def _further(spark) -> DataFrame:
    """(place, bits): the bits that refining a key of a place deletes, as one mask; 2,016 rows."""
    high = range(SEGMENT_BITS, 2 * SEGMENT_BITS)
    rows = [(place, 1 << place | 1 << bit) for place in range(SEGMENT_BITS) for bit in high]
    rows += [(0, 1 << a | 1 << b) for a in high for b in high if a < b]
    rows += [(WHOLE, 1 << a | 1 << b) for a in range(SEGMENT_BITS) for b in range(a)]
    return spark.createDataFrame([(place, _signed(bits)) for place, bits in rows], "place int, bits bigint")


def _linked(members: DataFrame, on: list[str]) -> DataFrame:
    """(src, dst) of members (fp, on) that share the key on and differ in at most two bits."""
    left, right = members.withColumnRenamed("fp", "src"), members.withColumnRenamed("fp", "dst")
    return left.join(right, on).filter((F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= 2))


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(src, dst): every pair of fingerprints that differ in at most two bits. nodes: (fp), each once."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.repartition(parts, "fp")  # 33 rows come of each: a few input files would be too few tasks
    index = spread.select("fp", F.explode(_index(F.col("fp"))).alias("key"))
    sizes = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
    # Merged at every size: the shared keys grow with the documents, a broadcast of them isn't bounded.
    shared = stored(index.join(sizes.hint("merge"), "key").withColumn("place", F.shiftright("key", SEGMENT_BITS).cast("int")), "simhash-index")
    few = shared.filter(F.col("n") <= hot).select("fp", "key", "place")
    pairs = _linked(few, ["key", "place"]).filter(F.col("place") == _place(F.col("src"), F.col("dst"))).select("src", "dst")
    many = shared.filter(F.col("n") > hot).join(F.broadcast(_further(spark)), "place")
    refined = many.select("fp", "bits", F.col("fp").bitwiseAND(F.bitwise_not("bits")).alias("rest")).distinct()
    again = refined.groupBy("bits", "rest").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # at most four
    found = again.select("bits", "rest", F.explode("fps").alias("fp"))
    return pairs.unionByName(_linked(found, ["bits", "rest"]).select("src", "dst")).distinct()


def _grouped(marked: DataFrame, hot: int) -> DataFrame:
    """(fp, first): for each fingerprint the smallest `order` of its component. marked: (fp, order)."""
    nodes = stored(marked.groupBy("fp").agg(F.min("order").alias("least")), "simhash-nodes")
    labels = connected_components(links(nodes.select("fp"), hot))
    merged = stored(labels.join(nodes, labels.node == nodes.fp).groupBy("component").agg(F.min("least").alias("first")), "simhash-firsts")
    moved = labels.join(merged, "component").select(F.col("node").alias("fp"), "first")
    # Stored, so that the join with the documents has a plain exchange on each side and one print's copies can be split.
    return stored(nodes.join(moved, "fp", "left").select("fp", F.coalesce("first", "least").alias("first")), "simhash-groups")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, hot: int = HOT) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key that links lead to, itself included."""
    marked = stored(fingerprints(docs, key, text, width), "simhash-documents")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"))
    by_print = _grouped(marked.select("fp", order.alias("order")), hot)
    return marked.join(by_print, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.key").alias("component_id"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, hot: int = HOT) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each component: that of the smallest key, then text hash."""
    marked = stored(fingerprints(docs.select(key, text, F.xxhash64(text).alias("hash")), key, text, width, ("hash",)), "simhash-documents")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "hash")
    return one_of_each(docs, _grouped(marked.select("fp", order.alias("order")), hot).select("first.key", "first.hash"), key, text)


def one_of_each(docs: DataFrame, winners: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs, one each, whose key and text hash are a row of winners (key, hash)."""
    own = unused("hash", docs.columns)
    marked = docs.withColumn(own, F.xxhash64(F.col(f"`{text}`")))
    winners = winners.distinct().select(F.col("key").alias(f"{own}_key"), F.col("hash").alias(f"{own}_won"))
    kept = marked.join(winners.hint("merge"), (F.col(own) == F.col(f"{own}_won")) & F.col(f"`{key}`").eqNullSafe(F.col(f"{own}_key")), "left_semi")
    return kept.dropDuplicates([key, own]).drop(own)
