"""Operator 8 for the similarity of shingle sets: deletion-variant signatures over minima instead of bits.

Two documents link when their sets of `width`-word shingles have a similarity of 0.8 or more; groups are what links
lead to. Two such documents' SimHash fingerprints may differ in some ten of 64 bits, too many for segments of bits. So
operator 8 itself (fingerprints of 64 bits over the shingles, its index of deleted bits, its join within two bits) gives the first
candidates, and for those that it can't see there is a second fingerprint of SEGMENTS x SYMBOLS minima of the shingles' hashes, each of which two documents share with a
chance equal to their similarity, and the second index is made as operator 8's: the fingerprint is cut in segments, each segment is
indexed with one symbol deleted, for every symbol; an equality join gives candidates, and every link is verified on
the whole shingle sets. Of pairs with exactly 0.8 some 2 in 100,000 share no key, of more similar ones fewer; no other
pair is missed. Documents with one set are one node.

The members of a key are first compared with its least and greatest node, a number of pairs that grows with the
members. What these links join needs no other comparison; of a key whose members are still in different groups, all
pairs of different groups are compared, but for those whose sizes alone keep them below 0.8. Keys that more than `hot`
nodes share (a passage or a large family of copies) are compared in blocks, a pair of blocks a task, which gives out no
more links than join groups. Blocks follow groups and sizes, so the comparisons grow with the products of the groups that
are left in such a family, but for those that sizes rule out; the rows don't.

Defined results: words and short texts as in simhash; texts without words (or null) are one group. Null keys
come after all others. Only key and text are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import chunks, map_arrow, stored, texts_of
from panelwright.llm.components import connected_components
from panelwright.llm.simhash import links as linked_prints
from panelwright.llm.simhash import majority, one_of_each
from panelwright.operators.windows import running

SEED = 42
WIDTH = 5
SEGMENTS, SYMBOLS = 8, 5
MINIMA = SEGMENTS * SYMBOLS
#: Nodes of a key up to which its pairs are rows; nodes of a block of more crowded keys, about.
HOT = 64
#: Shingles of a block, about; a longer text's block has its own number of them besides.
BLOCK_SHINGLES = 1 << 20
#: Columns of an incidence matrix at a time.
COLUMNS = 8192
#: Similarity of linked documents, as a fraction.
PART, WHOLE = 4, 5
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, MINIMA), np.uint64)
_MIX, _FACTOR = _DRAWS[0], _DRAWS[1] | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, in ascending order."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64))


def keys(found: np.ndarray) -> list[int]:
    """A key for each segment and deleted symbol, segment by segment: the hash of the other symbols; none for an empty set."""
    if not len(found):
        return []
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        least = np.minimum(least, ((found[i : i + 2048, None] ^ _MIX) * _FACTOR).min(0))
    segments = least.reshape(SEGMENTS, SYMBOLS)
    return [_signed(np.delete(segment, i)) for segment in segments for i in range(SYMBOLS)]


def _signed(values: np.ndarray) -> int:
    digest = xxhash.xxh64_intdigest(values.tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest


def _nodes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, hash, node, n, fp, keys): node stands for the set of shingles, n for its size, fp for its SimHash fingerprint."""

    def rows(batch):
        found = [shingles(t, width) for t in texts_of(batch, text)]
        out = [pa.array([_signed(x) for x in found], pa.int64()), pa.array(list(map(len, found)), pa.int64()), pa.array(np.array([majority(x) for x in found], np.uint64).view(np.int64)), pa.array(list(map(keys, found)), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("hash"), *out], names=[key, "hash", "node", "n", "fp", "keys"])

    marked = docs.select(key, text, F.xxhash64(text).alias("hash"))
    return map_arrow(marked, rows, f"`{key}` {docs.schema[key].dataType.simpleString()}, hash bigint, node bigint, n bigint, fp bigint, keys array<bigint>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of (node, text)."""

    def rows(batch):
        texts, nodes = texts_of(batch), batch.column("node")
        for lo, hi in chunks(texts, 1 << 20):
            found = [shingles(t, width).view(np.int64) for t in texts[lo:hi]]
            yield pa.RecordBatch.from_arrays([nodes.slice(lo, hi - lo), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return map_arrow(texts.select("node", "text"), rows, "node bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose sets are similar enough. Merged at every size: the sets aren't bounded."""
    one = sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")).hint("merge")
    two = sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")).hint("merge")
    both = pairs.join(one, "src").join(two, "dst")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter((PART + WHOLE) * common >= PART * (F.size("a") + F.size("b"))).select("src", "dst")


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst): candidates of operator 8, a row or two a node: nodes (node, fp) of one fingerprint with the least of them, and that
    of each fingerprint with that of its least neighbour within two bits. What such pairs leave out has a key of minima in common."""
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("end")), "copies-prints")
    beside = linked_prints(prints.select("fp")).groupBy(F.col("dst").alias("fp")).agg(F.min("src").alias("near"))
    ends = prints.withColumnsRenamed({"fp": "near", "end": "near_end"})
    near = prints.join(beside.hint("merge"), "fp").join(ends.hint("merge"), "near").select(F.col("end").alias("node"), F.col("near_end").alias("end"))
    pairs = nodes.join(prints.hint("merge"), "fp").select("node", "end").unionByName(near).filter("node <> end")
    return pairs.select(F.least("node", "end").alias("src"), F.greatest("node", "end").alias("dst")).distinct()


def links(nodes: DataFrame, texts: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """(src, dst) whose components are those of all candidate pairs that verify.

    nodes: (node, n, fp, keys), each once; texts: (node, text), a text of each or several equal ones.
    """
    index = nodes.select("node", F.posexplode("keys").alias("place", "value"))
    buckets = index.groupBy("place", "value").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("low"), F.max("node").alias("high")).filter("members > 1")
    shared = stored(index.join(buckets.hint("merge"), ["place", "value"]), "copies-index")
    ends = shared.select("node", F.explode(F.array("low", "high")).alias("end")).filter("node <> end")
    near = print_pairs(nodes.select("node", "fp"))
    tried = stored(ends.select(F.least("node", "end").alias("src"), F.greatest("node", "end").alias("dst")).unionByName(near).distinct(), "copies-pairs")
    asked = shared.select("node").unionByName(tried.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    wanted = texts.join(asked.hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    sets = stored(_sets(wanted, width), "copies-sets")
    first = stored(_verified(tried, sets), "copies-links")
    # The least and greatest node of three members or fewer meet all of them.
    parts = nodes.select("node", "n", "keys").join(connected_components(first).hint("merge"), "node", "left").select("node", "n", "keys", F.coalesce("component", "node").alias("part"))
    placed = shared.filter("members > 3").select("place", "value", "node", "members").join(parts.select("node", "n", "part").hint("merge"), "node")
    placed = stored(_mixed(placed, ["place", "value"]), "copies-mixed")
    pairs = _apart(placed.filter(F.col("members") <= hot), ["place", "value"]).join(tried.hint("merge"), ["src", "dst"], "left_anti")
    crowded = _block_links(placed.filter(F.col("members") > hot), sets, hot)
    return first.unionByName(_verified(pairs, sets)).unionByName(crowded)


def _block_links(members: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """(src, dst) that join the parts of crowded keys as all their verified pairs do. members: (place, value, node, n, part).

    Nodes that such keys connect are a family, dealt in the order of part and size to blocks of at most `block` nodes and about
    BLOCK_SHINGLES shingles. Of two blocks of one part nothing needs comparing, nor of two whose sizes keep them below 0.8. A task
    takes the sets of another pair of blocks, compares them as one product of incidence matrices, and gives out a forest of the
    links between parts: no pair is a row.
    """
    leads = members.groupBy("place", "value").agg(F.min("node").alias("lead"))
    ties = members.join(leads.hint("merge"), ["place", "value"]).select(F.col("node").alias("src"), F.col("lead").alias("dst")).filter("src <> dst").distinct()
    labels = connected_components(ties)
    nodes = members.groupBy("node").agg(F.first("part").alias("part"), F.first("n").alias("n")).join(labels.hint("merge"), "node", "left").select("node", "part", "n", F.coalesce("component", "node").alias("family"))
    weight = F.greatest(F.lit(BLOCK_SHINGLES // block), F.col("n"))
    placed = running(nodes, ["family"], [F.col(c).asc() for c in ("part", "n", "node")], {"upto": weight})
    dealt = stored(placed.withColumn("own", F.floor((F.col("upto") - weight) / BLOCK_SHINGLES)).drop("upto"), "copies-blocks")
    ends = [f(c).alias(f"{name}_{c}") for c in ("n", "part") for name, f in (("low", F.min), ("high", F.max))]
    stats = stored(dealt.groupBy("family", "own").agg(*ends), "copies-block-sizes")
    a, b = (stats.withColumnsRenamed({c: f"{side}_{c}" for c in stats.columns if c != "family"}) for side in "ab")
    one_part = "a_low_part = a_high_part and b_low_part = b_high_part and a_low_part = b_low_part"
    far = f"{WHOLE} * a_high_n < {PART} * b_low_n or {WHOLE} * b_high_n < {PART} * a_low_n"
    pairs = stored(a.join(b.hint("merge"), "family").filter(f"a_own <= b_own and not ({one_part}) and not ({far})").select("family", F.col("a_own").alias("i"), F.col("b_own").alias("j")), "copies-block-pairs")
    sides = [pairs.withColumn("own", F.col("i")).withColumn("side", F.lit(0)), pairs.filter("i < j").withColumn("own", F.col("j")).withColumn("side", F.lit(1))]
    rows = sides[0].unionByName(sides[1]).join(dealt.drop("n").hint("merge"), ["family", "own"]).join(sets.hint("merge"), "node")

    def forest(rows):
        found, sizes = rows["shingles"].tolist(), np.array([len(x) for x in rows["shingles"]])
        _, places = np.unique(np.concatenate(found), return_inverse=True)
        owners = np.repeat(np.arange(len(found)), sizes)
        order = np.argsort(places, kind="stable")
        places, owners = places[order], owners[order]
        common = np.zeros((len(found), len(found)), np.float32)
        for lo in range(0, int(places[-1]) + 1, COLUMNS):
            at = slice(*np.searchsorted(places, [lo, lo + COLUMNS]))
            part = np.zeros((len(found), COLUMNS), np.float32)
            part[owners[at], places[at] - lo] = 1
            common += part @ part.T
        groups, side, ids = rows["part"].tolist(), rows["side"].to_numpy(), rows["node"].tolist()
        linked = (PART + WHOLE) * common >= PART * (sizes[:, None] + sizes[None, :])
        if side.any():
            linked &= (side[:, None] == 0) & (side[None, :] == 1)
        above, out = {g: g for g in groups}, []

        def root(g):
            while above[g] != g:
                g = above[g]
            return g

        for x, y in zip(*(z.tolist() for z in np.nonzero(linked))):
            p, q = root(groups[x]), root(groups[y])
            if p != q:
                above[max(p, q)] = min(p, q)
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return rows.groupBy("family", "i", "j").applyInPandas(forest, "src bigint, dst bigint")


def _mixed(members: DataFrame, on: list[str]) -> DataFrame:
    """The members (on, node, n, part) of keys in which there is more than one part."""
    mixed = members.groupBy(*on).agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select(*on)
    return members.join(mixed.hint("merge"), on, "left_semi")


def _apart(members: DataFrame, on: list[str]) -> DataFrame:
    """(src, dst) of members of a key that are in different parts and of sizes that allow a link."""
    a, b = (members.select(*on, *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "part")]) for side in "ab")
    both = a.join(b.hint("merge"), on).filter(F.expr(f"node_a < node_b and part_a <> part_b and {WHOLE} * least(n_a, n_b) >= {PART} * greatest(n_a, n_b)"))
    return both.select(F.col("node_a").alias("src"), F.col("node_b").alias("dst")).distinct()


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """The rows of docs, all columns, of which one stays for each group: that of the smallest key, then text hash."""
    marked = stored(_nodes(docs, key, text, width), "copies-documents")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "hash")
    nodes = stored(marked.groupBy("node").agg(F.min(order).alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")]), "copies-nodes")
    held = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    firsts = nodes.select("node", F.col("least.key").alias("own_key"), F.col("least.hash").alias("own_hash"))
    texts = held.join(firsts.hint("merge"), (F.col("hash") == F.col("own_hash")) & F.col("key").eqNullSafe(F.col("own_key"))).select("node", "text")
    labels = connected_components(links(nodes.select("node", "n", "fp", "keys"), texts, width, hot))
    parts = nodes.select("node", "least").join(labels.hint("merge"), "node", "left")
    winners = parts.groupBy(F.coalesce("component", "node").alias("part")).agg(F.min("least").alias("least")).select("least.key", "least.hash")
    return one_of_each(docs, winners, key, text)
