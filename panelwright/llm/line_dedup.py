"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, in lower case (A-Z). `LineRuns` keeps how many documents
hold each key in runs: tables bucketed by key, each bucket one file in the order of keys. Every new batch of documents is
merge-anti-joined with the settled keys of all runs (those already in enough documents, which need no more counting) and adds
its own keys as a run of level 0. When a level holds two runs, a merge join of both makes one run of the next level. All runs
have the same buckets and are read in their order, so neither join shuffles or sorts a run.
Keys in at least min_documents documents lose all their lines.

Keys are held as two 64-bit hashes with different seeds. All steps are equality joins and sums of pre-aggregated
counts, so a line that a third of all documents share is one row per task.

Defined results: a null text is one empty line. A document is a row; repeated rows count as documents
of their own. Keys of fewer than min_chars code points never drop. Extra columns are kept as they are.
An empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import shared_path, stored, unused

#: Batches at least, and documents of a batch from which on there are more.
BATCHES, BATCH_DOCUMENTS = 4, 50_000_000
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Document counts of line keys in levels of sorted runs."""

    def __init__(self, spark: SparkSession, min_documents: int):
        self.spark, self.min_documents = spark, min_documents
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []  # the run of each level, if it has one
        self.tables: list[str] = []

    @contextmanager
    def in_order(self) -> Iterator[None]:
        """Spark takes the order of a bucket that is one file from its table; by default it sorts it again."""
        before = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(ORDERED, before)

    def _write(self, counts: DataFrame) -> str:
        """A run of (a, b, n): one file per bucket, as counts is dealt like the buckets, in the order of a and b."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.tables.append(name)
        with self.in_order():
            counts.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", shared_path(self.spark, "line-run")).saveAsTable(name)
        return name

    def close(self) -> None:
        """Takes the runs out of the catalog; their files stay in the shared folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()

    def _settled(self, run: str) -> DataFrame:
        return self._counts(run).filter(F.col("n") >= self.min_documents).select("a", "b")

    def _counts(self, run: str) -> DataFrame:
        return self.spark.table(run).select("a", "b", "n").hint("merge")

    def _merged(self, one: DataFrame, two: DataFrame) -> DataFrame:
        two = two.withColumnRenamed("n", "more")
        return one.join(two, ["a", "b"], "full").select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

    def add(self, keys: DataFrame) -> None:
        """keys: (a, b), one row per document and distinct key of the batch."""
        batch = keys.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
        for run in filter(None, self.levels):
            batch = batch.join(self._settled(run), ["a", "b"], "left_anti")
        run, level = self._write(batch), 0
        while level < len(self.levels) and self.levels[level]:
            run = self._write(self._merged(self._counts(self.levels[level]), self._counts(run)))
            self.levels[level] = None
            level += 1
        self.levels[level : level + 1] = [run]

    def frequent(self) -> DataFrame:
        """(a, b) of every key in at least min_documents documents of all batches, stored; each key once."""
        merged = reduce(self._merged, map(self._counts, filter(None, self.levels)))
        with self.in_order():
            return stored(merged.filter(F.col("n") >= self.min_documents).select("a", "b"), "line-frequent")


def _hashes(text: Column, min_chars: int) -> Column:
    """The hash of each line's key, in the lines' order; null where the key is too short."""
    keys = F.transform(_lines(text), line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, _hash(k)))


def frequent_line_hashes(docs: DataFrame, text: str, min_documents: int, min_chars: int, batches: int | None) -> tuple[DataFrame, DataFrame]:
    """(listed, frequent): listed has each text's identity (row, check) and its lines' hashes, frequent has (a, b)."""
    source = F.col(f"`{text}`")
    rows = docs.select(*_identity(source), _hashes(source, min_chars).alias("keys"))
    if batches is None:
        batches = max(BATCHES, -(-docs.count() // BATCH_DOCUMENTS))
    listed = stored(rows.withColumn("batch", F.pmod("row", F.lit(batches)).cast("int")), "line-keys", ["batch"], compression="zstd")
    runs = LineRuns(docs.sparkSession, min_documents)
    distinct = F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))
    try:
        for i in range(batches):
            runs.add(listed.filter(F.col("batch") == i).select(F.inline(distinct)))
        return listed, runs.frequent()
    finally:
        runs.close()


def _identity(text: Column, row: str = "row", check: str = "check") -> list[Column]:
    """Equal texts have equal identities: they lose the same lines, so nothing else has to tell rows apart."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias(row), F.xxhash64(F.lit(2), whole).alias(check)]


def drop_frequent_lines(docs: DataFrame, text: str = "text", min_documents: int = 10, min_chars: int = 1, batches: int | None = None, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with its text shortened and the counts of its lines before dropping and of those dropped."""
    listed, frequent = frequent_line_hashes(docs, text, min_documents, min_chars, batches)
    lines = listed.select("row", "check", F.posexplode("keys").alias("pos", "key")).select("row", "check", "pos", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    hits = lines.filter(F.col("a").isNotNull()).join(frequent, ["a", "b"], "left_semi")
    own = unused("lines", docs.columns)
    row, check, drop = (f"{own}_{c}" for c in ("row", "check", "drop"))
    # Stored, so that the join below has a plain exchange on each side and a text with very many copies can be split.
    drops = stored(hits.groupBy(F.col("row").alias(row), F.col("check").alias(check)).agg(F.collect_set("pos").alias(drop)), "line-drops")
    source = F.col(f"`{text}`")
    kept = [c for c in docs.columns if c not in (n_lines, n_dropped)]
    joined = docs.select(*[F.col(f"`{c}`") for c in kept], *_identity(source, row, check)).join(drops, [row, check], "left")
    whole = F.coalesce(source, F.lit(""))
    count = F.char_length(whole) - F.char_length(F.translate(whole, "\n", "")) + 1
    split = _lines(source)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(drop))
    shorter = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    out = {text: F.when(F.col(drop).isNull(), source).otherwise(shorter)}
    return joined.select(
        *[(out[c].alias(c) if c == text else F.col(f"`{c}`")) for c in kept],
        count.cast("bigint").alias(n_lines),
        F.when(F.col(drop).isNull(), F.lit(0)).otherwise(F.size(drop)).cast("bigint").alias(n_dropped),
    )
