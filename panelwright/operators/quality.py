"""Contracts, audits, lineage and leakage checks. Findings are rows; only `require` raises."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.expressions import has_secret, locator_kind


class ContractError(ValueError):
    """A table breaks a contract that its consumer needs."""


def require(violations: DataFrame, what: str) -> None:
    """Raises with the first violations, if there are any."""
    some = violations.limit(5).collect()
    if some:
        raise ContractError(f"{what}: {[tuple(r) for r in some]}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def contract_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_violations, n_rows) in one pass; a rule is a condition that must be true (null is a violation)."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"r{i}") for i, c in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_violations")) for i, name in enumerate(rules)])
    return counts.select(F.inline(pairs), "n_rows") if rules else counts.select(F.lit("").alias("rule"), F.lit(0).alias("n_violations"), "n_rows").limit(0)


def single_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n_values, value): the value of columns that must be constant, null where they aren't."""
    row = df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns], *[F.min(F.col(c).cast("string")).alias(f"v_{c}") for c in columns])
    items = [F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("n_values"), F.when(F.col(f"n_{c}") == 1, F.col(f"v_{c}")).alias("value")) for c in columns]
    return row.select(F.inline(F.array(*items)))


def audit(df: DataFrame, row_id: str, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """(row_id, field, message): a finding for every rule (field, is_bad, message) that a row breaks."""
    found = F.array(*[F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))) for field, bad, message in rules])
    return df.select(row_id, F.inline(F.filter(found, lambda x: x.isNotNull())))


def manifest_rules(columns: Mapping[str, str]) -> list[tuple[str, Column, str]]:
    """Rules for provenance rows; columns maps name, url, checksum, bytes and command to columns."""
    c = {k: F.col(v) for k, v in columns.items()}
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return [
        (columns["name"], blank(c["name"]), "blank"),
        (columns["url"], locator_kind(c["url"]) != "url", "not an http url"),
        (columns["url"], F.coalesce(has_secret(c["url"]), F.lit(False)), "secret-like value"),
        (columns["checksum"], ~F.coalesce(c["checksum"].rlike("^[0-9a-f]{64}$"), F.lit(False)), "not a sha-256"),
        (columns["bytes"], ~F.coalesce(c["bytes"] >= 0, F.lit(False)), "negative or missing size"),
        (columns["command"], blank(c["command"]), "no command"),
    ]


def provenance_record(df: DataFrame, source_id: str, url: str, command: str, method: str, at: Column) -> DataFrame:
    """One row: what a table came from, its row count, and a SHA-256 of its rows in any order."""
    rows_sha256 = rows_checksum(df).select("row_count", "rows_sha256")
    return rows_sha256.select(F.lit(source_id).alias("source_id"), F.lit(url).alias("source_url"), F.lit(command).alias("command"), F.lit(method).alias("method"), at.alias("retrieved_at"), "row_count", "rows_sha256")


def row_digest(columns: Sequence[str]) -> Column:
    """The SHA-256 of a row's text: its columns as strings in this order, each after its length, a null as `-`."""
    text = [F.coalesce(F.concat(F.char_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *text), 256)


def rows_checksum(df: DataFrame) -> DataFrame:
    """(row_count, rows_sha256): the SHA-256 of the sums of the rows' digests, by 15 hexadecimal digits; repeats count."""
    parts = [F.conv(F.substring(row_digest(df.columns), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.agg(F.count(F.lit(1)).alias("row_count"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select("row_count", F.sha2(F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("rows_sha256"))


def file_checksums(spark, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, read as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checksum_mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], checksum: str) -> DataFrame:
    """Keys whose checksum differs between two artifacts, or that only one has."""
    both = a.select(*keys, F.col(checksum).alias("left")).distinct().join(b.select(*keys, F.col(checksum).alias("right")).distinct(), list(keys), "full")
    return both.filter(~F.col("left").eqNullSafe(F.col("right")))


def leakage(build: Callable[[DataFrame], DataFrame], rows: DataFrame, entity: str, period: str, cut: int) -> DataFrame:
    """(entity, period, column, full, past): features of periods up to cut that change when later rows are removed."""
    whole, past = build(rows).filter(F.col(period) <= cut), build(rows.filter(F.col(period) <= cut))
    columns = [c for c in whole.columns if c not in (entity, period)]
    text = lambda df: df.select(entity, period, *[F.col(c).cast("string").alias(c) for c in columns])
    long = lambda df, name: text(df).unpivot([entity, period], columns, "column", name)
    both = long(whole, "full").join(long(past, "past"), [entity, period, "column"], "full")
    return both.filter(~F.col("full").eqNullSafe(F.col("past")))


def coverage_audit(entities: DataFrame, candidates: DataFrame, entity: str, eligible: Column, quality: Sequence[Column], wanted: int, fallback: DataFrame) -> DataFrame:
    """Per entity: ok, needs_fallback or error, its candidates, the chosen ones in order, and the fallback's distance.

    candidates: (entity, station, ...); fallback: (entity, station, miles, rank) from nearest_k.
    """
    from panelwright.operators.windows import top_k

    counts = candidates.groupBy(entity).agg(F.count(F.lit(1)).alias("candidates"))
    best = top_k(candidates.filter(eligible), [entity], quality, wanted)
    chosen = best.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("rank", "station"))).alias("items")).select(entity, F.array_join(F.transform("items", lambda x: x.station.cast("string")), ",").alias("chosen"))
    near = fallback.filter("rank = 1").select(entity, F.col("station").alias("fallback"), "miles")
    out = entities.select(entity).join(counts, entity, "left").join(chosen, entity, "left").join(near, entity, "left")
    status = F.when(F.col("chosen").isNotNull(), "ok").when(F.col("fallback").isNotNull(), "needs_fallback").otherwise("error")
    keep = lambda c: F.when(F.col("chosen").isNull(), F.col(c)).alias(c)
    return out.select(entity, F.coalesce("candidates", F.lit(0)).alias("candidates"), "chosen", status.alias("status"), keep("fallback"), keep("miles"))


def artifact_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("artifact"), "records") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
