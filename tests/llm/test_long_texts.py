"""Texts of some millions of characters, alone and beside short ones, through operators that work on whole texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import bpe, line_dedup, media, mixing, near_copies, quality_rules, simhash, token_files, toxicity, warc

WORDS = " ".join(f"w{i % 977}" for i in range(300_000)) + "\n"
LONG = WORDS + "ab" * 60_000 + "\n" + "é中 " * 50_000


def test_long_texts_are_whole_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, "short text"), (3, LONG), (4, None)], "doc_id long, text string")
    codes = {r.doc_id: r for r in bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert codes[1].decoded_sha256 == codes[3].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(LONG, add_special_tokens=False).ids
    assert codes[1].n_tokens == len(own) and codes[1].ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
    files = {r.doc_id: r for r in token_files.store_and_read(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert files[3].ids_crc32 == zlib.crc32(np.array([*own, 2], "<u4").tobytes()) and files[2].start == len(own) + 1
    prints = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[1].component_id == prints[3].component_id == 1 and prints[2].component_id == 2
    assert {r.doc_id for r in near_copies.representatives(docs).collect()} == {1, 2, 4}
    lines = {r.doc_id: r for r in line_dedup.drop_frequent_lines(docs, min_documents=2).collect()}
    assert (lines[1].n_lines, lines[1].n_dropped, lines[1].text) == (3, 3, "") and lines[2].n_dropped == 0
    rules = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert rules[1].n_words == len(LONG.split()) and rules[4].base_failed
    found = {r.doc_id: r.score for r in toxicity.scores(docs, (-4.0, {"w": 9.0})).collect()}
    assert 0.5 < found[1] < 1 and found[4] == 0.0


def test_long_texts_are_stored_and_mixed_whole(spark):
    docs = spark.createDataFrame([(1, LONG, "en", "web-1"), (2, "short text", "en", "web-1"), (3, LONG, "de", "web-2"), (4, None, None, None)], "doc_id long, text string, lang string, source string")
    data = LONG.encode()
    kept = {r.doc_id: r for r in media.round_trip_digests(docs).collect()}
    assert kept[1].n_bytes == len(data) and kept[1].payload_sha256 == hashlib.sha256(media.padded(LONG)).hexdigest()
    assert kept[1][1:] == kept[3][1:] and kept[4].n_bytes == 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), F.col("text").alias("html"))
    read = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert read[1].payload_bytes == read[3].payload_bytes == len(data)
    assert read[1].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert (read[1].record_type, read[1].refers_to, read[3].record_type) == ("revisit", 3, "response")
    whole = mixing.Mixture(budget_parts=1, budget_whole=1, max_epochs=1)
    mixed = {r.doc_id: r.text for r in mixing.mixed_documents(docs, whole, mixing.domain_of_source(F.col("source"))).collect()}
    assert mixed[1].split() == mixed[3].split() == LONG.split() and mixed[2] == "short text"
    assert mixing.mixed_documents(docs, mixing.Mixture(budget_parts=1, budget_whole=3, max_epochs=1), mixing.domain_of_source(F.col("source"))).agg(F.sum(F.size(F.split("text", " ")))).first()[0] > 100_000
