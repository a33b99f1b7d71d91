import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelwright.llm import huffman, queries, token_files, warc
from panelwright.llm.common import shared_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("counts", [[0], [5], [1, 1], [0, 3, 0, 1], [2**i for i in range(40)], list(range(1, 3000)), [1] * 70000])
def test_code_lengths_are_limited_and_complete(counts):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all()
    used = lengths[lengths > 0].astype(int)
    assert used.max(initial=0) <= huffman.limit_for(len(used))
    if len(used) > 1:
        assert sum(2.0**-n for n in used) == 1.0


def test_code_lengths_are_optimal_where_unlimited():
    import heapq

    counts = np.array([7, 1, 1, 3, 9, 30, 2, 2], np.int64)
    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_blocks_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 60000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=4))
    data, marks = huffman.encode(ids, lengths, huffman.codes(lengths))
    decoder = huffman.Decoder(lengths)
    assert (decoder.decode(data, marks, n) == ids).all()
    if n > 1024:  # a block alone
        assert (decoder.decode(data, marks[1:2], 512) == ids[512:1024]).all()


@pytest.mark.parametrize("match_added", [True, False])
def test_token_files_match_the_library(spark, monkeypatch, match_added):
    monkeypatch.setattr(token_files, "GROUP_DOCUMENTS", 7)
    own = Tokenizer.from_file(TOKENIZER)
    if not match_added:
        own.encode_special_tokens = True
    random_ = random.Random(3)
    texts = [None, "", "<|endoftext|> x", "it's  \n 12 é中", "z" * 3000] + ["".join(random_.choices("abcde  \n'", k=random_.randint(0, 400))) for _ in range(60)]
    rows = [(random_.randint(-50, 50) if i else None, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted((tuple(r) for r in token_files.store_and_read(docs, TOKENIZER, match_added=match_added).collect()), key=lambda r: r[1])
    want = {}
    for key, text, _ in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        want.setdefault(key, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    start = 0
    for key, begin, n, check in got:
        assert begin == start
        want[key].remove((n, check))
        start += n
    assert token_files.store_and_read(docs.limit(0), TOKENIZER).count() == 0
    named = docs.selectExpr("concat('k', doc_id) AS doc_id", "text")
    assert {r.doc_id for r in token_files.store_and_read(named, TOKENIZER).collect()} == {r.doc_id for r in named.collect()}


def test_every_code_point_is_encoded_as_the_library_does():
    own, coder = Tokenizer.from_file(TOKENIZER), token_files.TextEncoder(TOKENIZER)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}'s {c}1 !{c} " for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    for text, ids, found in zip(texts, coder.encode(texts), own.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == found.ids, text


def test_op9_matches_added_tokens_as_the_library_does(spark, tmp_path):
    own = Tokenizer.from_file(TOKENIZER)
    random_ = random.Random(5)
    bits = ["<|endoftext|>", "<|endoftext|", "|>", " ", "\n", "it's", "a", "é", "12"]
    texts = ["a<|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b", None] + ["".join(random_.choices(bits, k=random_.randint(0, 30))) for _ in range(200)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = 0
    for r in sorted(queries.op9_huffman_ids(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = [*own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r.doc_id]
        start += len(ids)
    assert 50256 in own.encode(texts[0], add_special_tokens=False).ids


def test_added_tokens_with_options_are_left_to_the_library(tmp_path):
    from tokenizers import AddedToken

    own = Tokenizer.from_file(TOKENIZER)
    own.add_tokens([AddedToken("<x>", lstrip=True, rstrip=True), AddedToken("<xy>x", single_word=True)])
    own.save(str(tmp_path / "own.json"))
    texts = ["a <x> b", "a<xy>x b", "<xy>xb", "plain  text", "", "<|endoftext|> c"]
    coder = token_files.TextEncoder(str(tmp_path / "own.json"), match_added=True)
    assert [x.tolist() for x in coder.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def pages():
    rows = [(1, "http://a/\r\nX: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "http://b", "<p>é</p>"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.0\r\n\r\nHTTP\n" * 50), (7, "u", "x\r\n\r\n"), (None, "n", "<p>é</p>"), (None, "n", "alone")]
    return [(*r, "extra") for r in rows]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, compression):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string, size string")
    got = {(r.page_id, r.payload_digest): r for r in warc.archive_and_read(frame, compression=compression).collect()}
    assert len(got) == len(pages())
    for key, _, html, _ in pages():
        body = (html or "").encode()
        same = [k for k, _, h, _ in pages() if (h or "") == (html or "") and k is not None]
        newest = max(same, default=None)
        r = got[key, base64.b32encode(hashlib.sha1(body).digest()).decode()]
        assert r.payload_bytes == len(body)
        assert (r.record_type, r.refers_to) == (("response", None) if key == newest else ("revisit", newest)), key
    assert warc.archive_and_read(frame.limit(0)).count() == 0
    large = {r.page_id: r.record_type for r in warc.archive_and_read(frame.filter("page_id is not null"), min_bytes=5).collect()}
    assert large[4] == "response" and large[5] == "response" and large[1] == "revisit"


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_filters_reach_the_reader(spark, compression):
    folder = shared_path(spark, "warc-test")
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string, size string").filter("page_id is not null")
    warc.write(warc.record_types(frame), folder, compression=compression)
    revisits = warc.read(spark, folder, payload="none").filter("record_type = 'revisit'")
    assert {r.record_id for r in revisits.collect()} == {"urn:page:1", "urn:page:2", "urn:page:4"}
    assert {r.payload_bytes for r in revisits.collect()} == {None}
    full = warc.read(spark, folder, payload="full").filter("target_uri in ('http://b', 'none')").collect()
    assert [bytes(r.payload).decode() for r in full] == ["<p>é</p>"]
    reader = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}}
    kept = [list(warc.read_slice(p, reader.wanted, "none")) for p in reader.partitions()]
    assert sum(map(len, kept)) == 3


def test_warc_payloads_that_are_not_wanted_are_not_inflated(spark):
    folder = shared_path(spark, "warc-test")
    frame = spark.createDataFrame([(i, "u", f"{i % 40} " + "long text " * 9000) for i in range(60)], "page_id long, url string, html string")
    warc.write(warc.record_types(frame), folder)
    parts = warc.WarcReader({"path": folder, "split_bytes": "2000"}).partitions()
    assert len(parts) > 10

    def inflated(wanted, payload):
        before = warc._Member.inflated
        rows = [r for p in parts for r in warc.read_slice(p, wanted, payload)]
        return len(rows), warc._Member.inflated - before

    whole = inflated({}, "digest")
    assert whole[0] == 60 and whole[1] > 40 * 90_000
    assert inflated({"record_type": {"revisit"}}, "digest")[1] <= 60 * 1200
    assert inflated({"record_id": {"urn:page:59"}}, "digest") <= (1, 60 * 1024 + 91_000)
    assert inflated({}, "none") <= (60, 60 * 1024)


def test_warc_payloads_that_are_not_wanted_are_not_read(spark):
    folder = shared_path(spark, "warc-test")
    random_ = random.Random(4)
    frame = spark.createDataFrame([(i, "u", "".join(map(str, random_.choices(range(10), k=200_000)))) for i in range(8)], "page_id long, url string, html string")
    warc.write(warc.record_types(frame), folder)
    parts = warc.WarcReader({"path": folder}).partitions()

    def taken(wanted, payload):
        before = warc._Member.taken
        rows = [r for p in parts for r in warc.read_slice(p, wanted, payload)]
        return len(rows), warc._Member.taken - before

    whole = taken({}, "digest")
    assert whole[0] == 8 and whole[1] > 8 * 80_000
    assert taken({}, "none") <= (8, 8 * warc.READ_BYTES)
    assert taken({"record_id": {"urn:page:3"}}, "digest")[1] <= 8 * warc.READ_BYTES + 100_000


def test_warc_files_of_others_and_lost_attempts(spark, tmp_path):
    record = warc.record_bytes(7, "u", hashlib.sha1(b"body").hexdigest(), None, b"body")
    revisit = warc.record_bytes(8, None, hashlib.sha1(b"body").hexdigest(), 7, None)
    (tmp_path / "a.warc").write_bytes(record + revisit)
    with __import__("gzip").open(tmp_path / "b.warc.gz", "wb") as sink:
        sink.write(record + revisit)
    rows = warc.read(spark, str(tmp_path), payload="full").filter("record_type = 'response'").collect()
    assert [(r.record_id, bytes(r.payload)) for r in rows] == [("urn:page:7", b"body")] * 2
    folder = shared_path(spark, "warc-test")
    frame = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    warc.write(warc.record_types(frame), folder)
    from panelwright.llm.common import open_shared

    store, path = open_shared(folder)
    with store.open_output_stream(f"{path}/part-lost.warc.gz") as sink:
        sink.write(b"half a file")
    assert warc.read(spark, folder).count() == 1
