import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import byte_bpe, pretokens, token_counts, token_files
from rankloom.llm.shared_files import put, read_range
from rankloom.llm.storage import scratch

from . import cases

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rnd = random.Random(4)
    letters = [chr(c) for c in [*range(1, 127), *range(0xA0, 0x250), 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x200D, 0x301, 0xFFFD, 0x85]]
    latin = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xC0, 0x250), *[32, 39, 115, 116] * 20]]
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)] + ["".join(rnd.choice(latin) for _ in range(rnd.randrange(60))) for _ in range(400)] + ["a" * 5000, " " * 3000, "\n" * 77 + "x", "''''s't're", "don't  DON'T \t\n x", "<|endoftext|> x"]


def test_spelled_out_pattern_finds_the_same_matches():
    import public_tokenizers
    import regex

    whole = regex.compile(public_tokenizers.PATTERN).findall
    for members in (pretokens.tiktoken_members, pretokens.tokenizers_members):
        split = pretokens.public_split(members)
        for text in odd_texts():
            assert split(text) == whole(text)
        for c in [*range(9, 14), *range(32, 127), *range(0xC0, 0x250)]:
            for text in (chr(c), f" {chr(c)}", f"a{chr(c)}1", f"{chr(c)}{chr(c)} .", f"'{chr(c)}"):
                assert split(text) == whole(text)


def any_texts(seed, n=4000):
    """Texts of random code points of all planes, letters and numbers of new scripts among them."""
    rnd = random.Random(seed)
    planes = [range(0x20, 0xD800), range(0xE000, 0x10000), range(0x10000, 0x20000), range(0x20000, 0x110000), range(0x20, 0x80), range(0x1C, 0xA1)]
    return ["".join(chr(rnd.choice(rnd.choice(planes[:3] + planes))) for _ in range(rnd.randrange(1, 30))) for _ in range(n)]


def test_random_code_points_are_split_as_each_library_splits_them(tokenizer):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours, theirs = byte_bpe.worker_bpe(byte_bpe.default_path()), pretokens.tokenizers_encoder(P.path("byte_bpe_50k.json"))
    for text in any_texts(1):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == encoding.encode_ordinary(text)
        assert np.frombuffer(theirs(text), "<u4").tolist() == tokenizer(text)


def test_token_files_hold_the_library_ids(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(odd_texts(), 5000)], cases.SCHEMA)
    docs = docs.unionByName(odd)
    text = {r.doc_id: r.text for r in docs.collect()}
    start = 0
    rows = sorted(token_files.token_ids(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(text)
    for r in rows:
        ids = tokenizer(text[r.doc_id]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_stored_tokens_are_read_by_ranges(spark):
    folder, ids = scratch(spark, "stored"), np.random.default_rng(2).integers(0, 2**20, 3000).astype(np.uint32)
    put(folder, "x", token_files.encode_file(np.array([7, 8]), np.array([1000, 3000]), ids))
    stored = token_files.StoredTokens(folder, "x")
    assert (stored.n_docs, stored.n_tokens) == (2, 3000)
    assert all(stored.token(k) == ids[k] for k in [0, 1, 511, 512, 513, 1023, 1024, 2999, *range(1500, 1540)])


def test_any_token_is_read_directly():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5000, 300), (5000, 70000), (3000, 2**32 - 1), (0, 1)):
        ids = rng.integers(0, top, n).astype(np.uint32) if n else np.empty(0, np.uint32)
        f = token_files.TokenFile(b"".join(token_files.encode_file(np.array([7]), np.array([n]), ids)))
        assert (f.tokens() == ids).all() and f.doc_ids.tolist() == [7] and f.ends.tolist() == [n]
        assert all(f.token(k) == ids[k] for k in rng.integers(0, max(n, 1), 200) if n)
        for a, b in np.sort(rng.integers(0, n + 1, (100, 2)), 1).tolist():
            assert (f.ids(a, b) == ids[a:b]).all()


def test_ids_that_do_not_fit_are_refused(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some words", None, None, None)], cases.SCHEMA)
    with pytest.raises(Exception, match="does not fit"):
        token_counts.write_flat(docs, scratch(spark, "narrow"), public_tokenizers.path("byte_bpe_50k.json"), 9, 1).collect()


def test_token_files_on_awkward_tables(spark, monkeypatch):
    assert token_files.token_ids(cases.empty(spark)).count() == 0
    rows = token_files.token_ids(cases.documents(spark, clash=True)).orderBy("start").collect()
    assert len(rows) == 13 and rows[0].doc_id is None and [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert sum(r.n_tokens for r in rows[:-1]) == rows[-1].start
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}


def test_counts_match_the_library(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = token_counts.token_counts(docs).collect()
    assert len(got) == len(text) and all(r.n_tokens == len(tokenizer(text[r.doc_id])) for r in got)
    for name in {r.file for r in got}:
        start = 0
        for k, r in enumerate(sorted((r for r in got if r.file == name), key=lambda r: r.place)):
            assert (r.place, r.start) == (k, start)
            start += r.n_tokens + 1


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
def test_blocks_are_stitched(spark, block):
    folder = scratch(spark, "flat")
    rnd = random.Random(block)
    files, want = {}, []
    contents = [[9] * 20, [1, 2, 3], [], [9], [1, 9, 2, 2, 9, 9, 3]] + [[rnd.choice([1, 2, 3, 4, 9]) for _ in range(50)] for _ in range(3)] + [[1] * 40 + [9] + [2] * 40]
    for k, ids in enumerate(contents):
        put(folder, f"f{k}", [np.array(ids, "<u2").tobytes()])
        files[f"f{k}"] = len(ids) * 2
        docs, at = [], 0
        for j, x in enumerate(ids):
            if x == 9:
                docs.append((at, j - at))
                at = j + 1
        if at < len(ids):
            docs.append((at, len(ids) - at))
        want += [(f"f{k}", p, s, n) for p, (s, n) in enumerate(docs)]
    df = spark.createDataFrame(list(files.items()), "file string, file_bytes long")
    got = [tuple(r) for r in token_counts.scan(df, folder, separator=9, block=block).select("file", "place", "start", "n_tokens").collect()]
    assert sorted(got) == sorted(want)


def test_counts_on_awkward_tables(spark):
    assert token_counts.token_counts(cases.empty(spark)).count() == 0
    rows = token_counts.token_counts(cases.documents(spark, clash=True)).collect()
    assert len(rows) == 13 and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}


def test_byte_bpe_is_the_rank_encoding(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd_texts(), 5000)), "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = byte_bpe.encode_documents(docs).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = encoding.encode_ordinary(text[r.doc_id])
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_byte_bpe_on_awkward_tables(spark):
    assert byte_bpe.encode_documents(cases.empty(spark)).count() == 0
    encoded, names = byte_bpe.encode_column(cases.documents(spark, clash=True), with_ids=True)
    rows = encoded.select("doc_id", F.col(names[0]).alias("n"), F.size(names[3]).alias("m")).collect()
    assert len(rows) == 13 and all(r.n == r.m for r in rows) and {r.n for r in rows if r.doc_id in (1, 2)} == {0}


def test_ranges_of_files(spark):
    folder = scratch(spark, "ranges")
    put(folder, "x", [b"abc", b"def"])
    put(folder, "x", [b"abcdef"])
    assert read_range(folder, "x") == b"abcdef" and read_range(folder, "x", 2, 3) == b"cde" and read_range(folder, "x", 4) == b"ef"


def test_strings_of_special_tokens(spark, tokenizer):
    import zlib

    import numpy as np

    texts = ["<|endoftext|> hi", "a<|endoftext|><|endoftext|>", " <|endoftext|>\n x", "<|endoftext", "<|endoftext|>" * 3, "é <|endoftext|>é"]
    assert tokenizer(texts[0]) == [50256, 23105]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.token_ids(df).collect()}
    for k, t in enumerate(texts):
        ids = np.array([*tokenizer(t), 2], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))
    import public_tokenizers

    plain = pretokens.tokenizers_encoder(public_tokenizers.path("byte_bpe_50k.json"), ordinary=True)
    assert 50256 not in np.frombuffer(plain(texts[1]), "<u4")


def test_rows_of_one_id_are_spread(spark):
    df = spark.createDataFrame([(None if k % 2 else 7, f"text {k}") for k in range(400)], "doc_id long, text string")
    from rankloom.llm.storage import scratch

    import public_tokenizers

    files = token_files.write_files(df, scratch(spark, "spread"), public_tokenizers.path("byte_bpe_50k.json"))
    assert max(r.n for r in files.groupBy("part").agg({"n_docs": "sum"}).toDF("part", "n").collect()) < 200
