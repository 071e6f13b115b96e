"""Token files, token counts and byte-pair encoding against the tokenizers library."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from burstlens.llm import blocks as B
from burstlens.llm.pretokens import Encoder
from burstlens.llm.token_counts import count_tokens
from burstlens.llm.token_files import read_token_files, write_token_files
from burstlens.llm.word_bpe import WordBPE, decode_ids, encode_texts, roundtrip_digests
from tests.llm.conftest import ODD_TEXTS

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
PARTS = (
    "' s t re ve ll m d a B é É ñ ! … 1 12 ² ß Σ İ Ⱥ the ing 日本 é ͅ 🎉 <|endoftext|> ¿ 'S"
).split()
PARTS += [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", " '"]


def texts(seed, n):
    r = random.Random(seed)
    found = ["".join(r.choice(PARTS) for _ in range(r.randrange(25))) for _ in range(n)]
    return [*found, None, "", " ", "a" * 1500, "ab" * 900, "theing" * 400, "é" * 300, "1" * 200]


@pytest.mark.parametrize("make, path", [(Encoder, BYTES), (WordBPE, WORDS)], ids=["bytes", "words"])
@pytest.mark.parametrize("size", [1000, 1 << 20])
def test_ids_equal_those_of_the_library(make, path, size):
    sample = texts(size, 4000)
    library, own = Tokenizer.from_file(path), make(path)
    want = library.encode_batch([t or "" for t in sample], add_special_tokens=False)
    got = []
    for block in B.blocks([pa.RecordBatch.from_pydict({"text": sample})], size=size):
        ids, first = own.ids_of(block)
        got += [ids[first[r] : first[r + 1]].tolist() for r in range(block.rows)]
    assert got == [e.ids for e in want]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr("burstlens.llm.pretokens.CACHE_WORDS", 10)
    test_ids_equal_those_of_the_library(Encoder, BYTES, 1000)
    test_ids_equal_those_of_the_library(WordBPE, WORDS, 1000)


def test_counts_of_odd_texts(odd, none):
    library = Tokenizer.from_file(BYTES)
    got = count_tokens(odd, BYTES, limit=9)
    assert got.columns == ["doc_id", "text", "Score", "position", "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        text = ODD_TEXTS[r.position][1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 9)
    assert got.count() == len(ODD_TEXTS) and count_tokens(none, BYTES).count() == 0


@pytest.mark.parametrize("table_size", [1, 5])
def test_the_broadcast_table_changes_no_count(odd, table_size):
    few, many = (count_tokens(odd, BYTES, table_size=n) for n in (table_size, 50_000))
    count = lambda df: {r.position: r.n_tokens for r in df.collect()}
    assert count(few) == count(many)


def test_token_files_are_in_order_and_whole(spark, odd, none, tmp_path):
    library = Tokenizer.from_file(BYTES)
    write_token_files(odd, str(tmp_path / "t"), BYTES)
    rows = read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    order = sorted(ODD_TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t in order]
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    assert [r.ids for r in rows] == want
    assert [r.start for r in rows] == [0, *itertools.accumulate(map(len, want))][:-1]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in want]
    flat = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("*.bin")))
    assert np.frombuffer(flat, "<u2").tolist() == [i for ids in want for i in ids]
    write_token_files(none, str(tmp_path / "n"), BYTES)
    assert read_token_files(spark, str(tmp_path / "n")).count() == 0


def test_a_width_that_does_not_hold_the_ids_is_refused(spark, tmp_path):
    wide = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    write_token_files(wide, str(tmp_path / "w"), BYTES, width=4)
    assert read_token_files(spark, str(tmp_path / "w")).first().n_tokens == 3
    with pytest.raises(Exception, match="does not fit"):
        write_token_files(wide, str(tmp_path / "x"), BYTES, end_id=1 << 16, width=2)


def test_encoding_and_decoding(odd, none):
    library = Tokenizer.from_file(WORDS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pairs = decode_ids(encode_texts(odd, WORDS), WORDS)
    for r in pairs.collect():
        ids = library.encode(ODD_TEXTS[r.position][1] or "", add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, library.decode(ids, skip_special_tokens=False))
    for r in roundtrip_digests(odd, WORDS).collect():
        ids = library.encode(ODD_TEXTS[r.position][1] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert (r.ids_sha256, r.decoded_sha256) == (sha(" ".join(map(str, ids))), sha(decoded))
    assert decode_ids(encode_texts(none, WORDS), WORDS).count() == 0


def test_files_are_read_by_a_task_each(spark, tmp_path):
    from burstlens.llm.queries import BYTE_BPE
    from burstlens.llm.token_files import read_token_files, write_token_files

    docs = spark.range(60).selectExpr("id as doc_id", "repeat('some words ', 20) as text").repartition(6)
    path = str(tmp_path / "tokens")
    write_token_files(docs, path, BYTE_BPE, end_id=0)
    files = spark.read.parquet(f"{path}/manifest").count()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        tasks = read_token_files(spark, path).selectExpr("spark_partition_id() as p").distinct().count()
        assert files > 1 and tasks == files
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
