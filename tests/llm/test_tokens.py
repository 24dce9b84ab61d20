"""Encoding and decoding against the libraries, byte for byte."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from redactory.llm import bpe, queries, token_files

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, "Hello  world\n\n don't  "), (2, None), (3, ""), (4, "a" * 5000), (5, " " * 900 + "x   y\n\n z" + "don't " * 400), (6, "naïve 日本語 🙂 é"), (6, "other text"), (7, "q"), (7, "q"), (8, "'re 'll <|endoftext|>   x"), (9, "word " * 3000)]


def want(texts):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoding(RANKS, public_tokenizers.PATTERN)._mergeable_ranks, special_tokens={})
    return sorted((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in texts)


def test_chunks_give_the_same_ids(docs_of):
    for chunk, overlap in ((100, 8), (500, 40), (32768, 2048)):
        done = bpe.encode_and_decode(docs_of(ROWS), RANKS, public_tokenizers.PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect()
        assert sorted((r.doc_id, bytes(r.ids)) for r in done) == want(ROWS)
        assert sorted((r.doc_id, bytes(r.bytes)) for r in done) == sorted((i, (t or "").encode()) for i, t in ROWS)
        assert all(r.n_tokens == len(r.ids) // 4 for r in done)


def test_no_rows(docs_of):
    assert bpe.encode(docs_of([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_byte_bpe(spark, sf).collect()}
    for i, ids in want(docs.items()):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[i].encode()).hexdigest())


def test_words_apart_are_texts_together():
    encoder = token_files.WordEncoder(WORDS)
    texts = ["a  b", "  x", " \n y  \n\n z", "", "a  b  ", "hi there", "x ", " ", "don't 're  <|endoftext|> ok", "a b. c, x.\ny z;\nW foo.\n\nbar e.\nf.\ng the,\nA ok", " a.\n b", "über  naïve 日本 語\tq \t r"]
    for _ in range(2):
        assert encoder.encode(texts) == encoder.whole(texts)


def test_files(spark, docs_of, sf, tmp_path):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    for df, rows in ((docs_of(ROWS), ROWS), (spark.read.parquet(f"{sf}/documents.parquet"), None)):
        rows = rows or [(r.doc_id, r.text) for r in df.collect()]
        folder = str(tmp_path / f"f{len(rows)}")
        shards = token_files.write(df, folder, WORDS, files=3)
        at, expected = 0, []
        for i, t in sorted((i, t or "") for i, t in rows):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
            expected.append((i, at, len(ids), zlib.crc32(ids)))
            at += len(ids)
        assert sorted(map(tuple, token_files.read(shards, folder).collect()), key=lambda r: r[1]) == expected
    assert token_files.write(docs_of([]), str(tmp_path / "none"), WORDS).count() == 0


@pytest.mark.parametrize("folder", ["{}/plain", "viewfs://tokens/shared/a/view"])
def test_shared_folders_of_a_cluster(spark, docs_of, tmp_path, monkeypatch, folder):
    """A path without a scheme under a master that is not local, and one in a view of another store."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tokens.link./shared", f"file://{tmp_path}")
    folder = folder.format(tmp_path)
    got = token_files.read(token_files.write(docs_of(ROWS), folder, WORDS, files=3), folder)
    assert sorted(r.doc_id for r in got.collect()) == [i for i, _ in ROWS]
    assert len(list(tmp_path.rglob("offsets-*"))) == len(list(tmp_path.rglob("ids-*"))) > 0


def test_files_that_the_driver_does_not_see(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "_names", lambda *_: [])
    with pytest.raises(ValueError, match="do not share"):
        token_files.write(docs_of(ROWS), str(tmp_path / "own"), WORDS, files=3)


def test_repeated_pieces_are_looked_up_once(monkeypatch):
    encoder, looked_up = token_files.WordEncoder(WORDS), []
    numbers = token_files._Pieces.numbers

    def counted(self, pieces, learn):
        looked_up.extend(pieces := list(pieces))
        return numbers(self, pieces, learn)

    monkeypatch.setattr(token_files._Pieces, "numbers", counted)
    texts = ["over and over, " * 500 + "over"] * 20
    assert encoder.encode(pa.array(texts)) == encoder.whole(texts)
    assert len(looked_up) < 30_000 / 10


def test_forgotten_pieces_and_small_groups(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 2)
    monkeypatch.setattr(token_files, "TOGETHER", 12)
    encoder = token_files.WordEncoder(WORDS)
    texts = [t or "" for _, t in ROWS] + ["naïvely日本 naïve, don't\x1f \x1fx 12a a12. a-b _x_  y ​ z", "x" * 40 + " b", "", "", " a", "\n", "b b\r\n b"]
    for some in (texts, texts[::-1], [], pa.array(["0", *texts], pa.large_string())[1:]):
        plain = some.to_pylist() if isinstance(some, pa.Array) else some
        assert encoder.encode(some) == encoder.whole(plain)


def test_long_pieces_are_forgotten(monkeypatch):
    """Few pieces may be many characters."""
    monkeypatch.setattr(token_files, "REMEMBERED_CHARS", 5_000, raising=False)
    monkeypatch.setattr(token_files, "TOGETHER", 1_000)
    encoder, texts = token_files.WordEncoder(WORDS), [f"{k},b{k}{'xy.' * 300}" for k in range(60)]
    assert encoder.encode(texts) == encoder.whole(texts)
    assert all(sum(map(len, kept.number)) < 10_000 for kept in (encoder.known, encoder.words, encoder.ends))


def test_failure_while_learning(monkeypatch):
    encoder = token_files.WordEncoder(WORDS)
    with monkeypatch.context() as m, pytest.raises(MemoryError):
        m.setattr(encoder, "whole", lambda texts: (_ for _ in ()).throw(MemoryError()))
        encoder.encode(["some words"])
    assert encoder.encode(["some words"]) == encoder.whole(["some words"])
