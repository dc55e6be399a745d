import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import clashing, no_docs, odd_docs
from tokenizers import Tokenizer, models, pre_tokenizers

from lexlake.llm import tokencount, tokens_out
from lexlake.llm.queries import op4_token_count, op10_token_output, tokenizer_file

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unigram():
    """The tokenizers library's own unigram model over the same pieces and scores."""
    import sentencepiece

    f = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    vocab = [(f.id_to_piece(i), f.get_score(i) if not (f.is_control(i) or f.is_byte(i) or f.is_unknown(i)) else -5e8) for i in range(f.get_piece_size())]
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


def test_counts_equal_the_library(unigram):
    counter = tokencount.Counter(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(2)
    texts = pq.read_table(f"{FOLDER}/documents.parquet", columns=["text"]).to_pydict()["text"]
    texts += ["", " ", "  a  b ", "\n\n", "日本語 ☃☃ x\ny", "\U0001f600", "▁a", "ééé\t", "a" * 300]
    texts += ["".join(rng.choice(" abcdéß\n日t") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert counter.count(t) == len(unigram.encode(t, add_special_tokens=False).ids), t[:80]


def test_count_query_takes_whole_texts(spark, unigram):
    got = {r["doc_id"]: r["n_tokens"] for r in op4_token_count(spark, FOLDER).collect()}
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert got == {i: len(unigram.encode(t, add_special_tokens=False).ids) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}


def test_small_memory_gives_equal_counts(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_ENTRIES", 3)
    counter = tokencount.Counter(tokenizer_file("piece_bpe_32k.model"))
    text = "one two three four one two\nthree five six " * 3
    assert counter.count(text) == counter.count(text) == tokencount.Counter(tokenizer_file("piece_bpe_32k.model")).count(text)


def test_count_of_odd_rows(spark):
    docs = clashing(odd_docs(spark))
    model = tokenizer_file("piece_bpe_32k.model")
    found = tokencount.token_counts(docs, model).collect()
    assert len(found) == docs.count() and {r["n_tokens"] for r in found if not r["text"]} == {0}
    assert tokencount.token_counts(no_docs(spark), model).count() == 0
    with pytest.raises(ValueError, match="taken"):
        tokencount.token_counts(docs.withColumnRenamed("lang", "N_TOKENS"), model)


def expected(rows):
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


def test_token_query_against_the_library(spark):
    docs = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert rows_of(op10_token_output(spark, FOLDER)) == expected(list(zip(docs["doc_id"], docs["text"], strict=True)))


def test_token_output_of_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens_out, "CACHE_PARTS", 5)
    monkeypatch.setattr(tokens_out, "CACHE_WORDS", 5)
    more = [(20, "It's <|endoftext|> we'll Å\u0085b\x1cc  d e"), (21, "x" * 5000), (22, "1a2 don't'S"), (23, "ﬁ İI\r\n\tq")]
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    path = str(tmp_path / "out")
    got = rows_of(tokens_out.token_output(clashing(docs), tokenizer_file("word_bpe_49k.json"), path=path))
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
    offsets = tokens_out.read_token_offsets(spark, path)
    assert sorted((r["start"], r["n_tokens"]) for r in offsets.collect()) == [(r[1], r[2]) for r in got]
    assert tokens_out.token_output(no_docs(spark), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_files_have_page_indexes_and_delta_or_dictionary_pages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "out")
    tokens_out.write_token_ids(docs, path, tokenizer_file("word_bpe_49k.json"))
    for file in (tmp_path / "out").glob("*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = [group.column(i) for i in range(group.num_columns)]
        assert all(c.has_offset_index for c in columns)
        assert any("DELTA_BINARY_PACKED" in c.encodings or "RLE_DICTIONARY" in c.encodings for c in columns if "ids" in c.path_in_schema)


def test_small_memory_gives_equal_ids(monkeypatch):
    monkeypatch.setattr(tokens_out, "CACHE_PARTS", 3)
    monkeypatch.setattr(tokens_out, "CACHE_WORDS", 2)
    path = tokenizer_file("word_bpe_49k.json")
    encoder, library = tokens_out.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(8)
    parts = ["The", "THE!!", "don't", "É", "éE,", "日本", "a1", "...", "$$$", "x" * 90, "<|endoftext|>", "İ!", "Σας.", "", "é", "\u0085", "가."]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) + rng.choice(" \n\t  ") for _ in range(rng.randrange(12))) for _ in range(5)]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == want


def test_every_letter_gives_equal_ids():
    path = tokenizer_file("word_bpe_49k.json")
    letters = [w for c in range(0x80, 0x250) for w in (chr(c), f"Q{chr(c)}x!!", f"{chr(c)}\u0301.", f"é\x0b!!\x0c{chr(c)}")]
    library = Tokenizer.from_file(path)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in letters]
    assert tokens_out.Encoder(path).encode(letters) == want and tokens_out.Encoder(path).encode([]) == []


def test_chunks_keep_every_row(monkeypatch):
    monkeypatch.setattr(tokens_out, "CHUNK_BYTES", 20)
    texts = ["", "a b", "x" * 70, "The  end.", "", "y" * 15] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    chunks = list(tokens_out._chunks(batch, 1))
    assert [t for c in chunks for t in c.column(1).to_pylist()] == texts and len(chunks) > 4
    assert all(c.num_rows == 1 or sum(map(len, c.column(1).to_pylist())) <= 20 for c in chunks)
    assert list(tokens_out._chunks(batch.slice(0, 0), 1)) == []
    encoder, library = tokens_out.Encoder(tokenizer_file("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    for c in chunks:
        ids, ends = encoder.encode_array(c.column(1), np.array([1], "<u4").tobytes())
        want = [[*library.encode(t, add_special_tokens=False).ids, 1] for t in c.column(1).to_pylist()]
        assert ids.tolist() == sum(want, []) and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_files_with_other_rules_go_through_the_library_alone(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    texts = ["Hello World", "", " two  blanks\n", "É日本 it's", "x" * 50]
    found = tokens_out.Encoder(path).encode(texts)
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens_out.token_output(docs, path).collect()} == {k: len(f) // 4 + 1 for k, f in enumerate(found)}


def test_memories_end_with_the_task(spark):
    encoder = tokens_out.Encoder(tokenizer_file("word_bpe_49k.json"))
    encoder.encode(["some words here, and there"])
    assert encoder.by_parts and encoder.words.young
    encoder.forget()
    assert not encoder.words.young and not encoder.parts.old
