import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from matchflow.llm import packing, pieces, tokens

from .conftest import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("file", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_the_librarys(spark, odd, library, tmp_path, file):
    path = public_tokenizers.path(file)
    got = tokens.token_counts(odd, path, str(tmp_path / "cache"), limit=100).collect()
    if file.endswith(".model"):
        count = lambda t: len(library.encode(t))
    else:
        tk = Tokenizer.from_file(path)
        count = lambda t: len(tk.encode(t, add_special_tokens=False).ids)
    want = sorted((str(i), len((t or "").encode()), n := count(t or ""), n > 100) for i, t in ODD)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want


def test_only_missing_contents_are_encoded_and_appended(spark, make_docs, tmp_path):
    cache = str(tmp_path / "cache")
    first = make_docs([(1, "a b"), (2, "a b"), (3, "c"), (9, "a▁b")])
    tokens.token_counts(first, MODEL, cache).collect()
    place = f"{cache}/tokenizer={tokens.tokenizer_digest(open(MODEL, 'rb').read(), 'model')}"
    assert spark.read.parquet(place).count() == 2  # copies and the other spelling of a blank share a count
    tokens.token_counts(make_docs([(4, "c"), (5, "d")]), MODEL, cache).collect()
    assert spark.read.parquet(place).count() == 3
    # A stored count is used as it is.
    marked = tokens.read_cache(spark, place).selectExpr("digest", "n_tokens + 1000 AS n_tokens")
    other = str(tmp_path / "other")
    marked.write.parquet(place.replace(cache, other))
    assert [r["n_tokens"] for r in tokens.token_counts(make_docs([(6, "d")]), MODEL, other).collect()][0] > 1000


def test_counts_of_no_rows(none, tmp_path):
    assert tokens.token_counts(none, MODEL, str(tmp_path / "c")).count() == 0


def test_pieces_are_the_librarys(odd, library):
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in pieces.digests(pieces.encode_documents(odd, MODEL)).collect())
    want = []
    for i, t in ODD:
        ids = [1, *library.encode(t or ""), 2]
        want.append((str(i), len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)


def test_prefix_table_on_documents_and_made_up_strings(library, texts):
    import random

    table = pieces.PrefixTable(pieces.read_model(MODEL))
    rng = random.Random(3)
    names = list(table.ids)
    made = ["".join(rng.choice(names) for _ in range(rng.randint(1, 12))).replace("▁", " ") for _ in range(3000)]
    made += ["".join(rng.choice("ethainosrd lc\n.") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    made += [" " * k + "x" + " " * k for k in range(50)]
    for text in texts + made:
        ids = [1, *library.encode(text), 2]
        coded = table.encode(text)
        assert list(memoryview(coded).cast("I")) == ids
        assert table.decode(coded) == library.decode(ids)


def test_decode_of_broken_bytes(library):
    table = pieces.PrefixTable(pieces.read_model(MODEL))
    for ids in ([1, 3 + 0xE2, 3 + 0x82, 300, 2], [3 + 0xFF, 3 + 0x41], [0, 5, 300], [28705, 28705], []):
        assert table.decode(struct.pack(f"<{len(ids)}I", *ids)) == library.decode(ids)


def test_word_ids_are_the_tokenizers(texts):
    data = open(WORDS).read()
    tk, words = Tokenizer.from_str(data), packing.WordIds(data)
    odd = ["", " ", "a<|endoftext|>b", "<|ENDOFTEXT|> <|startoftext|>x", "é É ́x", "ΣΑΣ ΟΔΥΣΣΕΥΣ", "a\x1cb \x1f", "İstanbul",
           "don't WE'VE 'sup 12345", "<|endoftext", "|> <|", "\x00 \x01", "a b c　d\x85e", "x!!'s THE!! of%%% Å ʹ"]
    for text, ids in zip(texts + odd, words(texts + odd)):
        assert list(memoryview(ids).cast("I")) == tk.encode(text, add_special_tokens=False).ids


def check_packing(rows, size):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing_of_odd_documents(odd):
    size = 64
    rows = packing.packed_documents(odd, WORDS, size=size).collect()
    used = check_packing(rows, size)
    assert used <= -(-sum(r["length"] for r in rows) // size) + 1
    tk = Tokenizer.from_file(WORDS)
    want = []
    for i, t in ODD:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), k // size, k, len(cut := ids[k:k + size]), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))) for k in range(0, len(ids), size)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_packing_keeps_ids_and_takes_no_rows(none, make_docs):
    assert packing.packed_documents(none, WORDS).count() == 0
    row = packing.packed_documents(make_docs([(1, "the cat")]), WORDS, keep_ids=True).first()
    assert zlib.crc32(bytes(row["ids"])) == row["ids_crc32"]


def test_genetic_packing_beats_its_first_packings():
    import numpy as np

    # Triplets that fill a bin exactly: best fit alone wastes bins.
    rng = np.random.default_rng(1)
    lengths = []
    for _ in range(60):
        a = int(rng.integers(380, 480))
        b = int(rng.integers(255, 1000 - a - 250))
        lengths += [a, b, 1000 - a - b]
    first = packing.evolve([], lengths, 1000, 6, 0, np.random.default_rng(2))
    later = packing.evolve([], lengths, 1000, 6, 60, np.random.default_rng(2))
    for p in later:
        assert sorted(i for b in p for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 1000 for b in p)
    assert len(later[0]) < len(first[0])


def test_blocks_and_second_round(spark, monkeypatch):
    import random

    monkeypatch.setattr(packing, "BLOCK_ITEMS", 60)
    rng = random.Random(4)
    lengths = [rng.randint(1, 90) for _ in range(500)] + [100] * 7
    rows = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id INT, length BIGINT"), 100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    used = check_packing(rows, 100)
    assert used <= 1.05 * sum(lengths) / 100 + 1


def test_bad_lengths_are_refused(spark):
    with pytest.raises(Exception, match="out of range"):
        packing.pack(spark.createDataFrame([(1, 101)], "doc_id INT, length BIGINT"), 100).collect()
