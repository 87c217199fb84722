import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from veridoc.llm import bpe, pretokenize, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a" * 1000, "ab" * 400 + "é" * 300, "!" * 999, "中文" * 300, "it's 'twas we'll 'll 're''s", "  two\n\n three \t ", "　x y", "<|endoftext|>", "Ᲊ\U00010d40\U00013460", "𝟘𝟙 ½", "\0nul"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_pieces_are_those_of_the_pattern():
    random.seed(1)
    signs = ["a", "s", "t", "r", "e", "v", "l", "m", "d", "S", "'", "'", "'", "1", "²", "!", ".", "\n", "\t", "é", "　", "中", " ", " ", " "]
    texts = ["".join(random.choices(signs, k=random.randint(0, 60))) for _ in range(5000)] + ["x" * 300 + " " * 300]
    joined, first, end, upto = pretokenize.pieces(texts)
    found = [joined[a:b] for a, b in zip(first.tolist(), end.tolist())]
    at = 0
    for text, stop in zip(texts, upto.tolist()):
        assert found[at:stop] == regex.findall(public_tokenizers.PATTERN, text)
        at = stop


def test_classes_are_the_librarys(library):
    split = Tokenizer.from_file(JSON).pre_tokenizer.pre_tokenize_str
    table = pretokenize.classes()
    random.seed(2)
    codes = [*range(0x3100), *random.sample(range(0x3100, 0x20000), 4000)]
    for code in codes:
        if 0xD800 <= code <= 0xDFFF:
            continue
        mark = chr(code)
        kind = pretokenize.LETTER if len(split("x" + mark)) == 1 else pretokenize.NUMBER if len(split("1" + mark)) == 1 else pretokenize.SIGN if len(split("!" + mark)) == 1 else pretokenize.SPACE
        own = table[code]
        own = pretokenize.LETTER if own >= pretokenize.C_STMD else pretokenize.SIGN if own == pretokenize.APOSTROPHE else pretokenize.SPACE if own == pretokenize.OTHER_SPACE else own
        assert own == kind, hex(code)


def test_ids_and_round_trip(library, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    for text in texts:
        ids, offsets = bpe.encode(text, RANKS, offsets=True)
        assert ids.tolist() == library.encode_ordinary(text)
        assert bpe.decode(ids, RANKS) == text.encode()
        if len(ids) > 3:
            assert bpe.decode(ids[2:], RANKS) == text.encode()[offsets[2] :]
    assert bpe.encode(None, RANKS).tolist() == []


def test_long_pieces_merge_alike():
    ranks = bpe.load_ranks(RANKS)
    random.seed(3)
    for n in (2, 9, 33, 150):
        piece = "".join(random.choices("abcdetion", k=n)).encode()
        assert bpe._merge_long(piece, ranks) == bpe.merge(piece, ranks)
        if n <= 32 and piece not in ranks:
            assert np.frombuffer(bpe.Merger(ranks).pairs.merge_all([piece], 32)[0], "<u4").tolist() == bpe.merge(piece, ranks)


def test_a_full_cache_is_emptied():
    cache = bpe.PieceCache(lambda new: [p.encode() for p in new], entries=3)
    for words in (["a", "b"], ["c", "d"], ["a", "b", "c", "d", "e"]):
        assert cache.ids(words) == [w.encode() for w in words] and len(cache) <= 3


def test_operator(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "y"), (90, None, "z"), (90, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = bpe.round_trip_digests(docs, RANKS).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 90:
            ids = library.encode_ordinary(ODD[r.doc_id])
            assert r.n_tokens == len(ids) and r.lossless
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(ODD[r.doc_id].encode()).hexdigest()
    encoded = bpe.bpe_encode(docs, RANKS)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.bpe_decode(encoded, RANKS).collect()}
    assert back[1] == ODD[1].encode() and back[90] == b""
    assert bpe.round_trip_digests(docs.where("false"), RANKS).count() == 0


def test_token_files(spark, tmp_path):
    import zlib

    import pyarrow.fs as pafs

    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    random.seed(4)
    texts = ODD + [" ".join(random.choices(["the", "of", "tion", "Wörter", "1999"], k=900)) for _ in range(30)]
    order = random.sample(range(len(texts)), len(texts))
    docs = spark.createDataFrame([(i, texts[i], 0) for i in order] + [(100, None, 0)], "doc_id long, text string, start int")
    manifest = token_files.write_token_files(docs, f"file://{tmp_path}/t", JSON, sequence=128)
    found = token_files.read_token_files(manifest).orderBy("doc_id").collect()
    expected = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in [*texts, ""]]
    start = 0
    for r, ids in zip(found, expected, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    name = manifest.orderBy("part").first()
    file = token_files.SequenceFile(pafs.LocalFileSystem(), name.file.removeprefix("file://") + ".arrow")
    flat = [i for ids in expected for i in ids]
    last = (name.n_tokens - 1) // 128
    assert file.sequence_at(1).tolist() == flat[128:256]
    assert file.mask_at(last).true_count == name.n_tokens - 128 * last and file.mask_at(0).true_count == 128
    view = file.sequence_at(0)
    assert not view.flags.owndata and not view.flags.writeable  # no copy of the mapped file
    empty = token_files.write_token_files(docs.where("false"), f"file://{tmp_path}/e", JSON)
    assert token_files.read_token_files(empty).count() == 0


def test_token_files_with_added_tokens(spark, tmp_path):
    import zlib

    library = Tokenizer.from_file(JSON)
    texts = ["a<|endoftext|>b", *ODD, "<|endoftext|><|endoftext|> it's", "<|endoftext| >", "x <|endoftext|>\n\ny" * 50, "after"]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/sf/documents.parquet")
    found = token_files.op7_token_files(spark, f"{tmp_path}/sf").orderBy("doc_id").collect()
    start = 0
    for r, text in zip(found, texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pairs_of_a_vocabulary_beyond_16_bits():
    ranks = {bytes([i]): i for i in range(256)} | {bytes([i, j]): 256 + 256 * i + j for i in range(256) for j in range(256)}
    ranks |= {b"abcd": 70_000, b"abcdef": 1_000_000}
    table = bpe.PairTable(ranks)
    left = np.array([ranks[b"ab"], ranks[b"abcd"], 97, ranks[b"cd"]], np.int32)
    right = np.array([ranks[b"cd"], ranks[b"ef"], 98, 97], np.int32)
    assert table.look_up(left, right).tolist() == [70_000, 1_000_000, ranks[b"ab"], table.NONE]
