import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from wayfowl.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_transducer_equals_the_library_on_odd_texts():
    lib, own, rng = library(), bpe.ByteBpe(bpe.load_ranks(PATH)), random.Random(5)
    words = ["the", "Ausführung", "ñandú", "naïve", "12345", "don't", "we'll", "!!!", "\n", "\n\n ", " ", "  ", "\t", "日本語", "😀", "\x1c", "\x85", "　", "é", "aaaa", "()", "x" * 60, "'s"]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 14)))
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text), repr(text)
        assert "".join(own.decode_stream(ids)) == text
    for _ in range(1500):
        piece = "".join(rng.choice("abetinrsoäé") for _ in range(rng.randint(1, 40)))
        assert list(own.fst.encode(piece.encode())) == lib.encode_ordinary(piece), piece


def test_tokens_come_out_after_bounded_lookahead():
    fst = bpe.MergeTransducer(bpe.load_ranks(PATH))
    state, longest = fst.start, max(map(len, fst.ranks))
    for byte in b"internationalisation" * 200:
        state, token, length = fst.step(state, byte)
        assert len(fst.bytes_of[token]) == length and max(node.depth for node in state.nodes) < longest


def test_a_long_piece_of_varied_letters_stays_within_the_memory():
    rng = random.Random(8)
    piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    fst = bpe.MergeTransducer(bpe.load_ranks(PATH), memo_states=5000)
    assert fst.encode(piece.encode()) == library().encode_ordinary(piece)
    assert len(fst.states) <= 5000


def test_memories_are_bounded_by_bytes():
    rng, lib = random.Random(3), library()
    own = bpe.ByteBpe(bpe.load_ranks(PATH), memo_size=200_000)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcdefgh日本語") for _ in range(rng.choice((5, 9, 300)))) for _ in range(60))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode_ordinary(text)
        assert own.size <= 200_000 and all(len(k) <= bpe.MEMO_BYTES for k in own.new)


def test_utf8_stream_takes_any_cut():
    data = "aé日😀\n".encode() * 3
    for size in range(1, 9):
        s = bpe.Utf8Stream()
        assert "".join([s.feed(data[i : i + size]) for i in range(0, len(data), size)] + [s.close()]) == data.decode()
    s = bpe.Utf8Stream()
    assert s.feed(b"a\xf0\x9f") + s.close() == "a�"


def test_query_equals_the_library(spark, sf):
    lib = library()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op8_byte_bpe(spark, sf).collect()}
    assert got == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "", 5), (2, "", 5), (3, "z" * 200_000 + " é", None)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens) for r in bpe.round_trip_digests(docs, PATH).collect()}
    assert {(1, 0), (None, 2), (2, 0)} < got
    back = {r.doc_id: r.text for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    assert back == {1: "", None: "a b", 2: "", 3: "z" * 200_000 + " é"}
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0
