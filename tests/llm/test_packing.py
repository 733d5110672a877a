import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wayfowl.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_library():
    odd = ["", " ", "Don't we'll I'M", "a,b;c. (x) !!!", "H̱ é É x　y", "ǅ İstanbul ß 12345 3rd", "<|endoftext|> x", "日本語 😀", "word... Word, WORD! word", "\x1cq\x85z", "ﬁ ½ x²"]
    lib, own = library(), packing.WordTokens(PATH)
    for text, ids in zip(odd * 2, own.batch([t.encode() for t in odd * 2]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_is_bounded_by_bytes_and_other_tokenizers_are_left_to_the_library():
    rng, lib = np.random.default_rng(5), library()
    own = packing.WordTokens(PATH, memo_size=60_000)
    for _ in range(40):
        text = " ".join("".join(rng.choice(list("abcdeXY.é"), int(rng.choice((3, 8, 200))))) for _ in range(50))
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        assert own.size <= 60_000 and max(map(len, own.memo), default=0) <= packing.MEMO_BYTES
    special = Tokenizer.from_file(PATH)
    assert np.frombuffer(packing.WordTokens(PATH, special_tokens=True).ids(b"a <|endoftext|> b"), "<u4").tolist() == special.encode("a <|endoftext|> b", add_special_tokens=False).ids
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    text = "The end,  of\nthe <|x|> day"
    assert np.frombuffer(packing.WordTokens(path).ids(text.encode()), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_packing_is_tight_and_valid():
    rng = np.random.default_rng(0)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1.2, 4000).astype(int) + 1)
    bins, offsets = packing.sum_of_squares(lengths)
    order = np.lexsort((offsets, bins))
    ends = offsets[order] + lengths[order]
    new = np.concatenate(([True], np.diff(bins[order]) > 0))
    assert (offsets[order][new] == 0).all() and (offsets[order][~new] == ends[:-1][~new[1:]]).all() and ends.max() <= 4096
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 4096 + 1


def test_each_choice_has_the_smallest_sum_of_squares():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 21, 60)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    gaps: dict[int, int] = {}

    def total(g):
        return sum(x * x for x in np.bincount([v for v in g.values() if v], minlength=1))

    for i in np.argsort(-lengths, kind="stable"):
        s, fits = int(lengths[i]), [b for b, g in gaps.items() if g >= lengths[i]]
        if fits:
            assert total(gaps | {int(bins[i]): gaps[int(bins[i])] - s}) == min(total(gaps | {b: gaps[b] - s}) for b in fits)
            gaps[int(bins[i])] -= s
        else:
            assert int(bins[i]) not in gaps
            gaps[int(bins[i])] = 20 - s


def test_query_keeps_every_token(spark, sf):
    rows = packing.op6_sum_of_squares_packing(spark, sf).toPandas()
    lib = library()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = [*lib.encode(r.text, add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p : p + 4096], "<u4")
            want[r.doc_id, p // 4096] = (p, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows.itertuples()} == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 4096 + 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a b", 5), (2, "", 5), (2, "", 5), (3, "z " * 10_000, None)], "doc_id long, text string, piece int")
    got = packing.pack_documents(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == [(0, 0, 3), (1, 0, 1), (2, 0, 1), (2, 0, 1), (3, 0, 4096), (3, 1, 4096), (3, 2, 10_001 - 8192)]
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
