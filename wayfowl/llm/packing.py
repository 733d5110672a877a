"""Sum-of-squares packing of tokenised documents into sequences.

Documents are tokenised (then closed by an end id), cut only if they are longer than a sequence, and the pieces are packed:
each goes where the sum of the squared numbers of open sequences per residual gap becomes smallest. Pieces are dealt into
groups of a bounded size by a hash of their id; each group is packed by one task on lengths alone, so that token ids are
never shuffled. A group's partly filled sequences are the only loss against one global packing.

Defined cases: null text counts as empty (one piece of one token, the end id); repeated rows are packed as pieces of their
own; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import remembered, short_batches, table, text_bytes, written

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs. Fixed: more input gives more groups, not larger ones.
GROUP_PIECES = 32768
#: Bytes of memory (with what Python needs for an entry) that remembered ids of words take at most, and the longest word that is
#: remembered. When half of that is new, the older half goes.
MEMO_SIZE = 224 << 20
MEMO_BYTES = 64
ENTRY = 200


class WordTokens:
    """The tokenizer's ids of whole texts as little-endian unsigned 32-bit integers. Where its pre-tokenizer drops white space and
    never joins text across it (a probe tells), ids of white-space separated words are remembered and joined; otherwise texts are
    encoded whole. The strings of special tokens are ordinary text unless special_tokens is set."""

    def __init__(self, path: str, memo_size: int = MEMO_SIZE, special_tokens: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_tokens
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_words = not special_tokens and all(plain(f"{a}{gap}{b}") == plain(a) + plain(b) for a in ("the", "x.", "7") for b in ("other", "(y", "8") for gap in (" ", "\n", " \t "))
        self.memo: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.memo_size, self.size = memo_size, 0

    def ids(self, text: bytes) -> bytes:
        return self.batch([text])[0]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        if self.size > self.memo_size // 2:
            self.memo, self.old, self.size = {}, self.memo, 0
        get, out, late = self.memo.__getitem__, [], []
        for text in texts:
            words = text.split()  # at ASCII white space, which every definition of white space has
            try:
                out.append(b"".join(map(get, words)))
            except KeyError:
                late.append((len(out), words))
                out.append(b"")
        if len(self.tails) > 10_000:
            self.tails.clear()
        if late:
            new = {w for _, words in late for w in words}.difference(self.memo)
            self._learn(new)
            for i, words in late:
                out[i] = b"".join(map(get, words))
            for w in new:
                if len(w) > MEMO_BYTES:
                    del self.memo[w]
                else:
                    self.size += len(w) + len(self.memo[w]) + ENTRY
        return out

    def _learn(self, words: set[bytes]) -> None:
        """A word of letters is looked up without the marks at its end, which are pre-tokens of their own, and if it is ASCII in
        lower case. Such words are one pre-token each: they are encoded as one text and told apart by the pre-token's number."""
        memo, old = self.memo, self.old
        memo[b""] = b""
        cores: dict[str, int] = {}
        plain, rest = [], []
        for w in words:
            if (ids := old.get(w)) is not None:
                memo[w] = ids
                continue
            text = w.decode("utf-8", "replace")
            core = text.rstrip(".,;:!?")
            if core.isalpha():
                if self.lowers and core.isascii():
                    core = core.lower()
                plain.append((w, cores.setdefault(core, len(cores)), text[len(core) :]))
            else:
                rest.append((w, text))
        if cores:
            found = self.tokenizer.encode("\n".join(cores), add_special_tokens=False)
            of, data = np.array(found.word_ids, np.int64), np.array(found.ids, "<u4").tobytes()
            if len(of) and of[-1] == len(cores) - 1:
                cuts = (np.searchsorted(of, np.arange(len(cores) + 1)) * 4).tolist()
                tails = self.tails
                for w, k, tail in plain:
                    if tail and tail not in tails:
                        tails[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids, "<u4").tobytes()
                    ids = data[cuts[k] : cuts[k + 1]]
                    memo[w] = ids + tails[tail] if tail else ids
            else:  # a letter that the normaliser turns into several pre-tokens
                rest += [(w, w.decode("utf-8", "replace")) for w, _, _ in plain]
        for (w, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            memo[w] = np.array(e.ids, "<u4").tobytes()


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def word_tokens(path: str) -> WordTokens:
    """Kept by the Python worker, which serves many tasks, until it turns to another operator."""
    return remembered(("word_tokens", path), lambda: WordTokens(path))


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        tokens = word_tokens(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.batch(text_bytes(batch, "text")), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECES.types, strict=True)], schema=_PIECES)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): what is to be packed."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length. With n[g] open bins of residual gap g, an item of length s that goes into a bin of gap g
    changes the sum of n[g] ** 2 by 2 * (n[g - s] - n[g]) + 2, or by 1 - 2 * n[g] if it fills the bin; the smallest change is
    taken, among equal ones the tightest gap. All lengths are known beforehand, so they come longest first and a bin is only
    opened where none fits: that leaves fewer bins than opening one whenever it lowers the sum."""
    n = np.zeros(capacity + 1, np.int64)  # open bins of each gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        left = np.flatnonzero(n[s:])  # what would be left of each gap that fits
        if len(left):
            change = 2 * (np.where(left > 0, n[left], 0) - n[left + s]) + np.where(left > 0, 2, 1)
            after = int(left[np.argmin(change)])
            gap = after + s
            b = stacks[gap].pop()
            n[gap] -= 1
        else:
            gap, after, b, used = capacity, capacity - s, used, used + 1
        bins[i], offsets[i] = b, capacity - gap
        if after:
            stacks[after].append(b)
            n[after] += 1
    return bins, offsets


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        group = int(pdf["grp"].iloc[0])
        return pdf.drop(columns="grp").assign(sequence_id=(group << 32) + bins, offset=offsets)

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """cut (as from pieces()) with sequence_id and offset."""
    groups = -(-max(cut.count(), 1) // group_pieces)
    short_batches(cut.sparkSession, 16384)
    # The row number keeps even copies of one row apart; cut is a written table, whose rows a repeated task numbers alike.
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(_pack_group(capacity), _PLACED)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    return pack(written(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity, end_id)), capacity, group_pieces)


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
