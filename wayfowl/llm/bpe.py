"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A merge table is compiled into a transducer that reads bytes and writes tokens. Its ground is a locality property of BPE: a
split of a text into tokens is the one that merging by rank gives exactly if each two neighbours, merged on their own, stay
as they are. So after each byte exactly one token can end there, given the tokens that end before it. A state holds the
places from which a longer token may still begin, each with the token that ends where it begins; a transition tells the token
that ends behind the byte read. No place lies further back than the longest token, so with that much lookahead all earlier
tokens are settled: they are read back from the place where all ways meet, at the end of a piece or every SETTLE_BYTES of a
long one. States and transitions are made when they are first needed and then remembered, MEMO_STATES of them at most.

Decoding joins the tokens' bytes in chunks and feeds them to an incremental UTF-8 machine, whose state is the unfinished
sequence at the end of the last chunk.

Defined cases: null text counts as empty and gives no ids; rows with a null doc_id and repeated rows are encoded like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, table

#: States that a worker remembers at most.
MEMO_STATES = 250_000
#: Bytes of memory (with what Python needs for an entry) that remembered ids of chunks and pieces take at most, and the longest
#: text that is remembered. When half of that is new, the older half goes.
MEMO_SIZE = 384 << 20
MEMO_BYTES = 64
ENTRY = 200
#: Bytes of a piece after which its settled tokens are written.
SETTLE_BYTES = 4096
DECODE_TOKENS = 8192


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Node:
    """A place in the trie of the vocabulary: the token that ends in it, or -1."""

    __slots__ = ("depth", "kids", "token")

    def __init__(self, depth: int):
        self.depth, self.kids, self.token = depth, {}, -1


class _State:
    """The places from which a longer token may still begin, earliest first: for each the node that is reached from it and the
    token that ends where it begins. The earliest node spells all text that can still matter, so histories with equal nodes and
    tokens share a state, whatever was read before. next: byte to (state, token that ends behind the byte, its length)."""

    __slots__ = ("lefts", "next", "nodes")

    def __init__(self, nodes: list[_Node], lefts: list[int]):
        self.nodes, self.lefts = nodes, lefts
        self.next: dict[int, tuple[_State, int, int]] = {}


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], memo_states: int = MEMO_STATES):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.root = _Node(0)
        self.merges: dict[int, int] = {}  # rank of what two tokens merge to
        for name, rank in ranks.items():
            node = self.root
            for byte in name:
                if (kid := node.kids.get(byte)) is None:
                    kid = node.kids[byte] = _Node(node.depth + 1)
                node = kid
            node.token = rank
            for i in range(1, len(name)):
                if (left := ranks.get(name[:i])) is not None and (right := ranks.get(name[i:])) is not None:
                    self.merges[left << 32 | right] = rank
        self.memo_states = memo_states
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.start = _State([self.root], [-1])
        self.states: dict[tuple, _State] = {}

    def parts_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this token from its bytes; (token, token) for a single byte, None if merging by rank
        (leftmost first) never arrives at it."""
        if token not in self.parts:
            at = [self.ranks[self.bytes_of[token][i : i + 1]] for i in range(len(self.bytes_of[token]))]
            last = (token, token)
            while len(at) > 1:
                rank, i = min((self.merges.get(at[i] << 32 | at[i + 1], 1 << 60), i) for i in range(len(at) - 1))
                if rank == 1 << 60:
                    last = None
                    break
                last = (at[i], at[i + 1])
                at[i : i + 2] = [rank]
            self.parts[token] = last
        return self.parts[token]

    def stay(self, left: int, right: int) -> bool:
        """Whether merging leaves these neighbours as they are; left is -1 at the start of the input. Goes back in time: the later
        made of the two tokens at the border is taken apart, and what then stood there must not have merged before."""
        parts, merges, before = self.parts, self.merges, 1 << 60
        if (parts[right] if right in parts else self.parts_of(right)) is None:
            return False
        if left < 0:
            return True
        while True:
            if merges.get(left << 32 | right, 1 << 60) < before:
                return False
            a, b = (parts.get(left) or self.parts_of(left))[1], (parts.get(right) or self.parts_of(right))[0]
            if a == left and b == right:
                return True
            if b == right or (a != left and left > right):
                before, left = left, a  # of equal ranks the left one merges first
            else:
                before, right = right + 1, b

    def step(self, state: _State, byte: int) -> tuple[_State, int, int]:
        token, length = -1, 0
        nodes: list[_Node] = []
        lefts: list[int] = []
        for node, left in zip(state.nodes, state.lefts):  # noqa: B905  # from the earliest on; exactly one token can end here
            if (node := node.kids.get(byte)) is None:
                continue
            if node.token >= 0 > token and self.stay(left, node.token):
                token, length = node.token, node.depth
            if node.kids:
                nodes.append(node)
                lefts.append(left)
        if token < 0:
            raise ValueError("the ranks lack single bytes")
        nodes.append(self.root)
        lefts.append(token)
        key = (nodes[0], *lefts)
        if (to := self.states.get(key)) is None:
            if len(self.states) >= self.memo_states:  # also within a piece: the walk goes on from here with an empty memory
                self._reset()
            to = self.states[key] = _State(nodes, lefts)
        state.next[byte] = move = (to, token, length)
        return move

    @staticmethod
    def _tokens(tokens: list[int], lengths: list[int], end: int) -> list[int]:
        """The tokens up to a place, read back from it."""
        out = []
        while end:
            out.append(tokens[end - 1])
            end -= lengths[end - 1]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one match of the splitting pattern."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        state, written = self.start, []
        tokens: list[int] = []
        lengths: list[int] = []
        for at in range(0, len(piece), SETTLE_BYTES):
            for byte in piece[at : at + SETTLE_BYTES]:
                state, token, length = state.next.get(byte) or self.step(state, byte)
                tokens.append(token)
                lengths.append(length)
            if at + SETTLE_BYTES < len(piece):
                # Where the ways to all places that still matter last meet, what comes before is settled and written.
                n = len(tokens)
                ways = {n - node.depth for node in state.nodes}
                while len(ways) > 1:
                    last = max(ways)
                    ways.remove(last)
                    ways.add(last - lengths[last - 1])
                cut = ways.pop()
                written += self._tokens(tokens, lengths, cut)
                del tokens[:cut], lengths[:cut]
        return written + self._tokens(tokens, lengths, len(tokens))


class Utf8Stream:
    """Incremental decoding: feed() takes bytes cut anywhere and gives the characters that are complete."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):  # a lead byte among the last three may open an unfinished sequence
            byte = data[-back]
            if byte >= 0xC0:
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut -= back
                break
            if byte < 0x80:
                break
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


_CUTS = re.compile(r"(?= \S)")


class ByteBpe:
    """Encodes texts by a rank file and a splitting pattern. A match of the pattern never spans the place before a space that
    a visible character follows, so texts are cut there, and the ids of each chunk are remembered, unless it is long; of long
    chunks the pieces are."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, memo_size: int = MEMO_SIZE):
        self.fst = MergeTransducer(ranks)
        self.table = [self.fst.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.findall = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.memo_size = memo_size
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.size = 0  # of what is new

    def _learn(self, text: str) -> bytes:
        """Ids of a chunk, which from now on are remembered if it is short."""
        if (ids := self.old.get(text)) is None:
            pieces = self.findall(text)
            if len(pieces) == 1:
                ids = np.array(self.fst.encode(text.encode()), "<u4").tobytes()
            else:
                ids = b"".join([self.new.get(p) or self._learn(p) for p in pieces])
        if len(text) <= MEMO_BYTES:
            self.new[text] = ids
            self.size += len(text) + len(ids) + ENTRY
        return ids

    def _joined(self, parts: list[str]) -> bytes:
        get = self.new.get
        found = list(map(get, parts))
        if None in found:
            found = [get(p) or self._learn(p) for p in parts]
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.size > self.memo_size // 2:
            self.old, self.new, self.size = self.new, {}, 0
        return self._joined(_CUTS.split(text))

    def decode_stream(self, ids: bytes) -> Iterator[str]:
        stream = Utf8Stream()
        for at in range(0, len(ids), 4 * DECODE_TOKENS):
            yield stream.feed(b"".join(map(self.table.__getitem__, np.frombuffer(ids[at : at + 4 * DECODE_TOKENS], "<u4").tolist())))
        yield stream.close()


_CODERS: dict[tuple[str, str], ByteBpe] = {}  # a Python worker serves many tasks


def coder(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _CODERS[path, pattern]


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _texts(docs: DataFrame) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids): the ids of each text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.encode(t or "") for t in batch.column("text").to_pylist()], pa.binary())], schema=_ENCODED)

    return _texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["".join(c.decode_stream(i or b"")) for i in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    short_batches(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes the ids as a stream, and digests both. Ids
    and texts stay in the task that made them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column("text").to_pylist():
                ids, digest = c.encode(text or ""), hashlib.sha256()
                for part in c.decode_stream(ids):
                    digest.update(part.encode())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], schema=_DIGESTS)

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
