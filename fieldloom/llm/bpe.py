"""Byte-level BPE encoding and decoding by a monoid tree reduction.

A piece (one match of the splitting pattern) is encoded by halves: each half is encoded, and neighbours are joined by
re-encoding a window of tokens around the seam. The window doubles until the pairs (last token left of it, first token in
it) and (last token in it, first token right of it) are both stable, that is, until the two tokens of each pair encode to
themselves. A token sequence whose adjacent pairs are all stable is the encoding of its bytes (given that every
token encodes to itself), so tokens outside the window cannot change. Pieces are independent; the tokens of a
text are the concatenation over its pieces, and decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import each, kept_for, without

LEAF = 24  # bytes encoded directly
HELD = 100_000  # pieces kept by a worker in each of two generations


class Coder:
    """Ranks and pattern of one vocabulary, with the pieces met lately."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        # the splitting pattern's \s is Unicode's White_Space, which leaves out the separators 0x1c to 0x1f
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.packed = _Recent(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes())

    def merge(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        ranks = self.ranks
        if len(data) <= 2 * LEAF:
            parts = [data[i : i + 1] for i in range(len(data))]
            found = [ranks.get(a + b, 1 << 31) for a, b in zip(parts, parts[1:])]
            while found and (low := min(found)) < 1 << 31:
                i = found.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del found[i]
                if i < len(found):
                    found[i] = ranks.get(parts[i] + parts[i + 1], 1 << 31)
                if i:
                    found[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 31)
            return [ranks[p] for p in parts]
        end = list(range(1, len(data) + 1))  # of the part that starts here; 0 once it is merged away
        before = list(range(-1, len(data) - 1))
        heap = [(r, i, i + 2) for i in range(len(data) - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= len(data) or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < len(data):
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < len(data):
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, a: int, b: int) -> bool:
        found = self.stable_pairs.get((a, b))
        if found is None:
            if len(self.stable_pairs) > HELD:
                self.stable_pairs.clear()
            found = self.stable_pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of two neighbours' bytes, from the tokens of each."""
        if not left or not right:
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            seam = self.merge(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.stable(left[i - 1], seam[0])) and (j == len(right) or self.stable(seam[-1], right[j])):
                return left[:i] + seam + right[j:]
            k *= 2

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data) if data else []
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.split(text))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        ids, token = np.frombuffer(packed, "<u4").tolist(), self.tokens.__getitem__
        return b"".join(b"".join(map(token, ids[i : i + 4096])) for i in range(0, len(ids), 4096))


class _Recent(dict):
    """Values by key, made when missing; two generations bound the memory."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= HELD:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 256:
            self[key] = value
        return value


def _coder(shared, pattern: str) -> Coder:
    """One coder per worker process and vocabulary."""
    key, coders = (hash(shared.value), pattern), kept_for("bpe")
    if key not in coders:
        coders[key] = Coder(shared.value, pattern)
    return coders[key]


class ByteBPE:
    """Column functions for one rank file. Its bytes are broadcast: their size is that of the vocabulary."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())

        def encode(texts: pa.Array) -> pa.Array:
            run = _coder(shared, pattern).encode
            return pa.array([run(t) for t in each(texts)], pa.binary())

        def decode(ids: pa.Array) -> pa.Array:
            run = _coder(shared, pattern).decode
            return pa.array([run(v) for v in each(ids)], pa.binary())

        def unpack(ids: pa.Array) -> pa.Array:
            values = [np.frombuffer(v, "<u4").astype(np.int32) for v in each(ids)]
            ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.empty(0, np.int32)])))

        def pack(ids: pa.Array) -> pa.Array:
            return pa.array([np.array(v or [], "<u4").tobytes() for v in each(ids)], pa.binary())

        def both(texts: pa.Array) -> pa.Array:
            run = _coder(shared, pattern)
            ids = [run.encode(t) for t in each(texts)]
            parts = [pa.array(ids, pa.binary()), pa.array([run.decode(v) for v in ids], pa.binary())]
            return pa.StructArray.from_arrays(parts, ["token_ids", "decoded"])

        self._both = F.arrow_udf(both, "token_ids binary, decoded binary")
        self._encode, self._decode = F.arrow_udf(encode, "binary"), F.arrow_udf(decode, "binary")
        self._unpack, self._pack = F.arrow_udf(unpack, "array<int>"), F.arrow_udf(pack, "binary")

    def encode_packed(self, text: Column) -> Column:
        """Ids as binary, four little-endian bytes each; empty for null."""
        return self._encode(text.cast("string"))

    def encode(self, text: Column) -> Column:
        """Ids as array<int>; empty for null."""
        return self._unpack(self.encode_packed(text))

    def round_trip(self, text: Column) -> Column:
        """Struct of packed ids and of the bytes decoded from them, in one pass over the text."""
        return self._both(text.cast("string"))

    def decode_packed(self, ids: Column) -> Column:
        """The bytes of packed ids."""
        return self._decode(F.coalesce(ids, F.lit(b"")))

    def decode(self, ids: Column) -> Column:
        """The text of array<int> ids; empty for null. An id that the vocabulary lacks fails the job."""
        return self.decode_packed(self._pack(ids)).cast("string")


def encoded(docs: DataFrame, coder: ByteBPE, *, text_col: str = "text") -> DataFrame:
    """docs with token_ids (packed), n_tokens and decoded (bytes of the decoded ids).

    A null text counts as empty and has no tokens. Texts are encoded whole; no special token is added or
    recognised. Input columns named like an added one are replaced; repeated rows are encoded each; an empty table
    gives an empty result.
    """
    base = without(docs, "token_ids", "n_tokens", "decoded")
    names = [F.col(f"`{c}`") for c in base.columns]
    made = docs.select(*names, coder.round_trip(F.col(f"`{text_col}`")).alias("__made"))
    return made.select(
        *names, "__made.token_ids", F.expr("cast(octet_length(__made.token_ids) div 4 as long)").alias("n_tokens"), "__made.decoded"
    )
