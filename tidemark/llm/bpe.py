"""BPE encoding and decoding.

Encoding finds, in each piece of the pre-tokenised text, the longest vocabulary match at every place with an
Aho-Corasick automaton and walks it with backtracking: a token is accepted only if the pair with the token before
it is compatible, that is, if merging their joint bytes by the merge rules gives just these two. The result is the
merge result, in time linear in the piece. Decoding gathers bytes through an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder for a byte-level vocabulary file."""

    def __init__(self, path: str, most_cached: int = 250_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.token = {i: raw(s) for s, i in spec["model"]["vocab"].items()}
        ids = {t: i for i, t in self.token.items()}
        self.byte = [ids[bytes([b])] for b in range(256)]
        self.merged, self.parts = {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            got = ids[a + b]
            self.merged.setdefault((ids[a], ids[b]), (rank, got))
            self.parts.setdefault(got, (rank, ids[a], ids[b]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for s, i in self.special.items():
            self.token[i] = s.encode()
        # Only tokens that the merge rules make out of their own bytes can be in a result.
        self.forward = ahocorasick.Automaton()
        for t, i in ids.items():
            if len(t) == 1 or i in self.parts:
                self.forward.add_word(t[::-1].decode("latin-1"), (i, len(t)))
        self.forward.make_automaton()
        self.shorter = self._shorter(ids)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.most = most_cached
        self.pieces = regex.compile(PIECES)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        n = max(self.token) + 1
        sizes = np.array([len(self.token.get(i, b"")) for i in range(n)], np.int64)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(n)), np.uint8)

    def _shorter(self, ids: dict[bytes, int]) -> dict[int, int]:
        """Of each token, the next shorter token that is its prefix."""
        out = {}
        for t, i in ids.items():
            for k in range(len(t) - 1, 0, -1):
                if (j := ids.get(t[:k])) is not None and (k == 1 or j in self.parts):
                    out[i] = j
                    break
        return out

    def compatible(self, a: int, b: int) -> bool:
        """True if the bytes of ``a`` then ``b`` merge to just these two tokens.

        Undo merges from the latest inwards, looking for one across the border that would have come first.
        """
        key = (a, b)
        if (known := self.pairs.get(key)) is not None:
            return known
        limit, left, right = 1 << 60, a, b
        while True:
            if (m := self.merged.get((left, right))) is not None and m[0] < limit:
                ok = False
                break
            pl, pr = self.parts.get(left), self.parts.get(right)
            if pl is None and pr is None:
                ok = True
                break
            if pr is None or (pl is not None and pl[0] > pr[0]):
                limit, left = pl[0], pl[2]
                if (m := self.merged.get((left, right))) is not None and m[0] < limit:
                    ok = False
                    break
            else:
                # The right token's merge is undone; an equal rank is done from the left first.
                limit, right = pr[0] + 1, pr[1]
                if (m := self.merged.get((left, right))) is not None and m[0] < limit:
                    ok = False
                    break
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def longest(self, piece: bytes) -> list[int]:
        """The longest token that starts at each byte."""
        n, best, size = len(piece), [0] * len(piece), [0] * len(piece)
        for end, (i, k) in self.forward.iter(piece[::-1].decode("latin-1")):
            start = n - 1 - end
            if k > size[start]:
                best[start], size[start] = i, k
        return best

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece."""
        n, first = len(piece), self.longest(piece)
        dead, out, at, token = bytearray(n + 1), [], 0, first[0]
        while True:
            end = at + len(self.token[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = first[at]
                continue
            nxt = self.shorter.get(token)
            while nxt is None:  # nothing fits here: go back over the token before
                dead[at] = 1
                last = out.pop()
                at -= len(self.token[last])
                nxt = self.shorter.get(last)
            token = nxt

    def _piece_ids(self, text: str) -> bytes:
        found = []
        for p in self.pieces.findall(text):
            found += self.encode_piece(p.encode())
        return np.array(found, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. Words split at single spaces are independent pieces."""
        cache = self.cache
        if len(cache) > self.most:
            cache.clear()
        words = text.split(" ")
        if any(not w or w[0].isspace() or w[-1].isspace() for w in words):
            units = regex.findall(r" ?\S+|\s+(?!\S)|\s+", text)
        else:
            units = [words[0], *[f" {w}" for w in words[1:]]]
        out = []
        for u in units:
            if (got := cache.get(u)) is None:
                got = self._piece_ids(u)
                if len(u) < 200:
                    cache[u] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers; a special token's string gives its id."""
        if not text:
            return np.empty(0, "<u4")
        if self.split is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        parts = []
        for part in self.split.split(text):
            if part in self.special:
                parts.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                parts.append(self._plain(part))
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that are no UTF-8 become the replacement character."""
        if not len(ids):
            return ""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.blob[at].tobytes().decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """One encoder for each vocabulary file and worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, *, with_ids: bool = False) -> DataFrame:
    """Encode and decode whole texts.

    In: doc_id, text. Out, a row for each input row: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit), decoded_sha256, and with ``with_ids`` the ids as an array. A null or empty text has no tokens. Other
    columns are ignored. ``vocabulary`` is a path that workers can read (an installed package's data file).
    """
    common.ship_code(docs.sparkSession)
    common.quiet_arrow(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            n, ids_sha, text_sha, arrays = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    arrays.append(ids.astype(np.int32))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(arrays, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
