"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1, so an Aho-Corasick automaton over all tokens finds every token in a
piece in one pass. The encoding of a piece is built left to right from the longest token at each
place; a token may follow another only if the exact merges would leave that pair as it is, which is
memoised per pair; if no token fits, the last one is taken back and a shorter one tried, and places
from which no encoding goes on are never tried again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import os
import re
from functools import cache
from itertools import chain

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from trailmark.llm.common import map_texts, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# Pieces whose ids a worker remembers.
REMEMBERED = 200_000

# Characters on which the standard library's classes agree with the pattern's: tab, line feed,
# carriage return, printable ASCII, and Latin letters up to U+024F.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER = re.compile(f"[^\\t\\n\\r -~{_LATIN}]")
_QUICK = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+"
)


class Memo(dict):
    """Ids of pieces seen lately: two generations of at most REMEMBERED pieces."""

    def __init__(self, work):
        self.work, self.older = work, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        ids = self[piece] = self.older.get(piece) or self.work(piece)
        return ids


class Encoder:
    """Exact merges of a rank file; ``ranks`` maps token bytes to ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.decimals = {i: str(i) for i in self.tokens}
        self.pattern = regex.compile(pattern).findall
        self.latin = _QUICK.findall if pattern == public_tokenizers.PATTERN else self.pattern
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.sizes = {i: len(t) for t, i in ranks.items()}
        # the next shorter token that begins like a token
        self.shorter = {
            i: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), None)
            for t, i in ranks.items()
        }
        # the last merge that makes each token, None for a token that no merge makes
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.tokens):
            t = self.tokens[i]
            pair = None
            if len(t) > 1:
                ids = self._merged(t, i)
                if len(ids) == 2:
                    pair = (ids[0], ids[1])
                    self.merges[pair] = i
            self.halves[i] = pair
        self.memo = Memo(self.piece)

    def _merged(self, piece: bytes, limit: int) -> list[int]:
        """Plain merges of a token by the ranks below its own."""
        parts = [bytes([b]) for b in piece]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = limit, -1
            for k in range(len(parts) - 1):
                r = ranks.get(parts[k] + parts[k + 1], limit)
                if r < best:
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _stays(self, left: int, right: int) -> bool:
        """Whether the merges of left + right end with exactly these two tokens.

        The merges are undone from the latest to the earliest. At no moment may the two tokens at
        the border have a merge of their own that comes before the next one on either side.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, bound = left, right, len(self.ranks) + 1
        good = True
        while True:
            joined = self.merges.get((a, b))
            if joined is not None and joined < bound:
                good = False
                break
            parts_a, parts_b = self.halves[a], self.halves[b]
            if parts_a is None and parts_b is None:
                break
            # undo the later of the two merges; of two equal ones the right one came later
            if parts_b is None or (parts_a is not None and a > b):
                bound, a = a, parts_a[1]
            else:
                bound, b = b + 1, parts_b[0]
        self.fits[(left, right)] = good
        return good

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        raw = text.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return (whole,)
        latin = raw.decode("latin-1")
        fits, stays, matches = self.fits, self._stays, self.automaton.iter_long
        ids = [token for _, token in matches(latin)]
        for k, pair in enumerate(zip(ids, ids[1:])):
            if not (fits[pair] if pair in fits else stays(*pair)):
                break
        else:  # every longest token may follow the one before it
            return tuple(ids)
        sizes, shorter, n = self.sizes, self.shorter, len(raw)
        token = ids[k + 1]
        del ids[k + 1 :]
        at = sum(map(sizes.__getitem__, ids))
        dead = set()  # places from which no encoding goes on
        while True:
            to = at + sizes[token]
            if to not in dead:
                pair = (ids[-1], token) if ids else None
                if pair is None or (fits[pair] if pair in fits else stays(*pair)):
                    ids.append(token)
                    if to == n:
                        return tuple(ids)
                    at = to
                    token = next(matches(latin, at))[1]
                    continue
            token = shorter[token]
            while token is None:
                dead.add(at)
                last = ids.pop()
                at -= sizes[last]
                token = shorter[last]

    def encode(self, text: str) -> list[int]:
        pieces = (self.pattern if _OTHER.search(text) else self.latin)(text)
        return list(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One per worker process; the file is part of the installed tokenizers on every machine."""
    made = Encoder(read_ranks(path), pattern)
    # its tables hold no cycles; walking them again and again would take a quarter of the time
    gc.freeze()
    gc.set_threshold(1_000_000)
    return made


def _digests(texts: list[bytes], path: str) -> dict[str, list]:
    coder = encoder(path)
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for t in texts:
        ids = coder.encode(t.decode())
        out["n_tokens"].append(len(ids))
        listed = ",".join(map(coder.decimals.__getitem__, ids))
        out["ids_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
    return out


def encode_digests(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """Columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256 (after a full round trip)."""
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, keep, added, lambda ts: _digests(ts, path))


def encode(docs: DataFrame, keep: list[str], path: str) -> DataFrame:
    """Columns ``keep`` with the ids of each whole text as ``tokens`` array<int>; null is empty."""

    def work(ts):
        coder = encoder(path)
        return {"tokens": [coder.encode(t.decode()) for t in ts]}

    return map_texts(docs, keep, "tokens array<int>", work)


def decode(frame: DataFrame, path: str, column: str = "tokens") -> DataFrame:
    """``frame`` with the text of ``column`` as ``decoded`` (binary); null ids give null."""

    @F.pandas_udf(BinaryType())
    def texts(ids):
        coder = encoder(path)
        return ids.map(lambda x: None if x is None else coder.decode(x))

    return frame.withColumn("decoded", texts(F.col(column)))


def vocabulary(name: str = VOCABULARY) -> str:
    return os.path.realpath(public_tokenizers.path(name))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document.

    Null and empty texts have no ids, so their digests are that of the empty string; repeated rows
    each get a row; an empty table gives none.
    """
    return encode_digests(table(spark, sf_dir, "documents"), ["doc_id"], vocabulary())
