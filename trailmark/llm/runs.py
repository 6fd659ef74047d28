"""Periodic runs of words, found online by sparse diagonals, and their collapse to one period.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbouring
word extends, of length max(LEAST, TIMES q) or more. Diagonal q holds the words that equal the word q
before them. For each word its earlier occurrences add one to the match lengths of their active lags;
a lag that the next word does not continue has ended, and gives its run at once if it is long enough.

Following every earlier occurrence would take n^2 / 2 steps where one word fills a text. Only one
occurrence per size 2^k of context can matter: inside a run of period q with 2^k the first power of
two not under q, the nearest earlier place with the same 2^k words is exactly q before (a nearer one
would give the run a smaller period), and a run of four periods is long enough to show it. So lag q is
active at a word only if the 2^k words that end there stood last q words before; q in (2^(k-1), 2^k].
This is exact, and takes n log n steps for any text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import map_texts, slices, table

# A run has at least so many words, and so many times its period.
LEAST = 6
TIMES = 4

_SPACE = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:long,length:long,period:long>>"

Run = tuple[int, int, int]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal ``keys``, and for each place the nearest earlier place of the same key (-1: none)."""
    order = np.argsort(keys, kind="stable")
    same = np.empty(len(keys), bool)
    same[:1] = False
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    numbers = np.empty(len(keys), np.int64)
    numbers[order] = np.cumsum(~same)
    before = np.full(len(keys), -1, np.int64)
    before[order[1:][same[1:]]] = order[:-1][same[1:]]
    return numbers, before


def _active(words: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, matched) sorted by place: lags that are active at a word, and the words of context
    that are known to match there. ``words`` numbers equal words of one text alike, texts laid end to
    end; ``room`` is the length of each word's text."""
    found = []
    at = np.arange(len(words))  # ends of blocks that stand elsewhere too
    numbers = words
    size, k = 1, 0
    while len(at):
        numbers, before = _ranked(numbers)
        lag = at - at[before]
        hit = (before >= 0) & (lag <= size) & (2 * lag > size)
        found.append((at[hit], lag[hit], np.full(hit.sum(), size)))
        # blocks of twice the words: both halves must stand elsewhere, in texts long enough for the lag
        live = before >= 0
        live[before[live]] = True
        live &= room[at] >= TIMES * (size + 1)
        at, numbers = at[live], numbers[live]
        half = np.searchsorted(at, at - size)
        both = at[np.minimum(half, len(at) - 1)] == at - size if len(at) else np.zeros(0, bool)
        numbers = numbers[half[both]] * (numbers.max(initial=0) + 1) + numbers[both]
        at = at[both]
        size, k = 2 * size, k + 1
    places, lags, sizes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(places, kind="stable")
    return places[order], lags[order], sizes[order]


def _emitted(places: np.ndarray, lags: np.ndarray, sizes: np.ndarray) -> Iterator[Run]:
    """The online pass: (start, length, period) in order of the word that ends each run."""
    active: dict[int, int] = {}  # lag: match length up to the word before
    last = -2

    def ended(at: int, left: dict[int, int]) -> Iterator[Run]:
        for lag, matched in left.items():
            if matched + lag >= max(LEAST, TIMES * lag):
                yield at + 1 - matched - lag, matched + lag, lag

    now: dict[int, int] = {}
    for place, lag, size in zip(places.tolist(), lags.tolist(), sizes.tolist()):
        if place != last:
            yield from ended(last - 1, active)
            active, now = now, {}
            if place != last + 1:
                yield from ended(last, active)
                active = {}
            last = place
        # a lag that goes on gains this word; a new one starts with the context it matches
        now[lag] = active.pop(lag, size - 1) + 1
    yield from ended(last - 1, active)
    yield from ended(last, now)


def find_runs(texts: list[list]) -> list[list[Run]]:
    """All runs of each text, given as its words, by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    numbers: dict = {}
    words = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(lengths.sum())
    )
    owner = np.repeat(np.arange(len(texts)), lengths)
    out: list[list[Run]] = [[] for _ in texts]
    if len(words):
        room = lengths[owner]
        # equal words of different texts are different words, so nothing matches across a border
        for start, length, period in _emitted(*_active(words * len(texts) + owner, room)):
            o = int(owner[start])
            out[o].append((start - int(starts[o]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """The words but those that a run holds after its first period."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, x in zip(words, gone) if not x] if runs else words


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _runs_of(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[Run]]]:
    for a, b in slices(texts):
        # bytes: the pattern's white space is exactly what bytes.split() splits at
        words = [t.split() for t in texts[a:b]]
        yield from zip(words, find_runs(words))


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``runs`` (by start, then period) and ``collapsed``, the text's kept
    words joined by one space.

    Null and empty texts have no runs and collapse to the empty string; repeated rows each get a
    row; an empty table gives none. Texts are read whole, without a bound on a period.
    """

    def work(texts):
        out = {"runs": [], "collapsed": []}
        for words, runs in _runs_of(texts):
            out["runs"].append([dict(zip(("start", "length", "period"), r)) for r in runs])
            out["collapsed"].append(b" ".join(collapsed(words, runs)).decode("utf-8", "replace"))
        return out

    return map_texts(docs, keep, f"runs {RUNS}, collapsed string", work, text)


def _digest(texts: list[bytes]) -> dict[str, list]:
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    out: dict[str, list] = {n: [] for n in names}
    for words, runs in _runs_of(texts):
        best = strongest(runs)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        values = (
            len(runs),
            *(best or (None, None, None)),
            1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        )
        for n, v in zip(names, values):
            out[n].append(v)
    return out


def run_digests(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with the count of runs, the strongest run, and digests of all runs and of
    the collapsed text."""
    added = (
        "n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string"
    )
    return map_texts(docs, keep, added, _digest, text)


def planted(doc_id: Column, text: Column) -> Column:
    """The text, with a periodic end in every tenth row by crc32 of the id: with n words, each word
    from a on is the word (i - a) mod p after word a. Rows without an id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")
    g = F.floor(h / 10)

    def altered(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        head = F.slice(words, F.lit(1), a)
        # the period is written often enough to cover the rest, then cut to n words
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))
        return F.when(n > 0, F.concat_ws(" ", F.slice(F.concat(head, tail), F.lit(1), n))).otherwise("")

    one = F.transform(F.array(words), altered)[0]  # the words are split once
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), one).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, every tenth document given a periodic end first."""
    docs = table(spark, sf_dir, "documents")
    return run_digests(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), ["doc_id"])
