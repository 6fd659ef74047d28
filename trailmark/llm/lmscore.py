"""Cross-entropy difference of matched language models.

A target and a background bigram model share vocabulary and smoothing, and differ only in the
documents they were counted on. A document's score is the mean over its tokens of the target's loss
minus the background's: the lower, the more it reads like the target.

All words and bigrams are counted, in Spark jobs that grow with the corpus. A word is a 64-bit hash, a
bigram the pair of them. Counting and scoring share one shuffle: the places of a text go to buckets of
their second word, where that word, its bigrams and it as a context are counted, and the counts
go back to the texts. A place is a few packed bytes on either way, never a row.
"""

from __future__ import annotations

import math
import pickle
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trailmark.llm.common import flat_texts, named, staged, table

WEIGHT = 50.0  # pseudo-counts with which a bigram estimate leans on the unigram estimate
# A word with more than 1 / BUSY of all tokens is busy: there are fewer than BUSY of them. Their
# counts are broadcast, and their bigrams are dealt out one by one. A bigram of a busy word with more than
# 1 / (BUSY / 4) of all tokens is looked up as well and never sent. No result depends on BUSY.
BUSY = 1 << 16
FLUSH = 1 << 20  # tokens that a task packs together
BUCKET = 1 << 20  # tokens of a bucket, on average
BUCKETS = 128  # at least
# Whole-number ids of target documents go to all tasks, 64 MB at most; if there are more, or of another
# type, documents are joined to them, which shuffles the texts in each of the three passes over them.
TARGET_IDS = 1 << 23

_TURN = 17  # bits that the first word's hash is turned by in a bigram's key
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SCREEN = np.uint64(42)  # a key without these low bits is one of 2^22


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all documents."""

    def work(batches) -> Iterator[dict]:
        for _, texts in batches:
            count = Counter(chain.from_iterable(map(_words, texts)))
            yield {"word": list(count), "n": list(count.values())}

    return flat_texts(docs, [], "word binary, n long", work).groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int) -> dict[bytes, int]:
    """Numbers 2, 3, ... of the ``size`` most frequent words; 0 is any other word, 1 the start of a
    text. Words are ranked by frequency class (sixteen to a doubling), within a class by a hash.

    Two histograms of bounded size find where the list ends, so that little more than the list
    itself reaches the driver, however many words and tasks there are.
    """
    ranked = staged(
        word_counts(docs).select(
            "word", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int").alias("class"),
            F.xxhash64("word").alias("h"),
        ),
        "words",
    )
    last, need = None, size
    for r in ranked.groupBy("class").count().orderBy(F.desc("class")).collect():
        if r["count"] > need:
            last = r["class"]
            break
        need -= r["count"]
    chosen = ranked if last is None else ranked.where(F.col("class") > last)
    rows = [(r["class"], r["h"], bytes(r["word"])) for r in chosen.collect()]
    if last is not None:
        partly = ranked.where(F.col("class") == last).withColumn("top", F.shiftright("h", 48))
        left, upto = need, None
        for r in partly.groupBy("top").count().orderBy("top").collect():  # 65,536 at most
            upto = r["top"]
            left -= r["count"]
            if left <= 0:
                break
        ends = sorted((r["h"], bytes(r["word"])) for r in partly.where(F.col("top") <= upto).collect())
        rows += [(last, h, w) for h, w in ends[:need]]
    return {w: i for i, (_, _, w) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1], r[2])), 2)}


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


# white space is in no word
START, OTHER = _hash(b" "), _hash(b"  ")


class _Numbers(dict):
    """A small number for each word as it comes, with each number's hash in ``hashes``: 0 is the start of
    a text, 1 any word that is not among ``known``."""

    def __init__(self, known: frozenset[bytes] | None):
        super().__init__()
        self.known = known
        self.hashes = array("Q", [START, OTHER])

    def __missing__(self, word: bytes) -> int:
        if self.known is not None and word not in self.known:
            n = 1
        else:
            n = len(self.hashes)
            self.hashes.append(_hash(word))
        self[word] = n
        return n

    def forget(self) -> None:
        """Begins anew when there are many words; numbers given out before mean nothing from then on."""
        if len(self) >= 1 << 19:
            self.clear()
            self.hashes = array("Q", [START, OTHER])


def _pairs(texts: list[bytes], numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's number, that of the word (or start of a text) before it, and the words of each text."""
    lists = [_words(t) for t in texts]
    size = np.array([len(ws) for ws in lists], dtype=np.int64)
    word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int32, size.sum())
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[(np.cumsum(size) - size)[size > 0]] = 0
    return before, word, size


def _keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One number for a bigram."""
    return ((before << np.uint64(_TURN)) | (before >> np.uint64(64 - _TURN))) ^ word


def _packed(*columns: np.ndarray) -> bytes:
    """The columns byte by byte of their numbers, compressed: high bytes are mostly zero."""
    planes = [(a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) for a in columns]
    return zstandard.compress(pickle.dumps(planes), 1)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    columns = []
    for kind, data in pickle.loads(zstandard.decompress(blob)):
        planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
        columns.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
    return columns


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in ``sorted_keys``, or their number if it is not there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    return np.where(sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys, at, len(sorted_keys))


def _screen(keys: np.ndarray) -> np.ndarray:
    """For the upper bits of a key, whether any of ``keys`` has them: most others need not be looked up."""
    maybe = np.zeros(1 << (64 - int(_SCREEN)), bool)
    maybe[keys >> _SCREEN] = True
    return maybe


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``keys``, and where each key starts in it; equal keys come in any order."""
    order = np.argsort(keys)
    return order, _firsts(keys[order])


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each key of a sorted column starts."""
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(fresh)


def _order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by ``keys``, whole numbers from 0 on, the first of them foremost; then as they come."""
    n = len(keys[0])
    tops = [int(k.max()) + 1 if n else 1 for k in keys]
    if math.prod(tops) * (n + 1) >= 1 << 63:
        return np.lexsort(keys[::-1])
    # one number holds keys and place: sorting numbers is several times faster than sorting by columns
    packed = np.zeros(n, np.int64)
    for k, top in zip(keys, tops):
        packed = packed * top + k
    packed = packed * (n + 1) + np.arange(n)
    packed.sort()
    return packed % (n + 1)


def _ends(size: np.ndarray) -> np.ndarray:
    """True at the last word of each text."""
    ends = np.zeros(size.sum(), bool)
    ends[np.cumsum(size)[size > 0] - 1] = True
    return ends


def _last_words(word: np.ndarray, size: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last word of each text, and of each target document's."""
    last = np.cumsum(size)[size > 0] - 1
    return word[last], word[last[target[last]]]


def _flushes(batches, known: frozenset[bytes] | None, packed: bytes | None) -> Iterator[tuple]:
    """Batches and texts joined to about FLUSH tokens: (batches, hash of each number, before, word, size,
    target of each word), words as numbers."""
    numbers = _Numbers(known)
    held, parts, n = [], [], 0
    ids = None if packed is None else np.cumsum(_unpacked(packed)[0])

    def target(mark: pa.Array) -> np.ndarray:
        if ids is None:
            return np.array(mark.to_pylist(), bool)
        return (_find(ids, mark.fill_null(0).to_numpy()) < len(ids)) & mark.is_valid().to_numpy(zero_copy_only=False)

    for batch, texts in batches:
        before, word, size = _pairs(texts, numbers)
        held.append(batch)
        parts.append((before, word, size, np.repeat(target(batch.column("lm__mark")), size)))
        n += len(word) + len(texts)
        if n >= FLUSH:
            yield held, np.array(numbers.hashes, np.uint64), *map(np.concatenate, zip(*parts))
            held, parts, n = [], [], 0
            numbers.forget()
    if held:
        yield held, np.array(numbers.hashes, np.uint64), *map(np.concatenate, zip(*parts))


@dataclass
class Targets:
    """The ids of the target documents: packed, or None and a table of them (lm__target)."""

    packed: bytes | None
    ids: DataFrame

    def mark(self, docs: DataFrame) -> DataFrame:
        """``docs`` with lm__mark in place of lm__id: what tells a task whether a row is a target."""
        if self.packed is not None:
            return docs.withColumn("lm__mark", F.col("lm__id").cast("long")).drop("lm__id")
        met = docs.join(self.ids.hint("merge"), F.col("lm__id") == F.col("lm__target"), "left")
        return met.withColumn("lm__mark", F.col("lm__target").isNotNull()).drop("lm__id", "lm__target")


def _targets(docs: DataFrame, targets: DataFrame) -> Targets:
    ids = targets.select(F.col("doc_id").alias("lm__target")).where("lm__target is not null").distinct()
    whole = all(isinstance(d.schema["doc_id"].dataType, IntegralType) for d in (docs, targets))
    if not whole or ids.count() > TARGET_IDS:
        return Targets(None, ids)
    values = np.sort(ids.select(F.col("lm__target").cast("long")).toArrow().column(0).combine_chunks().to_numpy())
    return Targets(_packed(np.diff(values, prepend=0)), ids)


@dataclass
class Models:
    """What is known of both models before the bigrams are counted over ``docs``, all of bounded size;
    pairs of numbers and of arrays are those of the background and of the target."""

    docs: DataFrame
    targets: Targets
    known: frozenset[bytes] | None  # None: all words
    totals: tuple[int, int]  # tokens
    types: int  # words, and one for all that were never seen
    names: np.ndarray  # sorted hashes of the busy words and START
    singles: tuple[np.ndarray, np.ndarray]  # how often each stands
    contexts: tuple[np.ndarray, np.ndarray]  # how often a word follows it
    keys: np.ndarray  # sorted keys of the busy bigrams
    pairs: tuple[np.ndarray, np.ndarray]  # how often each stands

    def constants(self) -> tuple:
        return self.known, self.totals, self.types, self.names, self.singles, self.contexts, self.keys, self.pairs


def _tallies(marked: DataFrame, known, packed) -> DataFrame:
    """(pair, key, n_0, n_1, ends_0, ends_1): every word with its counts, and how often it ends a text;
    as pairs, bigrams with more than 2 / BUSY of a flush's tokens. A bigram with more than 4 / BUSY of
    all tokens is among them with more than half its count."""
    shared = marked.sparkSession.sparkContext.broadcast((known, packed))

    def work(batches) -> Iterator[dict]:
        known, packed = shared.value
        for _, hashes, before, word, size, target in _flushes(batches, known, packed):
            n, t, e, te = (np.bincount(w, minlength=len(hashes)) for w in (word, word[target], *_last_words(word, size, target)))
            there = np.flatnonzero(n)
            key = hashes[there].view(np.int64)
            yield {"pair": np.zeros(len(key), bool), "key": key, "n_0": n[there], "n_1": t[there], "ends_0": e[there], "ends_1": te[there]}
            keys = np.sort(_keys(hashes[before], hashes[word]))
            first = _firsts(keys)
            key, n = keys[first], np.diff(np.append(first, len(keys)))
            often = n * BUSY > 2 * len(word)
            zero = np.zeros(often.sum(), np.int64)
            yield {"pair": zero == 0, "key": key[often].view(np.int64), "n_0": n[often], "n_1": zero, "ends_0": zero, "ends_1": zero}

    names = ["n_0", "n_1", "ends_0", "ends_1"]
    found = flat_texts(marked, ["lm__mark"], "pair boolean, key long, " + ", ".join(f"{c} long" for c in names), work)
    return found.groupBy("pair", "key").agg(*[F.sum(c).alias(c) for c in names])


def _busy_pairs(marked: DataFrame, known, packed, names: np.ndarray, keys: np.ndarray) -> DataFrame:
    """(key, n_0, n_1): exact counts of the bigrams ``keys`` whose second word is in ``names``."""
    shared = marked.sparkSession.sparkContext.broadcast((known, packed, names, keys))

    def work(batches) -> Iterator[dict]:
        known, packed, names, keys = shared.value
        maybe = _screen(keys)
        for _, hashes, before, word, _, target in _flushes(batches, known, packed):
            at = np.flatnonzero((_find(names, hashes) < len(names))[word])
            key = _keys(hashes[before[at]], hashes[word[at]])
            found = np.flatnonzero(maybe[key >> _SCREEN])
            place, at = _find(keys, key[found]), at[found]
            n = np.bincount(place, minlength=len(keys) + 1)[:-1]
            t = np.bincount(place[target[at]], minlength=len(keys) + 1)[:-1]
            there = np.flatnonzero(n)
            yield {"key": keys[there].view(np.int64), "n_0": n[there], "n_1": t[there]}

    found = flat_texts(marked, ["lm__mark"], "key long, n_0 long, n_1 long", work)
    return found.groupBy("key").agg(F.sum("n_0").alias("n_0"), F.sum("n_1").alias("n_1"))


def _columns(rows: DataFrame) -> list[np.ndarray]:
    """A bounded table in the driver, sorted by its first column, which holds hashes."""
    got = [c.combine_chunks().to_numpy() for c in rows.toArrow().columns]
    got[0] = got[0].view(np.uint64)
    order = np.argsort(got[0])
    return [c[order] for c in got]


def train(docs: DataFrame, targets: DataFrame, size: int | None = None) -> Models:
    """Both models over all of ``docs``: the background on every document, the target on those
    whose id is in ``targets`` (doc_id). With a ``size`` all but the most frequent words are one
    class; without, every word has its own counts. Bigrams are counted by ``score``."""
    known = None if size is None else frozenset(vocabulary(docs, size))
    ids = _targets(docs, targets)
    marked = ids.mark(docs.select(F.col("doc_id").alias("lm__id"), "text"))
    counts = staged(_tallies(marked, known, ids.packed), "words")
    words = counts.where(~F.col("pair"))
    types, *sums = words.agg(F.count("*"), *[F.sum(c) for c in ("n_0", "n_1", "ends_0", "ends_1")]).first()
    totals, starts = [x or 0 for x in sums[:2]], [x or 0 for x in sums[2:]]
    busy = words.where(F.col("n_0") * F.lit(BUSY) > totals[0])
    start = np.array([START], np.uint64)  # a context like a word; as a word it does not stand anywhere
    name, n0, n1, e0, e1 = _columns(busy.select("key", "n_0", "n_1", "ends_0", "ends_1"))  # fewer than BUSY
    name, n0, n1 = np.append(name, start), np.append(n0, 0), np.append(n1, 0)
    x0, x1 = np.append(n0[:-1] - e0, starts[0]), np.append(n1[:-1] - e1, starts[1])
    order = np.argsort(name)
    name = name[order]
    often = counts.where(F.col("pair") & (F.col("n_0") * F.lit(BUSY) > 2 * totals[0]))  # fewer than BUSY / 2
    keys = _columns(often.select("key"))[0]
    pairs = _columns(_busy_pairs(marked, known, ids.packed, name, keys)) if len(keys) else [keys, np.zeros(0, np.int64), np.zeros(0, np.int64)]
    return Models(
        docs, ids, known, tuple(totals), types + 1, name, (n0[order], n1[order]), (x0[order], x1[order]), pairs[0], tuple(pairs[1:])
    )


def _sent(rows: DataFrame, shared, packed, kept: list[str], counted: bool, asked: bool, buckets: int) -> DataFrame:
    """(bucket, flush, head, blob): the places of ``rows`` packed by bucket, and for each flush a head
    with the columns ``kept``, each text's tokens, and the part of its losses that needs no bucket."""
    ids = rows.sparkSession.sparkContext.broadcast(packed)

    def work(batches) -> Iterator[dict]:
        known, totals, types, names, singles, contexts, keys, pairs = shared.value
        flush = (TaskContext.get().partitionId() * 2 + counted) << 32
        code = np.uint16 if len(names) < 1 << 16 else np.uint32
        maybe = _screen(keys)
        for held, hashes, before, word, size, target in _flushes(batches, known, ids.value):
            doc = np.repeat(np.arange(len(size), dtype=np.uint32), size)
            name = _find(names, hashes)
            of_word, of_before, key = name[word], name[before], _keys(hashes[before], hashes[word])
            place = np.full(len(word), len(keys))
            found = np.flatnonzero((of_word < len(names)) & maybe[key >> _SCREEN])
            place[found] = _find(keys, key[found])
            looked, given = place < len(keys), of_before < len(names)
            out = {"bucket": [], "flush": [], "head": [], "blob": []}
            if asked:
                head = pa.Table.from_batches(held).select(kept).append_column("n_tokens", pa.array(size))
                for k in (0, 1):
                    single = (singles[k][of_word[looked]] + 1.0) / (totals[k] + types)
                    gain = np.log(pairs[k][place[looked]] + WEIGHT * single)
                    norm = np.log(contexts[k][of_before[given]] + WEIGHT)
                    part = np.bincount(doc[given], norm, len(size)) - np.bincount(doc[looked], gain, len(size))
                    head = head.append_column(f"part_{k}", pa.array(part))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, head.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(head)
                out = {"bucket": [flush % buckets], "flush": [flush], "head": [True], "blob": [sink.getvalue().to_pybytes()]}
            flags = target * 1 + _ends(size) * 2 + counted * 4 + asked * 8
            # a word that is not busy goes to one bucket with all its bigrams and as a context
            # a busy word as a context is known here, and its busy bigrams too
            rest = np.flatnonzero(~looked)
            mixed = np.where(of_word[rest] < len(names), key[rest], hashes[word[rest]]) * _MIX
            bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            # within a bucket busy words by name, then others by hash
            rank = np.where(name < len(names), name, np.unique(hashes, return_inverse=True)[1] + len(names))
            order = _order(bucket, rank[word[rest]])
            rest, cuts = rest[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                at = rest[cuts[b] : cuts[b + 1]]
                rare = hashes[word[at[of_word[at] == len(names)]]]
                fresh = np.flatnonzero(np.append(True, rare[1:] != rare[:-1])) if len(rare) else np.zeros(0, np.int64)
                blob = _packed(
                    doc[at], flags[at].astype(np.uint8), of_word[at].astype(code), of_before[at].astype(code),
                    rare[fresh], np.diff(np.append(fresh, len(rare))).astype(np.uint32), hashes[before[at[of_before[at] == len(names)]]],
                )
                out["bucket"].append(b)
                out["flush"].append(flush)
                out["head"].append(False)
                out["blob"].append(blob)
            yield out
            flush += 1

    return flat_texts(rows, [*kept, "lm__mark"], "bucket long, flush long, head boolean, blob binary", work)


def _per_key(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """For each row, the sums of ``columns`` over the rows of its key."""
    order, first = _runs(keys)
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return [np.bincount(which, c, len(first)).astype(np.int64)[which] for c in columns]


def _answers(sent: DataFrame, shared) -> DataFrame:
    """(flush, head, blob): heads as they came; for each flush's places in a bucket the counts
    of its bigram and, if the second word is not busy, of the word and of it as a context."""
    schema = pa.schema([("flush", pa.int64()), ("head", pa.bool_()), ("blob", pa.binary())])

    def work(given: pa.Table) -> pa.Table:
        names = shared.value[3]
        out, parts = {"flush": [], "head": [], "blob": []}, []

        def send(flush: int, head: bool, blob: bytes) -> None:
            for c, v in zip(out, (flush, head, blob)):
                out[c].append(v)

        for flush, head, blob in zip(*(given.column(c).to_pylist() for c in ("flush", "head", "blob"))):
            if head:
                send(flush, head, blob)
                continue
            doc, flags, of_word, of_before, rare, times, others = _unpacked(blob)
            word, before = (np.append(names, names[:1])[c.astype(np.int64)] for c in (of_word, of_before))
            word[of_word == len(names)] = np.repeat(rare, times)
            before[of_before == len(names)] = others
            parts.append((np.full(len(doc), len(parts)), np.full(len(doc), flush), doc, flags, of_word, word, before))
        if parts:
            part, flush, doc, flags, of_word, word, before = map(np.concatenate, zip(*parts))
            del parts
            counted, target, last = flags & 4 > 0, flags & 5 == 5, flags & 2 > 0
            pairs = _per_key(_keys(before, word), counted, target)
            del before
            own = _per_key(word, counted, target, counted & ~last, target & ~last)
            ask = np.flatnonzero(flags & 8 > 0)
            ask = ask[_order(part[ask], doc[ask])]
            cuts = np.flatnonzero(np.append(True, np.diff(part[ask]) != 0)) if len(ask) else []
            for i, j in zip(cuts, [*cuts[1:], len(ask)]):
                at = ask[i:j]
                rare = at[of_word[at] == len(names)]
                numbers = [last[rare].astype(np.uint8), *(c[rare] for c in own)]
                step = np.diff(doc[at].astype(np.int64), prepend=0).astype(np.uint32)
                send(int(flush[at[0]]), False, _packed(step, of_word[at], *(c[at] for c in pairs), *numbers))
        return pa.table(out, schema)

    return sent.groupBy("bucket").applyInArrow(work, "flush long, head boolean, blob binary")


def score(docs: DataFrame, models: Models, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with n_tokens, both losses in nats per token, and their difference.

    The models' bigrams are counted in the same shuffle; other documents than those of the models go
    along with them. Rows must come in the same order when a lost task is run again, as they do from files.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(models.constants())
    buckets = max(BUCKETS, -(-models.totals[0] // BUCKET))
    kept = [f"keep{i}" for i in range(len(keep))]
    columns = [*[named(c).alias(k) for c, k in zip(keep, kept)], "text"]
    if docs.sameSemantics(models.docs):
        rows = models.targets.mark(docs.select(*columns, F.col("doc_id").alias("lm__id")))
        sent = _sent(rows, shared, models.targets.packed, kept, True, True, buckets)
    else:
        rows = docs.select(*columns, F.lit(False).alias("lm__mark"))
        counted = models.targets.mark(models.docs.select("text", F.col("doc_id").alias("lm__id")))
        sent = _sent(rows, shared, None, kept, False, True, buckets).unionByName(
            _sent(counted, shared, models.targets.packed, [], True, False, buckets)
        )
    result = docs.select(
        *columns[:-1], F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("loss_target"), F.lit(0.0).alias("loss_background")
    ).schema
    arrow = to_arrow_schema(result)

    def work(given: pa.Table) -> pa.Table:
        _, totals, types, names, singles, *_ = shared.value
        heads = given.filter(given.column("head")).column("blob").to_pylist()
        head = pa.ipc.open_stream(heads[0]).read_all()
        sums = [head.column(f"part_{k}").to_numpy().copy() for k in (0, 1)]
        for is_head, blob in zip(given.column("head").to_pylist(), given.column("blob").to_pylist()):
            if is_head:
                continue
            step, of_word, *pairs, last, single_0, single_1, context_0, context_1 = _unpacked(blob)
            doc, busy = np.cumsum(step.astype(np.int64)), of_word < len(names)
            for k, own, context in ((0, single_0, context_0), (1, single_1, context_1)):
                n = np.empty(len(doc))
                n[busy] = singles[k][of_word[busy]]
                n[~busy] = own
                loss = -np.log(pairs[k] + WEIGHT * (n + 1.0) / (totals[k] + types))
                loss[~busy] += np.where(last > 0, 0.0, np.log(context + WEIGHT))
                sums[k] += np.bincount(doc, loss, len(sums[k]))
        size = head.column("n_tokens").to_numpy()
        means = [pa.array(s / np.maximum(size, 1)) for s in sums]
        arrays = [*(head.column(k) for k in kept), head.column("n_tokens"), means[1], means[0]]
        return pa.table([a.cast(f.type) for a, f in zip(arrays, arrow)], schema=arrow)

    out = _answers(sent, shared).groupBy("flush").applyInArrow(work, result)
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept)], "n_tokens", "loss_target", "loss_background",
        (F.col("loss_target") - F.col("loss_background")).alias("score"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a model of the documents labelled as good and one of all documents.

    Null and empty texts have no tokens and score 0; repeated rows each get a row and are counted
    each; without labels the target model knows no counts; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return score(docs, train(docs, good), ["doc_id"])
