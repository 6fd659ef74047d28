"""Exact overlaps between items, counted in blocks without a row per pair.

An item is a set of baskets, a basket a list of items. Spark deals the items into blocks and brings every
block the lists of the baskets its items are in; a task then counts an item's partners over its lists
in numpy and sends on only those that can be among the best. A basket of s items thus costs s^2 array
steps at most, and its list travels once per block that needs it, not once per item:

* An item goes to the block of its largest basket, so a large list goes to few blocks. Blocks are sized
  by the length of the lists they count over; blocks of small baskets are pooled.
* An item whose lists are too long for one task is counted in parts, which are added up per pair.
* The few largest baskets of all have no list: which of them an item is in is a bit mask that travels with
  it, and two masks give that part of the overlap.
* Of the other long lists only a part is counted over. The item's short lists and the heads of the long
  ones give a lower bound on its k-th best partner; what is met only in m long lists shares m baskets at
  most, so partners with too many or too few baskets of their own to reach the bound are skipped, a list
  being in order of that number. What the short lists have met is looked up in the long ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from trailmark.operators.hotkeys import join_spread
from trailmark.session import staged

# Items in a list that is counted over in part.
LONG = 2048
# List entries counted over in one block, and for one item in one task.
VISITS = 1 << 23
BUSY = 1 << 25
# Largest baskets that are held as bits.
MOST_BITS = 30
# Rows that a task packs at once.
HELD = 1 << 20
# What a row is: a partner in a list, an item whose partners are asked for, one that is counted in parts.
LISTED, ASKED, HEAVY = 1, 2, 4

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers by their lowest, second, ... bytes, as many as the largest one needs; bytes by how
    often they occur, as Spark's own compression only finds repeated ones."""
    raw = np.ascontiguousarray(values, np.int64).view(np.uint64)
    width = (int(raw.max()).bit_length() + 7) // 8 if len(raw) else 0
    code = zlib.compressobj(1, strategy=zlib.Z_RLE)
    # each plane is a block of its own, with its own code
    planes = [raw.view(np.uint8).reshape(-1, 8)[:, x].tobytes() for x in range(width)]
    return b"".join(code.compress(x) + code.flush(zlib.Z_FULL_FLUSH) for x in planes) + code.flush() if planes else b""


def _numbers(planes: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and planes:
        planes = zlib.decompress(planes)
        width = len(planes) // n
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view(np.int64).ravel()


class Block:
    """The lists of a block: items by local number (in order of their ids), with ``n`` and bit mask."""

    def __init__(self, lengths: np.ndarray, entries: np.ndarray, n: np.ndarray, mask: np.ndarray | None):
        self.baskets = np.arange(len(lengths))
        self.lengths = lengths
        self.to = np.cumsum(lengths)
        self.ids, self.items = np.unique(entries, return_inverse=True)
        self.n = np.zeros(len(self.ids), np.int64)
        self.mask = np.zeros(len(self.ids), np.int64)
        self.n[self.items] = n
        if mask is not None:
            self.mask[self.items] = mask
        self._by_n: dict[int, np.ndarray] = {}
        self._by_id: dict[int, np.ndarray] = {}

    def __getitem__(self, x: int) -> np.ndarray:
        return self.items[self.to[x] - self.lengths[x] : self.to[x]]

    def by_n(self, x: int) -> np.ndarray:
        if x not in self._by_n:
            items = np.sort(self[x])
            self._by_n[x] = items[np.argsort(self.n[items], kind="stable")]
        return self._by_n[x]

    def counted(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The items in ``parts``, in order, and in how many each is."""
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        every = np.concatenate(parts)
        if 8 * len(every) < len(self.ids):
            return np.unique(every, return_counts=True)
        counts = np.bincount(every, minlength=len(self.ids))
        met = np.flatnonzero(counts)
        return met, counts[met]

    def holding(self, lists: list[int], items: np.ndarray) -> np.ndarray:
        """In how many of ``lists`` each of ``items`` is."""
        out = np.zeros(len(items), np.int64)
        for x in lists:
            if x not in self._by_id:
                self._by_id[x] = np.sort(self[x])
            held = self._by_id[x]
            at = np.minimum(np.searchsorted(held, items), len(held) - 1)
            out += held[at] == items
        return out

    def shared(self, mask: int, items: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.mask[items] & mask).astype(np.int64)


def closest(k: int, long: int = LONG) -> Callable[..., Found]:
    """The partners that may be among an item's ``k`` best by overlap^2 / n, then id."""

    def work(block: Block, lists: list[int], own: int, n: int, mask: int) -> Found:
        short = [block[x] for x in lists if block.lengths[x] <= long]
        many = [x for x in lists if block.lengths[x] > long]
        met, light = _met(block, short, many, own, mask)
        keep = met != own
        met, light = met[keep], light[keep]
        shared = block.shared(mask, met)
        total = light + shared
        near = total * total / block.n[met]
        if len(met) > k:
            best = near >= np.partition(near, len(near) - k)[len(near) - k]
            met, light, shared, near = met[best], light[best], shared[best], near[best]
            if len(met) > k:  # ties at the end
                first = np.lexsort((met, -near))[:k]
                met, light, shared = met[first], light[first], shared[first]
        return met, light, shared

    def _met(block: Block, short: list, many: list[int], own: int, mask: int):
        if not many:
            return block.counted(short)
        most = len(many) + int(mask).bit_count()  # baskets shared with what no short list has met
        heads = [block.by_n(x)[: k + 2] for x in many]
        if most == 1:  # such partners share one basket: the first by n are the best, one being the item itself
            met, light = block.counted(short + heads)
            rest = ~np.isin(met, heads[0])
        else:
            met, light = block.counted(short + heads)
            others = met != own
            low = light[others] + block.shared(mask, met[others])
            near = low * low / block.n[met[others]]
            bound = np.partition(near, len(near) - k)[len(near) - k] if len(near) >= k else 0.0
            # n >= overlap >= overlap^2 / n >= bound, and most^2 / n >= bound; a hair wider for rounding
            least, last = bound * (1 - 1e-9), most * most / bound * (1 + 1e-9) if bound else math.inf
            parts = []
            for x in many:
                n = block.n[block.by_n(x)]
                parts.append(block.by_n(x)[np.searchsorted(n, least) : np.searchsorted(n, last, "right")])
            met, light = block.counted(short + parts)
            rest = (block.n[met] < least) | (block.n[met] > last)
        light[rest] += block.holding(many, met[rest])
        return met, light

    return work


def frequent(least: int, most: int, long: int = LONG) -> Callable[..., Found]:
    """Partners of a larger id that share ``least`` baskets or more; the ``most`` best of an item, by
    overlap, then id. ``n`` is how far an id stands behind the first of its kind; a kind has no pairs."""

    def work(block: Block, lists: list[int], own: int, n: int, mask: int) -> Found:
        # a pair met only in ``spared`` lists and by bits shares fewer than ``least``
        many = sorted((x for x in lists if block.lengths[x] > long), key=lambda x: -block.lengths[x])
        spared = many[: max(0, least - 1 - int(mask).bit_count())]
        skip = set(spared)
        met, light = block.counted([block[x] for x in lists if x not in skip])
        keep = (met > own) & (block.ids[met] - block.n[met] != block.ids[own] - n)
        met, light = met[keep], light[keep]
        shared = block.shared(mask, met)
        keep = light + shared + len(spared) >= least
        met, light, shared = met[keep], light[keep], shared[keep]
        light = light + block.holding(spared, met)
        keep = light + shared >= least
        met, light, shared = met[keep], light[keep], shared[keep]
        if len(met) > most:
            first = np.lexsort((met, -(light + shared)))[:most]
            met, light, shared = met[first], light[first], shared[first]
        return met, light, shared

    return work


# What a block gets in one row: lists, and the block's own items in them, as ``_planes``.
PARTS = ("firsts", "sizes", "gaps", "n", "mask", "own_list", "own_item", "own_n", "own_mask", "own_busy")


def _packing(later: bool, held: int):
    """Rows sorted by basket and item to a row per block and ``held`` rows, with the lists the block needs.
    With ``later`` a list begins at the block's first item in it."""
    schema = pa.schema([(c, pa.int64()) for c in ("to_block", "lists", "owns")] + [(p, pa.binary()) for p in PARTS])

    def packed(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        kind = rows["kind"].to_numpy()
        at = np.cumsum(first) - 1  # the list of each row
        item, n = rows["i"].to_numpy(), rows["nj"].to_numpy()
        mask = rows["maskj"].to_numpy() if "maskj" in rows.column_names else None
        own_n = rows["n"].to_numpy() if "n" in rows.column_names else n
        own_mask = rows["mask"].to_numpy() if "mask" in rows.column_names else mask
        listed = (kind & LISTED) > 0
        sizes = np.bincount(at[listed], minlength=at[-1] + 1)
        starts = np.cumsum(sizes) - sizes
        place = np.cumsum(listed) - listed  # of each row among the listed ones
        ids, n = item[listed], n[listed]
        gaps = np.diff(ids, prepend=ids[:1])
        mask = None if mask is None else mask[listed]
        own = np.flatnonzero(((kind & ASKED) > 0) & (sizes[at] > 0))
        to = rows["to_block"].to_numpy(zero_copy_only=False)[own].astype(np.int64)
        order = np.argsort(to, kind="stable")
        own, to = own[order], to[order]
        blocks, begin = np.unique(to, return_index=True)
        out: list[dict] = []
        size = 0
        for block, x, y in zip(blocks.tolist(), begin, [*begin[1:], len(own)]):
            mine = own[x:y]
            lists, head, local = np.unique(at[mine], return_index=True, return_inverse=True)
            start = place[mine[head]] if later else starts[lists]
            long = starts[lists] + sizes[lists] - start
            entry = np.repeat(start - (np.cumsum(long) - long), long) + np.arange(long.sum())
            gap = gaps[entry]
            gap[(np.cumsum(long) - long)[long > 0]] = 0
            values = (
                ids[np.minimum(start, len(ids) - 1)], long, gap, n[entry], None if mask is None else mask[entry],
                local, item[mine], own_n[mine], None if own_mask is None else own_mask[mine], (kind[mine] & HEAVY) > 0,
            )
            planes = {p: b"" if v is None else _planes(v) for p, v in zip(PARTS, values)}
            out.append({"to_block": block, "lists": len(lists), "owns": len(mine)} | planes)
            size += len(entry)
            if size > held:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def taken(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting)
            u = rows["u"].to_numpy()
            first = np.concatenate([[True], u[1:] != u[:-1]])
            end = len(u) if last else int(np.flatnonzero(first)[-1])  # the last basket may go on
            if end:
                yield from packed(rows.slice(0, end), first[:end])
            waiting[:] = rows.slice(end).to_batches()

        limit = held
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= limit:
                yield from taken(False)
                limit = held + 2 * sum(b.num_rows for b in waiting)
        if waiting:
            yield from taken(True)

    return run, schema


def _read(rows: pa.Table, names: tuple[str, ...], count: Callable[[dict], int]) -> list[np.ndarray]:
    """The columns ``names`` of all rows, end to end."""
    found = [[_numbers(r[p], count(r)) for p in names] for r in rows.to_pylist()]
    return [np.concatenate(c) for c in zip(*found)]


def _counting(work: Callable[..., Found]):
    schema = pa.schema([(c, pa.int64()) for c in ("i", "n", "j", "nj", "light", "shared")])

    def run(rows: pa.Table) -> pa.Table:
        sizes, firsts = _read(rows.select(["lists", "sizes", "firsts"]), ("sizes", "firsts"), lambda r: r["lists"])
        entries = [int(x.sum()) for x in np.split(sizes, np.cumsum(rows["lists"].to_numpy())[:-1])]
        parts = []
        for name in ("gaps", "n", "mask"):
            planes = rows[name].to_pylist()
            if name == "mask" and not any(planes):
                parts.append(None)
                continue
            parts.append(np.concatenate([_numbers(p, k) for p, k in zip(planes, entries)]))
        gaps, n_entry, mask_entry = parts
        begin = np.cumsum(sizes) - sizes
        ids = np.cumsum(gaps)
        ids += np.repeat(firsts - ids[begin], sizes)
        block = Block(sizes, ids, n_entry, mask_entry)
        del ids, gaps, n_entry, mask_entry, parts
        names = ("own_list", "own_item", "own_n", "own_mask", "own_busy")
        at, item, own_n, own_mask, own_busy = _read(rows.select(["owns", *names]), names, lambda r: r["owns"])
        before = np.cumsum(rows["lists"].to_numpy()) - rows["lists"].to_numpy()
        at = at + np.repeat(before, rows["owns"].to_numpy())
        mine_ids, starts, owner = np.unique(item, return_index=True, return_inverse=True)
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(mine_ids)))
        n, mask, busy = (c[starts] for c in (own_n, own_mask, own_busy))
        place = np.searchsorted(block.ids, mine_ids)
        found: list[tuple] = []
        for x, (i, start, end) in enumerate(zip(mine_ids, [0, *ends], ends)):
            mine = at[order[start:end]].tolist()
            own = int(place[x]) if place[x] < len(block.ids) and block.ids[place[x]] == i else -1
            if busy[x]:  # a part of its lists: every partner is sent on
                met, light = block.counted([block[y] for y in mine])
                met, light = met[met != own], light[met != own]
                shared = block.shared(int(mask[x]), met)
            else:
                met, light, shared = work(block, mine, own, int(n[x]), int(mask[x]))
            if len(met):
                found.append((np.full(len(met), x), met, light, shared))
        if not found:
            return schema.empty_table()
        x, met, light, shared = (np.concatenate(c) for c in zip(*found))
        columns = mine_ids[x], n[x], block.ids[met], block.n[met], light, shared
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def bits(rows: DataFrame, large: DataFrame | None) -> DataFrame | None:
    """(i, mask): which of the ``large`` baskets (u, no), MOST_BITS at most, hold an item."""
    if large is None:
        return None
    return rows.join(F.broadcast(large), "u").groupBy("i").agg(F.sum(F.expr("shiftleft(1L, no)")).alias("mask"))


def bits_of(mask: Column) -> Column:
    """The numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(MOST_BITS - 1)), lambda b: F.getbit(mask, b) == 1)


def _known(items: DataFrame, masks: DataFrame | None) -> DataFrame:
    if masks is None:
        return items.withColumn("mask", F.lit(0).cast("long"))
    return items.join(masks, "i", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))


def overlaps(
    left: tuple[DataFrame, DataFrame],
    right: tuple[DataFrame, DataFrame],
    work: Callable[..., Found],
    large: DataFrame | None = None,
    visits: int = VISITS,
    busy: int = BUSY,
    later: bool = False,
    held: int = HELD,
    entries: DataFrame | None = None,
) -> DataFrame:
    """(i, n, j, nj, light, shared): for items i of ``left`` the partners j in ``right`` that ``work`` picks,
    with the baskets both are in: ``light`` counts those with a list, ``shared`` the ``large`` ones.

    A side is (i, u), distinct, and (i, n), a row per item, with whatever number of the item ``work``
    needs; items are whole numbers. Pairs that share only large baskets are not found. Rows of an item
    whose lists hold more than ``busy`` entries give all partners, in parts: light is to be added up per
    (i, j). With ``later`` only partners of a larger id are counted in whole, and lists are sent shorter.
    ``entries`` (i, u, kind) are the rows of both sides where the caller has them in one written table.
    """
    kind = left[0].schema["i"].dataType
    whole = left[0] is right[0]
    sides = [(rows, _known(items, bits(rows, large))) for rows, items in ((left,) if whole else (left, right))]
    (rows, known), (other, other_known) = sides[0], sides[-1]
    written = whole or entries is not None
    if whole:
        entries = rows.select("i", "u", F.lit(LISTED + ASKED).alias("kind"))
    elif entries is None:
        both = rows.select("i", "u", F.lit(ASKED).alias("kind")).unionByName(
            other.select("i", "u", F.lit(LISTED).alias("kind"))
        )
        entries = both.groupBy("i", "u").agg(F.bit_or("kind").alias("kind"))
    entries = entries.where("i IS NOT NULL AND u IS NOT NULL")
    if large is not None:
        entries = entries.join(F.broadcast(large), "u", "left_anti")
    if not written:
        entries = staged(entries, "entries")
    asked, listed = F.col("kind").bitwiseAND(ASKED) > 0, F.col("kind").bitwiseAND(LISTED) > 0
    # the window leaves a basket's rows together, and needs one shuffle of them
    sized = entries.withColumn("s", F.count_if(listed).over(Window.partitionBy("u")))
    met = asked & (F.col("s") > 0)
    facts = sized.groupBy("i").agg(
        F.count("*").alias("rows"),
        F.sum(F.when(met, F.col("s"))).alias("w"),
        F.max(F.when(met, F.struct("s", "u")))["u"].alias("home"),
    )
    facts = staged(facts, "facts")
    homes = facts.where(F.col("w") <= busy).groupBy("home").agg(F.sum("w").alias("gw"))
    pooled = homes.where(F.col("gw") <= visits).agg(F.sum("gw")).first()[0] or 0
    pools = max(math.ceil(pooled / visits), rows.sparkSession.sparkContext.defaultParallelism)
    parts = F.when(F.col("w") > busy, F.ceil(F.col("w") / busy)).otherwise(
        F.when(F.col("gw") > visits, F.ceil(F.col("gw") / visits)).otherwise(1)
    )
    # pools have small numbers, other blocks the hash of what they hold
    block = F.when(F.col("w") > busy, F.xxhash64("i", F.lit("busy"))).when(F.col("gw") > visits, F.xxhash64("home"))
    dealt = facts.where("w > 0").join(homes, "home", "left").select(
        "i",
        F.coalesce(block, F.pmod(F.xxhash64("home"), F.lit(pools))).alias("block"),
        block.isNull().alias("pool"),
        parts.alias("parts"),
        F.when(F.col("w") > busy, HEAVY).otherwise(0).alias("heavy"),
    )
    partner = other_known.select("i", F.col("n").alias("nj"), F.col("mask").alias("maskj"))
    every = partner if whole else partner.join(known, "i", "full")
    facing = join_spread(entries, every.join(dealt, "i", "left"), "i", counts=facts.select("i", F.col("rows").alias("_c")))
    salt = F.when(F.col("heavy") > 0, F.xxhash64("u")).otherwise(F.xxhash64("i"))
    to = F.when(F.col("pool"), F.col("block")).otherwise(F.xxhash64("block", F.pmod(salt, F.col("parts"))))
    flags = F.when(F.col("block").isNull(), F.col("kind").bitwiseAND(LISTED)).otherwise(F.col("kind") + F.col("heavy"))
    own = [] if whole else ["n"]
    masks = [] if large is None else ["maskj"] if whole else ["maskj", "mask"]
    facing = facing.select("u", F.col("i").cast("long").alias("i"), F.coalesce("nj", F.lit(0).cast("long")).alias("nj"), *own, *masks, flags.alias("kind"), to.alias("to_block"))
    facing = facing.fillna(0, [*own, *masks]) if own or masks else facing
    pack, schema = _packing(later, held)
    packed = facing.repartition("u").sortWithinPartitions("u", "i").mapInArrow(pack, from_arrow_schema(schema))
    name = kind.simpleString()
    found = packed.groupBy("to_block").applyInArrow(
        _counting(work), "i long, n long, j long, nj long, light long, shared long"
    )
    return found.select(F.col("i").cast(name).alias("i"), "n", F.col("j").cast(name).alias("j"), "nj", "light", "shared")
