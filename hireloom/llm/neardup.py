"""Near-duplicate records by multiple-global-order filtering (problem 5).

Each record is the set of its distinct word runs. Under any total order of the tokens, two sets whose Jaccard similarity is at
least t must share tokens in their prefixes; filters under several orders are intersected before anything is verified.

* Hash order. Let a and b be the sizes and o the least overlap, ceil(t (a + b) / (1 + t)). Of the a - 1 neighbouring pairs of
  tokens of one set at most 2 (a - o) lose a member and at most b - o are parted by a token of the other set alone, so
  3 o - a - b - 1 neighbouring pairs are common. A pair is far more selective than a token where texts share phrases.
* Rarity order of those pairs, by a count sketch of the corpus: similar sets share a pair within their first a - c pairs, c being
  the bound above for the smallest partner. Only these are indexed. Sets too small for the bound index their single tokens too.
* Records that meet in the index must have sizes and parity bitmaps (their distance never exceeds the symmetric difference) that
  allow the similarity.
* Rarity order and hash order of single tokens. Of what is left, prefixes under both orders are sent, and must share a token under
  either one; only for pairs that pass every order are the whole sets sent and compared.

Records with equal sets collapse into one class each. Within a batch they collapse before the index is built, and the index keeps
each class once for each token, so copies never pair up in it. An entry that may stand in more than HOT_ENTRY records is split:
its records are dealt to so many lots, and each two lots meet in a cell of their own. Blocks of cells and entries are partitions of
their own, as many as the index needs and a multiple of the cores. Each block gets the number, size and bitmap of every record that has
an entry in it; where there are many blocks, that is several times the index. Then the index is written once, and its blocks are
compared in rounds, of which each sends less than the index holds and is removed before the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hireloom.common import discard, materialise, pairs_within, scratch_path, shuffles_freed, slots, stored
from hireloom.llm.shingles import Sketch, chunks, mix, pack_tokens, runs, unpack_tokens, words
from hireloom.llm.sketching import bits_for, key_bitmap, merged_sketch, passes, share

#: Slots of the count sketch for each record, and its least and greatest size (128 MB a task) in bits. Beyond 2 ** 21 records the
#: order it gives tells rare tokens less well apart, but stays one order for all records: no pair is lost by it.
SKETCH_SLOTS, SKETCH_LEAST, SKETCH_MOST = 16, 22, 25
#: The same for the bitmap of records in candidate pairs (128 MB at most): beyond it sets of other records are sent too.
BITMAP_SLOTS, BITMAP_LEAST, BITMAP_MOST = 16, 20, 30
#: Tokens of the records of one block, about; the number of blocks grows with the corpus. A record's size and bitmap are sent to each
#: block it has an entry in, so smaller blocks would send more.
BLOCK_ENTRIES = 6_000_000
#: Times the size of the index that are sent at once without writing it, and that a round sends beside the written one.
AT_ONCE, A_ROUND = 2.0, 0.75
#: Records of an entry that are paired in one cell, about.
HOT_ENTRY = 16_384
#: Steps of a doubling in which counts are told.
STEPS = 8
#: Pairs compared at once within a block.
PAIR_CHUNK = 1 << 18
#: Records of one index part at most, whose numbers take two bytes.
PART_RECORDS = 60_000
#: 64-bit words of a record's parity bitmap.
PARITY_WORDS = 6
#: Bytes of an entry with its record's place, and of a record's number, size and bitmap.
ENTRY_BYTES, RECORD_BYTES = 8, 12 + 8 * PARITY_WORDS


def _texts(batch: pa.RecordBatch) -> pa.Array:
    title, body = (pc.fill_null(batch.column(i).cast(pa.large_string()), "") for i in (1, 2))
    return pc.binary_join_element_wise(title, body, pa.scalar(" ", pa.large_string()))


def _sets(batch: pa.RecordBatch, k: int, least_words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(keys, tokens, edges) of the eligible records of each chunk of a batch of (key, title, body)."""
    for start, part in chunks(_texts(batch)):
        tokens, edges, counts = runs(part, k)
        sizes = np.diff(edges)
        _, of = words(batch.column(1).slice(start, len(part)))
        ok = (counts - np.bincount(of, minlength=len(part)) >= least_words) & (sizes > 0)
        if not ok.all():
            tokens, edges = tokens[np.repeat(ok, sizes)], np.concatenate(([0], np.cumsum(sizes[ok])))
        yield batch.column(0).slice(start, len(part)).filter(pa.array(ok)), tokens, edges


def _set_hashes(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)))
    return mix(total[edges[1:]] - total[edges[:-1]] + np.diff(edges).astype(np.uint64)).view(np.int64)


class Bounds:
    """The numbers that a similarity of t or more implies."""

    def __init__(self, t: float):
        if not 0.5 < t <= 1:
            raise ValueError("the threshold must lie above 0.5 and not above 1")
        self.t = t
        self.pair_share = 3 * t / (1 + t) - 1
        #: The least size at which one common neighbouring pair is certain, whatever the partner.
        self.least = next(a for a in range(2, 10_000) if self.common_pairs(np.array([a]))[0] >= 1)
        self.single = math.ceil(self.least / t)

    def common_pairs(self, a: np.ndarray) -> np.ndarray:
        return np.ceil(self.pair_share * (a + np.ceil(self.t * a - 1e-9)) - 1 - 1e-9).astype(np.int64)

    def indexed_pairs(self, a: np.ndarray) -> np.ndarray:
        return np.clip(a - np.maximum(self.common_pairs(a), 1), 1, np.maximum(a - 1, 1))

    def prefix(self, a: np.ndarray | int) -> np.ndarray:
        return a - np.ceil(self.t * a - 1e-9).astype(np.int64) + 1

    def overlap(self, sizes: np.ndarray) -> np.ndarray:
        """Least overlap of two sets with ``sizes`` elements together."""
        return np.ceil(sizes * (self.t / (1 + self.t)) - 1e-9).astype(np.int64)


def _entries(tokens: np.ndarray, edges: np.ndarray, rarity: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, record, count): the indexed neighbouring pairs of each set, and the single tokens of small ones; the count, in steps of
    a doubling, is a bound for how often the entry occurs."""
    sizes = np.diff(edges)
    of = np.repeat(np.arange(len(sizes)), sizes)
    # Runs are kept in hash order already, so neighbours in the array are neighbours in that order.
    slot = rarity[(tokens & np.uint64(len(rarity) - 1)).astype(np.int64)]
    same = of[1:] == of[:-1]
    pair = mix(tokens[:-1] * np.uint64(3) + mix(tokens[1:]))[same]
    rank, own = (slot[:-1].astype(np.uint64) + slot[1:])[same], of[:-1][same]
    key = (own.astype(np.uint64) << np.uint64(40)) | (rank << np.uint64(31)) | (pair >> np.uint64(33))
    order = _in_order(key, pair)
    firsts = np.concatenate(([0], np.cumsum(np.maximum(sizes - 1, 0))))
    place = np.arange(len(pair)) - np.repeat(firsts[:-1], np.maximum(sizes - 1, 0))
    keep = place < bounds.indexed_pairs(sizes)[own]
    small = sizes[of] <= bounds.single
    least = np.minimum(slot[:-1], slot[1:])[same]
    entries = np.concatenate((pair[order][keep], mix(tokens[small] + np.uint64(1))))
    return entries, np.concatenate((own[keep], of[small])), np.concatenate((least[order][keep], slot[small]))


def _in_order(key: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Order by key, and by the whole hash where keys are equal: one global order, whatever else a set holds."""
    order = np.argsort(key)
    ranked = key[order]
    tie = np.flatnonzero(ranked[1:] == ranked[:-1])
    if len(tie):
        at = np.unique(np.concatenate((tie, tie + 1)))
        order[at] = order[at][np.lexsort((whole[order[at]], ranked[at]))]
    return order


#: The lowest bits of an entry: all its records meet (0), or only those of its two sides (1 and 2).
_SIDES = np.uint64(3)


def _cells(entry: np.ndarray, of: np.ndarray, count: np.ndarray, sets: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, record) with hot entries once for each cell that their record's lot meets in."""
    entry = entry & ~_SIDES
    lots = np.ceil(2.0 ** ((count.astype(np.float64) + 0.5) / STEPS) / hot).astype(np.int64)
    split = np.flatnonzero(lots > 1)
    if not len(split):
        return entry, of
    n = lots[split]
    row = np.repeat(split, n)
    mine = (mix(sets.view(np.uint64)) >> np.uint64(8))[of[row]].astype(np.int64) % lots[row]
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    cell = (np.minimum(mine, other) * lots[row] + np.maximum(mine, other)).astype(np.uint64)
    side = np.where(mine == other, 0, np.where(mine < other, 1, 2)).astype(np.uint64)
    made = (mix(entry[row] + (cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & ~_SIDES) | side
    rest = lots <= 1
    return np.concatenate((entry[rest], made)), np.concatenate((of[rest], of[row]))


def _round_blocks(records: int, tokens: int, blocks: int, cores: int, bounds: Bounds) -> int:
    """Blocks of one round: all, unless that sends more than AT_ONCE times what the index holds."""
    entries = float(bounds.indexed_pairs(np.array([math.ceil(tokens / max(records, 1))]))[0])
    index = entries * ENTRY_BYTES + RECORD_BYTES
    sent = entries * ENTRY_BYTES + RECORD_BYTES * blocks * (1 - (1 - 1 / blocks) ** entries)
    if sent <= AT_ONCE * index:
        return blocks
    each = blocks / math.ceil(sent / (A_ROUND * index))
    return max(1, int(each) // cores * cores if each >= cores else int(each))


def _parity(tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
    n, bits = len(edges) - 1, 64 * PARITY_WORDS
    of = np.repeat(np.arange(n), np.diff(edges))
    bit = (mix(tokens + np.uint64(7)) >> np.uint64(40)).astype(np.int64) % bits
    odd = (np.bincount(of * bits + bit, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view("<u8")


def _block_pairs(entry: np.ndarray, doc: np.ndarray, ids: np.ndarray, sizes: np.ndarray, parity: np.ndarray, bounds: Bounds) -> Iterator[np.ndarray]:
    """Distinct (id, id) pairs of documents that share an entry and may be similar; ids are distinct documents' numbers."""
    order = np.lexsort((doc, entry))
    entry, doc = entry[order], doc[order]
    side, entry = entry & _SIDES, entry >> np.uint64(2)
    fresh = np.concatenate(([True], (entry[1:] != entry[:-1]) | (doc[1:] != doc[:-1])))
    entry, doc, side = entry[fresh], doc[fresh], side[fresh]
    starts = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(entry)])))
    # Each entry meets all later ones of its group; a group's pairs are dealt out row by row, in chunks.
    remaining = np.repeat(starts + lengths, lengths) - np.arange(len(entry)) - 1
    rows = np.flatnonzero(remaining)
    upto = np.cumsum(remaining[rows])
    done = 0
    while done < len(rows):
        base = upto[done - 1] if done else 0
        stop = max(int(np.searchsorted(upto, base + PAIR_CHUNK, side="right")), done + 1)
        row, n = rows[done:stop], remaining[rows[done:stop]]
        left = np.repeat(row, n)
        right = left + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        apart = (side[left] != side[right]) | (side[left] == 0)
        x, y = doc[left[apart]], doc[right[apart]]
        total = sizes[x] + sizes[y]
        fits = np.minimum(sizes[x], sizes[y]) >= np.maximum(sizes[x], sizes[y]) * bounds.t - 1e-9
        x, y, total = x[fits], y[fits], total[fits]
        apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1)
        fits = apart <= total - 2 * bounds.overlap(total)
        a, b = ids[x[fits]], ids[y[fits]]
        yield np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        done = stop


def near_duplicates(rows: DataFrame, key: str, title: str, body: str, k: int = 5, threshold: float = 0.8, least_words: int = 0,
                    sketch_bits: int | None = None, bitmap_bits: int | None = None, block_entries: int = BLOCK_ENTRIES, hot_entry: int = HOT_ENTRY) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (key, rep) names the class of equal sets of each record by its least key; links (rep_a, rep_b,
    similarity), rep_a < rep_b, are the pairs of classes with a Jaccard similarity of ``threshold`` or more (above 0.5) over the
    ``k``-word runs of title, a blank and body.

    ``key`` must be a unique bigint. Records whose body has fewer than ``least_words`` words, or whose text has no k-word run, take
    no part: null and empty texts give no row. Similarity is inclusive. The whole text counts, however long. Other columns are
    pruned; an empty table gives two empty tables. Runs are compared by 48-bit hashes.
    """
    with shuffles_freed(rows.sparkSession):
        return _near_duplicates(rows, key, title, body, k, threshold, least_words, sketch_bits, bitmap_bits, block_entries, hot_entry)


def _near_duplicates(rows: DataFrame, key: str, title: str, body: str, k: int, threshold: float, least_words: int,
                     sketch_bits: int | None, bitmap_bits: int | None, block_entries: int, hot_entry: int) -> tuple[DataFrame, DataFrame]:
    picked = rows.select(F.col(key).cast("bigint").alias("key"), F.col(title).alias("title"), F.col(body).alias("body"))
    bounds = Bounds(threshold)
    sketch_bits = sketch_bits or bits_for(picked.count(), SKETCH_SLOTS, SKETCH_LEAST, SKETCH_MOST)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, part = Sketch(sketch_bits), 0
        nulls = lambda n, kind: pa.nulls(n, kind)
        names = ["key", "set", "n", "part", "block", "counts"]
        for batch in batches:
            for keys, tokens, edges in _sets(batch, k, least_words):
                sketch.add(tokens)
                n = len(keys)
                part = part or (keys[0].as_py() if n else 0)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(_set_hashes(tokens, edges)), pa.array(np.diff(edges), pa.int32()), nulls(n, pa.int64()), nulls(n, pa.int32()), nulls(n, pa.binary())], names=names
                )
        used, packed = sketch.blocks()
        for i, p in zip(used, packed):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((None, pa.int64()), (None, pa.int64()), (None, pa.int32()), (part, pa.int64()), (i, pa.int32()), (p, pa.binary()))], names=names)

    counts_path = scratch_path(rows.sparkSession, "neardup-counts")
    first = stored(picked.mapInArrow(counted, "key bigint, set bigint, n int, part bigint, block int, counts binary"), counts_path)
    signatures = materialise(first.where(F.col("block").isNull()).select("key", "set", "n"), "neardup-signatures")
    counts = merged_sketch(first.where(F.col("block").isNotNull()).select("part", "block", "counts"), sketch_bits)
    discard(rows.sparkSession, counts_path)
    rarity = share(rows, np.minimum(np.round(np.log2(counts.astype(np.float64) + 1) * STEPS), 255).astype(np.uint8))
    records, indexed = signatures.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = cores * max(1, math.ceil(indexed / block_entries / cores))
    of_round = _round_blocks(records, indexed, blocks, cores, bounds)
    rounds = math.ceil(blocks / of_round)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in (b.slice(i, PART_RECORDS) for b in batches for i in range(0, len(b), PART_RECORDS)):
            held: list[tuple] = []
            for keys, tokens, edges in _sets(batch, k, least_words):
                if not len(keys):
                    continue
                sets = _set_hashes(tokens, edges)
                _, once = np.unique(sets, return_index=True)
                if len(once) < len(sets):
                    picks = np.zeros(len(sets), bool)
                    picks[once] = True
                    tokens, edges, sets = tokens[np.repeat(picks, np.diff(edges))], np.concatenate(([0], np.cumsum(np.diff(edges)[picks]))), sets[picks]
                entry, of = _cells(*_entries(tokens, edges, rarity.value, bounds), sets, hot_entry)
                held.append((entry, of, sets, np.diff(edges), _parity(tokens, edges)))
            if not held:
                continue
            shift = np.cumsum([0] + [len(h[2]) for h in held])
            entry, of = np.concatenate([h[0] for h in held]), np.concatenate([h[1] + s for h, s in zip(held, shift)])
            yield entry & np.uint64((1 << 48) - 1), of, *(np.concatenate([h[i] for h in held]) for i in (2, 3, 4))

    def in_blocks(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = ((entry >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        return block[order], order

    def sent(start: int, entry: np.ndarray, of: np.ndarray, sets: np.ndarray, sizes: np.ndarray, parity: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows for the blocks of the round that begins with block ``start``, in whose blocks all entries lie."""
        block, order = in_blocks(entry)
        cuts = np.searchsorted(block, np.arange(start, start + of_round + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[i] : cuts[i + 1]]
            used, local = np.unique(of[at], return_inverse=True)
            cells = [pack_tokens(entry[at]), local.astype("<u2").tobytes(), sets[used].astype("<i8").tobytes(), sizes[used].astype("<i4").tobytes(), parity[used].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["block", "entry", "doc", "sets", "sizes", "parity"])

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            yield from sent(0, *part)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The index: a row for each part, with columns for the entries of each round, so a round reads only its own."""
        for entry, of, sets, sizes, parity in parts(batches):
            block, order = in_blocks(entry)
            cuts = np.searchsorted(block, np.arange(rounds + 1) * of_round)
            cells = [sets.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), parity.tobytes()]
            for a, b in zip(cuts[:-1], cuts[1:]):
                cells += [pack_tokens(entry[order[a:b]]), of[order[a:b]].astype("<u2").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["sets", "sizes", "parity", *entries_of])

    def resent(start: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                entry, of, sets, sizes, parity = (c[i].as_py() for c in batch.columns)
                entry, parity = unpack_tokens(entry), np.frombuffer(parity, "<u8").reshape(-1, PARITY_WORDS)
                yield from sent(start, entry, np.frombuffer(of, "<u2").astype(np.int64), np.frombuffer(sets, "<i8"), np.frombuffer(sizes, "<i4"), parity)

    def joined(table: pa.Table) -> pa.Table:
        cell = lambda name, kind: [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
        ids = cell("sets", "<i8")
        shift = np.cumsum([0] + [len(x) for x in ids])
        entry = np.concatenate([unpack_tokens(x) for x in table.column("entry").to_pylist()])
        doc = np.concatenate([x.astype(np.int64) + s for x, s in zip(cell("doc", "<u2"), shift)])
        ids, sizes, parity = np.concatenate(ids), np.concatenate(cell("sizes", "<i4")).astype(np.int64), np.concatenate(cell("parity", "<u8")).reshape(-1, PARITY_WORDS)
        distinct, at, number = np.unique(ids, return_index=True, return_inverse=True)
        found = list(_block_pairs(entry, number[doc], distinct, sizes[at], parity[at], bounds))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"set_a": pairs[:, 0], "set_b": pairs[:, 1]})

    row = "block int, entry binary, doc binary, sets binary, sizes binary, parity binary"

    def paired(index: DataFrame) -> DataFrame:
        return index.repartitionById(of_round, "block").groupBy("block").applyInArrow(joined, "set_a bigint, set_b bigint").distinct()

    if rounds == 1:
        pairs = paired(picked.mapInArrow(posted, row))
    else:
        entries_of = [f"{c}_{r}" for r in range(rounds) for c in ("entry", "doc")]
        index_path = scratch_path(rows.sparkSession, "neardup-index")
        # A row is large, so row groups are closed after few rows.
        index = stored(picked.mapInArrow(kept, ", ".join(f"{c} binary" for c in ("sets", "sizes", "parity", *entries_of))), index_path,
                       **{"parquet.block.size": str(1 << 25), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"})
        found_in = []
        for r in range(rounds):
            again = index.select(f"entry_{r}", f"doc_{r}", "sets", "sizes", "parity").mapInArrow(partial(resent, r * of_round), row)
            found_in.append(materialise(paired(again), "neardup-round"))
        discard(rows.sparkSession, index_path)
        pairs = reduce(DataFrame.unionByName, found_in).distinct()
    classes = signatures.groupBy("set").agg(F.min("key").alias("rep"))
    classes = materialise(classes, "neardup-classes")
    members = signatures.select("key", "set").join(classes, "set").select("key", "rep")
    for side in ("a", "b"):
        pairs = pairs.join(classes.withColumnsRenamed({"set": f"set_{side}", "rep": f"rep_{side}"}), f"set_{side}")
    candidates = materialise(pairs.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")), "neardup-candidates")

    bitmap_bits = bitmap_bits or bits_for(2 * candidates.count(), BITMAP_SLOTS, BITMAP_LEAST, BITMAP_MOST)
    wanted = share(rows, key_bitmap(candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")), "rep", bitmap_bits))
    flagged = picked.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(1 << bitmap_bits)))

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lambda x: (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column(3).to_numpy())))
            for keys, tokens, edges in _sets(batch, k, least_words):
                of = np.repeat(np.arange(len(keys)), np.diff(edges))
                rank = rarity.value[(tokens & np.uint64(len(rarity.value) - 1)).astype(np.int64)].astype(np.uint64)
                ranked = tokens[_in_order((of.astype(np.uint64) << np.uint64(40)) | (rank << np.uint64(32)) | (tokens >> np.uint64(16)), tokens)]
                first = [(e, e + int(p)) for e, p in zip(edges[:-1], bounds.prefix(np.diff(edges)))]
                cells = [[short(ranked[a:b]) for a, b in first], [short(tokens[a:b]) for a, b in first], [pack_tokens(tokens[a:b]) for a, b in zip(edges[:-1], edges[1:])]]
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, pa.binary()) for c in cells)], names=["rep", "rare", "hashed", "tokens"])

    sets_path = scratch_path(rows.sparkSession, "neardup-sets")
    found = stored(flagged.mapInArrow(whole_sets, "rep bigint, rare binary, hashed binary, tokens binary"), sets_path)

    def beside(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(found.select(F.col("rep").alias(f"rep_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]), f"rep_{side}")
        return pairs.select("rep_a", "rep_b", *[f"{c}_{side}" for c in columns for side in ("a", "b")])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for order in (2, 4):  # rarity order, then hash order
                for i in np.flatnonzero(keep):
                    x, y = (np.frombuffer(batch.column(c)[int(i)].as_py(), "<u4") for c in (order, order + 1))
                    keep[i] = np.isin(x, y).any()
            yield batch.select([0, 1]).filter(pa.array(keep))

    alike = materialise(beside(candidates, "rare", "hashed").mapInArrow(passed, "rep_a bigint, rep_b bigint"), "neardup-passed")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similarity = np.zeros(len(batch))
            for i in range(len(batch)):
                x, y = (unpack_tokens(batch.column(c)[i].as_py()) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                similarity[i] = common / (len(x) + len(y) - common)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarity)], names=["rep_a", "rep_b", "similarity"])
            yield out.filter(pa.array(similarity >= threshold - 1e-12))

    links = materialise(beside(alike, "tokens").mapInArrow(verified, "rep_a bigint, rep_b bigint, similarity double"), "neardup-links")
    discard(rows.sparkSession, sets_path)
    return members, links


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: the linked pairs of records, copies within a class included.

    Classes of many copies are dealt to slots, so that no task holds all the pairs of a class.
    """
    placed = materialise(slots(members, "rep", "key")[0], "neardup-slots")
    sizes = placed.select("rep", "n_slots").distinct()
    across = links.select("rep_a", "rep_b")
    for side in ("a", "b"):
        n = sizes.select(F.col("rep").alias(f"rep_{side}"), "n_slots")
        across = across.join(n, f"rep_{side}").withColumn(f"slot_{side}", F.explode(F.sequence(F.lit(0), F.col("n_slots") - 1))).drop("n_slots")
    for side, name in (("a", "x"), ("b", "y")):
        across = across.join(placed.select(F.col("rep").alias(f"rep_{side}"), F.col("slot").alias(f"slot_{side}"), F.col("key").alias(name)), [f"rep_{side}", f"slot_{side}"])
    several = placed.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.max("n_slots").alias("n_slots")).where("n > 1").drop("n")
    within = pairs_within(placed, several, "rep", "key")
    return across.select("x", "y").unionByName(within.withColumnsRenamed({"key_a": "x", "key_b": "y"})).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def components(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, rep, class_id, n_links): the connected group of each record by its least representative, and its class's links.

    Each round hooks every root onto the least root linked to its group, follows the hooks to their ends by pointer jumping and
    contracts the links to the roots that are left. A root that takes no other's lower label takes in a neighbour, so two rounds
    halve the roots of a group at least; it ends when no link joins two roots. Each step is written to the shared folder.
    """
    edges = links.select("rep_a", "rep_b").unionByName(links.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b")))
    edges = materialise(edges, "neardup-edges")
    labels = materialise(members.select("rep").distinct().select("rep", F.col("rep").alias("label")), "neardup-labels")
    between = edges
    while not between.isEmpty():
        hooks = between.groupBy(F.col("rep_a").alias("root")).agg(F.least(F.col("rep_a"), F.min("rep_b")).alias("up"))
        hooks = materialise(hooks, "neardup-hooks")
        while True:  # each pass halves the way to the end
            above = hooks.select(F.col("root").alias("up"), F.col("up").alias("onward"))
            moved = materialise(hooks.join(above, "up").select("root", "up", "onward"), "neardup-hooks")
            done = moved.where(F.col("up") != F.col("onward")).isEmpty()
            hooks = moved.select("root", F.col("onward").alias("up"))
            if done:
                break
        labels = labels.join(hooks, F.col("label") == F.col("root"), "left").select("rep", F.coalesce("up", "label").alias("label"))
        labels = materialise(labels, "neardup-labels")
        for side in ("rep_a", "rep_b"):
            between = between.join(hooks.withColumnsRenamed({"root": side, "up": f"_{side}"}), side).drop(side).withColumnRenamed(f"_{side}", side)
        between = materialise(between.where("rep_a <> rep_b").select("rep_a", "rep_b").distinct(), "neardup-between")
    degree = edges.groupBy(F.col("rep_a").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
    named = labels.join(degree, "rep", "left").select("rep", F.col("label").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, "rep").select("key", "rep", "class_id", "n_links")
