"""N-gram Jaccard join: a blocked sparse matrix product of documents by word shingles, with size-derived bounds.

Documents with equal shingle sets form one class, a row of the matrix. The columns are ordered from rare to frequent. Two
sets of Jaccard similarity 3/4 share a column among the first n - ceil(3 n / 4) + 1 of each, so that only these
entries are multiplied: they are dealt out in blocks of columns, each block multiplies its part, and the overlaps are
added up over the blocks. Pairs whose overlap so far, with all that may follow, stays below what their sizes ask for are
discarded. A column that many classes share would give all pairs among them; it only says that they may belong together.

What may belong together is compared in full, each set being sent to one task once: there, the sets' own product gives
the links from one set to all that are not reached yet. Where more than a task should hold may belong together, rounds
compare a few pivots of each frequent column with the others. Sets still apart after these are compared if a frequent
column can be the first that they share: by their sizes and places in it, and where that leaves too many pairs, by the
next columns too, which have to agree as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.common import attach, cut, give_back, table
from keyloom.llm.components import components
from keyloom.llm.hashing import MULTIPLIERS, hashed_texts, mixed

WORDS = 5
#: Linked if LINK[1] * intersection >= LINK[0] * union.
LINK = (3, 4)


@dataclass(frozen=True)
class Sizes:
    """How the work is dealt out. Other sizes give the same result."""

    #: Columns with up to so many classes are multiplied out.
    small_run: int = 64
    #: Sets that may belong together are compared in one task up to so many sets and shingles; beyond, in rounds.
    task_sets: int = 4096
    task_entries: int = 8_000_000
    pivots: int = 3
    rounds: int = 6
    #: After the rounds: pairs of a column for each of its sets up to which they are compared, not parted by the next column.
    dense: int = 64
    levels: int = 4
    #: Columns with so many entries count as frequent, and at most so many are told to the tasks (16 MB): their order.
    frequent: int = 8
    most_frequent: int = 1_000_000
    #: Columns with so many entries are not sent to one block, but spread by sets.
    hot: int = 200_000
    #: Entries that a task gathers before it deals them to blocks (columns to count, entries to multiply), and those of a block.
    window: int = 2_000_000
    flush: int = 500_000
    block: int = 1_000_000
    #: Beyond so many blocks, entries are dealt in two steps, so that what a task sends to a block stays worth a row.
    one_step: int = 16_000
    #: The filter of the sets to be compared in full has at most so many bits; a full one lets more through.
    filter_bits: int = 1 << 24


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes; of fewer words the one whole sequence."""
    for w, bounds in hashed_texts(texts):
        h = np.zeros(max(len(w) - n + 1, 0), np.uint64)
        for k in range(n if len(h) else 0):
            h += w[k : k + len(h)] * MULTIPLIERS[k]
        h = mixed(h + np.uint64(n))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(h[a : b - n + 1])
            elif b > a:
                yield mixed((w[a:b] * MULTIPLIERS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield w[:0]


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    return next(shingle_sets(pa.array([text.encode("utf-8", "surrogatepass")], pa.binary()), n))


def signature(s: np.ndarray) -> bytes:
    """128 bits of a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True)
    give_back()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, size and signature of each text."""
    kinds = [pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        rows = [(doc_id, len(s), signature(s) if len(s) else None) for doc_id, s in _texts([batch])]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)], ["doc_id", "n_shingles", "sig"])


def _steps(n_blocks: int, one_step: int) -> int:
    """How many blocks go together in the first of two steps; 1: there is one step."""
    return -(-n_blocks // one_step)


class _Cells:
    """Columns cut to their first bits and packed by block: sorted, as gaps. together: so many blocks go as one."""

    def __init__(self, bits: int, n_blocks: int, window: int) -> None:
        self.shift, self.per_block, self.window = np.uint64(64 - bits), np.uint64(-(-(1 << bits) // n_blocks)), window

    def packed(self, cells: np.ndarray, together: int) -> pa.RecordBatch:
        cells = np.sort(cells)
        block = (cells // self.per_block // np.uint64(together)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(block)) + 1
        out = []
        for part in np.split(cells, cuts):
            gaps = np.diff(part, prepend=part[:1])
            kind = next(k for k in (np.uint16, np.uint32, np.uint64) if gaps.max() <= np.iinfo(k).max)
            out.append(bytes([np.dtype(kind).itemsize]) + part[:1].tobytes() + gaps.astype(kind).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(block[np.r_[0, cuts]]), pa.array(out, pa.binary())], ["block", "cells"])

    def of_texts(self, together: int):
        """Of each window of texts. Equal sets of a window count once."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            window, held, seen = [], 0, set()
            for _, s in _texts(batches):
                if len(s) and (sig := signature(s)) not in seen:
                    seen.add(sig)
                    window.append(s >> self.shift)
                    held += len(s)
                    if held >= self.window:
                        yield self.packed(np.concatenate(window), together)
                        window, held, seen = [], 0, set()
            if window:
                yield self.packed(np.concatenate(window), together)

        return run

    def again(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The second step: what blocks together got, for each block."""
        window, held = [], 0
        for batch in batches:
            for x in batch.column(1):
                window.append(_unpacked(x.as_py()))
                held += len(window[-1])
                if held >= self.window:
                    yield self.packed(np.concatenate(window), 1)
                    window, held = [], 0
        if window:
            yield self.packed(np.concatenate(window), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u8", 1, 1) + np.cumsum(np.frombuffer(x, f"<u{x[0]}", offset=9).astype(np.uint64), dtype=np.uint64)


def _counted(frequent: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """The cells of a block with `frequent` entries or more."""
        cell, n = np.unique(np.concatenate([_unpacked(x) for x in block["cells"]]), return_counts=True)
        return pd.DataFrame({"cell": cell[n >= frequent].astype(np.int64), "n": n[n >= frequent]})

    return run


ENTRY = np.dtype([("sig", "V16"), ("n", "<u4"), ("place", "<u4"), ("hash", "<u8")])


def _need(n):
    """The least intersection that a set of n must have with any other that it links with."""
    return (LINK[0] * n + LINK[1] - 1) // LINK[1]


class _Order:
    """The order of columns, from rare to frequent: rare ones by hash, the others as told."""

    def __init__(self, shared, bits: int) -> None:
        self.shared, self.shift = shared, np.uint64(64 - bits)

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns of a set in order, and which of them are hot."""
        cells, place, hot = self.shared.value
        if not len(cells):
            return s, np.zeros(len(s), bool)
        own = (s >> self.shift).astype(np.int64)
        at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
        often = cells[at] == own
        by = np.argsort(place[at[often]], kind="stable")
        return np.concatenate([s[~often], s[often][by]]), np.concatenate([np.zeros((~often).sum(), bool), hot[at[often]][by]])


def _dealt(e: np.ndarray, block: np.ndarray, together: int) -> pa.RecordBatch:
    block = block // together
    by = np.argsort(block, kind="stable")
    e, block = e[by], block[by]
    cuts = np.flatnonzero(np.diff(block)) + 1
    return pa.RecordBatch.from_arrays([pa.array(block[np.r_[0, cuts]], pa.int64()), pa.array([x.tobytes() for x in np.split(e, cuts)], pa.binary())], ["block", "entries"])


class _Entries:
    """The entries to be multiplied, by block of columns: blocks 0 to n_blocks - 1. Those of hot columns go to the n_hot
    blocks after these, by set."""

    def __init__(self, order: _Order, n_blocks: int, n_hot: int, flush: int) -> None:
        self.order, self.n_blocks, self.n_hot, self.flush = order, n_blocks, n_hot, flush

    def of_texts(self, together: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, blocks, held, seen = [], [], 0, set()
            for _, s in _texts(batches):
                if not len(s) or (sig := signature(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sig)
                n = len(s)
                s, hot = self.order(s)
                e = np.empty(n - _need(n) + 1, ENTRY)
                e["sig"], e["n"], e["place"], e["hash"] = np.frombuffer(sig, "V16"), n, np.arange(len(e)), s[: len(e)]
                parts.append(e)
                spread = self.n_blocks + int.from_bytes(sig[:6], "big") % max(self.n_hot, 1)
                blocks.append(np.where(hot[: len(e)], spread, (e["hash"] % np.uint64(self.n_blocks)).astype(np.int64)))
                held += len(e)
                if held >= self.flush:
                    yield _dealt(np.concatenate(parts), np.concatenate(blocks), together)
                    parts, blocks, held = [], [], 0
            if parts:
                yield _dealt(np.concatenate(parts), np.concatenate(blocks), together)

        return run

    def again(self, together: int):
        """The second step: what blocks together got, for each block."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, blocks, held = [], [], 0
            for batch in batches:
                for first, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    e = np.frombuffer(x, ENTRY)
                    own = (e["hash"] % np.uint64(self.n_blocks)).astype(np.int64)
                    sig = np.frombuffer(e["sig"].tobytes(), np.uint8).reshape(-1, 16)[:, :6].astype(np.int64)
                    spread = self.n_blocks + (sig @ (1 << np.arange(40, -1, -8, dtype=np.int64))) % max(self.n_hot, 1)
                    parts.append(e)
                    blocks.append(np.where(own // together == first, own, spread) if self.n_hot else own)
                    held += len(e)
                    if held >= self.flush:
                        yield _dealt(np.concatenate(parts), np.concatenate(blocks), 1)
                        parts, blocks, held = [], [], 0
            if parts:
                yield _dealt(np.concatenate(parts), np.concatenate(blocks), 1)

        return run


def _possible(n1, p1, n2, p2):
    """Whether sets of these sizes that share the columns at these places can still link."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    most = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) + np.minimum(p1, p2)
    return (LINK[1] * small >= LINK[0] * large) & ((LINK[0] + LINK[1]) * most >= LINK[0] * (n1 + n2))


PRODUCT = "a binary, b binary, na long, nb long, place long, overlap long, run binary, col long"
_KINDS = {"nb": "Int64", "place": "Int64", "overlap": "Int64", "run": object, "col": "Int64"}


def _multiply(n_blocks: int, small_run: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        """Of one block of columns: pairs with their overlap (place: what they can have in common if no column comes before
        the first they share here); the classes of frequent columns, with their places there (run: the
        classes' own, so that columns with the same classes are one; b: one of them). Of a hot block: classes by column."""
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in block["entries"]])
        keys = np.frombuffer(np.ascontiguousarray(e["sig"]).tobytes(), ">u8").reshape(-1, 2)
        by = np.lexsort((keys[:, 1], keys[:, 0]))
        new = np.r_[True, (keys[by][1:] != keys[by][:-1]).any(axis=1)]
        node = np.empty(len(e), np.int64)
        node[by] = np.cumsum(new) - 1
        sigs = e["sig"][by][new]
        size_of = e["n"][by][new].astype(np.int64)
        by = np.lexsort((node, e["hash"]))
        e, node = e[by], node[by]
        once = ~np.r_[False, (e["hash"][1:] == e["hash"][:-1]) & (node[1:] == node[:-1])]
        e, node = e[once], node[once]
        name = lambda ids: [sigs[i].tobytes() for i in ids]
        n, place = e["n"].astype(np.int64), e["place"].astype(np.int64)
        if block["block"].iloc[0] >= n_blocks:
            out = pd.DataFrame({"a": name(node), "b": None, "na": n, "nb": None, "place": place, "overlap": None, "run": None, "col": e["hash"].view(np.int64)})
            return out.astype(_KINDS)
        cuts = np.flatnonzero(np.r_[True, e["hash"][1:] != e["hash"][:-1]])
        sizes = np.diff(np.r_[cuts, len(e)])
        codes, mosts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in range(2, small_run + 1):
            at = cuts[sizes == size]
            for i in range(size if len(at) else 0):
                for j in range(i + 1, size):
                    ok = _possible(n[at + i], place[at + i], n[at + j], place[at + j])
                    x, y = (at + i)[ok], (at + j)[ok]
                    codes.append(node[x] * len(sigs) + node[y])
                    mosts.append(np.minimum(n[x] - place[x], n[y] - place[y]))
        code = np.concatenate(codes)
        by = np.argsort(code, kind="stable")
        code, most = code[by], np.concatenate(mosts)[by]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        overlap = np.diff(np.r_[first, len(code)])
        a, b = code[first] // len(sigs), code[first] % len(sigs)
        parts = [pd.DataFrame({"a": name(a), "b": name(b), "na": size_of[a], "nb": size_of[b], "place": np.maximum.reduceat(most, first) if len(code) else most, "overlap": overlap, "run": None, "col": None})]
        # of columns with the same classes the first in order is enough: all classes have it before the others
        runs: dict[bytes, int] = {}
        long = dict(zip(cuts[sizes > small_run].tolist(), sizes[sizes > small_run].tolist(), strict=True))
        for at, size in long.items():
            key = hashlib.blake2b(node[at : at + size].tobytes(), digest_size=16).digest()
            if key not in runs or place[at] < place[runs[key]]:
                runs[key] = at
        for at in runs.values():
            own = slice(at, at + long[at])
            members = name(node[own])
            parts.append(pd.DataFrame({"a": members, "b": members[0], "na": n[own], "nb": None, "place": place[own], "overlap": None, "run": hashlib.blake2b(b"".join(members), digest_size=16).digest(), "col": None}))
        out = pd.concat([x.astype(_KINDS) for x in parts])
        del e, keys, by, new, node, sigs, size_of, n, place, code, most, codes, mosts, parts
        give_back()
        return out

    return run


def _together(group: pd.DataFrame) -> pd.DataFrame:
    """The component of each set among sets that may belong together: each goes to the least set it is linked with."""
    group = group.drop_duplicates("sig")
    sigs, sets = group["sig"].tolist(), group["shingles"].tolist()
    n = np.array([len(x) for x in sets])
    left, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    by = np.argsort(left, kind="stable")
    left, owner = left[by], owner[by]
    label = np.full(len(sets), -1)
    waiting = len(sets)
    for start in range(len(sets)):
        if label[start] >= 0:
            continue
        label[start] = start
        queue = [start]
        waiting -= 1
        while queue and waiting:
            i = queue.pop()
            begin, end = np.searchsorted(left, sets[i]), np.searchsorted(left, sets[i], "right")
            lengths = end - begin
            at = np.repeat(begin - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            overlap = np.bincount(owner[at], minlength=len(sets))
            hit = np.flatnonzero((label < 0) & (overlap > 0) & (LINK[1] * overlap >= LINK[0] * (n + n[i] - overlap)))
            label[hit] = start
            queue += hit.tolist()
            waiting -= len(hit)
            left_open = label[owner] < 0
            if 2 * left_open.sum() < len(owner):  # what is reached need not be met again
                left, owner = left[left_open], owner[left_open]
    least = {k: min(x for x, c in zip(sigs, label, strict=True) if c == k) for k in np.unique(label[label != np.arange(len(sets))])}
    rows = [(x, least[k]) for x, k in zip(sigs, label.tolist(), strict=True) if k in least]
    return pd.DataFrame(rows, columns=["node", "root"])


def _arrays(shared, bits: int, order: _Order, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signature and shingles, in the order of columns, of the sets that the filter lets through, once a task."""
        wanted, seen, sigs, sets, held = shared.value, set(), [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["sig", "shingles"])

        for _, s in _texts(batches):
            if not len(s):
                continue
            sig = signature(s)
            cell = int.from_bytes(sig[:4], "big") % bits
            if wanted[cell >> 3] >> (cell & 7) & 1 and sig not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sig)
                sigs.append(sig)
                sets.append(order(s)[0].view(np.int64))
                held += len(s)
                if held >= flush:
                    yield out()
                    sigs, sets, held = [], [], 0
        if sigs:
            yield out()

    return run


def _filter_of(needed: DataFrame, count: int, most: int) -> tuple[bytes, int]:
    """A bit for each signature (collisions let a few more through), at most so many whatever their number."""
    bits = min(max(1 << (16 * count).bit_length(), 1 << 16), most)
    cell = F.conv(F.hex(F.substring("sig", 1, 4)), 16, 10).cast("long") % bits
    words = needed.select(cell.alias("c")).groupBy(F.floor(F.col("c") / 8).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(c % 8 as int))")).alias("byte")).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    out[words["at"].to_numpy(int)] = words["byte"].to_numpy(int)
    return out.tobytes(), bits


def linked(intersection: Column, n1: Column, n2: Column) -> Column:
    return LINK[1] * intersection >= LINK[0] * (n1 + n2 - intersection)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    return cut(both.filter(linked(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"))).select("a", "b"))


def _need_of(n: Column) -> Column:
    return F.floor((LINK[0] * n + LINK[1] - 1) / LINK[1])


def _can_link(n1: Column, n2: Column, most: Column) -> Column:
    """Whether sets of these sizes can link with at most so many columns in common."""
    return (LINK[1] * F.least(n1, n2) >= LINK[0] * F.greatest(n1, n2)) & ((LINK[0] + LINK[1]) * most >= LINK[0] * (n1 + n2))


def _with_pivots(labelled: DataFrame, turn: int, pivots: int, total: int) -> DataFrame:
    """Pairs of each run's classes with a few pivots of other labels: classes of its largest labels, the same in all runs
    that have them, as far as can be."""
    one = F.struct("a", "na", "place")
    labels = labelled.groupBy("run", "root").agg(F.count("*").alias("n"), F.max_by(one, F.xxhash64("a", F.lit(turn))).alias("p"))
    chosen = labels.groupBy("run", F.pmod(F.xxhash64("root", F.lit(turn)), F.lit(pivots)).alias("slot")).agg(F.max(F.struct("n", "root", "p")).alias("best"), F.sum("n").alias("n"))
    chosen = chosen.groupBy("run").agg(F.collect_list("best").alias("chosen"), F.sum("n").alias("n"))  # at most `pivots`
    each = attach(labelled, chosen, "run", "n", total).withColumn("c", F.explode("chosen")).filter("root <> c.root")
    p = lambda name: F.col("c.p")[name]
    most = 1 + F.least(F.col("na") - F.col("place") - 1, p("na") - p("place") - 1) + F.least(F.col("place"), p("place"))
    return each.filter(_can_link(F.col("na"), p("na"), most)).select(F.least("a", p("a")).alias("a"), F.greatest("a", p("a")).alias("b")).distinct()


def _still_apart(labelled: DataFrame, sets: DataFrame, sizes: Sizes) -> DataFrame:
    """All pairs of classes with different labels that a run's column can link: the column as the first that they share.

    Classes of one size and place in a column are alike to the bounds, so these are paired first. Where that would leave
    more than `dense` pairs a class, the classes are parted by the columns that can be the next in common: at most as many
    as a set can miss and still link.
    """
    found = None
    level, here = 1, labelled.select("run", "a", "root", "na", "place")
    while True:
        here = cut(here)
        kinds = here.groupBy("run", "na", "place").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
        one = cut(kinds)
        two = one.select("run", *[F.col(c).alias(f"{c}2") for c in ("na", "place", "n", "low", "high")])
        most = level + F.least(F.col("na") - F.col("place"), F.col("na2") - F.col("place2")) - 1
        ordered = (F.col("na") < F.col("na2")) | ((F.col("na") == F.col("na2")) & (F.col("place") <= F.col("place2")))
        apart = (F.col("low") != F.col("high2")) | (F.col("high") != F.col("low2"))
        pairs = cut(one.join(two, "run").filter(ordered & apart & _can_link(F.col("na"), F.col("na2"), most)))
        weight = pairs.groupBy("run").agg(F.sum(F.col("n").cast("double") * F.col("n2")).alias("w"))
        heavy = one.groupBy("run").agg(F.sum("n").alias("m")).join(weight, "run").select("run", (F.lit(level < sizes.levels) & (F.col("w") > sizes.dense * F.col("m"))).alias("heavy"))
        # pairs that have all columns in common that they need share no further one for certain
        pairs = cut(pairs.join(heavy, "run").withColumn("heavy", F.col("heavy") & (LINK[0] * (F.col("na") + F.col("na2")) > (LINK[0] + LINK[1]) * level)))
        light = pairs.filter("not heavy").select("run", "na", "place", "na2", "place2")
        other = here.select("run", F.col("a").alias("b"), F.col("root").alias("root2"), F.col("na").alias("na2"), F.col("place").alias("place2"))
        new = here.join(light, ["run", "na", "place"]).join(other, ["run", "na2", "place2"]).filter("root <> root2")
        new = new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = cut((new if found is None else found.unionByName(new)).distinct())
        dense = pairs.filter("heavy")
        if dense.isEmpty():
            return found
        sides = dense.select("run", "na", "place").unionByName(dense.select("run", F.col("na2").alias("na"), F.col("place2").alias("place"))).distinct()
        missing = F.col("na") - F.col("place") - 1 - (_need_of(F.col("na")) - level)
        following = F.transform(F.slice("shingles", (F.col("place") + 2).cast("int"), (missing + 1).cast("int")), lambda g, i: F.struct(g.alias("g"), (F.col("place") + 1 + i).alias("next")))
        parted = here.join(sides, ["run", "na", "place"]).join(sets.withColumnRenamed("sig", "a"), "a").filter(missing >= 0)
        here = parted.select("run", "a", "root", "na", F.explode(following).alias("x")).select(F.unhex(F.md5(F.concat(F.hex("run"), F.lit(":"), F.col("x.g").cast("string")))).alias("run"), "a", "root", "na", F.col("x.next").alias("place"))
        level += 1


def _by_rounds(pairs: DataFrame, members: DataFrame, sets: DataFrame, sizes: Sizes) -> DataFrame:
    """node and root of the components of classes too many for one task."""
    members = cut(members)
    total = members.count()
    links = _verified(pairs, sets)
    roots = components(links)
    labels = lambda: members.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    for turn in range(sizes.rounds):
        new = _verified(_with_pivots(cut(labels()), turn, sizes.pivots, total), sets)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        roots = components(links)
    new = _verified(_still_apart(labels(), sets, sizes), sets)
    return roots if new.isEmpty() else components(links.unionByName(new))


def _grouped(rows: DataFrame, first, again, schema: str, together: int) -> DataFrame:
    """What tasks deal out to blocks, in one step or, where blocks are very many, in two."""
    dealt = rows.mapInArrow(first, schema)
    return dealt if together == 1 else dealt.repartition("block").mapInArrow(again, schema)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A text's set are its distinct 5-word shingles (words are runs of other characters than space and U+0009 to U+000D, A-Z
    as a-z); of one to four words the whole sequence; null and blank texts have the empty set and link with nothing. Two
    texts link when the Jaccard similarity of their sets is 3/4 or more. component_id is the least doc_id that links lead
    to, the row's own included; null ids count as greater than others. Repeated rows are texts with equal sets. Other
    columns are ignored; an empty table gives an empty result.

    sizes changes how the work is dealt out, not the result. Sets are compared by 64-bit hashes of shingles, made of 64-bit hashes
    of words; classes of equal sets go by 128-bit signatures.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = cut(rows.mapInArrow(_profile, "doc_id long, n_shingles long, sig binary"))
    totals = profile.agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("entries")).first()
    entries = totals["entries"] or 0

    bits = min(max(32, entries.bit_length() + 4), 60)
    n_blocks = max(1, entries // sizes.window)
    together = _steps(n_blocks, sizes.one_step)
    cells = _Cells(bits, n_blocks, sizes.window)
    counted = _grouped(rows, cells.of_texts(together), cells.again, "block long, cells binary", together).groupBy("block").applyInPandas(_counted(sizes.frequent), "cell long, n long")
    top = counted.orderBy(F.desc("n"), "cell").limit(sizes.most_frequent).toPandas().sort_values("cell")
    rank = np.empty(len(top), np.int64)
    rank[np.lexsort((top["cell"], top["n"]))] = np.arange(len(top))
    hot = top["n"].to_numpy(np.int64) >= sizes.hot
    order = _Order(context.broadcast((top["cell"].to_numpy(np.int64), rank, hot)), bits)

    n_blocks = max(1, entries // sizes.block)
    n_hot = -(-int(top["n"].to_numpy(np.int64)[hot].sum()) // sizes.block)
    together = _steps(n_blocks, sizes.one_step)
    n_blocks = -(-n_blocks // together) * together
    dealt = _Entries(order, n_blocks, n_hot, sizes.flush)
    dealt = _grouped(rows, dealt.of_texts(together), dealt.again(together), "block long, entries binary", together)
    product = cut(dealt.groupBy("block").applyInPandas(_multiply(n_blocks, sizes.small_run), PRODUCT))
    shared = product.filter("overlap is not null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("overlap").alias("overlap"), F.max("place").alias("most"))
    kept = lambda n: n - _need_of(n) + 1
    rest = F.greatest(F.col("na") - kept(F.col("na")), F.col("nb") - kept(F.col("nb")))  # beyond the entries that were dealt
    pairs = cut(shared.filter((LINK[0] + LINK[1]) * (F.col("overlap") + rest) >= LINK[0] * (F.col("na") + F.col("nb"))).select("a", "b"))
    members = product.filter("run is not null").select("run", "a", "na", "place", "b")
    if n_hot:
        by_column = cut(product.filter("col is not null").groupBy("col", "a").agg(F.first("na").alias("na"), F.min("place").alias("place")))
        columns = by_column.groupBy("col").agg(F.count("*").alias("n"), F.min("a").alias("b"), F.bit_xor(F.xxhash64("a")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "a")).alias("y"))
        columns = columns.filter("n > 1").select("col", "n", "b", F.unhex(F.md5(F.concat_ws(":", "n", "x", "y"))).alias("run"))
        members = members.unionByName(attach(by_column, columns, "col", "n", by_column.count()).filter("run is not null").select("run", "a", "na", "place", "b"))
    # columns of one run have the same classes: all classes take their places in the first of them in the order of columns
    members = members.groupBy("run", "a").agg(F.first("na").alias("na"), F.min("place").alias("place"), F.min("b").alias("b"))

    near = components(pairs.unionByName(members.select("a", "b")))
    near = cut(near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()))
    n_shingles = profile.filter("sig is not null").groupBy(F.col("sig").alias("node")).agg(F.first("n_shingles").alias("n"))
    groups = cut(near.join(n_shingles, "node").groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("entries")))
    large = cut(groups.filter((F.col("sets") > sizes.task_sets) | (F.col("entries") > sizes.task_entries)).select("root"))
    wanted, size = _filter_of(near.withColumnRenamed("node", "sig"), near.count(), sizes.filter_bits)
    found = rows.mapInArrow(_arrays(context.broadcast(wanted), size, order, sizes.flush), "sig binary, shingles array<bigint>")
    found = found.join(near.withColumnRenamed("node", "sig"), "sig")
    if large.isEmpty():
        roots = cut(found.groupBy("root").applyInPandas(_together, "node binary, root binary"))
    else:
        sets = cut(found.join(large, "root", "left_semi").groupBy("sig").agg(F.first("shingles").alias("shingles")))
        inside = near.join(large, "root", "left_semi").select(F.col("node").alias("a"))
        # their overlap leaves out frequent columns: these may link whose first column in common is one of these
        first = shared.filter(_can_link(F.col("na"), F.col("nb"), F.col("most"))).select("a", "b")
        by_rounds = _by_rounds(first.join(inside, "a", "left_semi"), members.join(inside, "a", "left_semi"), sets, sizes)
        roots = cut(found.join(large, "root", "left_anti").groupBy("root").applyInPandas(_together, "node binary, root binary").unionByName(by_rounds))

    classes = profile.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    classes = cut(classes)
    merged = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    classes = attach(classes, merged, "root", "m", totals["docs"]).select("sig", "component_id", "n")
    out = attach(profile.filter("sig is not null"), classes, "sig", "n", totals["docs"])
    empty = profile.filter("sig is null").withColumn("component_id", F.col("doc_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionByName(empty.select("doc_id", "n_shingles", "component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM split),
entries AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM entries a JOIN entries b ON a.h = b.h AND a.doc_id <> b.doc_id
  WHERE 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = s.doc_id
"""
