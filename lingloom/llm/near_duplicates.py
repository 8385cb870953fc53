"""Records of similar content: a join on sets of code-point n-grams by an inverted index of their prefixes.

Exact copies are collapsed first; one of each class goes on. Every set is put in
one global order, rare n-grams first, the order of a prefix tree. Two sets of
Jaccard similarity t share one of the first n - ceil(t*n) + 1 elements, so the
tree is cut at that depth and spread over the cluster by element: the branches
that hang below one element meet in one group. In a group a pair is followed only
while the elements passed by (its depths in both branches) leave enough to reach
the threshold, which a sort by slack turns into a range; a parity bitmap of each
set then bounds what can remain below. Bitmaps and sizes are stored once a text,
beside it, and read by the tasks; only numbers of texts and depths are shuffled.
Nothing is dropped that could still reach the threshold. Survivors are verified on the texts: the candidates of a record
form a tree whose walk shares the overlap of common beginnings and leaves a
branch as soon as the remaining lengths cannot suffice.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.llm.tally import tally
from lingloom.session import materialize, release


@dataclass(frozen=True)
class NearDuplicateConfig:
    """gram: code points of an element. threshold: least Jaccard similarity. least_length: code points a text must
    have. slots: counters of the frequencies that order elements (their number, and so what is broadcast, does not
    grow with the data; any order gives exact results). block: records of one element that are compared in one task;
    elements that more texts hold, by exact count, are cut into pairs of blocks. chunk: pairs looked at in one array.
    texts_at_once: texts whose branches are packed together; part_entries: entries of a part of the index, about, that
    one task holds at a time (all three bound memory). walk: candidates of one record that
    are walked in one task. few: rows up to which a list is broadcast."""

    gram: int = 5
    threshold: float = 0.7
    least_length: int = 150
    slots: int = 1 << 22
    block: int = 20_000
    chunk: int = 200_000
    texts_at_once: int = 4096
    part_entries: int = 2_000_000
    walk: int = 2_000
    few: int = 1_000_000


BLANKS = re.compile(r"\s+")


def normal_text(text: str) -> str:
    """Lower case, each run of white space one blank, none at the edges."""
    return BLANKS.sub(" ", text.lower()).strip()


def gram_hashes(text: str, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the ``k``-code-point substrings of a normalised text."""
    return np.unique(hashes_in_order(text, k))


def hashes_in_order(text: str, k: int) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(a) < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = a[: len(a) - k + 1].copy()
        for i in range(1, k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - k + 1 + i]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (slots - 1)


def frequencies(texts: DataFrame, config: NearDuplicateConfig) -> np.ndarray:
    """How many texts hold an element of each slot, over all texts. ``texts`` is (text) of normalised distinct texts.

    The count of a slot is never less than that of any of its elements.
    """

    def add(table, batch):
        for at in range(0, batch.num_rows, config.texts_at_once):
            for t in batch.slice(at, config.texts_at_once).column(0).to_pylist():
                np.add.at(table, _slot(gram_hashes(t, config.gram), config.slots), 1)

    return np.minimum(tally(texts.select("text"), config.slots, add), np.iinfo(np.int32).max).astype(np.int32)


def hot_elements(texts: DataFrame, counts, config: NearDuplicateConfig) -> dict[int, int]:
    """Elements that more than ``block`` texts hold, with exact counts.

    Only those of slots over ``block`` can be, so only they are counted, by a
    grouped aggregation. There are at most as many as all elements by ``block``;
    their list is broadcast up to ``few`` and an error beyond.
    """
    if not (counts.value > config.block).any():
        return {}

    def run(batches):
        for b in batches:
            found = [h[counts.value[_slot(h, config.slots)] > config.block] for h in (gram_hashes(t, config.gram) for t in b.column(0).to_pylist())]
            element, n = np.unique(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(element.view(np.int64)), pa.array(n)], names=["element", "n"])

    exact = texts.select("text").mapInArrow(run, "element long, n long").groupBy("element").agg(F.sum("n").alias("n")).where(F.col("n") > config.block)
    rows = exact.limit(config.few + 1).collect()
    if len(rows) > config.few:
        raise ValueError("more hot elements than a broadcast holds: raise block")
    return {r["element"]: r["n"] for r in rows}


def bits_for(n: int) -> int:
    """Bits of a set's parity bitmap: a power of two, so that larger ones fold onto smaller ones."""
    return 512 if n < 500 else 1024 if n < 1000 else 2048 if n < 2000 else 4096


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap whose bit is the parity of the elements that fall on it, as 64-bit words."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    """Rows of bitmaps folded to ``bits`` bits: parities of halves add up."""
    while words.shape[1] * 64 > bits:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: zeros come together and compress."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(raw: memoryview, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, dtype=np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of neighbours, modulo the width of their kind; ``np.cumsum`` in that kind undoes it."""
    return np.concatenate((x[:1], x[1:] - x[:-1]))


KINDS = [np.uint32, np.int32, np.uint16, np.uint16, np.int64]  # of key, count, text, depth, id
CODEC = "zstd"


def packed_postings(key: np.ndarray, text: np.ndarray, depth: np.ndarray, ident: np.ndarray) -> tuple[int, bytes]:
    """Length before compression and bytes of entries sorted by key, then text; ``text`` points into ``ident``."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    wide = depth.max() >= 1 << 16
    raw = [planes(steps(key[first])), planes(np.diff(np.append(first, len(key))).astype(np.int32)), planes(steps(text.astype(np.uint16))), planes(depth.astype(np.int32 if wide else np.uint16)), planes(steps(ident))]
    whole = np.array([*map(len, raw), wide], dtype=np.int64).tobytes() + b"".join(raw)
    return len(whole), pa.compress(whole, codec=CODEC, asbytes=True)


def unpacked_postings(size: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, depth, id) of each entry."""
    whole = memoryview(pa.decompress(data, decompressed_size=size, codec=CODEC, asbytes=True))
    head = np.frombuffer(whole[:48], dtype=np.int64).tolist()
    at = np.cumsum([48, *head[:5]]).tolist()
    kinds = [*KINDS[:3], np.int32 if head[5] else np.uint16, KINDS[4]]
    key, count, text, depth, ident = (from_planes(whole[i:j], kind) for i, j, kind in zip(at, at[1:], kinds))
    return np.repeat(np.cumsum(key, dtype=np.uint32), count), depth.astype(np.int32), np.cumsum(ident)[np.cumsum(text, dtype=np.uint16)]


def tree_prefixes(texts: DataFrame, counts, hot: dict[int, int], parts: int, config: NearDuplicateConfig) -> DataFrame:
    """(part, size, data): each set cut at the depth at which a partner must have met it.

    The index is spread by element over ``parts``. A row packs the entries that
    some texts put into one part: 32 bits of the element's hash, which a part
    seldom gives to two elements and then only makes pairs that are verified in
    vain, and for each the texts and depths. Elements of slots that count one
    text have no partner and are left out, depths count them. Records of hot
    elements fall into blocks, and every pair of blocks is a group of its own.
    """
    k, slots, t, most = config.gram, config.slots, config.threshold, config.block
    at_once = min(config.texts_at_once, 1 << 16)
    schema = pa.schema([("part", pa.int32()), ("size", pa.int64()), ("data", pa.binary())])
    shipped = texts.sparkSession.sparkContext.broadcast((np.array(sorted(hot), dtype=np.int64), np.array([hot[x] for x in sorted(hot)], dtype=np.int64)))

    def packed(entries, numbers):
        key, depth = (np.concatenate([e[c] for e in entries]) for c in (0, 1))
        text = np.repeat(np.arange(len(entries)), [len(e[0]) for e in entries])
        ident = np.array(numbers, dtype=np.int64)
        place = (key % np.uint64(parts) << np.uint64(32)) | (key >> np.uint64(32))
        order = np.argsort(place, kind="stable")
        place, text, depth = place[order], text[order], depth[order]
        part, key = (place >> np.uint64(32)).astype(np.int64), (place & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for at in range(0, len(cut) - 1, 64):
            rows = [(int(part[a]), *packed_postings(key[a:b], text[a:b], depth[a:b], ident)) for a, b in zip(cut[at : at + 64], cut[at + 1 : at + 65])]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        seen = counts.value
        hot_element, hot_count = shipped.value
        entries, numbers, held = [], [], 0
        for b in batches:
            for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = gram_hashes(text, k)
                n = len(h)
                if not n:
                    continue
                often = seen[_slot(h, slots)]
                order = np.lexsort((h, often))[: n - math.ceil(t * n) + 1]
                depth = np.flatnonzero(often[order] > 1).astype(np.int32)
                if not len(depth):
                    continue
                element = h[order[depth]]
                key = _mixed(element)
                if len(hot_element):
                    at = np.minimum(np.searchsorted(hot_element, element.view(np.int64)), len(hot_element) - 1)
                    blocks = np.where(hot_element[at] == element.view(np.int64), -(-hot_count[at] // most), 1)
                    rep = np.repeat(np.arange(len(depth)), blocks)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    own = (ident % blocks)[rep]
                    mine = np.where(blocks[rep] > 1, (np.minimum(own, other) << 31) + np.maximum(own, other) + 1, 0)
                    key, depth = _mixed(key[rep] ^ _mixed(mine.view(np.uint64))), depth[rep]
                entries.append((key, depth))
                numbers.append(ident)
                held += len(key)
                if len(numbers) >= at_once or held >= config.part_entries:
                    yield from packed(entries, numbers)
                    entries, numbers, held = [], [], 0
        if entries:
            yield from packed(entries, numbers)

    return texts.select("id", "text").mapInArrow(run, "part int, size long, data binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Stored:
    """Number, size and bitmap of texts, in the order of their numbers."""

    id: np.ndarray
    n: np.ndarray
    bitmaps: Bitmaps

    @classmethod
    def read(cls, files: list[str], wanted: np.ndarray | None) -> Stored:
        """From the Parquet files of the texts: those whose numbers are ``wanted`` (sorted), or all."""
        idents, sizes, words, data = [], [], [], []
        for name in files:
            system, path = pa.fs.FileSystem.from_uri(name)
            with pq.ParquetFile(system.open_input_file(path)) as file:
                for b in file.iter_batches(65_536, columns=["id", "n", "bitmap"], use_threads=False):
                    if wanted is not None:
                        own = b.column("id").to_numpy()
                        at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                        b = b.take(pa.array(np.flatnonzero(wanted[at] == own)))
                    if not b.num_rows:
                        continue
                    idents.append(b.column("id").to_numpy())
                    sizes.append(b.column("n").to_numpy())
                    d, _, w = Bitmaps.parts_of(b.column("bitmap"))
                    data.append(d)
                    words.append(w)
        ident, n, words, data = (np.concatenate([*x, np.zeros(0, dtype=kind)]) for x, kind in ((idents, np.int64), (sizes, np.int32), (words, np.int64), (data, np.uint64)))
        start = np.cumsum(words) - words
        order = np.argsort(ident, kind="stable")
        return cls(ident[order], n[order].astype(np.int64), Bitmaps(data, start[order], words[order]))


class Bitmaps:
    """Bitmaps of rows, of one or more widths, folded on demand. Made from an Arrow column without an object a row."""

    def __init__(self, data: np.ndarray, start: np.ndarray, words: np.ndarray):
        self.words = words
        self.table = {}
        self.place = np.zeros(len(words), dtype=np.int64)
        for w in np.unique(words).tolist():
            rows = np.flatnonzero(words == w)
            self.table[w] = data[start[rows][:, None] + np.arange(w)]
            self.place[rows] = np.arange(len(rows))
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of_column(cls, column: pa.Array) -> Bitmaps:
        return cls(*cls.parts_of(column))

    @staticmethod
    def parts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of all bitmaps, where each begins, and how many it has."""
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return np.frombuffer(column.buffers()[2], dtype=np.uint8, count=offsets[-1])[offsets[0] :].view(np.uint64), (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8

    @classmethod
    def of_bytes(cls, maps: list[bytes]) -> Bitmaps:
        return cls.of_column(pa.array(maps, type=pa.binary()))

    def get(self, rows: np.ndarray, own: int, at: int) -> np.ndarray:
        if (own, at) not in self.folded:
            self.folded[own, at] = fold(self.table[own], at * 64)
        return self.folded[own, at][self.place[rows]]


def pairs_in_groups(group: np.ndarray, depth: np.ndarray, n: np.ndarray, ident: np.ndarray, bitmaps: list[bytes] | Bitmaps, t: float, chunk: int):
    """Pairs (id, id) of one or more whole groups that may reach the threshold.

    With c = (1-t)/(1+t) a pair may differ in at most c*(n1+n2) elements, and its
    depths d1, d2 are elements it differs in: d1 - c*n1 + d2 - c*n2 <= 0. Sorted by
    this slack inside each group, the partners of a record are one range.
    """
    held = bitmaps if isinstance(bitmaps, Bitmaps) else Bitmaps.of_bytes(bitmaps)
    yield from pairs_of(group, depth, np.arange(len(group)), n, ident, held, t, chunk)


STEPS = 2  # bands of size in which a set may be t times another


def pairs_of(group: np.ndarray, depth: np.ndarray, text: np.ndarray, sizes: np.ndarray, idents: np.ndarray, held: Bitmaps, t: float, chunk: int):
    """The same for entries that point into arrays of their texts. Sizes fall into bands, so that a partner is at most STEPS bands away."""
    c = (1 - t) / (1 + t)
    n = sizes[text]
    slack = depth - c * n
    band = np.floor(STEPS * np.log(n) / -math.log(t) + 1e-9).astype(np.int64)
    many = int(band.max()) + STEPS + 2 if len(band) else 1
    label = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    order = np.lexsort((slack, label * many + band))
    slack, n, text = slack[order], n[order], text[order]
    remains = n - depth[order]
    place = (label * many + band)[order]
    wide = 4.0 * (np.abs(slack).max(initial=0.0) + 1.0)
    keys = place * wide + slack
    words = held.words[text]
    for away in range(STEPS + 1):
        # rounding of the keys is far below this, and a pair too much is not harmful
        end = np.searchsorted(keys, (place + away) * wide - slack + 1e-4, side="right")
        begin = np.arange(len(keys)) + 1 if away == 0 else np.searchsorted(keys, (place + away) * wide - wide / 2, side="left")
        much = np.maximum(end - begin, 0)
        total = np.cumsum(much)
        at = 0
        while at < len(keys):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")))
            m = much[at:stop]
            if m.any():
                a = np.repeat(np.arange(at, stop), m)
                b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[at:stop], m)
                near = (np.minimum(n[a], n[b]) >= t * np.maximum(n[a], n[b]) - 1e-9) & (idents[text[a]] != idents[text[b]])
                a, b = a[near], b[near]
                # what is left below the shared element has to suffice for the overlap
                enough = np.minimum(remains[a], remains[b]) >= t / (1 + t) * (n[a] + n[b]) - 1e-9
                a, b = a[enough], b[enough]
                bound = c * (n[a] + n[b]) + 1e-9
                for wa in held.table:
                    for wb in held.table:
                        pick = np.arange(len(a)) if len(held.table) == 1 else np.flatnonzero((words[a] == wa) & (words[b] == wb))
                        if len(pick):
                            w = min(wa, wb)
                            x, y = text[a[pick]], text[b[pick]]
                            differ = np.bitwise_count(held.get(x, wa, w) ^ held.get(y, wb, w)).sum(axis=1, dtype=np.int32)
                            ok = differ <= bound[pick]
                            if ok.any():
                                p, q = idents[x[ok]], idents[y[ok]]
                                yield np.minimum(p, q), np.maximum(p, q)
            at = stop


def candidate_pairs(prefixes: DataFrame, texts: DataFrame, config: NearDuplicateConfig) -> DataFrame:
    """Distinct (a, b), a < b, of record ids whose sets may reach the threshold. ``texts`` is a table of ``materialize`` with id, n and bitmap."""
    t, chunk = config.threshold, config.chunk
    files = texts.inputFiles()
    # so many bitmaps a task holds; of larger tables it reads those of one part at a time
    whole = texts.count() <= config.part_entries

    def pairs(rows: list[tuple], all_texts: Stored | None):
        key, depth, ident = (np.concatenate(c) for c in zip(*(unpacked_postings(*r) for r in rows)))
        order = np.argsort(key, kind="stable")
        key, depth, ident = key[order], depth[order], ident[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(new, len(key)))
        kept = np.repeat(size > 1, size)
        group, depth, ident = np.repeat(np.arange(len(size)), size)[kept], depth[kept], ident[kept]
        if not len(group):
            return
        held = all_texts or Stored.read(files, np.unique(ident))
        found = list(pairs_of(group, depth, np.searchsorted(held.id, ident), held.n, held.id, held.bitmaps, t, chunk))
        if found:
            a, b = np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])
            both = np.unique(np.stack([a, b], axis=1), axis=0)
            for at in range(0, len(both), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(both[at : at + 50_000, 0]), pa.array(both[at : at + 50_000, 1])], names=["a", "b"])

    def run(batches):
        part, rows, all_texts = None, [], None
        for b in batches:
            for at, *row in zip(*(c.to_pylist() for c in b.columns)):
                if whole and all_texts is None:
                    all_texts = Stored.read(files, None)
                if at != part and rows:
                    yield from pairs(rows, all_texts)
                    rows = []
                part = at
                rows.append(tuple(row))
        if rows:
            yield from pairs(rows, all_texts)

    return prefixes.repartition("part").sortWithinPartitions("part").mapInArrow(run, "a long, b long").distinct()


def walk_tree(of: list, sets: list[list], t: float) -> list[float | None]:
    """Similarity of one ordered set to each of others, or None below the threshold.

    The others are walked in the order of their elements, as a prefix tree: the
    overlap of a beginning that two of them share is counted once, and a branch
    is left when what remains cannot suffice.
    """
    mine = set(of)
    out: list[float | None] = [None] * len(sets)
    path: list = []
    overlap = [0]  # overlap[d]: elements of path[:d] that are mine
    dead = -1  # depth at which the present branch was left, by the bound of dead_n
    dead_n = 0
    for k in sorted(range(len(sets)), key=lambda i: sets[i]):
        other = sets[k]
        n, m = len(mine), len(other)
        need = math.ceil(t / (1 + t) * (n + m) - 1e-9)
        d, most = 0, min(len(path), m)
        while d < most and path[d] == other[d]:
            d += 1
        if 0 <= dead <= d and m <= dead_n:
            continue  # below a branch that was left for a set at least as long
        del path[d:], overlap[d + 1 :]
        dead = -1
        o = overlap[d]
        while d < m:
            if o + m - d < need:
                dead, dead_n = d, m
                break
            x = other[d]
            o += x in mine
            path.append(x)
            d += 1
            overlap.append(o)
        else:
            if o >= need and n + m > o and o / (n + m - o) >= t - 1e-12:
                out[k] = o / (n + m - o)
    return out


def spread_by_record(candidates: DataFrame, config: NearDuplicateConfig) -> DataFrame:
    """(a, b, part): the candidates of a record stay together, in parts of about ``walk`` where it has more."""
    often = candidates.groupBy("a").agg(F.count("*").alias("k")).where(F.col("k") > config.walk)
    few = often.limit(config.few + 1).count() <= config.few
    joined = candidates.join(F.broadcast(often) if few else often, "a", "left")
    return joined.select("a", "b", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / config.walk)).cast("int")).alias("part"))


def verify(candidates: DataFrame, reps: DataFrame, counts, config: NearDuplicateConfig) -> DataFrame:
    """(rep_a, rep_b, similarity) of the candidates that reach the threshold, by their texts.

    All candidates of a record, or a part of them, are in one task and are walked
    as one tree.
    """
    k, slots, t = config.gram, config.slots, config.threshold
    # only the texts of candidates move, where their list can be broadcast
    ids = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct()
    if ids.limit(config.few + 1).count() <= config.few:
        reps = reps.join(F.broadcast(ids), "id", "left_semi")
    x = reps.select(F.col("id").alias("a"), F.col("rep").alias("rep_a"), F.col("text").alias("text_a"))
    y = reps.select(F.col("id").alias("b"), F.col("rep").alias("rep_b"), F.col("text").alias("text_b"))
    # b's text first; that of a comes last, by the key that the candidates are then spread by
    joined = spread_by_record(candidates, config).join(y, "b").join(x, "a").repartition("a", "part").sortWithinPartitions("a", "part")

    def run(batches):
        seen = counts.value
        known: dict[str, list] = {}

        def ordered(text: str) -> list:
            if text not in known:
                if len(known) > 256:
                    known.clear()
                often = seen[_slot(hashes_in_order(text, k), slots)].tolist()
                known[text] = sorted(set(zip(often, (text[i : i + k] for i in range(len(text) - k + 1)))))
            return known[text]

        for b in batches:
            rows = b.to_pylist()
            out: list[dict] = []
            at = 0
            while at < len(rows):
                stop = at
                while stop < len(rows) and rows[stop]["a"] == rows[at]["a"]:
                    stop += 1
                found = walk_tree(ordered(rows[at]["text_a"]), [ordered(r["text_b"]) for r in rows[at:stop]], t)
                out += [{"rep_a": r["rep_a"], "rep_b": r["rep_b"], "similarity": s} for r, s in zip(rows[at:stop], found) if s is not None]
                at = stop
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("rep_a", pa.string()), ("rep_b", pa.string()), ("similarity", pa.float64())]))

    return joined.mapInArrow(run, "rep_a string, rep_b string, similarity double")


@dataclass(frozen=True)
class NearDuplicates:
    members: DataFrame  # key, rep: the class of exact copies each record belongs to
    links: DataFrame  # rep_a, rep_b, similarity: linked classes, each pair once


def near_duplicates(df: DataFrame, key: str = "source_id", text: str = "source_text", config: NearDuplicateConfig = NearDuplicateConfig()) -> NearDuplicates:
    """Classes of equal texts and the links between similar ones.

    Texts are compared in lower case with each run of white space one blank. A
    null text, or one under ``least_length`` code points, takes no part. Repeated
    keys count once; a class is named by its least key. An empty table gives no
    classes and no links.
    """
    spark = df.sparkSession
    usable = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.length("text") >= config.least_length)

    def normal(batches):
        for b in batches:
            yield b.set_column(1, "text", pa.array([normal_text(t) for t in b.column(1).to_pylist()], type=pa.string()))

    def measured(batches):
        for b in batches:
            n, maps = [], []
            for t in b.column(2).to_pylist():
                h = gram_hashes(t, config.gram)
                n.append(len(h))
                maps.append(parity(h, bits_for(len(h))).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, type=pa.int32()), pa.array(maps, type=pa.binary())], names=[*b.schema.names, "n", "bitmap"])

    normed = usable.mapInArrow(normal, "key string, text string")
    hashed = normed.withColumn("h", F.unhex(F.md5(F.encode("text", "UTF-8"))))
    classes = hashed.groupBy("h").agg(F.min("key").alias("rep"), F.min("text").alias("text"))
    # numbers are those of partition and row as written, so no two classes have the same
    reps = materialize(classes.mapInArrow(measured, "h binary, rep string, text string, n int, bitmap binary").withColumn("id", F.monotonically_increasing_id()))
    release(spark)
    # keys by the hash of their text; a key lost with its text cannot occur, as both come from one row
    members = materialize(hashed.select("key", "h").distinct().join(reps.select("h", "rep"), "h").select("key", "rep"))
    release(spark)
    counts = spark.sparkContext.broadcast(frequencies(reps, config))
    # an upper bound of the entries, from lengths alone
    entries = reps.agg(F.sum(F.length("text") * (1 - config.threshold) + 2)).first()[0] or 0
    parts = max(1, math.ceil(entries / config.part_entries))
    candidates = materialize(candidate_pairs(tree_prefixes(reps, counts, hot_elements(reps, counts, config), parts, config), reps, config))
    release(spark)
    links = verify(candidates, reps, counts, config)
    return NearDuplicates(members, links)


def expand(found: NearDuplicates) -> DataFrame:
    """(a, b), a < b: every linked pair of records, copies included. Its size is that of the result asked for."""
    links = found.links.select("rep_a", "rep_b")
    between = (
        links.join(found.members.select(F.col("key").alias("x"), F.col("rep").alias("rep_a")), "rep_a")
        .join(found.members.select(F.col("key").alias("y"), F.col("rep").alias("rep_b")), "rep_b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    m = found.members
    within = m.select(F.col("key").alias("a"), "rep").join(m.select(F.col("key").alias("b"), "rep"), "rep").where("a < b").select("a", "b")
    return between.unionByName(within).distinct()


def class_links(found: NearDuplicates) -> DataFrame:
    """(key, rep, links): one row a record with its class and the number of classes linked to it."""
    ends = found.links.select(F.col("rep_a").alias("rep")).union(found.links.select(F.col("rep_b").alias("rep")))
    n = ends.groupBy("rep").agg(F.count("*").alias("links"))
    return found.members.join(n, "rep", "left").select("key", "rep", F.coalesce("links", F.lit(0)).alias("links"))
