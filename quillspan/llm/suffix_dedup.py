"""Suffix-array dedup of passages that recur anywhere in the corpus.

Method: a collection of byte strings gets its Burrows-Wheeler transform and common-prefix array column by column: each round
puts one more symbol of every string in front of its last suffix and merges the new suffixes into the transform and the prefix
lengths, which are read from one set of files and written to another, front to back. A suffix whose common prefix with a
neighbour is ``length`` or more starts a passage that recurs.

A whole corpus would need as many rounds as its longest text has bytes, each over all data, in one task. So the strings are
pieces of the texts, dealt so that equal passages meet. Each passage of ``length`` bytes holds ``length - GRAM + 1`` grams;
the one of least hash (leftmost of ties) is its anchor, which depends on the passage alone. A piece is all passages
with one anchor: at most 2 x length bytes, each start position of a text in exactly one piece. Only anchors whose gram
occurs twice go on; their pieces are grouped by gram, and each task transforms collections of whole groups. Within a group,
pieces are cut to what another one shares with them around the anchor (by sorting what follows and what precedes it), those
cut below ``length`` bytes are left out, as they cannot recur, and equal ones are one string with a mark that it stands for several.

A group of more than ``max_group`` different pieces is parted first, so that no task holds an unbounded group. The distance from
a passage's start to its anchor is cut into cells of CELLS[0] distances, then CELLS[1] and so on. All passages of a cell hold the
same stretch around the anchor, its core: pieces' parts of one cell are a group of their own if their cores are equal. Equal
passages have equal distances and cores, so they still meet. Equal parts are one string; a part alone in its group recurs nowhere
and goes; parts of a group that is still crowded are cut into finer cells, down to single passages, which are their core. All other groups are
transformed, whatever their way. Cells hold hashes; bytes move only for parts that are transformed or cut again.

Texts are keyed by their MD5, so copies are one text; a copied text of ``length`` bytes or more is removed whole. Defined cases:
null and empty texts have nothing to remove; texts under ``length`` bytes recur nowhere; repeated rows and null ids are copies
like others, with one result per row; an empty table gives an empty result. Memory of a task: a piece of SEGMENT bytes of text and
about COLLECTION bytes of strings with about 50 bytes of tables each.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import release, settle, small_batches, table, text_of
from .words import U, mix

LENGTH, GRAM, MAX_GROUP, COLLECTION, SEGMENT = 400, 32, 64, 64 << 10, 1 << 20
CELLS = (64, 8, 1)
#: Keys a task remembers to spare itself repeats; beyond that it forgets them all.
REMEMBERED = 1 << 17


# ---- the transform ----------------------------------------------------------------------------------------------------


class Files:
    """The transform and prefix lengths of one round, a file each; save() writes them anew beside the old, load() reads from front to back."""

    KINDS = (("bwt", np.uint8), ("lcp", np.uint16))

    def __init__(self, folder: str):
        self.files = [[open(os.path.join(folder, f"{name}{turn}"), "w+b", buffering=0) for name, _ in self.KINDS] for turn in (0, 1)]  # noqa: SIM115
        self.turn, self.size = 0, 0

    def save(self, arrays: tuple[np.ndarray, ...]) -> None:
        self.turn ^= 1
        self.size = len(arrays[0])
        for file, array in zip(self.files[self.turn], arrays, strict=True):
            file.seek(0)
            left = memoryview(array).cast("B")
            while left:
                left = left[file.write(left) :]

    def load(self) -> tuple[np.ndarray, ...]:
        out = []
        for file, (_, kind) in zip(self.files[self.turn], self.KINDS, strict=True):
            file.seek(0)
            out.append(np.fromfile(file, kind, self.size))
        return tuple(out)

    def close(self) -> None:
        for file in (*self.files[0], *self.files[1]):
            file.close()


def least_between(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last], each range not empty."""
    order = np.argsort(-first, kind="stable")  # with falling starts, what reduceat does between the ranges costs nothing
    pairs = np.empty(2 * len(first), np.int64)
    pairs[::2], pairs[1::2] = first[order], last[order] + 1
    out = np.empty(len(first), values.dtype)
    out[order] = np.minimum.reduceat(np.append(values, values.dtype.type(0)), pairs)[::2]
    return out


def column_bwt(strings: list[bytes], folder: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bwt, lcp, places) over all suffixes of ``strings``, the empty ones first, sorted; ends sort below all symbols, longest string first.

    bwt: the byte before the suffix, 255 (no byte of UTF-8) if it is a whole string. lcp: the common prefix with the suffix
    before. places[i][l]: where the suffix of length l of string i stands. Strings are shorter than 65,536 bytes."""
    n = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    order = np.argsort(-sizes, kind="stable")  # the strings that a round still extends are the first ones
    sizes = sizes[order]
    rounds = int(sizes[0]) if n else 0
    tape = np.full((rounds + 1, n), 255, np.uint8)  # row j: the symbols before the suffixes of length j
    for row, i in enumerate(order):
        tape[: len(strings[i]), row] = np.frombuffer(strings[i], np.uint8)[::-1]
    files = Files(folder)
    files.save((tape[0].copy(), np.zeros(n, np.uint16)))
    place = np.arange(n)  # where the last suffix of each string stands
    for j in range(rounds):
        active = int(np.searchsorted(-sizes, -j, "left"))  # strings longer than j
        place, symbols = place[:active], tape[j, :active]
        bwt, lcp = files.load()
        by_symbol = np.argsort(bwt, kind="stable")  # all places in order of (symbol, place)
        rank = np.empty(len(bwt), np.int64)
        rank[by_symbol] = np.arange(len(bwt))
        at = rank[place]
        new = n + at  # the new suffixes' places: as many stand before as symbols and places are less, and the empty ones
        before, after = by_symbol[np.maximum(at - 1, 0)], by_symbol[np.minimum(at + 1, len(bwt) - 1)]
        old = np.ones(len(bwt) + active, bool)
        old[new] = False
        bwt2, lcp2 = np.empty(len(old), np.uint8), np.empty(len(old), np.uint16)
        bwt2[old], lcp2[old] = bwt, lcp
        bwt2[new], lcp2[new] = tape[j + 1, :active], 0
        k = np.flatnonzero((at > 0) & (bwt[before] == symbols))
        if len(k):
            lcp2[new[k]] = least_between(lcp, before[k] + 1, place[k]) + 1
        k = np.flatnonzero((at + 1 < len(bwt)) & (bwt[after] == symbols))
        if len(k):
            lcp2[new[k] + 1] = least_between(lcp, place[k] + 1, after[k]) + 1
        files.save((bwt2, lcp2))
        place = new
    bwt, lcp = files.load()
    files.close()

    rank = np.empty(len(bwt), np.int64)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    at, walk = np.arange(n), np.zeros((rounds + 1, n), np.int64)
    for j in range(rounds + 1):  # from each empty suffix forward along the transform
        walk[j, : len(at)] = at
        at = n + rank[at[: int(np.searchsorted(-sizes, -j, "left"))]]
    places: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for row, i in enumerate(order):
        places[i] = walk[: len(strings[i]) + 1, row]
    return bwt, lcp, places


def recurring(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, the sorted starts of its ``length``-byte substrings that start anywhere else in the collection too."""
    if not strings:
        return []
    with tempfile.TemporaryDirectory() as folder:
        _, lcp, places = column_bwt(strings, folder)
    again = (lcp >= length) | np.append(lcp[1:] >= length, False)
    return [(len(s) - length - np.flatnonzero(again[p[length:]]))[::-1] for s, p in zip(strings, places, strict=True)]


# ---- anchors ----------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position (GRAM: a power of 2)."""
    h, step = mix(data.astype(U) + U(1)), 1
    while step < GRAM:
        h = mix(h[:-step] * U(0x9E3779B97F4A7C15) + h[step:])
        step *= 2
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    blocks = np.append(values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first, last, anchor) of each piece: the passages from first to last have this anchor, in order and gapless."""
    parts = []
    for low in range(0, max(0, len(text) - length + 1), SEGMENT):  # starts low .. low + SEGMENT - 1
        data = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - low), low)
        h = gram_hashes(data)
        ranked = (h & ~U(0x1FFFFF)) | np.arange(len(h), dtype=U)  # by hash, then from the left
        least = sliding_min(ranked, length - GRAM + 1)
        cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        at = (least[cut] & U(0x1FFFFF)).astype(np.int64)
        parts.append((h[at].view(np.int64), low + cut, low + np.append(cut[1:], len(least)) - 1, low + at))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def runs_of(starts: np.ndarray) -> list[int]:
    """[first, last, first, last ...] of runs of consecutive numbers."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) != 1)
    return np.stack((starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)]), 1).ravel().tolist()


# ---- groups -----------------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def reach(contexts: list[bytes]) -> list[int]:
    """For each string, the longest prefix that another one has too: that of a neighbour in sorted order."""
    order = sorted(range(len(contexts)), key=contexts.__getitem__)
    out = [0] * len(contexts)
    for i, j in zip(order, order[1:]):
        c = common(contexts[i], contexts[j])
        out[i], out[j] = max(out[i], c), max(out[j], c)
    return out


class Collector:
    """Takes groups of (number, piece, offset of the anchor, whether it stands for several); transforms them in collections.

    A piece is cut to what another one may share with it. Equal cuts are one string; one that stands for several pieces or
    places recurs all over, and is in the collection for the others' sake. Groups without others need no transform."""

    def __init__(self, length: int):
        self.length, self.strings, self.owners, self.size = length, [], [], 0

    def add(self, group: list[tuple[bytes, bytes, int, bool]]) -> Iterator[tuple[bytes, list[int]]]:
        right, left = reach([p[at:] for _, p, at, _ in group]), reach([p[:at][::-1] for _, p, at, _ in group])
        cuts: dict[bytes, list[tuple[bytes, int]]] = {}
        sure: set[bytes] = set()
        for (number, piece, at, several), r, back in zip(group, right, left, strict=True):
            if r + back < self.length:
                continue  # no other piece agrees with it over a passage's length
            cut = piece[at - back : at + r]
            owners = cuts.setdefault(cut, [])
            owners.append((number, at - back))
            if several or len(owners) > 1:
                sure.add(cut)
        for cut in sure:
            for number, shift in cuts[cut]:
                yield number, [shift, shift + len(cut) - self.length]
        if len(sure) == len(cuts):
            return
        size = sum(map(len, cuts))
        if self.size + size > COLLECTION:  # between groups: a group stays in one collection
            yield from self.flush()
        self.size += size
        for cut, owners in cuts.items():
            self.strings.append(cut)
            self.owners.append([] if cut in sure else owners)

    def flush(self) -> Iterator[tuple[bytes, list[int]]]:
        for owners, starts in zip(self.owners, recurring(self.strings, self.length), strict=True):
            for number, shift in owners if len(starts) else []:
                yield number, runs_of(starts + shift)
        self.strings, self.owners, self.size = [], [], 0


# ---- the operator -----------------------------------------------------------------------------------------------------


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def batch_of(columns: list, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def anchor_table(keyed: DataFrame, length: int) -> DataFrame:
    """(_key, _gram, _place): a row per piece; _place packs first, last - first and anchor - first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            found, keys = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    found.append(anchors(utf8(text), length))
                    keys.append(key)
            if len(seen) > REMEMBERED:  # repeated rows do no harm
                seen.clear()
            if not found:
                continue
            sizes = [len(f[0]) for f in found]
            owner = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            gram, first, last, at = (np.concatenate([f[i] for f in found]) for i in range(4))
            place = (first * length + (last - first)) * length + (at - first)
            yield pa.RecordBatch.from_arrays([owner, pa.array(gram), pa.array(place)], names=["_key", "_gram", "_place"])

    return keyed.mapInArrow(scan, "_key binary, _gram long, _place long")


def piece_table(texts: DataFrame, length: int) -> DataFrame:
    """(_gram, _pid, _off, _key, _first, _piece) of the listed anchors; _piece is null where this task has given it before."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
    names = ["_gram", "_pid", "_off", "_key", "_first", "_piece"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = utf8(text)
                for p in places:
                    rest, off = divmod(p["_place"], length)
                    first, more = divmod(rest, length)
                    piece = data[first : first + more + length]
                    pid = hashlib.md5(piece + off.to_bytes(4, "big")).digest()
                    for row, x in zip(rows, (p["_gram"], pid, off, key, first, None if pid in given else piece), strict=True):
                        row.append(x)
                    given.add(pid)
                if len(given) > REMEMBERED:
                    given.clear()
                if len(rows[0]) > 5000:
                    yield batch_of(rows, kinds, names)
                    rows = [[] for _ in names]
            if rows[0]:
                yield batch_of(rows, kinds, names)

    return texts.mapInArrow(cut, "_gram long, _pid binary, _off int, _key binary, _first long, _piece binary")


def transform_groups(pieces: DataFrame, length: int) -> DataFrame:
    """(_pid, _runs) of pieces(_group, _pid, _off, _piece, _several, _shift), dealt and sorted by group: runs of starts that recur in the group, moved by _shift."""
    kinds, names = [pa.binary(), pa.list_(pa.int64())], ["_pid", "_runs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collector, last, group = Collector(length), None, []

        def out(rows: list) -> pa.RecordBatch:
            return batch_of([[number[0] for number, _ in rows], [[x + number[1] for x in runs] for number, runs in rows]], kinds, names)

        for batch in batches:
            rows: list = []
            for g, pid, off, piece, several, shift in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if g != last:
                    rows.extend(collector.add(group))
                    last, group = g, []
                group.append(((pid, shift), piece, off, several))
            if rows:
                yield out(rows)
        if rows := [*collector.add(group), *collector.flush()]:
            yield out(rows)

    dealt = pieces.repartition("_group").sortWithinPartitions("_group")
    return dealt.select("_group", "_pid", "_off", "_piece", "_several", "_shift").mapInArrow(work, "_pid binary, _runs array<bigint>")


# ---- crowded groups ---------------------------------------------------------------------------------------------------


def starts_of(off: int, size: int, cell: int, width: int, length: int) -> tuple[int, int, int]:
    """(first, last, core end) for the cell of the distances from ``cell`` on, in a piece of ``size`` bytes with its anchor at ``off``: the starts, and where the core ends, which begins at off - cell."""
    least = off - min(cell + width, length - GRAM + 1) + 1
    return max(0, least), min(off - cell, size - length), least + length


def cell_table(todo: DataFrame, width: int, length: int) -> DataFrame:
    """(_group, _sub, _pid, _cell, _first, _last, _several) of todo(_pid, _off, _piece, _cells): a row per cell of ``width`` distances.

    _group stands for cell and core, _sub for the part's bytes and its place around the anchor. _cells: (from, to, several)."""
    kinds, names = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()], ["_group", "_sub", "_pid", "_cell", "_first", "_last", "_several"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pid, off, piece, cells in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for c in cells:
                    for cell in range(c["from"], c["to"], width):
                        first, last, end = starts_of(off, len(piece), cell, width, length)
                        if first <= last:
                            place = b"%d:%d:" % (cell, width)
                            core = piece[off - cell : end]
                            part = b"%d:" % (off - first) + piece[first : last + length]
                            rows.append((hashlib.md5(place + core).digest(), hashlib.md5(part).digest(), pid, cell, first, last, c["several"]))
            if rows:
                yield batch_of(list(zip(*rows, strict=True)), kinds, names)

    return todo.select("_pid", "_off", "_piece", "_cells").mapInArrow(cut, "_group binary, _sub binary, _pid binary, _cell int, _first int, _last int, _several boolean")


def part_table(asked: DataFrame, width: int, length: int) -> DataFrame:
    """(_group, _pid, _off, _piece, _several, _shift): the parts of asked(_pid, _off, _piece, _parts) with their bytes."""
    kinds, names = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.bool_(), pa.int32()], ["_group", "_pid", "_off", "_piece", "_several", "_shift"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pid, off, piece, parts in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for x in parts:
                    first, last, _ = starts_of(off, len(piece), x["_cell"], width, length)
                    rows.append((x["_group"], pid, off - first, piece[first : last + length], x["_sure"], first))
            if rows:
                yield batch_of(list(zip(*rows, strict=True)), kinds, names)

    return asked.select("_pid", "_off", "_piece", "_parts").mapInArrow(cut, "_group binary, _pid binary, _off int, _piece binary, _several boolean, _shift int")


def crowded_groups(pieces: DataFrame, length: int, max_group: int) -> list[DataFrame]:
    """Tables of (_pid, _runs) that tell all that recurs among pieces(_pid, _off, _piece, _several) of crowded groups, beside what _several tells.

    A round per width of CELLS. Of equal parts one goes on, marked: what they share is told at once for all of them."""
    whole = F.array(F.struct(F.lit(0).alias("from"), F.lit(length - GRAM + 1).alias("to"), F.col("_several").alias("several")))
    todo = settle(pieces.select("_pid", "_off", "_piece", whole.alias("_cells")))
    out = []
    for width in CELLS:
        rows = settle(cell_table(todo, width, length))
        parts = settle(rows.groupBy("_group", "_sub").agg(F.min("_pid").alias("_pid"), F.first("_cell").alias("_cell"), F.count("*").alias("_n"), F.max("_several").alias("_several")))
        shared = rows.join(parts.where("_n > 1").select("_group", "_sub"), ["_group", "_sub"])
        out.append(settle(shared.select("_pid", F.array("_first", "_last").cast("array<bigint>").alias("_runs"))))
        crowd = parts.groupBy("_group").agg(F.count("*").alias("_parts")).where("_parts > 1")
        left = settle(parts.join(crowd, "_group").select("_group", "_pid", "_cell", "_parts", (F.col("_several") | (F.col("_n") > 1)).alias("_sure")))
        few = left.where(F.col("_parts") <= max_group).groupBy("_pid").agg(F.collect_list(F.struct("_group", "_cell", "_sure")).alias("_parts"))
        out.append(settle(transform_groups(part_table(todo.join(few, "_pid"), width, length), length)))
        many = left.where(F.col("_parts") > max_group).groupBy("_pid").agg(F.collect_list(F.struct(F.col("_cell").alias("from"), F.least(F.col("_cell") + width, F.lit(length - GRAM + 1)).alias("to"), F.col("_sure").alias("several"))).alias("_cells"))
        todo = settle(todo.drop("_cells").join(many, "_pid"))
        if not todo.limit(1).count():  # single passages are equal where their cores are
            break
    return out


def find_passages(keyed: DataFrame, *, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """(_key, _runs) for texts of ``keyed(_key, _text)``: an array of runs of starts [first, last, ...] of passages that recur."""
    spark = keyed.sparkSession
    small_batches(spark)
    found = settle(anchor_table(keyed, length))
    place = F.xxhash64("_key", "_place")
    twice = settle(found.groupBy("_gram").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi")).where("_lo <> _hi").select("_gram"))
    listed = settle(found.join(twice, "_gram").groupBy("_key").agg(F.collect_set(F.struct("_gram", "_place")).alias("_places")))
    del found, twice
    release(spark)
    rows = settle(piece_table(keyed.join(listed, "_key").select("_key", "_text", "_places"), length))
    del listed
    release(spark)
    members = rows.select("_pid", "_key", "_first")
    place = F.xxhash64("_key", "_first")
    different = settle(rows.groupBy("_gram", "_pid").agg(F.max("_off").alias("_off"), F.max("_piece").alias("_piece"), (F.min(place) != F.max(place)).alias("_several")))
    members = settle(members.distinct())
    del rows
    release(spark)
    crowd = settle(different.groupBy("_gram").agg(F.count("*").alias("_n")))
    several = different.where("_several").select("_pid", F.array(F.lit(0).cast("long"), F.octet_length("_piece") - F.lit(length)).alias("_runs"))
    grouped = different.join(crowd.where(f"_n > 1 and _n <= {max_group}").select("_gram"), "_gram")
    runs = settle(transform_groups(grouped.select(F.col("_gram").alias("_group"), "_pid", "_off", "_piece", "_several", F.lit(0).alias("_shift")), length)).unionByName(several)
    big = crowd.where(f"_n > {max_group}").select("_gram")
    if big.limit(1).count():
        for told in crowded_groups(different.join(big, "_gram"), length, max_group):
            runs = runs.unionByName(told)
    placed = members.join(runs, "_pid").select("_key", F.transform("_runs", lambda x: x + F.col("_first")).alias("_runs"))
    out = settle(placed.groupBy("_key").agg(F.flatten(F.collect_list("_runs")).alias("_runs")))
    del different, members, crowd, several, grouped, runs, big, placed
    release(spark)
    return out


def removed_spans(runs: list[int], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by the passages of runs of starts."""
    spans: list[tuple[int, int]] = []
    for first, last in sorted(zip(runs[::2], runs[1::2], strict=True)):
        end = min(size, last + length)
        if spans and first <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((first, end))
    return spans


def drop_passages(docs: DataFrame, *, length: int = LENGTH, max_group: int = MAX_GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row per row of ``docs``: the byte spans removed [start, end, ...], and the bytes left."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).withColumn("_key", key_of(F.col("_text")))
    found = find_passages(keyed.select("_key", "_text"), length=length, max_group=max_group)
    copies = keyed.groupBy("_key").agg(F.count("*").alias("_n"))
    marks = settle(copies.where("_n > 1").join(found, "_key", "full_outer").select("_key", (F.col("_n") > 1).alias("_copied"), "_runs"))
    met = keyed.join(marks, "_key", "left").select("doc_id", "_text", F.coalesce("_copied", F.lit(False)).alias("_copied"), "_runs")
    field = docs.select(F.col(id_col).alias("doc_id")).schema.simpleString()[7:-1].replace("doc_id:", "doc_id ", 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, all_spans, kept = [], [], []
            for text, copied, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = utf8(text)
                spans = [(0, len(data))] if copied and len(data) >= length else removed_spans(runs or [], length, len(data))
                edges = [0, *(x for s in spans for x in s), len(data)]
                sizes.append(len(data))
                all_spans.append(edges[1:-1])
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return met.mapInArrow(cut, f"{field}, n_bytes long, spans array<bigint>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # alternating: ends as the spans' total
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("repeats"), F.octet_length("kept").cast("long").alias("n_kept"),
    )
