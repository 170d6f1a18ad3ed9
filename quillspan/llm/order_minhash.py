"""MinHash near-dedup by Order MinHash with banded alignment.

Method: a text is its sequence of shingles of five words, each labelled with its occurrence number. A sketch takes, under one
hash, the few labelled shingles with the least values and keeps them in the order of the text; a text has SKETCHES of them.
Two texts that agree in a sketch are candidates: they share shingles in the same order, so the chance follows edit similarity.
Candidates are verified by aligning the shingle sequences within the band that the required similarity allows: with L aligned
shingles out of m and n, the similarity is L / (m + n - L), the order-keeping form of the Jaccard coefficient.

Sketches of LONG shingles (for texts of SHORT_TEXT shingles or more) meet by chance far less often than those of two, which
short texts need; texts near the bound have both. At a similarity of 0.8 a pair agrees in none of 24 sketches with a chance
of about 1 in 10,000. Verified pairs form classes, the connected components.

Scale: equal texts are one key from the start. Members of a bucket are first compared with its leader, the most central key: a
text has as many comparisons as buckets, however many copies there are. Then the exact rest: every two bucket mates that are not
in one class by then are held against each other by outlines, bit sets whose difference is never more than that of the texts'
shingles. Pairs that the outlines allow are verified, first the nearest mate of each key, then all that are still in two
classes. So each two texts of a bucket are verified, in one class by other links, or proven unlike; buckets over BLOCK keys are
compared block by block. Tables between the steps hold keys; texts are shuffled only for keys that have a candidate.

Defined cases: null and empty texts, and texts without words, are one class each by equal text; texts of fewer than five words
have one shingle of all their words; ties go to the least key; repeated rows are members of their class like others; a null
doc_id takes part, but names a class only if all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import settle, small_batches, table, text_of
from .components import components, extended
from .words import mix, occurrences, shingles, word_hashes

SHINGLE, SIMILARITY, SKETCHES = 5, 0.8, 24
SHORT, LONG, SHORT_TEXT = 2, 5, 32
BITS, BLOCK = 4096, 1024  # of an outline; keys that are held against each other in one unit of work
PART = 64  # pairs of one text that are verified together
#: Keys a task remembers to spare itself repeats; beyond that it forgets them all.
REMEMBERED = 1 << 17
SALTS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def label_shingles(shingled: np.ndarray) -> np.ndarray:
    return mix(shingled + occurrences(shingled).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sketches(shingled: np.ndarray, take: int) -> np.ndarray:
    """SKETCHES hashes, each of the ``take`` least labelled shingles in text order."""
    labelled = label_shingles(shingled)
    out = np.empty(SKETCHES, np.uint64)
    width = max(1, min(SKETCHES, (1 << 20) // max(1, len(labelled))))  # salts at once, so that long texts need little memory
    for i in range(0, SKETCHES, width):
        valued = mix(labelled[None, :] ^ SALTS[i : i + width, None])
        if len(labelled) > take:
            chosen = np.sort(np.argpartition(valued, take - 1, axis=1)[:, :take], axis=1)
        else:
            chosen = np.broadcast_to(np.arange(len(labelled)), valued.shape)
        h = np.full(len(valued), take, np.uint64)
        for j in range(chosen.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + labelled[chosen[:, j]])
        out[i : i + width] = h ^ SALTS[i : i + width]
    return out


def buckets_of(words: np.ndarray) -> np.ndarray:
    """The bucket numbers of a text: those of short sketches, of long ones, or both near the bound."""
    s = shingles(words, SHINGLE)
    parts = []
    if 0 < len(s) <= SHORT_TEXT / SIMILARITY:
        parts.append(sketches(s, SHORT))
    if len(s) >= SHORT_TEXT:
        parts.append(sketches(s, LONG))
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64)


def rising(pairs: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    tails: list[int] = []
    for x in pairs.tolist():
        i = bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
        else:
            tails[i] = x
    return len(tails)


def banded_lcs(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence along cells with |i - j| <= band, by bit-parallel rows over the band's columns.

    Bit j - low of the row says that the row's value rises at column j; the window moves on with the diagonal."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        where.setdefault(x, []).append(j)
    width = 2 * band + 1
    full, row, done = (1 << width) - 1, (1 << width) - 1, 0
    for i, x in enumerate(a.tolist()):
        low = i - band
        if i:  # column low - 1 leaves; a zero bit there is a step of the score for good
            done += not row & 1
            row = row >> 1 | 1 << (width - 1)
        hits = where.get(x)
        if hits:
            match = 0
            for j in hits[bisect_left(hits, low) :]:
                if j > i + band:
                    break
                match |= 1 << (j - low)
            u = row & match
            row = (row + u | row - u) & full
    return done + width - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether L / (len(a) + len(b) - L) >= similarity for the alignment length L.

    First an upper bound (common shingles with their numbers), then equal ends off, then the alignment of labelled shingles,
    which is a lower bound, and only between the two bounds the banded alignment itself."""
    if not len(a) and not len(b):
        return True
    need = int(similarity * (len(a) + len(b)) / (1 + similarity))
    while need < len(a) + len(b) and need / (len(a) + len(b) - need) < similarity:
        need += 1
    while need and (need - 1) / (len(a) + len(b) - need + 1) >= similarity:
        need -= 1
    if min(len(a), len(b)) < need:
        return False
    band = len(a) + len(b) - 2 * need
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b, need = a[: len(a) - tail], b[: len(b) - tail], need - head - tail
    if need <= 0:
        return True
    label = np.uint64(0xD6E8FEB86659FD93)
    la, lb = a + occurrences(a).astype(np.uint64) * label, b + occurrences(b).astype(np.uint64) * label
    _, ia, ib = np.intersect1d(la, lb, return_indices=True)
    if len(ia) < need:
        return False
    near = np.abs(ia - ib) <= band
    order = np.argsort(ia[near])
    if rising(ib[near][order]) >= need:
        return True
    repeats = len(np.unique(a)) < len(a) or len(np.unique(b)) < len(b)
    return repeats and banded_lcs(a, b, band) >= need


def sketch_keys(keyed: DataFrame) -> DataFrame:
    """(_key, _bucket) rows of each different text of ``keyed(_key, _text)``."""
    small_batches(keyed.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # keys of this partition: a hot text is sketched once here
        for batch in batches:
            keys, texts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    texts.append(text.encode("utf-8", "surrogatepass"))
            if len(seen) > REMEMBERED:  # the rows are made distinct anyway
                seen.clear()
            found = [buckets_of(w) for w in word_hashes(texts)]
            sizes = np.array([len(f) for f in found], np.int64)
            column = pa.array(np.repeat(np.array(keys, object), sizes).tolist(), pa.binary())
            yield pa.RecordBatch.from_arrays([column, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())], names=["_key", "_bucket"])

    return keyed.mapInArrow(sketch, "_key binary, _bucket long").distinct()


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``pairs(_a, _b)`` with _ok. The pairs of one _a go in parts of about PART; its text is sent once to each part, not to each pair."""
    many = pairs.groupBy("_a").agg(F.count("*").alias("_n")).where(F.col("_n") > PART)
    parts = F.coalesce(F.ceil(F.col("_n") / PART), F.lit(1)).cast("int")
    placed = settle(pairs.join(many, "_a", "left").select("_a", "_b", F.pmod(F.xxhash64("_b"), parts).cast("int").alias("_part")))
    heads = placed.select("_a", "_part").distinct().join(texts.select(F.col("_key").alias("_a"), "_text"), "_a").select("_a", "_part", F.lit(None).cast("binary").alias("_b"), "_text")
    mates = placed.join(texts.select(F.col("_key").alias("_b"), "_text"), "_b").select("_a", "_part", "_b", "_text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.uint64)
        for batch in batches:
            a, b, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            left, right, out = [], [], []
            for i in range(len(a)):
                found = shingles(word_hashes([texts[i].encode("utf-8", "surrogatepass")])[0], SHINGLE)
                if b[i] is None:  # the part's own text comes first
                    known = found
                    continue
                left.append(a[i])
                right.append(b[i])
                out.append(aligned(known, found, similarity))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(out, pa.bool_())], names=["_a", "_b", "_ok"])

    dealt = heads.unionByName(mates).repartition("_a", "_part").sortWithinPartitions("_a", "_part", F.col("_b").asc_nulls_first())
    return dealt.mapInArrow(check, "_a binary, _b binary, _ok boolean")


def compare_with_leaders(buckets: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """One star per bucket of buckets(_bucket, _key, _n): its pairs (leader, key), with _ok.

    The leader is the key whose buckets are the most crowded: among edited copies of one text, the one with the fewest edits."""
    weight = buckets.groupBy("_key").agg(F.sum("_n").alias("_w"))
    heads = settle(buckets.join(weight, "_key").groupBy("_bucket").agg(F.max_by("_key", F.struct("_w", "_key")).alias("_head")))
    met = buckets.join(heads, "_bucket").where(F.col("_key") != F.col("_head")).select(F.col("_head").alias("_a"), F.col("_key").alias("_b"))
    return settle(verify(settle(met.distinct()), texts, similarity))


def outline(shingled: np.ndarray) -> bytes:
    """BITS parities of the labelled shingles: two outlines differ in no more bits than the texts in labelled shingles."""
    return np.packbits(np.bincount((label_shingles(shingled) >> np.uint64(52)).astype(np.int64), minlength=BITS) & 1 != 0).tobytes()


def outlines(texts: DataFrame) -> DataFrame:
    """(_key, _len, _bits) of texts(_key, _text)."""
    small_batches(texts.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(w, SHINGLE) for w in word_hashes([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([outline(f) for f in found], pa.binary())], names=["_key", "_len", "_bits"])

    return texts.select("_key", "_text").mapInArrow(draw, "_key binary, _len long, _bits binary")


def allowed(rows: list[tuple], across: bool, similarity: float, nearest: bool) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of rows (side, key, label, length, bits) of two labels that may be as similar by their outlines; with ``across``, of two sides.

    With ``nearest``, for each key only the pair whose outlines differ least for their lengths."""
    rows = sorted(rows, key=lambda r: r[3])
    ids: dict[bytes, int] = {}
    labels, sides = np.array([ids.setdefault(r[2], len(ids)) for r in rows]), np.array([r[0] for r in rows])
    sizes = np.array([r[3] for r in rows], np.int64)
    bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
    upto = np.searchsorted(sizes, sizes / similarity + 1e-6, "right")  # a shorter text cannot be that similar
    best: dict[int, tuple[float, int]] = {}
    for i in range(len(rows)):
        j = np.arange(i + 1, upto[i])
        j = j[labels[j] != labels[i]]
        if across:
            j = j[sides[j] != sides[i]]
        both = sizes[i] + sizes[j]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        may = apart <= both - 2 * np.ceil(similarity * both / (1 + similarity) - 1e-6)
        for k, d in zip(j[may].tolist(), (apart[may] / both[may]).tolist(), strict=True):
            if nearest:
                best[i], best[k] = min(best.get(i, (2.0, 0)), (d, k)), min(best.get(k, (2.0, 0)), (d, i))
            else:
                yield rows[i][1], rows[k][1]
    for i, (_, k) in best.items():
        yield rows[i][1], rows[k][1]


def compare_rest(asked: DataFrame, drawn: DataFrame, tested: DataFrame, texts: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Verified pairs, beside ``tested``, of bucket mates asked(_bucket, _key, _n, _label) that are in two classes and may be similar; with ``nearest``, one for each key and unit.

    A unit is two blocks of a bucket, so no task holds more than 2 x BLOCK outlines about."""
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    placed = asked.join(drawn, "_key").withColumn("_side", F.pmod(F.xxhash64("_key"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = placed.select("_bucket", F.least("_side", "_other").alias("_lo"), F.greatest("_side", "_other").alias("_hi"), "_side", "_key", "_label", "_len", "_bits")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[bytes, bytes]]:
            unit, rows = None, []
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                    if row[:3] != unit:
                        if unit:
                            yield from allowed(rows, unit[1] != unit[2], similarity, nearest)
                        unit, rows = row[:3], []
                    rows.append(row[3:])
            if unit:
                yield from allowed(rows, unit[1] != unit[2], similarity, nearest)

        for part in batched(parts(), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in part], pa.binary()) for f in (min, max)], names=["_a", "_b"])

    mates = units.repartition("_bucket", "_lo", "_hi").sortWithinPartitions("_bucket", "_lo", "_hi").mapInArrow(pair, "_a binary, _b binary").distinct()
    known = tested.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b"))
    return settle(verify(settle(mates.join(known, ["_a", "_b"], "left_anti")), texts, similarity))


def crowded(rows: DataFrame) -> DataFrame:
    """(_bucket, _key, _n) of the buckets that hold two keys or more."""
    rows = settle(rows)
    full = settle(rows.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1"))
    return settle(rows.join(full, "_bucket"))


def links_of(tested: DataFrame) -> DataFrame:
    return tested.where("_ok").select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def near_classes(keyed: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of the texts of ``keyed(_key, _text)`` that have a verified link: label names the class."""
    buckets = crowded(sketch_keys(keyed))
    texts = settle(keyed.join(buckets.select("_key").distinct(), "_key").groupBy("_key").agg(F.first("_text").alias("_text")))
    tested = compare_with_leaders(buckets, texts, similarity)
    labels, drawn = components(links_of(tested)), None
    for nearest in (True, False):  # the links of the first pass spare the second most of its pairs
        named = settle(buckets.join(labels.select(F.col("node").alias("_key"), "label"), "_key", "left").select("_bucket", "_key", "_n", F.coalesce("label", "_key").alias("_label")))
        several = named.groupBy("_bucket").agg(F.min("_label").alias("_l0"), F.max("_label").alias("_l1")).where("_l0 != _l1").select("_bucket")
        asked = settle(named.join(several, "_bucket"))
        if not asked.limit(1).count():
            break
        if drawn is None:
            drawn = settle(outlines(texts.join(asked.select("_key").distinct(), "_key")))
        fresh = compare_rest(asked, drawn, tested, texts, similarity, nearest)
        tested, labels, buckets = tested.unionByName(fresh), extended(labels, links_of(fresh)), asked.drop("_label")
    return labels


def key_of(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def near_duplicates(docs: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _key, _label, class_id), a row per row of ``docs``: class_id is the least doc_id of the class; _key stands for the text, _label for the class."""
    keyed = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).select("_id", key_of(F.col("_text")).alias("_key"), "_text")
    labels = near_classes(keyed.select("_key", "_text"), similarity=similarity)
    ids = settle(keyed.select("_id", "_key"))
    named = ids.join(labels.select(F.col("node").alias("_key"), "label"), "_key", "left").select("_id", "_key", F.coalesce("label", "_key").alias("_label"))
    named = settle(named)
    least = settle(named.groupBy("_label").agg(F.min("_id").alias("_class")))
    return named.join(least, "_label").select(F.col("_id").alias("doc_id"), "_key", "_label", F.col("_class").alias("class_id"))


def one_of_each(docs: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any more) that stay: the least doc_id of each class, a single row of it; null ids only where a class has no other."""
    named = near_duplicates(docs, similarity=similarity)
    stays = named.groupBy("_label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key")).alias("_s")).select(F.col("_s.doc_id").alias("_sid"), F.col("_s._key").alias("_skey"))
    keyed = docs.withColumn("_key", key_of(text_of("text")))
    met = keyed.join(settle(stays), (F.col("_key") == F.col("_skey")) & F.col("doc_id").eqNullSafe(F.col("_sid")), "left_semi")
    return met.dropDuplicates(["doc_id", "_key"]).drop("_key")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))
