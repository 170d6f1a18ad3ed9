"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Method: texts and items are word sequences; an item's windows (10 consecutive words, or the whole of a shorter item) are the
patterns. A block is two words (one for one-word patterns). A shift table says, for the block that ends at a position, how far
the search may jump without missing a pattern; blocks not in it allow the greatest jump. Where the shift is 0 the block's
bucket gives the patterns that end with it, and direct comparison confirms one. Patterns of each length search on their own.

The patterns are collected and broadcast in blocks of items of at most ``block_bytes`` of text each (hashed, so by expectation;
one item that is larger stays whole), as many as the table needs; each block is one more narrow pass over the texts, and none
shuffles. A worker builds a block's tables once. After every CHAINED blocks the rows are written down, so that no more than these
blocks' tables (about 50 times their text) are in memory at once. Defined cases: a null text has no words; a null item_id counts as the id ``null``; items without words have no
windows; repeated items count once; empty tables give no hits or an empty result; rows that repeat a doc_id stay apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import settle, small_batches, table, text_of

WINDOW, BLOCK_BYTES, CHAINED = 10, 2 << 20, 4
#: A-Z to a-z; digits, a-z and all bytes from 0x80 are of words; the rest are spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Patterns:
    """Patterns of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, patterns: dict[tuple, list[str]]):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.bucket: dict = {}
        for words, items in patterns.items():
            for end in range(self.block - 1, length):
                key = words[end - self.block + 1 : end + 1]
                self.shift[key] = min(self.shift.get(key, length), length - 1 - end)
            self.bucket.setdefault(words[length - self.block :], {})[words] = items

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of each occurrence, from left to right."""
        m, b, get, n = self.length, self.block, self.shift.get, len(words)
        jump, at = m - b + 1, m - 1
        while at < n:
            key = (words[at - 1], words[at]) if b == 2 else (words[at],)
            skip = get(key, jump)
            if skip:
                at += skip
                continue
            found = self.bucket[key].get(tuple(words[at - m + 1 : at + 1]))
            if found is not None:
                yield at - m + 1, found
            at += 1


def build(items: list[tuple[str, str | None]], window: int) -> list[Patterns]:
    by_length: dict[int, dict[tuple, list[str]]] = {}
    for item, text in items:
        words = tuple(words_of(text))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            owners = by_length.setdefault(size, {}).setdefault(words[i : i + size], [])
            if not owners or owners[-1] != item:
                owners.append(item)
    return [Patterns(size, by_length[size]) for size in sorted(by_length)]


_BUILT: dict[str, list[Patterns]] = {}


def built(name: str, items: list[tuple[str, str | None]], window: int) -> list[Patterns]:
    """build(), once per worker for a block's name; the last blocks are remembered."""
    if name not in _BUILT:
        while len(_BUILT) >= CHAINED:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = build(items, window)
    return _BUILT[name]


def mark(words: list[bytes], patterns: list[Patterns]) -> tuple[list[int], set[str]]:
    """Maximal hit runs as [start, end, start, end ...], and the items found."""
    spans, found = [], set()
    for p in patterns:
        for start, items in p.search(words):
            spans.append((start, start + p.length))
            found.update(items)
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The ``carry`` columns, then _text, _n_words, _spans (hit runs of words), _items (whose windows occur), for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    tests = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("_item"), text_of(item_text_col).alias("_text"))
    size = tests.agg(F.sum(F.octet_length("_text"))).collect()[0][0] or 0
    blocks = -(-size // block_bytes) or 1
    k = len(carry)
    own = [T.StructField("_text", T.StringType()), T.StructField("_n_words", T.LongType()), T.StructField("_spans", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*(docs.schema[c] for c in carry), *own])
    out = docs.select(*carry, F.col(text_col).cast("string").alias("_text"), F.lit(0).cast("long").alias("_n_words"), F.expr("cast(array() as array<int>)").alias("_spans"), F.expr("cast(array() as array<string>)").alias("_items"))
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block) if blocks > 1 else tests
        rows = sorted({(r["_item"], r["_text"]) for r in part.toLocalIterator()})
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            patterns = built(name, shared.value, window)
            for batch in batches:
                counts, spans, items = [], [], []
                for text, old, had in zip(*(batch.column(k + i).to_pylist() for i in (0, 2, 3)), strict=True):
                    words = words_of(text)
                    runs, found = mark(words, patterns)
                    if old:
                        runs = merged([*zip(runs[::2], runs[1::2], strict=True), *zip(old[::2], old[1::2], strict=True)])
                    counts.append(len(words))
                    spans.append(runs)
                    items.append(sorted(found.union(had)))
                new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: k + 1], *new], names=batch.schema.names)

        out = out.mapInArrow(scan, schema)
        if block % CHAINED == CHAINED - 1 and block + 1 < blocks:
            out = settle(out)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("_spans", F.lit(0), lambda a, x: x - a)  # alternating sum: s1, e1-s1, s2-e1+s1 ... ends as the runs' total
    return out.select("doc_id", F.col("_n_words").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"))


SQL = r"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), hits AS (SELECT p.r, p.i, p.n, t.item FROM places p JOIN windows t ON p.n = t.n AND p.win = t.win),
covered AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.items, '')) AS items_sha256, c.r IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON d.r = c.r LEFT JOIN found f ON d.r = f.r
"""
