"""Documents to nodes: size and content guards, then one parse per document in Arrow batches.

The parse is the dear step of every query, so its input is dealt evenly over the cluster, by the bytes of its text; only the node
types and fields that are asked for are made; and what several queries read is written down once (``settled``)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jstext import utf16_length_col
from ..functions.markdown import FIELDS, Sheet

#: UTF-16 units beyond which a document is not parsed, and within which a NUL makes it unreadable.
LARGEST, NUL_REACH = 512 * 1024, 8000
#: Characters of text whose nodes go into one batch of rows; a longer document is a batch of its own, of LARGEST at most.
BATCH_CHARS = 256 * 1024
#: Text bytes that a parse task should have, at most and at least, and the most tasks.
TASK_BYTES, LEAST_BYTES, MOST_TASKS = 16 << 20, 64 << 10, 200_000

_INTS = {"node_id", "parent_id", "depth_in_tree", "child_ix", "child_count", "start_line", "start_col", "start_off", "end_line", "end_col", "end_off", "heading_depth", "list_start"}
_BOOLS = {"ordered", "spread", "checked", "passthrough"}
_LISTS = {"ancestor_types", "align"}


def field_type(name: str) -> T.DataType:
    return T.IntegerType() if name in _INTS else T.BooleanType() if name in _BOOLS else T.ArrayType(T.StringType()) if name in _LISTS else T.StringType()


def _arrow_type(name: str) -> pa.DataType:
    return pa.int32() if name in _INTS else pa.bool_() if name in _BOOLS else pa.list_(pa.string()) if name in _LISTS else pa.string()


def with_status(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with units, and scan_status: scanned, too-large, unreadable or unscanned (no text)."""
    units = utf16_length_col(F.col("text"))
    # Units and characters differ by the astral ones before the NUL, which only texts with a NUL at all need to count.
    head = F.substring_index(F.substring("text", 1, NUL_REACH), "\0", 1)
    nul = F.contains("text", F.lit("\0")) & F.contains(F.substring("text", 1, NUL_REACH), F.lit("\0")) & (utf16_length_col(head) < NUL_REACH)
    # A text has no more units than bytes, and its bytes are known: only long ones need counting.
    large = F.when(F.octet_length("text") > LARGEST, units > LARGEST).otherwise(False)
    status = F.when(F.col("text").isNull(), "unscanned").when(large, "too-large").when(nul, "unreadable").otherwise("scanned")
    return docs.withColumn("units", units).withColumn("scan_status", status)


def refused(text: str) -> bool:
    """The guards for one text, as with_status."""
    units = len(text) + (0 if text.isascii() else sum(c > "\uffff" for c in text))
    nul = text.find("\0")
    return units > LARGEST or 0 <= nul and nul + sum(c > "\uffff" for c in text[: min(nul, NUL_REACH)]) < NUL_REACH


def dealt(ready: DataFrame) -> DataFrame:
    """``ready(doc_id, text)`` in as many equal parts as the bytes of its text ask for, whatever files or joins it comes from.

    The bytes are counted in one pass, which costs little beside the parse. Rows are dealt in turn: no key can crowd a part."""
    size = ready.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = min(4 * ready.sparkSession.sparkContext.defaultParallelism, size // LEAST_BYTES)
    return ready.repartition(int(max(1, least, min(MOST_TASKS, size // TASK_BYTES))))


def parse_nodes(docs: DataFrame, *, types: tuple[str, ...] | None = None, fields: tuple[str, ...] | None = None, deal: bool = True, marks: tuple[str, ...] | None = None, outside: tuple[str, ...] = (), external: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """The node table of ``docs(doc_id, text)``: doc_id and ``fields`` (default FIELDS), a row per node of ``types`` (default all).

    Numbers of nodes are those of the whole tree, whatever is left out. Refused documents are filtered before they reach Python.
    ``deal``: False keeps the rows where they are, for inputs that are already spread evenly.
    ``marks``: of text nodes, only those with one of them in their value get a row; ``outside``: and none below nodes of these types.
    ``carry``: columns of ``docs`` that each row repeats, after doc_id, so that nobody has to join them later.
    ``external``: if given, of texts that the parser reads in one go, nodes without use for a check are left out, as ``quick_reader`` tells."""
    names = tuple(FIELDS) if fields is None else fields
    ready = with_status(docs.select("doc_id", "text", *carry)).where("scan_status = 'scanned'").select("doc_id", "text", *carry)
    ready = dealt(ready) if deal else ready
    schema = T.StructType([*(docs.schema[c] for c in ("doc_id", *carry)), *(T.StructField(f, field_type(f)) for f in names)])
    kinds = [_arrow_type(f) for f in names]
    wanted = None if types is None else frozenset(types)

    def rows_of(sheet: Sheet, ids: pa.RecordBatch) -> pa.RecordBatch:
        owners = pa.array(sheet.numbers(), pa.int32())
        return pa.RecordBatch.from_arrays([*(c.take(owners) for c in ids.columns), *(pa.array(sheet.column(f), k) for f, k in zip(names, kinds, strict=True))], names=["doc_id", *carry, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sheet, first, chars = batch.select([0, *range(2, batch.num_columns)]), Sheet(wanted, marks, names, names, outside, external), 0, 0
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                sheet.add(text)
                chars += len(text)
                if chars >= BATCH_CHARS:
                    yield rows_of(sheet, ids.slice(first, i + 1 - first))
                    sheet, first, chars = Sheet(wanted, marks, names, names, outside, external), i + 1, 0
            if sheet.texts:
                yield rows_of(sheet, ids.slice(first))

    return ready.mapInArrow(run, schema)
