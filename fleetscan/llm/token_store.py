"""Token-id output in Parquet with selective reads (operator 4).

Ids are a Parquet list column beside small metadata columns, sorted by document id, in
row groups and pages of set sizes.  Ids are dictionary-encoded (a vocabulary is a small
dictionary) or delta-encoded, the ascending metadata columns delta-encoded.  Statistics
and the page index let a reader skip row groups and pages by document id, and a reader of
metadata never touches the ids.

Spark orders the text over range partitions; each task writes its file with Arrow and
reports it.  The reports are a table below the same folder, which names the files of the
tries that Spark committed, with their rows, ids and row groups.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from .common import fresh, materialize, open_fs, ship, spread
from .tokens import default_tokenizer, encode_column, release_memory

#: Writer settings: bytes of ids in a row group, bytes of a page, and of a dictionary.
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 32 << 20, 256 << 10, 8 << 20
#: Bytes of ids that one task reads back, about.
READ_BYTES = 128 << 20
#: Columns beside the key: ids of a row, the row's ids, the file's number, ids in the file before.
COLUMNS = (("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("file_part", pa.int32()), ("within", pa.int64()))
REPORT = "file_part int, file string, n_rows long, n_tokens long, row_groups int"


def in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``text`` in ascending order over range partitions, null keys first and
    equal keys by a hash of their text, by which a hot key is spread too.

    The session's shuffle partitions are many enough for small tables and are merged at
    run time; a table of more input splits than that gets one partition for each split, so
    that a file's size doesn't grow with the table.
    """
    spark, tie = docs.sparkSession, fresh(docs, "__tie")
    rows = docs.select(key, text).withColumn(tie, F.xxhash64(text))
    splits = rows.rdd.getNumPartitions()
    order = [F.col(key).asc_nulls_first(), F.col(tie)]
    parts = rows.repartitionByRange(splits, *order) if splits > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*order)
    return parts.sortWithinPartitions(*order).drop(tie)


class FileWriter:
    """One task's file: rows are held until their ids fill a row group."""

    def __init__(self, uri: str, schema: pa.Schema, row_group_bytes: int, page_bytes: int, encoding: str):
        fs, path = open_fs(uri)
        ids = "token_ids.list.element"
        delta = [f.name for f in schema if pa.types.is_integer(f.type)]
        self.sink = fs.open_output_stream(path)
        self.out = pq.ParquetWriter(
            self.sink, schema, compression="zstd", version="2.6", data_page_version="2.0", data_page_size=page_bytes, write_page_index=True, dictionary_pagesize_limit=DICTIONARY_BYTES,
            use_dictionary=[ids] if encoding == "dictionary" else False, column_encoding=dict.fromkeys(delta if encoding == "dictionary" else [*delta, ids], "DELTA_BINARY_PACKED"),
        )
        self.schema, self.most = schema, row_group_bytes
        self.held: list[pa.RecordBatch] = []
        self.size = self.groups = 0

    def add(self, rows: pa.RecordBatch, size: int) -> None:
        self.held.append(rows)
        self.size += size
        if self.size >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.held:
            rows = pa.Table.from_batches(self.held, self.schema)
            # Blocks of ids may be larger than small row groups.
            each = min(rows.num_rows, max(1, rows.num_rows * self.most // self.size)) if self.size > 2 * self.most else rows.num_rows
            self.out.write_table(rows, row_group_size=each)
            self.held, self.size, self.groups = [], 0, self.groups - (-rows.num_rows // each)

    def close(self) -> None:
        self.flush()
        self.out.close()
        self.sink.close()


def write_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end_id: int | None = 0, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, encoding: str = "dictionary") -> None:
    """Write the ids of every row in ascending order of ``key`` over ordered files.

    ``encoding`` of the ids is "dictionary" or "delta". The text is range-partitioned by
    key, sorted, encoded and written in one stage. Null keys come first; rows with equal
    keys are ordered by a hash of their text; null texts are empty. Other columns aren't
    written. An empty table has the schema's file only. A text of any length is one row; it
    is held in memory once, with its ids.

    Every try of a task writes a file of its own name, and the reports name only those of
    the try that Spark committed: a lost executor leaves unreferenced files only.
    """
    ship(docs.sparkSession)
    vocabulary = tokenizer or default_tokenizer()
    schema = pa.schema([pa.field(key, to_arrow_type(docs.schema[key].dataType)), *(pa.field(n, t) for n, t in COLUMNS)])
    body = fresh(docs, "__body")
    fs, folder = open_fs(path)
    fs.create_dir(folder, recursive=True)
    FileWriter(f"{path}/schema.parquet", schema, row_group_bytes, page_bytes, encoding).close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_part, n_rows, before = TaskContext.get().partitionId(), 0, 0
        name, out = f"part-{own_part:06d}-{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            for part, ids, bounds in encode_column(batch, body, vocabulary, end_id):
                out = out or FileWriter(f"{path}/{name}", schema, row_group_bytes, page_bytes, encoding)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                where = [pa.array(np.full(part.num_rows, own_part, np.int32)), pa.array(before + bounds[:-1])]
                out.add(pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), lists, *where], schema=schema), ids.nbytes)
                n_rows, before = n_rows + part.num_rows, before + len(ids)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([own_part], pa.int32()), pa.array([name]), pa.array([n_rows]), pa.array([before]), pa.array([out.groups], pa.int32())], names=["file_part", "file", "n_rows", "n_tokens", "row_groups"])
        release_memory()

    ordered = in_order(docs, key, text).select(key, F.col(text).alias(body))
    ordered.mapInArrow(run, REPORT).write.parquet(f"{path}/reports")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file of a store: its number, name, rows, ids and row groups."""
    return spark.read.schema(REPORT).parquet(f"{path}/reports")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files: key, n_tokens, token_ids, file_part and within. Selecting
    metadata reads no ids; a filter on the key skips row groups and pages.

    The files' names (one a file, as in Spark's own file index) come from the reports.
    """
    names = [r["file"] for r in reports(spark, path).select("file").collect()]
    return spark.read.parquet(f"{path}/schema.parquet", *(f"{path}/{n}" for n in names))


def file_offsets(spark: SparkSession, path: str) -> DataFrame:
    """file_part and file_start, the ids of all files before it: one small row a file.

    The reports give it. The table is written, so that Spark knows its size: a join with it
    is a broadcast below the session's threshold and a shuffle beyond it.
    """
    before = F.sum("n_tokens").over(Window.orderBy("file_part")) - F.col("n_tokens")
    return materialize(reports(spark, path).select("file_part", before.alias("file_start")), "file-offsets")


def with_starts(tokens: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows of the store with start (ids of all documents before) in the place of
    file_part and within; ``tokens`` may lack other columns of the store."""
    return tokens.join(offsets, "file_part").withColumn("start", F.col("file_start") + F.col("within")).drop("file_part", "within", "file_start")


def id_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The rows of the store with ids_crc32 (unsigned CRC-32 of the ids as little-endian
    unsigned 32-bit integers) in the place of token_ids.

    Row groups are dealt to tasks by the bytes of their ids, and each task reads its own
    with Arrow: whole lists never pass from Spark to Python.
    """
    ship(spark)
    key_field = pq.read_schema(open_fs(f"{path}/schema.parquet")[1], filesystem=open_fs(path)[0]).field(key)
    groups = reports(spark, path).select("file", "row_groups", (F.col("n_tokens") * 4 / F.col("row_groups")).cast("long").alias("bytes"), F.explode(F.sequence(F.lit(0), F.col("row_groups") - 1)).alias("row_group"))
    columns = [key, *(n for n, _ in COLUMNS)]
    names = [key, "n_tokens", "file_part", "within", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, group in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "row_group")), strict=True):
                fs, file = open_fs(f"{path}/{name}")
                with fs.open_input_file(file) as source:
                    for rows in pq.ParquetFile(source).iter_batches(row_groups=[group], columns=columns, batch_size=4096):
                        lists = rows.column(2)
                        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
                        at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
                        crc = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(3), rows.column(4), pa.array(crc, pa.int64())], names=names)

    kind = from_arrow_type(key_field.type).simpleString()
    return spread(groups, "bytes", READ_BYTES, "file", "row_group").mapInArrow(run, f"`{key}` {kind}, n_tokens long, file_part int, within long, ids_crc32 long")
