"""Token counts per document from flat token files, by a separator scan.

A flat token file is a run of fixed-width little-endian token ids in which an end-of-document id closes every
document; there is no index.  The scan works on blocks of any stream:

1. each block finds its separators in one vectorised comparison and reports their places;
2. a prefix scan over the block summaries gives every block its offset, the number of
   documents before it and the last separator before it, which stitches documents that
   cross borders.  The scan has two levels (groups of ``GROUP`` blocks), so even one huge
   stream is not ordered by one task;
3. each separator closes a document: the tokens since the separator before it.

:func:`read_token_files` is a data source over raw files: a file is cut into byte ranges of whole blocks, so one of
any size is read by many tasks, and a stream may be one file or the files of a folder in order of their names.
:func:`encode` turns documents into streams: every task appends the tokens of its documents to its own stream, cut into blocks
without regard to documents, and lists their ids in order (the manifest), which the scan does not read;
:func:`write_token_files` puts the streams into flat files in the shared folder.

Rows: a null or empty text has no tokens and still one separator; null and repeated ids are kept in the manifest.
Tokens after the last separator form an unclosed document.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from netloom.operators.stages import settle, shared_folder
from netloom.sources.ranges import RANGE_BYTES, ByteRange, File, chunks, list_files, opened, plan_ranges

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The usual split into words, numbers, signs and spaces that this vocabulary was made with (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50_256
WIDTH = 2  # bytes of a token id
BLOCK = 65_536  # tokens
GROUP = 1024  # blocks of a prefix scan's lower level


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes):
    """Text to token ids by the given ranks; special names in a text are ordinary text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _dtype(width: int) -> str:
    return {2: "<u2", 4: "<u4"}[width]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Documents as token streams: ``stream, block, payload``, and ``first, ids`` in manifest rows."""
    words = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))  # about a megabyte, whatever the corpus
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = _dtype(width)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, stream = encoder(words.value), TaskContext.get().partitionId()
        waiting, held, number, first = [], 0, 0, 0
        names = ["stream", "block", "payload", "first", "ids"]

        def rows(blocks: list[np.ndarray], at: int, ids, ids_type) -> pa.RecordBatch:
            n, own = len(blocks), 0 if ids is None else 1
            return pa.RecordBatch.from_arrays([
                pa.array([stream] * (n + own), pa.int32()), pa.array([*range(at, at + n), *[None] * own], pa.int64()),
                pa.array([*(b.tobytes() for b in blocks), *[None] * own], pa.binary()),
                pa.array([*[None] * n, *[first] * own], pa.int64()),
                pa.array([*[None] * n, *([ids] if own else [])], pa.list_(ids_type)),
            ], names)

        ids_type = pa.int64()
        for batch in it:
            ids_type = batch.column(0).type
            for text in batch.column(1):
                own = np.array([*code.encode_ordinary(text.as_py() or ""), end], kind)
                waiting.append(own)
                held += len(own)
            flat = np.concatenate(waiting) if waiting else np.empty(0, kind)
            full = len(flat) // block
            yield rows(list(flat[: full * block].reshape(full, block)), number, batch.column(0).to_pylist(), ids_type)
            number, first = number + full, first + batch.num_rows
            waiting, held = [flat[full * block :]], len(flat) - full * block
        if held:
            yield rows([np.concatenate(waiting)], number, None, ids_type)

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(batches, f"stream int, block long, payload binary, first long, ids array<{id_type}>")


class TokenReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.width, self.block = options["path"], int(options["width"]), int(options["block"])
        self.span, self.joined = int(options.get("rangebytes", RANGE_BYTES)), options.get("joined") == "true"

    def partitions(self) -> list[ByteRange]:
        files = list_files(self.path)
        for f in files:
            if f.size % self.width:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole number of tokens")
        if self.joined:
            named = sorted(files, key=lambda f: f.path)
            files = [File(f.path, f.size, f.modified, k) for k, f in enumerate(named)]
        return plan_ranges(files, self.span, self.width * self.block)

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        size = self.width * self.block
        # Block numbers give the order only, so a file of a joined stream leaves room behind it.
        stream, first = (self.path, partition.number << 40) if self.joined else (partition.path, 0)
        for k, payload in enumerate(chunks(partition.path, partition.start, partition.stop, size), first + partition.start // size):
            yield pa.RecordBatch.from_arrays([pa.array([stream]), pa.array([k], pa.int64()), pa.array([payload], pa.binary())], ["stream", "block", "payload"])


class TokenSource(DataSource):
    """``spark.read.format("tokens")``; options ``path``, ``width``, ``block``, ``rangeBytes``, ``joined``."""

    @classmethod
    def name(cls) -> str:
        return "tokens"

    def schema(self) -> str:
        return "stream string, block long, payload binary"

    def reader(self, schema: StructType) -> TokenReader:
        return TokenReader(self.options)


def read_token_files(
    spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK, range_bytes: int = RANGE_BYTES, joined: bool = False
) -> DataFrame:
    """``stream, block, payload`` of raw token files, read by byte ranges.

    A stream is a file (named by its path) or, if ``joined``, all files of the folder in order of their names.
    """
    spark.dataSource.register(TokenSource)
    reader = spark.read.format("tokens").option("width", width).option("block", block)
    return reader.option("rangeBytes", range_bytes).option("joined", str(joined).lower()).load(path)


def write_token_files(encoded: DataFrame, folder: str) -> DataFrame:
    """The streams of :func:`encode` as flat files in ``folder``; returns ``file, first, ids`` of their documents.

    The files are written as the result is evaluated, once for every attempt of a task; the rows name the file of the attempt that counts.
    """
    ids_type = encoded.schema["ids"].dataType.simpleString()

    def make() -> tuple:
        system, inner = opened(folder)
        system.create_dir(inner, recursive=True)
        return system, inner

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = make()
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        with system.open_output_stream(f"{inner}/{name}") as out:
            for batch in it:
                for payload in batch.column("payload").drop_null():
                    out.write(payload.as_buffer())
                own = batch.filter(batch.column("ids").is_valid())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * own.num_rows, pa.string()), own.column("first"), own.column("ids")], ["file", "first", "ids"]
                )

    make()  # an empty table has no tasks that would
    return encoded.select("payload", "first", "ids").mapInArrow(write, f"file string, first long, ids {ids_type}")


def separators(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """``stream, block, n, ends``: tokens of each block and the places of its separators."""
    kind = _dtype(width)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = [np.frombuffer(p.as_buffer(), kind) for p in batch.column(2)]
            ends = [np.flatnonzero(p == end) for p in parts]
            offsets = np.cumsum([0, *map(len, ends)])
            flat = pa.array(np.concatenate(ends) if ends else np.empty(0), pa.int64())
            places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(p) for p in parts], pa.int64()), places], ["stream", "block", "n", "ends"]
            )

    kind_of_stream = blocks.schema["stream"].dataType.simpleString()
    return blocks.select("stream", "block", "payload").mapInArrow(scan, f"stream {kind_of_stream}, block long, n long, ends array<long>")


def _before(df: DataFrame, value, how, name: str, start: int) -> DataFrame:
    """Add the aggregate of ``value`` over all earlier blocks of the stream, in two levels."""
    tops = df.groupBy("stream", "grp").agg(how(value).alias("top"))
    earlier = Window.partitionBy("stream").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("stream").alias("of"), F.col("grp").alias("of_grp"), how("top").over(earlier).alias("base"))
    inner = Window.partitionBy("stream", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("own", how(value).over(inner)).join(
        tops, F.col("stream").eqNullSafe(F.col("of")) & (F.col("grp") == F.col("of_grp"))
    )
    base, own = F.coalesce("base", F.lit(start)), F.coalesce("own", F.lit(start))
    joined = joined.withColumn(name, base + own if how is F.sum else F.greatest(base, own))
    return joined.drop("of", "of_grp", "base", "own")


def token_counts(blocks: DataFrame, end: int = END, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """``stream, ordinal, start, n_tokens, closed``: the documents of every stream in order."""
    found = settle(separators(blocks, end, width), "separators").withColumn("grp", F.floor(F.col("block") / group))
    found = _before(found, F.col("n"), F.sum, "offset", 0)
    found = _before(found, F.size("ends").cast("long"), F.sum, "count", 0)
    found = found.withColumn("last", F.when(F.size("ends") > 0, F.col("offset") + F.element_at("ends", -1)))
    found = settle(_before(found, F.col("last"), F.max, "open", -1), "stitched")
    # Start and end are paired before the rows are made: a block's places are not repeated per document.
    bounds = F.expr("transform(ends, (x, i) -> struct(offset + x AS at, if(i = 0, open, offset + ends[greatest(i - 1, 0)]) AS since))")
    places = found.where(F.size("ends") > 0).select("stream", "count", F.posexplode(bounds).alias("pos", "b"))
    closed = places.select(
        "stream", (F.col("count") + F.col("pos")).alias("ordinal"), (F.col("b.since") + 1).alias("start"),
        (F.col("b.at") - F.col("b.since") - 1).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    tails = found.groupBy("stream").agg(
        F.sum(F.size("ends").cast("long")).alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.sum("n").alias("n")
    )
    tails = tails.where("n > start").select("stream", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tails)


def manifest(encoded: DataFrame, stream: str = "stream") -> DataFrame:
    """``of, nth, doc_id``: which document of a stream is which."""
    rows = encoded.where("ids IS NOT NULL").select(stream, "first", F.posexplode("ids").alias("pos", "doc_id"))
    return rows.select(F.col(stream).alias("of"), (F.col("first") + F.col("pos")).alias("nth"), "doc_id")


def query(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    ids = manifest(settle(write_token_files(encode(docs), folder), "token-manifest"), "file")
    counts = token_counts(read_token_files(spark, folder)).withColumn("stream", F.substring_index("stream", "/", -1))
    # The places of the separators are settled; the files of this query are not read again.
    system, inner = opened(folder)
    system.delete_dir(inner)
    return counts.join(ids, (F.col("stream") == F.col("of")) & (F.col("ordinal") == F.col("nth"))).select(
        "doc_id", "n_tokens", "stream", "ordinal", "start"
    )
