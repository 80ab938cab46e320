"""File trees as tables of blocks: whatever the size of a file, a row holds block_bytes of it and what follows next.

Folders are listed by tasks, level by level, hidden ones included (Spark's own file sources leave out names that begin with _ or a dot). Blocks are byte ranges that tasks read by themselves, so a file
is read by as many tasks as it has blocks, and each needs the memory of one. A block's text is its own characters, those of the next `overlap` bytes, so that what begins in it can be read to its end, and one
character before, for patterns that look back. A text is cut between characters; bytes that are no UTF-8 are replaced.

Pictures other than SVGs have one row without content, empty files one with an empty text; an empty folder gives no rows. A root that does not exist fails. Equal files give rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.audit import PICTURE
from factloom.sources.shared import written

BLOCK_BYTES, OVERLAP = 8 << 20, 1 << 16
LONGEST = 4  # bytes of a character
BATCH_CHARS = 4 << 20  # of blocks that a task holds before they go on


def qualified(spark: SparkSession, root: str) -> str:
    """The root as Hadoop writes it, with its scheme and without a slash at the end: `.`, `/x/` and `file:///x` alike."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(uri)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and folders in each folder."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, path = located(folder)
            found = store.get_file_info(pyarrow.fs.FileSelector(path))
            names = [f"{folder}/{x.base_name}" for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([x.size or 0 for x in found], pa.int64()), pa.array([x.type == pyarrow.fs.FileType.Directory for x in found], pa.bool_())], ["uri", "length", "folder"])


def listed(spark: SparkSession, root: str) -> DataFrame:
    """All files below root: path (below it), uri, length. Each level of folders is a job."""
    top, levels = qualified(spark, root), []
    folders = spark.createDataFrame([(top,)], "uri string")
    while not folders.isEmpty():
        # folders are few beside files, and each is a task's work of its own size
        found = written(folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_contents, "uri string, length long, folder boolean"), "tree")
        levels.append(found.where(~F.col("folder")))
        folders = found.where("folder").select("uri")
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.select(F.substring("uri", len(top) + 2, 1 << 30).alias("path"), "uri", "length")


def _cut(data: bytes, lead: int, own: int, more: bool) -> tuple[str, int, int, int]:
    """Text of the bytes, its characters before and in the block, and the bytes at its start that belong to the block before. data: lead bytes before the block, own bytes of it, and what follows; more: whether the file goes on behind."""
    tail = lambda b: b & 0xC0 == 0x80  # noqa: E731  a byte within a character

    def edge(at: int) -> int:
        """The first place from `at` on where a character begins, or the end; `at` itself where so many bytes are part of none."""
        return next((i for i in range(at, min(at + LONGEST, len(data))) if not tail(data[i])), at if at + LONGEST <= len(data) else len(data))

    start, stop, end = edge(lead), edge(lead + own), len(data)
    if lead + own >= len(data):
        stop = len(data)
    if more:
        end = max(stop, next((i for i in range(len(data) - 1, max(len(data) - LONGEST, stop) - 1, -1) if not tail(data[i])), end))
    first = next((i for i in range(start - 1, max(start - LONGEST, 0) - 1, -1) if not tail(data[i])), start) if lead else start
    before, mine, after = (data[a:b].decode("utf-8", "replace") for a, b in ((first, start), (start, stop), (stop, end)))
    return before + mine + after, len(before), len(mine), start - lead


def read_tree(spark: SparkSession, root: str, block_bytes: int = BLOCK_BYTES, overlap: int = OVERLAP) -> DataFrame:
    """The files below root in blocks: path (below root), start (byte of the file where its own characters begin), content (text, null for pictures), lead and own (characters of content before the block, and in it)."""
    assert block_bytes >= LONGEST and overlap >= LONGEST

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, lead, own, skipped = None, 0, 0, 0
                if row["text"]:
                    store, path = located(row["uri"])
                    back = min(row["start"], LONGEST)
                    with store.open_input_file(path) as f:
                        f.seek(row["start"] - back)
                        data = f.read(back + block_bytes + overlap)
                    text, lead, own, skipped = _cut(data, back, block_bytes, row["start"] - back + len(data) < row["length"])
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]], pa.string()), pa.array([row["start"] + skipped], pa.int64()), pa.array([text], pa.string()), pa.array([lead], pa.int32()), pa.array([own], pa.int32())], ["path", "start", "content", "lead", "own"])

    picture = F.col("path").rlike(PICTURE) & ~F.lower("path").endswith(".svg")
    last = F.greatest(F.col("length") - 1, F.lit(0))
    blocks = listed(spark, root).select("path", "uri", "length", (~picture).alias("text"), F.explode(F.when(picture, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), last, F.lit(block_bytes).cast("long")))).alias("start"))
    # blocks of a large file go to different tasks
    blocks = blocks.repartition("uri", "start")
    return blocks.mapInArrow(read, "path string, start long, content string, lead int, own int")


def blocks_of(texts: DataFrame, path_col: str, text_col: str, block_chars: int, overlap: int) -> DataFrame:
    """Texts of a table in blocks as of a tree: path, start (byte of the text), content, lead, own. Null texts have one block without content."""
    names, kinds = ["path", "start", "content", "lead", "own"], [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text is walked through once: each block costs its own characters, not those before it
        for batch in batches:
            out, size = [], 0
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                text, start = None if data is None else data.decode("utf-8", "replace"), 0
                for first in range(0, max(len(text or ""), 1), block_chars):
                    lead, own = min(first, 1), len(text or "") and min(block_chars, len(text) - first)
                    content = None if text is None else text[first - lead : first + block_chars + overlap]
                    out.append((path, start, content, lead, own))
                    start, size = start + len((content or "")[lead : lead + own].encode()), size + len(content or "")
                    if size >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = texts.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "path string, start long, content string, lead int, own int")
