"""A committed sink of one file per task, listings of real trees, and manifests of what was written."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import file_system, stored

#: Files that one call writes at most: their names pass through the driver.
MOST_FILES = 10_000
#: Bytes of rows, as text, from which a file is written by several tasks, and which each of them writes about.
SHARE = 32 << 20
ENDINGS = {"json": "jsonl", "csv": "csv", "parquet": "parquet", "text": "txt"}
#: Everything in quotes comes back as it was: blanks, quotes, line ends, and an empty text apart from a missing one.
CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": '""', "lineSep": "\n"}
#: How such a file is read: only what stands without quotes and is empty is missing.
CSV_READ = {**CSV, "emptyValue": "", "nullValue": "\0", "multiLine": "true"}


def write_files(df: DataFrame, path: str, kind: str, name: str | Column = "task", order: list[str] | None = None, ending: str | None = None) -> DataFrame:
    """Write exactly one file for each value of ``name``, called ``<value>.<ending>``; returns (name, file, n_rows).

    ``kind`` is json (one object a line), csv, parquet or text (one column of lines).  A value may have slashes, which
    make folders; a null or empty one is called ``_null``, and no file's name begins with what readers skip.  Values that differ only in characters that a file name can't
    have are told apart by a number.  ``order`` sorts a file's rows.

    If no file has over ``SHARE`` bytes, each is written by a task of its own.  Otherwise each task writes a share of
    about as many bytes, and shares of lines are joined: tasks copy each to its place in its file.  That needs a folder that all
    executors mount (``file:``); elsewhere one task writes all of a file.  A Parquet file is always written by one task,
    but if large its rows come there compressed (zstd).

    The files are committed together: they are made in a folder beside ``path``, and stand in its place only when all are
    there, with a ``_SUCCESS`` mark; what was there before is replaced.  A job that fails leaves the old files.
    """
    spark = df.sparkSession
    column = F.col(name) if isinstance(name, str) else name
    rows = df.withColumn("_name", F.coalesce(F.nullif(column.cast("string"), F.lit("")), F.lit("_null")))
    n_bytes = F.sum(sum((F.coalesce(F.octet_length(t), F.lit(0)).cast("long") for t in _texts(df)), F.lit(0)))
    counts = rows.groupBy("_name").agg(F.count(F.lit(1)).alias("n_rows"), n_bytes.alias("n_bytes")).limit(MOST_FILES + 1).collect()
    if len(counts) > MOST_FILES:
        raise ValueError(f"over {MOST_FILES} files")
    files, taken, ending = {}, set(), ENDINGS[kind] if ending is None else ending
    for value in sorted(r["_name"] for r in counts):
        safe = "/".join("".join(c if c.isalnum() or c in "._-= " else "_" for c in part).strip(". ").lstrip("_.") or "x" for part in value.split("/") if part) or "x"
        made, k = safe, 1
        while made.lower() in taken:
            k += 1
            made = f"{safe}_{k}"
        taken.add(made.lower())
        files[value] = f"{made}.{ending}" if ending else made
    found = {r["_name"]: r["n_rows"] for r in counts}
    # Largest first, so that the longest tasks begin first.
    numbers = sorted(files, key=lambda v: -found[v])
    numbered = spark.createDataFrame([(v, k) for k, v in enumerate(numbers)], "_name string, _file int")
    # A file of lines has no column for its own name.
    placed = rows.join(F.broadcast(numbered), "_name").drop("_name", *([name] if kind == "text" and isinstance(name, str) else []))
    made = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    large = [r for r in counts if r["n_bytes"] > SHARE]
    joined = bool(large) and kind != "parquet" and file_system(spark, made)[0].getUri().getScheme() == "file"
    # Shares have about as many rows each, so the large file of the longest rows sets their number.
    n = min(MOST_FILES, 1 + int(sum(found.values()) * max(r["n_bytes"] / r["n_rows"] for r in large) / SHARE)) if large else 0
    if joined:
        placed = _in_shares(placed, order or [], n)
    elif large and kind == "parquet":
        placed = _by_packs(_in_shares(placed, order, n) if order else placed.sortWithinPartitions("_file"), len(files))
    else:
        # The partition of a file has its number and nothing else, so no two files meet in one task and none is sorted to part them.
        placed = placed.repartitionById(max(1, len(files)), "_file").drop("_file")
        placed = placed.sortWithinPartitions(*order) if order else placed
    writer = placed.write.option("maxRecordsPerFile", 0)
    for key, value in CSV.items() if kind == "csv" else ():
        writer = writer.option(key, value)
    if joined:
        # The names of the columns stand once in a file, not once in a share.
        names = F.struct(*[F.lit(c).alias(f"_{k}") for k, c in enumerate(placed.drop("_file").columns)])
        head = (spark.range(1).select(F.to_csv(names, CSV)).first()[0] + "\n").encode() if kind == "csv" else b""
        writer.option("header", "false").partitionBy("_file").format(kind).save(f"{made}/parts")
        _join_parts(spark, made, [files[v] for v in numbers], head, n)
    else:
        writer.format(kind).save(f"{made}/parts")
        _name_parts(spark, made, [files[v] for v in numbers])
    _swap(spark, made, path)
    return spark.createDataFrame([(v, f, found[v]) for v, f in files.items()], "name string, file string, n_rows long")


def _texts(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`").cast("string") for c in df.columns]


def _in_shares(placed: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows by file and ``order`` in ``n`` ranges.  Rows that are equal there, copies too, are parted by where they come from."""
    tied = placed.withColumn("_tie", F.xxhash64(F.spark_partition_id(), *_texts(placed)))
    return tied.repartitionByRange(n, "_file", *order, "_tie").sortWithinPartitions("_file", *order).drop("_tie")


def _by_packs(shares: DataFrame, n_files: int) -> DataFrame:
    """One partition a file, with its rows as they follow one another in ``shares``; they get there as packs, compressed."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        seq = TaskContext.get().partitionId() << 32
        schema = pa.schema([("_file", pa.int32()), ("_seq", pa.int64()), ("_rows", pa.binary())])
        for batch in batches:
            at = batch.schema.get_field_index("_file")
            files, rows = batch.column(at).to_numpy(), batch.remove_column(at)
            # Rows are sorted by file, so each run is one.
            cuts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist(), len(files)] if len(files) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                    out.write_batch(rows.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([files[a]], pa.int32()), pa.array([seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=schema)
                seq += 1

    def unpack(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in batch.column(batch.schema.get_field_index("_rows")):
                with pa.ipc.open_stream(rows.as_buffer()) as source:
                    yield from source

    packs = shares.mapInArrow(pack, "_file int, _seq long, _rows binary")
    return packs.repartitionById(n_files, "_file").sortWithinPartitions("_seq").mapInArrow(unpack, shares.drop("_file").schema)


def _join_parts(spark: SparkSession, folder: str, names: list[str], head: bytes, n_tasks: int) -> None:
    """Copy the parts of each file, in their order and behind ``head``, to their places in it."""
    fs, _ = file_system(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    copies, lengths = [], {}
    for k, name in enumerate(names):
        parts = [s for s in fs.listStatus(path(f"{folder}/parts/_file={k}")) if not s.getPath().getName().startswith(("_", "."))]
        target = path(f"{folder}/files/{name}")
        fs.mkdirs(target.getParent())
        to, at = fs.makeQualified(target).toUri().getPath(), len(head)
        for s in sorted(parts, key=lambda s: int(s.getPath().getName().split("-")[1])):
            copies.append((s.getPath().toUri().getPath(), to, at))
            at += s.getLen()
        lengths[name] = at

    def copy(one):
        part, to, at = one
        # A part goes when it has been copied, so that rows don't lie there twice; a task that runs again finds it gone.
        if not os.path.exists(part):
            return
        # Opened without cutting it, as other tasks write their places at the same time.
        with open(part, "rb") as source, os.fdopen(os.open(to, os.O_WRONLY | os.O_CREAT, 0o666), "wb") as sink:
            if at == len(head):
                sink.write(head)
            sink.seek(at)
            shutil.copyfileobj(source, sink, 1 << 20)
        os.remove(part)

    spark.sparkContext.parallelize(copies, n_tasks).foreach(copy)
    for name, length in lengths.items():
        if fs.getFileStatus(path(f"{folder}/files/{name}")).getLen() != length:
            raise OSError(f"{name} isn't whole")
    fs.create(path(f"{folder}/files/_SUCCESS")).close()


def _name_parts(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Rename the one part of each file; a missing or second part is an error."""
    fs, root = file_system(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    # A part's name begins with part- and the number of the partition that wrote it.
    made = [s.getPath() for s in fs.listStatus(path(f"{folder}/parts")) if not s.getPath().getName().startswith(("_", "."))]
    numbers = [int(p.getName().split("-")[1]) for p in made]
    for k, name in enumerate(names):
        parts = [p for p, n in zip(made, numbers, strict=True) if n == k]
        if len(parts) != 1:
            raise OSError(f"{name} has {len(parts)} parts")
        target = path(f"{folder}/files/{name}")
        fs.mkdirs(target.getParent())
        if not fs.rename(parts[0], target):
            raise OSError(f"{name} can't be renamed")
    fs.mkdirs(path(f"{folder}/files"))
    fs.create(path(f"{folder}/files/_SUCCESS")).close()


def _swap(spark: SparkSession, folder: str, path: str) -> None:
    fs, target = file_system(spark, path)
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(target.getParent())
    old = made(f"{folder}/old")
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be replaced")
    if not fs.rename(made(f"{folder}/files"), target):
        fs.rename(old, target)
        raise OSError(f"{path} can't be put in place")
    fs.delete(made(folder), True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of CSV files of ``write_files``, and ``file_path``, as Spark reads them by ``CSV_READ``, but in splits.

    As quoted texts may hold line ends, that reader takes each file whole in one task.  Here lines are read in splits: a
    line begins a row where the quotes before it in its file are even in number, since those in a text are doubled.  Rows
    that cross the ends of splits are put together from their pieces.  The rows are stored; ``discard`` deletes them.
    """
    # Lines of a task come split by split, in the order of the file.
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_split"))
    quotes = F.sum(F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit(""))))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a split.
    states = lines.groupBy("file_path", "_split").agg(quotes.alias("_n")).select("file_path", "_split", (before % 2).cast("int").alias("_inside"))

    def rows_of(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        key, odd, held, piece, first = None, 0, [], None, False
        out = []

        def tail():
            # What is left of a split goes on in the next one; without any row's end it is all of one row's middle.
            if held:
                out.append((*key, 1 if piece is None else 0, first, "\n".join(held)))

        def made():
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (("file_path", pa.string()), ("_split", pa.int64()), ("_piece", pa.int32()), ("_first", pa.bool_()), ("_row", pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

        for batch in batches:
            value, path, split, inside = (batch.column(batch.schema.get_field_index(c)) for c in ("value", "file_path", "_split", "_inside"))
            if inside.null_count:
                raise ValueError("the files' splits changed while they were read")
            n, texts, splits = len(batch), value.to_pylist(), split.to_numpy()
            numbers = pc.dictionary_encode(path).indices.to_numpy()
            counts = pc.count_substring(value, '"').to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(splits) != 0) | (np.diff(numbers) != 0)) + 1).tolist(), n] if n else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = (path[a].as_py(), int(splits[a]))
                if here != key:
                    tail()
                    key, odd, held = here, inside[a].as_py(), []
                    # The first piece of a split that begins inside a row belongs to an earlier one.
                    piece, first = (0 if odd else None), here[1] == 0
                states = (odd + np.cumsum(counts[a:b])) & 1
                odd, at = int(states[-1]), a
                for end in (np.flatnonzero(states == 0) + a + 1).tolist():
                    row = "\n".join([*held, *texts[at:end]])
                    out.append((*key, piece, first, row))
                    held, at, piece, first = [], end, None, False
                held.extend(texts[at:b])
            yield made()
            out.clear()
        tail()
        yield made()

    # Without the small side's shuffle the lines stay in order; stored, as it is read twice.
    placed = lines.join(F.broadcast(states), ["file_path", "_split"], "left").select("value", "file_path", "_split", "_inside")
    rows = stored(placed.mapInArrow(rows_of, "file_path string, _split long, _piece int, _first boolean, _row string"))
    # Two pieces a split at most: one that ends a row and one that begins one.
    w = Window.partitionBy("file_path").orderBy("_split", "_piece")
    pieces = rows.filter("_piece is not null").withColumn("_begun", F.last(F.when(F.col("_piece") == 1, F.col("_split")), ignorenulls=True).over(w))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_split", "_piece", "_row"))), lambda x: x["_row"])
    whole = pieces.groupBy("file_path", "_begun").agg(F.bool_or("_first").alias("_first"), F.array_join(texts, "\n").alias("_row"))
    both = rows.filter("_piece is null").select("file_path", "_first", "_row").unionByName(whole.select("file_path", "_first", "_row"))
    # The first row of a file has the names.
    out = both.filter("not _first and _row <> ''").select(F.from_csv("_row", schema, CSV_READ).alias("_row"), "file_path").select("_row.*", "file_path")
    out._stored_at = rows._stored_at
    return out


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, size, modified) of all files below ``root``; ``glob`` is on their names.  Contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def manifest_of(df: DataFrame, keys: list[str], **settings) -> DataFrame:
    """What was written, part by part: of each (keys) the rows, the number of files, and their names, sorted.

    ``df`` is read from files.  ``settings`` (sources, variants, shots, seed and the like) stand in each row as they are.
    """
    files = df.groupBy(*keys, F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("_n"))
    rows = files.groupBy(*keys).agg(F.sum("_n").alias("n_records"), F.count(F.lit(1)).alias("n_files"), F.array_sort(F.collect_list(F.element_at(F.split("_path", "/"), -1))).alias("files"))
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)
    return rows.withColumns({k: lit(v) for k, v in settings.items()}) if settings else rows
