"""Source files and snippets as rows of (file_path, content)."""
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fixed
from ..functions import language as L
from ..session import cut_lineage


#: Files one task reads, and bytes of them it holds, at most.
TASK_FILES = 16384
BATCH_BYTES = 16 << 20
#: Tasks per core that list folders.
LISTERS = 4


def read_tree(spark: SparkSession, folder: str, extensions=None) -> DataFrame:
    """Every file below a folder with an allowed extension; undecodable bytes are dropped.

    Files are read as bytes so that one bad encoding cannot fail the scan, and the listing is filtered by name before any content
    is read.  Tasks list the folders, one each, level by level, so that the driver holds no names, and a task reads many small
    files.  Empty files and hidden names are left out, as by Spark's readers.  A file system that only Spark knows, or a single
    file, is left to Spark's own reader.
    """
    suffixes = tuple(extensions or fixed.SCAN_EXTENSIONS)
    prefix, root = _folder_place(folder)
    if root is None:
        pattern = "*{" + ",".join(suffixes) + "}"
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern)
            .load(folder)
        )
        path = F.regexp_replace("path", "^file:/*", "/")
    else:
        found = _listing(spark, folder, root, suffixes)
        tasks = max(spark.sparkContext.defaultParallelism, -(-found.count() // TASK_FILES))
        raw = found.repartition(tasks, "path").mapInPandas(_reader(folder), "path string, content binary")
        path = F.concat(F.lit(prefix), F.col("path"))
    return raw.select(path.alias("file_path"), decode_lossy(F.col("content")).alias("content"))


def _folder_place(folder: str) -> tuple:
    """What stands before the paths of a folder's file system, and the folder's path there; none if it can't be listed by tasks."""
    from pyarrow import fs

    try:
        system, root = fs.FileSystem.from_uri(folder)
        listed = system.get_file_info(root).type == fs.FileType.Directory
    except (OSError, ValueError):  # no such scheme, or a path within the working folder
        return None, None
    local = isinstance(system, fs.LocalFileSystem)
    if not listed or not local and root not in folder:
        return None, None
    return "" if local else folder[:folder.index(root)], root


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (
        name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _listing(spark: SparkSession, folder: str, root: str, suffixes: tuple) -> DataFrame:
    """The paths of all files below a folder with one of the endings."""
    def entries(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for place in batch["path"]:
                below = [(e.path, e.type == fs.FileType.Directory) for e in system.get_file_info(fs.FileSelector(place))
                         if not _hidden(e.base_name) and (e.type == fs.FileType.Directory or e.size and e.base_name.endswith(suffixes))]
                for k in range(0, len(below), TASK_FILES):
                    yield pd.DataFrame(below[k:k + TASK_FILES], columns=["path", "is_folder"])

    files, folders, n = None, spark.createDataFrame([(root,)], "path string"), 1
    while n:
        wanted = min(n, LISTERS * spark.sparkContext.defaultParallelism)
        level = cut_lineage(folders.repartition(wanted).mapInPandas(entries, "path string, is_folder boolean"))
        here = level.filter("NOT is_folder").select("path")
        files = here if files is None else files.unionByName(here)
        folders = level.filter("is_folder").select("path")
        n = folders.count()
    return files


def _reader(folder: str):
    """Reads the files of a batch of paths, some bytes at a time."""
    def contents(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            held, size = [], 0
            for path in batch["path"]:
                with system.open_input_stream(path, compression=None) as stream:
                    held.append((path, stream.read()))
                size += len(held[-1][1])
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(held, columns=["path", "content"])
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=["path", "content"])

    return contents


def write_tree(files: DataFrame, folder: str) -> DataFrame:
    """Write (file_path, content) rows as files below a folder every executor reaches; returns what was written.

    A file is written under its own name, so a repeated task writes the same bytes again.
    """
    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for path, content in zip(batch["file_path"], batch["content"]):
                place, data = f"{root}/{path}", (content or "").encode()
                system.create_dir(place.rpartition("/")[0], recursive=True)
                with system.open_output_stream(place, compression=None) as stream:
                    stream.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"file_path": batch["file_path"], "bytes": sizes})

    return files.select("file_path", "content").mapInPandas(write, "file_path string, bytes long")


def decode_lossy(data: Column) -> Column:
    """UTF-8 text of bytes, leaving invalid sequences out."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))


def with_language(files: DataFrame) -> DataFrame:
    """Add the language and keep only the files of a supported one."""
    found = files.withColumn("language", L.detect(F.col("file_path"), F.col("content")))
    return found.filter(F.col("language").isin(fixed.SUPPORTED_LANGUAGES))


def snippets(rows: DataFrame, code: str = "code", language: str = "language", name: str = "quick_scan.tmp") -> DataFrame:
    """In-memory snippets as files; a missing language is read off the text."""
    return rows.select(
        *[c for c in rows.columns if c not in (code, language)],
        F.lit(name).alias("file_path"),
        F.coalesce(F.col(language), L.from_content(F.col(code))).alias("language"),
        F.coalesce(F.col(code), F.lit("")).alias("content"),
    )
