"""A folder of files as a DataFrame, and what the engine reads from it.

Spark's own file readers skip names that begin with an underscore or a dot, both of which matter here, so this is a
data source of its own.  The folder must be a mount that the driver and the executors share.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafgraph.functions import text as X

# What a scan leaves out and reads.
DEPENDENCY_FILE, SKIPPED, OVERVIEW = "deps.yml", "node_modules", "leafgraph-index.md"
SCANNED, LISTED = (".md", ".txt"), (".md", ".txt", ".pdf", ".docx")
SUMMARY_CHARS = 500
FILES_IN_PARTITION = 2000


class Tree(DataSource):
    """``path`` (relative, with slashes), ``bytes``, ``content`` (null if not UTF-8, or with option ``read`` = false), ``valid``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, bytes long, content string, valid boolean"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.read_text = options["path"], options.get("read", "true") != "false"
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")

    def partitions(self) -> list[InputPartition]:
        """Lists of names in the order of the walk.  The driver holds the names alone; sizes and contents are read by tasks."""
        out, names = [], []
        for folder, below, files in os.walk(self.root):
            below.sort()
            base = os.path.relpath(folder, self.root).replace(os.sep, "/")
            for n in sorted(files):
                names.append(n if base == "." else f"{base}/{n}")
                if len(names) == FILES_IN_PARTITION:
                    out.append(InputPartition(names))
                    names = []
        return [*out, InputPartition(names)]

    def read(self, partition):
        for name in partition.value:
            path, content, valid = os.path.join(self.root, name), None, True
            try:
                size = os.stat(path).st_size
            except OSError:
                continue
            if self.read_text:
                try:
                    with open(path, encoding="utf-8") as f:  # line ends become \n
                        content = f.read()
                except (OSError, UnicodeDecodeError):
                    valid = False
            yield name, size, content, valid


def files(spark: SparkSession, root: str, read: bool = True) -> DataFrame:
    spark.dataSource.register(Tree)
    return spark.read.format("tree").option("read", str(read).lower()).load(root)


def _chosen(rows: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """A row for each extension that a path ends with, so one listed twice counts twice."""
    ends = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(e).alias("end")) for i, e in enumerate(extensions, 1)))
    rows = rows.where(~X.is_hidden(F.col("path")) & ~F.contains("path", F.lit(SKIPPED)) & (X.base_name(F.col("path")) != DEPENDENCY_FILE))
    return rows.withColumn("e", F.explode(F.filter(ends, lambda x: F.endswith("path", x["end"])))).withColumn("place", F.col("e.place"))


def document_paths(rows: DataFrame, extensions: tuple[str, ...] = LISTED) -> DataFrame:
    """(place, path) of documents by extension; ``place`` and ``path`` give the order."""
    return _chosen(rows, extensions).select("place", "path")


def scan_documents(rows: DataFrame, extensions: tuple[str, ...] = SCANNED) -> DataFrame:
    """(place, path, content, summary) of documents that can be read and aren't blank."""
    rows = _chosen(rows, extensions).where(F.col("content").rlike(r"(?U)\S"))
    return rows.select("place", "path", "content", F.substring("content", 1, SUMMARY_CHARS).alias("summary"))


def inventory(rows: DataFrame) -> DataFrame:
    """(path, bytes) of files that are neither hidden nor locks."""
    return rows.where(~X.is_hidden(F.col("path")) & ~X.is_office_lock(F.col("path"))).select("path", "bytes")


def entry(rows: DataFrame) -> DataFrame:
    """At most one path: SKILL.md, else any spelling of it at the root, else the first skill of a plugin folder."""
    path = F.col("path")
    rank = F.when(path == "SKILL.md", 0).when(F.upper(path) == "SKILL.MD", 1).when(path.rlike(r"^\.claude/skills/[^/]+/skill\.md$"), 2)
    return rows.select(path, rank.alias("rank")).where("rank is not null").orderBy("rank", "path").limit(1).select("path")


def ordered(rows: DataFrame) -> DataFrame:
    """What a listing has, the engine's own overview left out, in the order of path components, not of strings."""
    path = F.col("path")
    listed = rows.where(~X.is_hidden(path) & ~X.is_office_lock(path) & (X.base_name(path) != OVERVIEW))
    return listed.orderBy(F.split(path, "/"))


def declared(rows: DataFrame, text: str = "content") -> DataFrame:
    """(file, path, includes) of dependency files: the last block of a path counts; two spaces and # begin a comment."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    plain = lambda c: F.regexp_replace(F.regexp_replace(bare(c), r'^"+|"+$', ""), r"^'+|'+$", "")
    lines = rows.select(F.col("path").alias("file"), F.posexplode(F.split(text, X.LINE_BREAK, -1)).alias("pos", "line"))
    lines = lines.withColumn("line", bare(F.col("line"))).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    line = F.col("line")
    head = F.regexp_extract("line", r"^-?\s*path:\s*(.+)$", 1)
    opens = F.when((head != "") | (line == "includes: []"), False).when(line == "includes:", True).when(~line.startswith("- ") & line.contains(":"), False)
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"head": F.when(head != "", plain(head)), "begun": F.when(head != "", F.col("pos")), "opens": opens})
    lines = lines.withColumns({"path": F.last("head", True).over(before), "block": F.last("begun", True).over(before), "open": F.last("opens", True).over(before)}).where("path is not null")
    last = F.max("block").over(Window.partitionBy("file", "path"))
    item = plain(F.regexp_replace(plain(F.substr("line", F.lit(3))), r"(?s)  #.*$", ""))
    lines = lines.withColumn("last", last).where("block = last").withColumn("item", F.when((F.col("path") != "") & F.col("open") & F.col("opens").isNull() & line.startswith("- ") & (item != ""), F.struct("pos", item.alias("include"))))
    return lines.groupBy("file", "path").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["include"]).alias("includes"))
