"""A data source that lists files by name and length, those of zero bytes too, without opening any.

Spark's own file sources leave files of zero bytes out and list on the driver. Here each sub-folder of the given one is a partition
of its own, listed by its own task.
"""

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length bigint"


class Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        self.path, self.recursive = path, recursive


class ListingReader(DataSourceReader):
    def __init__(self, path: str):
        # Paths come out as Spark's file sources write them.
        self.files, self.top = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
        self.prefix = "file:" if self.files.type_name == "local" else path.split("://", 1)[0] + "://"

    def partitions(self) -> list[InputPartition]:
        below = self.files.get_file_info(fs.FileSelector(self.top, allow_not_found=True))
        return [Folder(self.top, False), *(Folder(x.path, True) for x in below if x.type == fs.FileType.Directory and not hidden(x.path[len(self.top):]))]

    def read(self, partition: Folder) -> Iterator[tuple[str, int]]:
        for x in self.files.get_file_info(fs.FileSelector(partition.path, recursive=partition.recursive, allow_not_found=True)):
            if x.type == fs.FileType.File and not hidden(x.path[len(self.top):]):
                yield self.prefix + x.path, x.size


def hidden(path: str) -> bool:
    """As Spark's file sources see it: some name in the path starts with a dot or an underscore, partition folders apart."""
    return any(name[0] == "." or (name[0] == "_" and "=" not in name) for name in path.split("/") if name)


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file below a folder."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").load(path)
