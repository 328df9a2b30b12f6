"""A stream of a source's numbered pages, whose offset is the source's cursor."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Page(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceStreamReader):
    """Offsets are {"page": n}: all pages before n have been read. Each page is a partition."""

    def __init__(self, options: dict, schema):
        self.root, self.schema = options["path"].rstrip("/"), schema

    def _pages(self) -> dict[int, str]:
        from pyarrow import fs

        store, root = _open(self.root)
        found = store.get_file_info(fs.FileSelector(root))
        names = {f.base_name: f.path for f in found if f.type == fs.FileType.Directory}
        return {int(n.removeprefix("page=")): p for n, p in names.items() if n.startswith("page=") and n[5:].isdigit()}

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self, *_) -> dict:
        return {"page": max(self._pages(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(p) for n, p in sorted(self._pages().items()) if start["page"] <= n < end["page"]]

    def read(self, partition: _Page):
        import pyarrow.json as pj
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        store, _ = _open(self.root)
        for f in store.get_file_info(fs.FileSelector(partition.path)):
            if f.base_name.endswith(".json") and f.size:
                with store.open_input_stream(f.path) as s:
                    table = pj.read_json(s, parse_options=pj.ParseOptions(explicit_schema=wanted, unexpected_field_behavior="ignore"))
                yield from table.select(wanted.names).to_batches(max_chunksize=10_000)

    def commit(self, end: dict) -> None:
        """Pages stay where they are: what has been read is known by the checkpoint."""


class PageSource(DataSource):
    """Format "sentrylake_pages": JSON lines in folders page=0, page=1 and on under `path`. The schema must be given."""

    @classmethod
    def name(cls) -> str:
        return "sentrylake_pages"

    def streamReader(self, schema):
        return _Reader(self.options, schema)


def page_stream(spark: SparkSession, path: str, schema: str):
    """The stream of the pages under a path that driver and executors see."""
    spark.dataSource.register(PageSource)
    return spark.readStream.format("sentrylake_pages").schema(schema).load(path)
