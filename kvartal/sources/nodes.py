"""Advert nodes: JSON lines as a table, and a paged connector over any transport."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kvartal.functions.parsing import NODE

PAGE_LIMIT = 50


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of nodes as one column ``node``; a line that is no node is NULL in its fields."""
    from pyspark.sql import functions as F

    return spark.read.schema(NODE).json(path).select(F.struct("*").alias("node"))


def fetch_pages(post: Callable[[dict], tuple[int, dict]], max_pages: int = 5, page_size: int = 25, pause: Callable[[], None] = lambda: None) -> Iterator[dict]:
    """Nodes of a cursor-paged service: ``post`` takes the variables and gives (status, body).

    Ends at the page limit, at an HTTP error, at reported errors, without a
    next page, or without a cursor to it.
    """
    cursor = None
    for i in range(max_pages):
        if i:
            pause()
        status, body = post({"first": min(page_size, PAGE_LIMIT), "cursor": cursor})
        if status != 200 or body.get("errors"):
            return
        found = ((body.get("data") or {}).get("items") or {})
        for edge in found.get("edges") or []:
            if edge.get("node"):
                yield edge["node"]
        info = found.get("pageInfo") or {}
        cursor = info.get("endCursor")
        if not info.get("hasNextPage") or not cursor:
            return


def http_post(url: str, query: str, headers: dict[str, str] | None = None, timeout: float = 30.0) -> Callable[[dict], tuple[int, dict]]:
    """A transport for :func:`fetch_pages`: JSON requests to ``url``; status 0 where none came back."""
    import urllib.error
    import urllib.request

    def post(variables: dict) -> tuple[int, dict]:
        data = json.dumps({"query": query, "variables": variables}).encode()
        request = urllib.request.Request(url, data, {"Content-Type": "application/json", "Accept": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as error:
            return error.code, {}
        except (OSError, ValueError):
            return 0, {}

    return post


def fetch_to_parquet(spark: SparkSession, post: Callable[[dict], tuple[int, dict]], path: str, today, max_pages: int = 5, page_size: int = 25, pause: Callable[[], None] = lambda: None) -> str:
    """Fetch nodes, normalise them, and write them under the listings contract, with all its columns also where nothing came.

    Nodes are at most ``max_pages`` pages of PAGE_LIMIT.  ``today`` is the
    Column of the date that relative dates count from.
    """
    from pyspark.sql import functions as F

    from kvartal.functions.parsing import flatten_node, normalise_nodes
    from kvartal.schema import LISTINGS, conform

    found = [(json.dumps(n, ensure_ascii=False),) for n in fetch_pages(post, max_pages, page_size, pause)]
    nodes = spark.createDataFrame(found, "node string").select(F.from_json("node", NODE).alias("node"))
    conform(normalise_nodes(flatten_node(nodes), today), LISTINGS).write.mode("overwrite").parquet(path)
    return path


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.options["path"]))]

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                body = json.loads(line)
                for edge in ((body.get("data") or {}).get("items") or {}).get("edges") or []:
                    if edge.get("node"):
                        yield (json.dumps(edge["node"], ensure_ascii=False),)


class NodePages(DataSource):
    """Saved response pages, one JSON body a line, as rows of node JSON: ``spark.read.format("node_pages").load(path)``."""

    @classmethod
    def name(cls):
        return "node_pages"

    def schema(self):
        return "node string"

    def reader(self, schema):
        return _Reader(self.options)
