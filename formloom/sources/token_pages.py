"""Token payloads as a data source: spark.read.format("token_pages").load(folder).

Files hold one payload a line: {"doc_id", "pages": [{"number", "width", "height", "tokens": [{"text", "bbox", "confidence",
"script"}], "lines": [[x, y, w, h]]}]}. The option `content` says what rows are wanted: tokens (default), pages or lines.
Files may be compressed (.gz). They are read in groups of about `groupBytes`, one task each; a file over it is a task of its own. Conditions on doc_id and
page go into the reader, where they spare the unfolding of whole documents and pages; `maxPages` pages of a document are
read at most (the reference's limit of 20 unless set, 0: all). A line that is no payload gives a row that has only its path
and an error, so one bad file doesn't stop a run. The folder is an address that Arrow's file systems know, as the executors
read it themselves.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

MAX_PAGES, GROUP_BYTES, BATCH = 20, 32_000_000, 20_000
#: A compressed file counts as so many times its size: about what payloads of forms shrink by.
PACKED = 30
SCHEMAS = {
    "tokens": "path string, doc_id bigint, page int, pos int, text string, x double, y double, w double, h double, confidence double, script string, error string",
    "pages": "path string, doc_id bigint, page int, width double, height double, error string",
    "lines": "path string, doc_id bigint, page int, x double, y double, w double, h double, error string",
}
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_TESTS = {
    EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, In: lambda a, b: a in b,
    IsNotNull: lambda a, b: a is not None,
}


class Group(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TokenPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content", "tokens").lower()
        self.most, self.group = int(options.get("maxpages", MAX_PAGES)), int(options.get("groupbytes", GROUP_BYTES))
        self.kept: list[tuple[str, str, object]] = []  # column, class of the condition, value

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and column in (("doc_id",), ("page",)):
                self.kept.append((column[0], type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def _system(self):
        return afs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (afs.LocalFileSystem(), self.path)

    def partitions(self):
        system, root = self._system()
        files = [x for x in system.get_file_info(afs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        groups, size = [[]], 0
        for x in sorted(files, key=lambda x: x.path):
            own = x.size * (PACKED if x.extension in ("gz", "zst", "bz2", "lz4") else 1)
            if groups[-1] and size + own > self.group:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += own
        return [Group(g) for g in groups if g]

    def wanted(self, column: str, value) -> bool:
        tests = {t.__name__: f for t, f in _TESTS.items()}
        return all(value is not None and tests[kind](value, v) for c, kind, v in self.kept if c == column)

    def rows(self, path: str, line: str):
        """The rows of one payload."""
        doc = json.loads(line)
        doc_id = int(doc["doc_id"])
        if not self.wanted("doc_id", doc_id):
            return
        for n, page in enumerate(doc.get("pages") or []):
            number = page.get("number")
            number = n + 1 if number is None else int(number)
            if (self.most and n >= self.most) or not self.wanted("page", number):
                continue
            if self.content == "pages":
                yield path, doc_id, number, _number(page.get("width")), _number(page.get("height")), None
            elif self.content == "lines":
                for box in page.get("lines") or []:
                    yield path, doc_id, number, *map(float, box[:4]), None
            else:
                for pos, t in enumerate(page.get("tokens") or []):
                    x, y, w, h = map(float, t["bbox"][:4])
                    yield path, doc_id, number, pos, str(t["text"]), x, y, w, h, 1.0 if t.get("confidence") is None else float(t["confidence"]), t.get("script"), None

    def read(self, partition: Group):
        fields = [c.split(" ") for c in SCHEMAS[self.content].split(", ")]
        schema = pa.schema([(n, _TYPES[t]) for n, t in fields])
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        failed = lambda path, e: (path, *[None] * (len(fields) - 2), f"{type(e).__name__}: {e}"[:500])
        # a bad line has no doc_id or page, so no condition on them takes it
        faults = not self.kept
        system, _ = self._system()
        held = []
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                for line in _lines(stream):
                    if not line.strip():
                        continue
                    try:
                        held += list(self.rows(path, line.decode("utf-8")))
                    except (ValueError, KeyError, TypeError, AttributeError, IndexError) as e:
                        held += [failed(path, e)] if faults else []
                    while len(held) >= BATCH:
                        yield batch(held[:BATCH])
                        held = held[BATCH:]
        if held:
            yield batch(held)


def _number(x):
    return None if x is None else float(x)


def _lines(stream, size: int = 1 << 20):
    rest = b""
    while True:
        part = stream.read(size)
        if not part:
            break
        *whole, rest = (rest + part).split(b"\n")
        yield from whole
    if rest:
        yield rest


class TokenPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_pages"

    def schema(self) -> str:
        content = self.options.get("content", "tokens").lower()
        if content not in SCHEMAS:
            raise ValueError(f"content is one of {', '.join(SCHEMAS)}")
        return SCHEMAS[content]

    def reader(self, schema) -> TokenPagesReader:
        return TokenPagesReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, content: str = "tokens", **options) -> DataFrame:
    """The rows of a folder of payloads; conditions on doc_id and page that follow are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenPages)
    return spark.read.format("token_pages").options(content=content, **options).load(path)


def payload_rows(tokens: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Tokens (doc_id, page, pos, text, x, y, w, h, confidence) as payloads, one row `value` of JSON per document, as the
    source reads them: df.write.text(folder). pages (doc_id, page, width, height) is optional."""
    from pyspark.sql import functions as F

    token = F.struct("text", F.array("x", "y", "w", "h").alias("bbox"), "confidence")
    listed = tokens.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", token.alias("t")))), lambda r: r["t"]).alias("tokens"))
    if pages is not None:
        listed = listed.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"], "left")
    page = F.struct(F.col("page").alias("number"), *[F.col(c) for c in ("width", "height") if c in listed.columns], "tokens")
    docs = listed.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return docs.select(F.to_json(F.struct("doc_id", "pages")).alias("value"))


def payload_of_pages(rows: DataFrame) -> DataFrame:
    """payload_rows() of documents that are one page row each (see operators.layouts): nothing is shuffled."""
    from pyspark.sql import functions as F

    one = lambda t: F.struct(t["text"].alias("text"), F.array(t["x"], t["y"], t["w"], t["h"]).alias("bbox"), t["confidence"].alias("confidence"))
    page = F.struct(F.col("page").alias("number"), F.transform(F.arrays_zip("text", "x", "y", "w", "h", "confidence"), one).alias("tokens"))
    return rows.select(F.to_json(F.struct("doc_id", F.array(page).alias("pages"))).alias("value"))
