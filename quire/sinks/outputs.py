"""Sinks: files, standard output, HTTP, an index table with merge, an artifact store; chosen by name from ``SINKS``."""

from __future__ import annotations

import base64
import hashlib
import http.client
import json
import os
import re
import ssl
import sys
import time
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import is_content_addressable
from ..operators.index import replace_children
from ..operators.pages import indices_json, of_parsed, parse_indices
from ..state import exists, file_system, shared_folder


def _write_each(rows: DataFrame, write_one, columns: list[str]) -> DataFrame:
    """(id, path, error) after ``write_one(row)`` for every row, in the tasks; an error is kept with its row.

    The writing happens once: what became of each row is kept in the shared folder, and read from there however often the result is used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                error = None
                try:
                    write_one(row)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((row["id"], row["path"], error))
            yield pd.DataFrame(out, columns=["id", "path", "error"])

    folder = f"{shared_folder(rows.sparkSession)}/written-{uuid.uuid4().hex}"
    rows.select(*columns).mapInPandas(run, "id string, path string, error string").write.parquet(folder)
    return rows.sparkSession.read.schema("id string, path string, error string").parquet(folder)


def write_files(docs: DataFrame, folder: str, extension: str = "txt", metadata: bool = True) -> DataFrame:
    """A text file for each document at its path below ``folder``; embedded ones have their id before the extension, so that none overwrites another.

    Each file is written aside and renamed, so a task that is run again leaves the same files.
    """

    def one(row: dict) -> None:
        child = f".{row['id']}" if row["level"] else ""
        target = os.path.join(folder, row["path"].lstrip("/") + child)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        parts = [(f"{target}.{extension}", row["content"] or "")]
        if metadata:
            parts.append((f"{target}.json", json.dumps(json.loads(row["json"] or "{}"), indent=2, ensure_ascii=False)))
        for name, text in parts:
            aside = f"{name}.{uuid.uuid4().hex}"
            with open(aside, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(aside, name)

    return _write_each(docs.withColumn("json", F.to_json("metadata")), one, ["id", "path", "level", "content", "json"])


def formatted(docs: DataFrame) -> DataFrame:
    """(path, level, ordinal, line): what standard output shows of each document: path, its parent, metadata, an empty line and the text."""
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ", "))), "\n")
    return docs.select("path", "level", "ordinal", F.concat_ws("\n", "path", F.coalesce("parent_id", F.lit("")), meta, F.lit(""), F.coalesce("content", F.lit("")), F.lit("")).alias("line"))


def write_stdout(docs: DataFrame, stream=None) -> None:
    """Streams row by row through the driver, partition after partition, each file's documents together and in their order; nothing is sorted."""
    for row in formatted(docs).select("line").toLocalIterator():
        print(row["line"], file=stream or sys.stdout)


class _Pinned(http.client.HTTPSConnection):
    """A connection to a server whose certificate must be the pinned one, if there is one, and be made out to ``verify_host``, if that is given."""

    def __init__(self, host: str, timeout: float, certificate: str | None, verify_host: str | None) -> None:
        context = ssl.create_default_context(cafile=certificate)
        super().__init__(host, timeout=timeout, context=context)
        self.verify_host, self.pin, self._own = verify_host, None, context
        if certificate:
            with open(certificate, encoding="ascii") as f:
                self.pin = hashlib.sha256(ssl.PEM_cert_to_DER_cert(f.read())).digest()

    def connect(self) -> None:
        http.client.HTTPConnection.connect(self)
        self.sock = self._own.wrap_socket(self.sock, server_hostname=self.verify_host or self.host)
        if self.pin and hashlib.sha256(self.sock.getpeercert(True)).digest() != self.pin:
            raise ssl.SSLCertVerificationError("the server's certificate isn't the pinned one")


def write_http(docs: DataFrame, base: str, retries: int = 3, timeout: float = 30, certificate: str | None = None, auth: tuple[str, str] | None = None, verify_host: str | None = None) -> DataFrame:
    """PUT of each root document's id, path, text and metadata as a form; an answer outside of 2xx is an error of that row, other failures are tried again.

    ``certificate`` is a PEM file with the only certificate that the server may have, ``verify_host`` the name that it must be made out to where that isn't the host of ``base``.
    """
    target = urllib.parse.urlsplit(base)

    def one(row: dict) -> None:
        form = {"id": row["id"], "path": row["path"], "text": row["content"] or ""}
        for k, values in json.loads(row["json"] or "{}").items():
            form[k] = values
        headers = {"Content-Type": "application/x-www-form-urlencoded"}
        if auth:
            headers["Authorization"] = "Basic " + base64.b64encode(":".join(auth).encode()).decode()
        body, place = urllib.parse.urlencode(form, doseq=True).encode(), f"{target.path.rstrip('/')}/{urllib.parse.quote(row['id'])}"
        for attempt in range(retries + 1):
            connection = _Pinned(target.netloc, timeout, certificate, verify_host) if target.scheme == "https" else http.client.HTTPConnection(target.netloc, timeout=timeout)
            try:
                connection.request("PUT", place, body, headers)
                answer = connection.getresponse()
                answer.read()
                if answer.status // 100 != 2:
                    raise ValueError(f"HTTP {answer.status} {answer.reason}")
                return
            except (OSError, http.client.HTTPException) as e:
                if attempt == retries or isinstance(e, ssl.SSLCertVerificationError):
                    raise
                time.sleep(0.1 * 2**attempt)
            finally:
                connection.close()

    return _write_each(docs.where("level = 0").withColumn("json", F.to_json("metadata")), one, ["id", "path", "content", "json"])


class IndexTable:
    """An index in Parquet folders, dealt to ``parts`` by root id. A version is a manifest that says for each part in which commit's folder it lies; a commit of some trees writes their parts only and
    leaves the others where they are. A version shows by the atomic creation of one file; a rollback forgets what wasn't committed.

    One writer at a time. Readers see the version that was newest when they began.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs, path = file_system(spark, self.folder)
        self._fs.mkdirs(path)
        self.pending: str | None = None
        now = self.version()
        self.parts = self._manifest(now)["parts"] if now else parts

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.folder))]

    def _manifest(self, version: str) -> dict:
        stream = self._fs.open(self._path(f"{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self) -> str | None:
        """Newest version with a marker of its commit."""
        done = sorted(n[:-5] for n in self._names() if n.endswith(".done"))
        return done[-1] if done else None

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        places = [f"{self.folder}/data-{v}/_part={n}" for n, v in manifest["places"].items() if parts is None or int(n) in parts]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        v = self.version()
        return self._read(self._manifest(v)) if v else None

    def _part(self, columns: list[str]) -> Column:
        key = F.coalesce(*[F.col(c).cast("string") for c in ("root_id", "id") if c in columns], F.lit("")) if {"root_id", "id"} & set(columns) else F.lit("")
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _stage(self, docs: DataFrame, kept: dict[str, str], schema: StructType | None = None) -> None:
        self.rollback()
        newest = max((int(n[1:13]) for n in self._names() if re.fullmatch(r"v\d{12}\.(done|json)", n)), default=0)
        self.pending = f"v{newest + 1:012d}"
        data = f"{self.folder}/data-{self.pending}"
        docs.withColumn("_part", self._part(docs.columns)).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(data)
        wrote = [s.getPath().getName() for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(data))]
        places = kept | {n.removeprefix("_part="): self.pending for n in wrote if n.startswith("_part=")}
        manifest = {"parts": self.parts, "places": places, "schema": (schema or docs.schema).jsonValue()}
        stream = self._fs.create(self._path(f"{self.pending}.json"), True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()

    def stage(self, docs: DataFrame) -> None:
        """Writes the next version, of the whole index, without showing it."""
        self._stage(docs, {})

    def commit(self) -> str | None:
        """Shows what was staged, by the atomic creation of one file."""
        if self.pending:
            self._fs.create(self._path(f"{self.pending}.done"), False).close()
            self.pending = None
        return self.version()

    def rollback(self) -> None:
        if self.pending:
            self._fs.delete(self._path(f"{self.pending}.json"), True)
            self._fs.delete(self._path(f"data-{self.pending}"), True)
            self.pending = None

    def write_trees(self, docs: DataFrame) -> None:
        """Whole trees: stale children of their roots go, everything new replaces its id. Only the parts in which these roots lie are read and written."""
        now = self.version()
        if now is None:
            self.stage(docs)
        else:
            manifest = self._manifest(now)
            touched = [r[0] for r in docs.select(self._part(docs.columns).alias("p")).distinct().collect()]  # as many as parts at most
            merged = replace_children(self._read(manifest, touched), docs)
            schema = StructType.fromJson(manifest["schema"])
            for f in merged.schema.fields:
                if f.name not in schema.fieldNames():
                    schema = schema.add(f)
            self._stage(merged.select(*schema.fieldNames()), {n: v for n, v in manifest["places"].items() if int(n) not in touched}, schema)
        self.commit()

    def replace(self, docs: DataFrame) -> None:
        self.stage(docs)
        self.commit()

    def vacuum(self, keep: int = 2) -> None:
        """Removes versions but the newest, and data that none of these needs."""
        done = sorted(n[:-5] for n in self._names() if n.endswith(".done"))
        needed = {v for version in done[-keep:] for v in (version, *self._manifest(version)["places"].values())}
        for n in self._names():
            version = n.removeprefix("data-").split(".")[0]
            if done and version <= done[-1] and version not in (needed if n.startswith("data-") else done[-keep:]):
                self._fs.delete(self._path(n), True)


def write_artifacts(items: DataFrame, folder: str) -> None:
    """(id, raw, metadata) as a Parquet store partitioned by the first two hex digits of the id; ids that aren't hexadecimal lie under ``flat``. What is there already, and what comes twice, is written once."""
    shard = F.when(is_content_addressable(F.col("id")), F.substring("id", 1, 2)).otherwise("flat")
    new = items.select("id", shard.alias("shard1"), "raw", F.to_json("metadata").alias("metadata_json"))
    spark = items.sparkSession
    if exists(spark, folder):
        new = new.join(spark.read.parquet(folder).select("id"), "id", "left_anti")
    new.dropDuplicates(["id"]).repartition("shard1").write.mode("append").partitionBy("shard1").parquet(folder)


def _shard_of(ident: str) -> str:
    return ident[:2] if re.fullmatch("[0-9a-f]{4,}", ident) else "flat"


def read_artifact(spark: SparkSession, folder: str, ident: str) -> DataFrame:
    """The artifact with an id; only its partition is read."""
    return spark.read.schema("id string, raw binary, metadata_json string, shard1 string").parquet(folder).where((F.col("shard1") == _shard_of(ident)) & (F.col("id") == ident)).limit(1)


def page_indices(docs: DataFrame, folder: str, parser: str = "quire") -> DataFrame:
    """(id, extractor, pages) of parsed documents: from the store of page places in ``folder``, partitioned like artifacts; what it lacks is computed, added to it and read from it the next time."""
    spark = docs.sparkSession
    shard = F.when(is_content_addressable(F.col("id")), F.substring("id", 1, 2)).otherwise("flat")
    kind = "id string, indices string, shard1 string"
    store = spark.read.schema(kind).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], kind)
    missing = docs.join(store.select("id"), "id", "left_anti").dropDuplicates(["id"])
    indices_json(parser, of_parsed(missing)).withColumn("shard1", shard).repartition("shard1").write.mode("append").partitionBy("shard1").parquet(folder)
    known = spark.read.schema(kind).parquet(folder).join(docs.select("id").distinct(), "id", "left_semi")
    return known.select("id", parse_indices(F.col("indices")).alias("i")).select("id", "i.extractor", "i.pages")


def write_dead_letters(docs: DataFrame, results: DataFrame, folder: str) -> None:
    """Documents whose write failed, kept for ``sources.dumps.dead_letters``."""
    docs.join(results.where("error is not null").select("id", F.col("error").alias("sink_error")), "id").write.mode("append").parquet(folder)


SINKS = {"file": write_files, "stdout": write_stdout, "rest": write_http, "index": lambda docs, folder: IndexTable(docs.sparkSession, folder).write_trees(docs)}
