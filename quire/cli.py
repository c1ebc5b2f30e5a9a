"""Commands over queues, reports and index tables: ``python -m quire.cli COMMAND ...``.

State lives in folders: a queue is Parquet with ``path``, reports are Parquet with (path, code, exception_class, exception_message, ts), an index is an ``IndexTable``.
Options may come from a file of ``name=value`` lines (``--options FILE``); what is on the command line wins.
Exit codes: 0 done, 1 failed, 2 wrong usage, 70 the JVM broke down.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.status import CODES, STATUS
from .operators import index, metadata, reports
from .plans.ingest import ReportStore, ingest, report_of
from .session import session
from .sinks.outputs import SINKS, IndexTable, write_files, write_http, write_stdout
from .sources import dumps
from .sources.parsers import Options, parse
from .sources.walk import walk
from .state import exists, file_system, remove, shared_folder

VERSION = "0.1"


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet, empty where there is none yet."""
    return spark.read.parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)


def _replace(df: DataFrame, folder: str) -> None:
    """Writes aside and swaps the folders, as the frame may read from the one it replaces."""
    spark, jvm = df.sparkSession, df.sparkSession.sparkContext._jvm
    fs, path = file_system(spark, folder)
    aside, old = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + ".new"), jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + ".old")
    df.write.mode("overwrite").parquet(aside.toString())
    fs.delete(old, True)
    if fs.exists(path):
        fs.rename(path, old)
    fs.rename(aside, path)
    fs.delete(old, True)


QUEUE, REPORTS = "path string", "path string, code int, exception_class string, exception_message string, ts timestamp"


def _code(text: str | None) -> int | None:
    if text is None:
        return None
    if text.isdigit() and int(text) in STATUS:
        return int(text)
    if text.upper() in CODES:
        return CODES[text.upper()]
    raise ValueError(f"no such status: {text}")


def _pairs(items: list[str]) -> dict[str, str | None]:
    return {a: b or None for a, _, b in (x.partition(":") for x in items)}


def _emit(lines: DataFrame, out: str | None, brackets: str) -> None:
    if out:
        with open(out, "w", encoding="utf-8") as f:
            dumps.write_json(lines, f, brackets)
    else:
        dumps.write_json(lines, sys.stdout, brackets)


def _condition(text: str | None):
    return F.expr(text) if text else None


def _spew(spark: SparkSession, paths: DataFrame, a: argparse.Namespace, options: Options) -> int:
    """Parses once, writes once, and reports what became of each path; 1 if any couldn't be written."""
    store = ReportStore(spark, a.reports)
    aside = f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}"
    try:
        parse(reports.to_do(paths.select("path"), store.latest()).distinct(), options).write.parquet(aside)
        docs, done = spark.read.parquet(aside), None
        if a.sink == "stdout":
            write_stdout(docs)
        else:
            done = write_files(docs, a.to, "html" if a.output_format == "html" else "txt") if a.sink == "file" else write_http(docs, a.to, certificate=a.certificate, verify_host=a.verify_host)
        store.add(report_of(docs, done))
        failed = 0 if done is None else done.where("error is not null").count()
        if failed:
            print(f"quire: {failed} documents couldn't be written", file=sys.stderr)
        return int(failed > 0)
    finally:
        remove(spark, aside)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    c = a.command
    if c == "queue":
        found = walk(spark, a.paths, tuple(a.include), tuple(a.exclude), a.ignore_hidden, not a.include_system, a.follow_links, a.max_depth).where("error is null").select("path")
        _replace(_table(spark, a.queue, QUEUE).unionByName(found).distinct(), a.queue)
        print(_table(spark, a.queue, QUEUE).count())
    elif c == "load-queue":
        loaded = dumps.queue_from_csv(spark, a.file, a.field) if a.file.endswith(".csv") else dumps.queue_from_json(spark, a.file)
        _replace(_table(spark, a.queue, QUEUE).unionByName(loaded), a.queue)
    elif c == "dump-queue":
        _emit(dumps.queue_lines(_table(spark, a.queue, QUEUE)), a.out, "[]")
    elif c == "wipe-queue":
        print(_table(spark, a.queue, QUEUE).count())
        _replace(spark.createDataFrame([], QUEUE), a.queue)
    elif c == "load-report":
        loaded = dumps.report_from_json(spark, a.file).select("path", "code", F.lit(None).cast("string").alias("exception_class"), F.lit(None).cast("string").alias("exception_message"), F.current_timestamp().alias("ts"))
        _replace(reports.latest(_table(spark, a.reports, REPORTS).unionByName(loaded)), a.reports)
    elif c == "dump-report":
        _emit(dumps.report_lines(reports.latest(_table(spark, a.reports, REPORTS)), _code(a.status)), a.out, "{}")
    elif c == "view-report":
        for r in reports.view(reports.latest(_table(spark, a.reports, REPORTS)), a.paths).collect():
            print(*[x if x is not None else "-" for x in r], sep="\t")
    elif c == "wipe-report":
        print(_table(spark, a.reports, REPORTS).count())
        _replace(spark.createDataFrame([], REPORTS), a.reports)
    elif c == "clean-report":
        _replace(reports.clean(_table(spark, a.reports, REPORTS), walk(spark, a.paths, ignore_system=False).where("error is null")), a.reports)
    elif c == "spew":
        options = Options(embeds=a.embeds, output=a.output_format, algorithm=a.algorithm, project=a.project, max_depth=a.max_embed_depth, max_bytes=a.max_embed_bytes, timeout=a.parse_timeout)
        paths = walk(spark, a.paths).where("error is null").select("path") if a.paths else _table(spark, a.queue, QUEUE)
        if a.sink == "index":
            print(ingest(spark, paths, a.to, a.reports, options))
        else:
            return _spew(spark, paths, a, options)
    elif c in ("copy", "tag", "rehash", "delete"):
        table = IndexTable(spark, a.index)
        docs = table.read()
        if docs is None:
            raise ValueError(f"no index in {a.index}")
        if c == "copy":
            chosen = docs if not a.filter else docs.where(a.filter)
            table.stage(index.merge_into(docs, index.copy_fields(chosen, _pairs(a.fields))))
        elif c == "tag":
            literals = metadata.parse_tags(a.literals)
            if a.other:
                other = IndexTable(spark, a.other).read()
                tags = (index.intersection if a.subset == "intersection" else index.complement)(docs, other, literals, condition=_condition(a.filter))
            else:
                tags = index.tag(docs, literals, condition=_condition(a.filter))
            table.stage(index.merge_into(docs, tags))
        elif c == "rehash":
            table.stage(index.apply_rehash(docs, a.pattern, a.replacement))
        else:
            query = [x for x in a.what if ":" in x]
            ids = [x for x in a.what if ":" not in x]
            condition = None
            for q in query:
                field, _, value = q.partition(":")
                one = F.col(field).isNotNull() if value == "*" else F.col(field) == value
                condition = one if condition is None else condition | one
            table.stage(index.delete(docs) if not a.what else index.delete(docs, condition, ids) if condition is not None else index.delete(docs, ids=ids))
        table.commit() if not a.no_commit else print(f"staged {table.pending}")
    elif c in ("commit", "rollback"):
        table = IndexTable(spark, a.index)
        table.pending = a.version
        print(table.commit() if c == "commit" else table.rollback())
    elif c == "inspect-dump":
        from .functions.text import preview, preview_list

        df = spark.read.parquet(a.file)
        shown = [preview(F.col(n)).alias(n) if t == "string" else preview_list(F.col(n)).alias(n) if t == "array<string>" else F.col(n) for n, t in df.dtypes]
        for r in df.select(*shown).toLocalIterator():
            print(r.asDict())
    elif c == "spew-dump":
        IndexTable(spark, a.index).write_trees(spark.read.parquet(a.file).drop("sink_error"))
    elif c == "version":
        print(VERSION)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__.split("\n")[0])
    p.add_argument("--options", help="file of name=value lines")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for n in names:
            s.add_argument(n)
        return s

    q = command("queue", "--queue")
    q.add_argument("paths", nargs="+")
    q.add_argument("--include", action="append", default=[])
    q.add_argument("--exclude", action="append", default=[])
    for flag in ("--ignore-hidden", "--include-system", "--follow-links"):
        q.add_argument(flag, action="store_true")
    q.add_argument("--max-depth", type=int)
    command("load-queue", "file", "--queue").add_argument("--field", default="path")
    command("dump-queue", "--queue", "--out")
    command("wipe-queue", "--queue")
    command("load-report", "file", "--reports")
    command("dump-report", "--reports", "--status", "--out")
    command("view-report", "--reports").add_argument("paths", nargs="+")
    command("wipe-report", "--reports")
    command("clean-report", "--reports").add_argument("paths", nargs="+")
    s = command("spew", "--queue", "--reports", "--to")
    s.add_argument("paths", nargs="*")
    s.add_argument("--sink", choices=list(SINKS), default="stdout")
    s.add_argument("--embeds", choices=("spawn", "concatenate", "ignore"), default="spawn")
    s.add_argument("--output-format", choices=("text", "html"), default="text")
    s.add_argument("--algorithm", default="sha256")
    s.add_argument("--project", default="")
    s.add_argument("--max-embed-depth", type=int, default=20)
    s.add_argument("--max-embed-bytes", type=int, default=0)
    s.add_argument("--parse-timeout", type=float, default=86_400, help="seconds for each file; 0 is no limit")
    s.add_argument("--certificate", help="PEM file with the only certificate that the server may have")
    s.add_argument("--verify-host", help="name that the server's certificate must be made out to")
    for name in ("copy", "tag", "rehash", "delete"):
        s = command(name, "--index", "--filter")
        s.add_argument("--no-commit", action="store_true")
        if name == "copy":
            s.add_argument("fields", nargs="+")
        elif name == "tag":
            s.add_argument("literals", nargs="+")
            s.add_argument("--other")
            s.add_argument("--subset", choices=("intersection", "complement"), default="intersection")
        elif name == "rehash":
            s.add_argument("pattern")
            s.add_argument("replacement")
        else:
            s.add_argument("what", nargs="*")
    command("commit", "--index", "version")
    command("rollback", "--index", "version")
    command("inspect-dump", "file")
    command("spew-dump", "file", "--index")
    command("version")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    argv = list(sys.argv[1:] if argv is None else argv)
    if "--options" in argv:
        at = argv.index("--options")
        given = {x.split("=")[0] for x in argv if x.startswith("--")}
        with open(argv[at + 1], encoding="utf-8") as f:
            lines = [x.strip() for x in f if "=" in x and not x.startswith("#")]
        argv[at : at + 2] = []
        argv += [w for x in lines for w in [f"--{x.partition('=')[0].strip()}", x.partition("=")[2].strip()] if f"--{x.partition('=')[0].strip()}" not in given]
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        return run(spark or session(), a)
    except (ValueError, OSError) as e:
        print(f"quire: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # the JVM's own errors
        print(f"quire: {e}", file=sys.stderr)
        return 70 if "OutOfMemoryError" in str(e) or "Py4JNetworkError" in type(e).__name__ else 1


if __name__ == "__main__":
    sys.exit(main())
