"""Record sources: JSON, CSV, spreadsheets, zip archives, folders and manifest-described packages.

Every reader gives rows of ``row_index`` (from 1, in file order) and ``record``, a map of strings; nested JSON values are
JSON text. Files are read by Spark, whole file by whole file, so a package of many files is read in parallel; a single
file is bounded by what one task can hold. Large flat files belong in Spark's own readers (``flat_csv``, ``json_lines``).
"""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.csvscan import cells_of

ROWS = "path string, row_index long, record map<string,string>"
KINDS = {".json": "json", ".csv": "csv", ".tsv": "tsv", ".xlsx": "xlsx"}


class SourceError(ValueError):
    """A file that can't be read as records."""


def _text(value) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def json_records(text: str) -> list[dict]:
    """An array of objects, an object with ``rows``, or a single object."""
    value = json.loads(text.removeprefix("﻿"))
    if isinstance(value, dict):
        value = value["rows"] if isinstance(value.get("rows"), list) else [value]
    if not isinstance(value, list) or not all(isinstance(r, dict) for r in value):
        raise SourceError("rows must be objects")
    return [{k: _text(v) for k, v in r.items()} for r in value]


def csv_records(text: str, separator: str = ",") -> list[dict]:
    """Header row, quoted parts over several lines, short rows padded, blank rows dropped; of equal headers the last wins. In
    CSV a quote turns quoting on and off wherever it stands; in TSV it is a character like any other."""
    body = text.removeprefix("\ufeff")
    if separator == ",":
        try:
            lines = cells_of(body)
        except ValueError as e:
            raise SourceError(str(e)) from None
    else:
        lines = list(csv.reader(io.StringIO(body, newline=""), delimiter=separator, quoting=csv.QUOTE_NONE))
    lines = [line for line in lines if any(c.strip() for c in line)]
    if not lines:
        return []
    heads = [h.strip() for h in lines[0]]
    return [dict(zip(heads, line + [""] * (len(heads) - len(line)))) for line in lines[1:]]


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_records(data: bytes) -> list[dict]:
    """The first worksheet: first row as header, blank headers and empty rows dropped, all cells as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        first = ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS).get(_REL)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheet = ElementTree.fromstring(z.read(posixpath.normpath(posixpath.join("xl", targets[first].lstrip("/").removeprefix("xl/")))))
    grid = []
    for row in sheet.iter(f"{{{_NS['m']}}}row"):
        cells: dict[int, str] = {}
        for at, c in enumerate(row.findall("m:c", _NS)):
            value, inline = c.find("m:v", _NS), c.find("m:is", _NS)
            text = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t")) if inline is not None else "" if value is None else value.text or ""
            kind = c.get("t")
            cells[_column(c.get("r")) if c.get("r") else at] = shared[int(text)] if kind == "s" and text else {"1": "true", "0": "false"}.get(text, text) if kind == "b" else text
        grid.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    grid = [g for g in grid if any(g)]
    if not grid:
        return []
    heads = [h.strip() for h in grid[0]]
    return [{h: c for h, c in zip(heads, g + [""] * (len(heads) - len(g))) if h} for g in grid[1:]]


def parse(path: str, data: bytes) -> list[dict]:
    kind = KINDS.get(posixpath.splitext(path.lower())[1])
    if kind == "xlsx":
        return xlsx_records(data)
    if kind is None:
        raise SourceError(f"{path} holds no records")
    text = data.decode("utf-8")
    return json_records(text) if kind == "json" else csv_records(text, "," if kind == "csv" else "\t")


def members(path: str, data: bytes) -> list[tuple[str, bytes]]:
    """The files of a zip archive by normalized name; of another file itself."""
    if not path.lower().endswith(".zip"):
        return [(path, data)]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(f"{path}!{posixpath.normpath(n.replace(chr(92), '/'))}", z.read(n)) for n in z.namelist() if not n.endswith("/")]


def _read(pick) -> object:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                for name, data in members(path, bytes(content)):
                    if pick is None or pick(name):
                        rows = parse(name, data)
                        yield pd.DataFrame({"path": [name] * len(rows), "row_index": range(1, len(rows) + 1), "record": rows})

    return run


def read_records(spark: SparkSession, path: str, *, suffixes: list[str] | None = None) -> DataFrame:
    """Records of a file, a folder (recursively) or a zip archive; with ``suffixes``, of the files that end so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    wanted = tuple(suffixes) if suffixes else tuple(KINDS)
    return files.mapInPandas(_read(lambda n: n.lower().endswith(tuple(w.lower() for w in wanted))), ROWS)


def flat_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A large flat CSV by Spark's splittable reader, as text columns, short rows padded and blank rows dropped."""
    df = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', inferSchema=False, mode="PERMISSIVE")
    padded = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in df.columns))
    return padded.where(F.concat_ws("", *(f"`{c}`" for c in padded.columns)) != "")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON Lines file; order by file and position."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", "map<string,string>").alias("record"), F.monotonically_increasing_id().alias("row_index"))


# Where packages without a manifest keep their rows and search terms, and the types staged as they are.
KNOWN_ROWS = [
    "json/knowledge_items_import.json", "json/knowledge_items_import_curated.json", "json/knowledge_items_import_full_clean.json",
    "json/classic_passages_curated.json", "json/classic_passages_full_clean.json",
    "csv/knowledge_items_import.csv", "csv/knowledge_items_import_curated.csv", "csv/knowledge_items_import_full_clean.csv",
    "csv/classic_passages_curated.csv", "csv/classic_passages_full_clean.csv",
]
KNOWN_TERMS = ["json/search_terms_curated.json", "json/search_terms.json", "csv/search_terms_curated.csv", "csv/search_terms.csv"]
DIRECT = {"knowledge_items_v1", "classic_passages_v1", "annotation_items_v1", "search_terms_v1", "standard_terms_v1", "relation_suggestions_v1"}
MANIFESTS = ["import_manifest.json", "import_manifest.example.json"]


def _listing(spark: SparkSession, path: str) -> list[str]:
    """Names of a package's files, relative to it. A package's file list is small; its contents stay with Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if not path.lower().endswith(".zip"):
        root = path.rstrip("/").split(":", 1)[-1].lstrip("/")
        return sorted(r[0].split(root, 1)[-1].lstrip("/") for r in files.select("path").collect())

    def names(frames):
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"]):
                yield pd.DataFrame({"name": [n.split("!", 1)[1] for n, _ in members(p, bytes(c))]})

    return sorted(r[0] for r in files.select("path", "content").mapInPandas(names, "name string").collect())


def _bytes(spark: SparkSession, path: str, name: str) -> bytes:
    if path.lower().endswith(".zip"):
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        return next(d for n, d in members(path, data) if n.endswith(name))
    return bytes(spark.read.format("binaryFile").load(f"{path.rstrip('/')}/{name}").first()["content"])


def read_package(spark: SparkSession, path: str) -> dict:
    """A package: ``rows`` of its primary files in manifest order, ``terms`` of its search-term files or None, and
    ``files``: for each listed file path, type, staged and skip_reason. Without a manifest well-known paths are tried."""
    names = _listing(spark, path)

    def have(name):
        return next((n for n in names if n == name or n.endswith("/" + name)), None)

    manifest_name = next((found for m in MANIFESTS if (found := have(m))), None)
    rows = terms = None
    report = []
    if manifest_name:
        manifest = json.loads(_bytes(spark, path, manifest_name).decode("utf-8-sig"))
        order = {t: i for i, t in enumerate(manifest.get("import_order") or [])}
        listed = sorted(manifest.get("files") or [], key=lambda f: order.get(f.get("target"), len(order)))
    else:
        found = next((n for k in KNOWN_ROWS if (n := have(k))), None)
        if found is None:
            raise SourceError("the package has neither a manifest nor a known file of records")
        listed = [{"path": found, "type": "knowledge_items_v1", "primary": True, "auto_stage": True}]
        listed += [{"path": n, "type": "search_terms_v1"} for k in KNOWN_TERMS if (n := have(k))][:1]
    for f in listed:
        name = have(f["path"])
        if name is None:
            if f.get("required", True):
                raise SourceError(f"{f['path']} is missing")
            report.append({"path": f["path"], "type": f.get("type"), "staged": False, "skip_reason": "missing"})
            continue
        primary = f.get("primary", False) and f.get("auto_stage", True) and f.get("type") in DIRECT
        is_terms = f.get("type") == "search_terms_v1" and not primary
        if primary or is_terms:
            at = path if path.lower().endswith(".zip") else f"{path.rstrip('/')}/{name}"
            part = read_records(spark, at, suffixes=[name])
            if is_terms:
                terms = part if terms is None else terms.unionByName(part)
            else:
                part = part.withColumn("file_no", F.lit(len(report)))
                rows = part if rows is None else rows.unionByName(part)
        reason = None if primary else "attached to rows" if is_terms else "not a primary file"
        report.append({"path": f["path"], "type": f.get("type"), "staged": primary, "skip_reason": reason})
    if rows is None:
        raise SourceError("the package has no primary file to stage")
    return {"rows": rows, "terms": terms, "files": report}


def write_package(spark: SparkSession, root: str, files: dict[str, tuple[DataFrame, str]]) -> None:
    """A package folder: a CSV file for each path of ``files``, with its rows and type, and a manifest that lists them, the
    first as primary. A package's file is one file, written by one task."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = []
    for k, (name, (df, kind)) in enumerate(files.items()):
        made = f"{root}/.made-{k}"
        df.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(made)
        part = next(s.getPath() for s in fs.listStatus(path(made)) if s.getPath().getName().startswith("part-"))
        fs.mkdirs(path(f"{root}/{name}").getParent())
        fs.rename(part, path(f"{root}/{name}"))
        fs.delete(path(made), True)
        listed.append({"path": name, "type": kind, "primary": k == 0, "auto_stage": k == 0})
    out = fs.create(path(f"{root}/{MANIFESTS[0]}"), False)
    out.write(bytearray(json.dumps({"files": listed}, ensure_ascii=False).encode()))
    out.close()


def attach_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows with ``package_terms``: the search terms that name the row's code or name, once each, weights within 1 and 200."""
    from quernstone.functions import text as T
    from quernstone.functions import values as V

    def get(*names):
        return V.first_text(F.col("record"), *names)

    weight = V.clamp(F.coalesce(V.lenient_long(get("weight")), F.lit(80)), 1, 200)
    plain = terms.select(
        F.array(get("item_code"), get("item_name")).alias("keys"), get("term").alias("term"),
        F.concat(F.lit("package_"), F.coalesce(get("term_type"), F.lit("imported_package"))).alias("term_type"), weight.alias("weight"),
    ).where("term is not null")
    told = plain.select(F.explode("keys").alias("key"), "term", "term_type", "weight").where("key is not null").select("key", F.struct("term", "term_type", "weight").alias("t"))
    keys = rows.select("path", "row_index", F.explode(F.array_distinct(F.array(T.blank_to_null(F.try_element_at("record", F.lit("code"))), T.blank_to_null(F.try_element_at("record", F.lit("name")))))).alias("key"))
    found = keys.join(told, "key").groupBy("path", "row_index").agg(F.array_sort(F.collect_set("t")).alias("package_terms"))
    return rows.join(found, ["path", "row_index"], "left")
