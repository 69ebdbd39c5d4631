"""EPUB containers as tables: documents in reading order, style sheets, and the diagnosis of protection.

Containers are read by Spark as binary files; a task opens one at a time and gives a row for each member.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "epub string, spine int, href string, media_type string, content binary, protected boolean, reason string, obfuscated_fonts int"
# What is a document, what is a font, and the two algorithms that only obfuscate fonts.
DOCUMENT_TYPES = ("application/xhtml+xml", "text/html")
DOCUMENT_NAMES = (".xhtml", ".html", ".htm")
FONT_NAMES = (".ttf", ".otf", ".woff", ".woff2", ".ttc")
FONT_ALGORITHMS = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")


def _local(tree, name: str):
    return [e for e in tree.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]


class Container:
    """One EPUB: names without regard to case, and its package."""

    def __init__(self, content):
        """From bytes, or from a file that can seek, of which only the members asked for are read."""
        self.zip = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
        self.names = {n.lower(): n for n in reversed(self.zip.namelist())}

    def read(self, name: str) -> bytes:
        return self.zip.read(self.names[name.lower()])

    def has(self, name: str) -> bool:
        return name.lower() in self.names

    def protection(self) -> tuple[bool, str, int]:
        """Whether it is protected, why, and how many fonts are obfuscated, which isn't protection."""
        for name in ("META-INF/rights.xml", "META-INF/license.lcpl"):
            if self.has(name):
                return True, name, 0
        fonts = 0
        if self.has("META-INF/encryption.xml"):
            for entry in _local(ElementTree.fromstring(self.read("META-INF/encryption.xml")), "EncryptedData"):
                how = [e.get("Algorithm", "") for e in _local(entry, "EncryptionMethod")]
                what = [unquote(e.get("URI", "")) for e in _local(entry, "CipherReference")]
                if how and what and all(h in FONT_ALGORITHMS for h in how) and all(w.lower().endswith(FONT_NAMES) for w in what):
                    fonts += 1
                else:
                    return True, f"encrypted: {', '.join(what) or 'unknown'}", fonts
        return False, "", fonts

    def manifest(self) -> tuple[dict[str, tuple[str, str]], list[str]]:
        """Items by id as (name, media type), and the ids of the spine."""
        package = next(e.get("full-path") for e in _local(ElementTree.fromstring(self.read("META-INF/container.xml")), "rootfile"))
        tree, base = ElementTree.fromstring(self.read(package)), posixpath.dirname(package)
        items = {e.get("id"): (posixpath.normpath(posixpath.join(base, unquote(e.get("href", "")))), e.get("media-type", "")) for e in _local(tree, "item")}
        return items, [e.get("idref") for e in _local(tree, "itemref")]


def member_rows(epub: str, content, wanted: Callable[[tuple], bool] = lambda row: True) -> Iterator[tuple]:
    """A row for the container (spine -1), one for each spine document in order, one for each style sheet (spine null).

    wanted says of a row without content whether it is; what isn't wanted is not read.
    """
    try:
        own = Container(content)
        protected, reason, fonts = own.protection()
        items, spine = ({}, []) if protected else own.manifest()
    except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, pa.ArrowInvalid) as x:
        rows = [(epub, -1, "", "", None, None, f"not an EPUB: {x}"[:200], 0)]
        yield from filter(wanted, rows)
        return
    yield from filter(wanted, [(epub, -1, "", "", None, protected, reason, fonts)])
    place = 0
    for ref in spine:
        name, kind = items.get(ref, ("", ""))
        if name and (kind in DOCUMENT_TYPES or name.lower().endswith(DOCUMENT_NAMES)) and own.has(name):
            if wanted((epub, place, name, kind, None, False, "", fonts)):
                yield epub, place, name, kind, own.read(name), False, "", fonts
            place += 1
    for name, kind in items.values():
        if kind == "text/css" and own.has(name) and wanted((epub, None, name, kind, None, False, "", fonts)):
            yield epub, None, name, kind, own.read(name), False, "", fonts


def members(epub: str, content: bytes) -> list[tuple]:
    return list(member_rows(epub, content))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All members of the containers under path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            for p, c in zip(frame["path"], frame["content"]):
                out = pd.DataFrame(members(p, bytes(c)), columns=[f.split()[0] for f in MEMBERS.split(", ")])
                yield out.astype({"spine": "Int32", "obfuscated_fonts": "int32"})

    return files.mapInPandas(run, MEMBERS)


def documents(members_: DataFrame) -> DataFrame:
    """Documents in reading order; a protected or unreadable container is an error, before anything else is done."""
    fault = F.when(F.col("protected") | F.col("protected").isNull(), F.raise_error(F.concat(F.col("epub"), F.lit(": "), F.col("reason"))))
    checked = members_.withColumn("_ok", F.when(fault.isNull(), True))
    return checked.where(F.col("_ok") & (F.col("spine") >= 0)).select("epub", "spine", "href", "media_type", "content")


def diagnosis(members_: DataFrame) -> DataFrame:
    return members_.where("spine = -1").select("epub", "protected", "reason", "obfuscated_fonts")


def style_sheets(members_: DataFrame) -> DataFrame:
    return members_.where("spine IS NULL").select("epub", "href", F.decode("content", "UTF-8").alias("css"))


def top_margins(sheets: DataFrame, least: float = 0.3) -> DataFrame:
    """(epub, class_name, em): the greatest top margin or padding of each class in simple rules, from `least` em on."""
    bare = F.regexp_replace("css", r"(?s)/\*.*?\*/", "")
    rules = sheets.select("epub", F.explode(F.regexp_extract_all(bare, F.lit(r"([^{}@;]+\{[^{}]*\})"), F.lit(1))).alias("rule"))
    body = F.regexp_extract("rule", r"\{([^{}]*)\}", 1)
    said = F.explode(F.regexp_extract_all(body, F.lit(r"((?:margin|padding)(?:-top)?\s*:\s*-?[\d.]+(?:em|rem|px|pt|%)?)"), F.lit(1))).alias("said")
    rows = rules.select("epub", F.explode(F.split(F.trim(F.regexp_extract("rule", r"^([^{]+)\{", 1)), r"\s*,\s*")).alias("selector"), "rule")
    rows = rows.select("epub", "selector", said)
    number = F.expr("try_cast(regexp_extract(said, '(-?[0-9.]+)', 1) AS double)")
    unit = F.regexp_extract("said", r"(em|rem|px|pt|%)$", 1)
    em = F.when(unit.isin("em", "rem"), number).when(unit == "px", number / 16).when(unit == "pt", number / 12).otherwise(0.0)
    rows = rows.where(F.col("selector").rlike(r"^[\w-]*\.[\w-]+$")).select("epub", F.regexp_extract("selector", r"\.([\w-]+)$", 1).alias("class_name"), em.alias("em"))
    return rows.groupBy("epub", "class_name").agg(F.max("em").alias("em")).where(F.col("em") >= least)
