"""Workbooks (.xlsx): read as cells by sheet, written from DataFrames, a sheet each.

Reading: files come through Spark's binary source, so any store will do; a first step lists each file's sheets, and the sheets, not the
files, are then dealt to tasks, which read their XML as a stream. Writing: rows become XML where they are, and each
sheet's parts are written beside the target; they are then put together in order, as a stream of bounded pieces, into a file of
another name, which is renamed at the end. So a reader sees a whole workbook or none, and a lost executor costs a part.

Defined cases: a file that isn't a whole workbook is refused (``ValueError``); empty cells are null; numbers, booleans and shared or own texts
are read as text; a sheet without rows has none; nulls are written as empty cells, lists are written as text, joined by a semicolon;
characters that XML can't hold are left out; a sheet has at most ``MOST_ROWS`` rows, and more are refused.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATED = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
#: What XML 1.0 has no place for.
_NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
CHUNK = 1 << 20


# ---- reading ----


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("not a whole workbook") from e


def _sheets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            book = _open(bytes(content))
            try:
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                listed = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
                shared = book.read("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in book.namelist() else b""
                for place, s in enumerate(listed):
                    target = targets[s.get(f"{{{_RELATED}}}id")]
                    member = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                    yield pd.DataFrame({"path": [path], "sheet": [s.get("name")], "place": [place], "hidden": [s.get("state", "visible") != "visible"], "xml": [book.read(member)], "shared": [shared]})
            except (KeyError, ElementTree.ParseError) as e:
                raise ValueError(f"{path} is not a whole workbook") from e


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _texts(shared: bytes) -> list[str]:
    return ["".join(t.text or "" for t in s.iter(f"{{{_MAIN}}}t")) for s in ElementTree.fromstring(shared)] if shared else []


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, sheet, place, hidden, xml, shared in pdf[["path", "sheet", "place", "hidden", "xml", "shared"]].itertuples(index=False):
            texts, out, number = _texts(bytes(shared)), [], 0
            for _, row in ElementTree.iterparse(io.BytesIO(bytes(xml))):
                if row.tag != f"{{{_MAIN}}}row":
                    continue
                number = int(row.get("r", number + 1))
                cells: list[str | None] = []
                for c in row:
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    value, kind = c.find(f"{{{_MAIN}}}v"), c.get("t")
                    if kind == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_MAIN}}}t"))
                    elif value is not None and value.text is not None:
                        cells[at] = texts[int(value.text)] if kind == "s" else {"1": "true", "0": "false"}[value.text] if kind == "b" else value.text
                out.append((path, sheet, place, hidden, number, cells))
                row.clear()
                if len(out) == 4096:
                    yield pd.DataFrame(out, columns=["path", "sheet", "place", "hidden", "row_no", "cells"])
                    out = []
            yield pd.DataFrame(out, columns=["path", "sheet", "place", "hidden", "row_no", "cells"])


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, place, hidden, row_no, cells): the rows of all sheets of the workbooks at ``path``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    sheets = files.mapInPandas(_sheets, "path string, sheet string, place int, hidden boolean, xml binary, shared binary")
    return sheets.repartition("path", "sheet").mapInPandas(_rows, "path string, sheet string, place int, hidden boolean, row_no long, cells array<string>")


def sheet(spark: SparkSession, path: str, name: str, header: int = 1) -> DataFrame:
    """One sheet as a table of texts: the columns that row ``header`` names; rows after it, in no order."""
    mine = cells(spark, path).where(F.col("sheet") == name)
    head = mine.where(F.col("row_no") == header).select("cells").first()
    if head is None:
        raise ValueError(f"no sheet {name} with a row {header}")
    names = [(i, c) for i, c in enumerate(head["cells"]) if c]
    return mine.where(F.col("row_no") > header).select(*[F.get("cells", F.lit(i)).alias(c) for i, c in names])


# ---- writing ----


def _xml_rows(df: DataFrame) -> DataFrame:
    """(value): a row's XML."""

    def cell(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            number = F.when(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(None)).otherwise(c.cast("string"))
            return F.coalesce(F.concat(F.lit("<c><v>"), number, F.lit("</v></c>")), F.lit("<c/>"))
        if kind == "boolean":
            return F.coalesce(F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>")), F.lit("<c/>"))
        text = F.array_join(c, "; ") if kind.startswith("array<string") else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c.cast("string")
        # Line breaks are written by number, so that a row stays one line of its part.
        clean = F.regexp_replace(text, _NO_XML, "")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;")):
            clean = F.replace(clean, F.lit(a), F.lit(b))
        return F.coalesce(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), clean, F.lit("</t></is></c>")), F.lit("<c/>"))

    return df.select(F.concat(F.lit("<row>"), *[cell(n, k) for n, k in df.dtypes], F.lit("</row>")).alias("value"))


def _head_row(names: list[str]) -> str:
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(n)}</t></is></c>' for n in names) + "</row>"


class _Sink(io.RawIOBase):
    """A stream of the shared store as a file to write to."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytearray(data))
        return len(data)


def _bytes_of(fs, part) -> Iterator[bytes]:
    stream, left = fs.open(part), fs.getFileStatus(part).getLen()
    try:
        while left > 0:
            piece = bytes(stream.readNBytes(min(CHUNK, left)))
            left -= len(piece)
            yield piece
    finally:
        stream.close()


def write(sheets: dict[str, DataFrame], path: str, hidden=(), overwrite: bool = False) -> None:
    """The DataFrames as sheets of one workbook at ``path``, in order; rows in the order of their DataFrame. ``hidden`` names
    sheets that aren't shown. A workbook that is there is refused unless ``overwrite``."""
    if not sheets or len({n.lower() for n in sheets}) < len(sheets) or any(not 0 < len(n) <= 31 or re.search(r"[\[\]:*?/\\]", n) for n in sheets):
        raise ValueError("sheets need names of up to 31 characters, each another, without []:*?/\\")
    spark = next(iter(sheets.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target = place(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not overwrite:
        raise ValueError(f"{path} is there")
    work = f"{path}.writing-{uuid.uuid4().hex}"
    try:
        for k, df in enumerate(sheets.values()):
            _xml_rows(df).write.text(f"{work}/{k}")
            if spark.read.text(f"{work}/{k}").count() >= MOST_ROWS:
                raise ValueError(f"a sheet has at most {MOST_ROWS} rows")
        whole = place(f"{work}/book")
        out = fs.create(whole, True)
        with zipfile.ZipFile(io.BufferedWriter(_Sink(out), CHUNK), "w", zipfile.ZIP_DEFLATED) as book:
            numbers = range(1, len(sheets) + 1)
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in numbers)
            book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_TYPES}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
            book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_RELATED}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}"{" state=" + quoteattr("hidden") if name in hidden else ""} r:id="rId{n}"/>' for n, name in zip(numbers, sheets, strict=True))
            book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_RELATED}"><sheets>{listed}</sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="rId{n}" Type="{_RELATED}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers) + "</Relationships>")
            for n, df in zip(numbers, sheets.values(), strict=True):
                with book.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as member:
                    member.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{_head_row(df.columns)}'.encode())
                    for status in sorted(fs.listStatus(place(f"{work}/{n - 1}")), key=lambda s: s.getPath().getName()):
                        if status.getPath().getName().startswith("part-"):
                            for piece in _bytes_of(fs, status.getPath()):
                                member.write(piece)
                    member.write(b"</sheetData></worksheet>")
        out.close()
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(whole, target):
            raise OSError(f"could not move the workbook to {path}")
    finally:
        fs.delete(place(work), True)


# ---- the workbook of a run ----

# Columns of the summary, in order.
SUMMARY = (
    "Compound Name", "CASRN", "Source", "Conc_Float", "Original SMILES", "Standardized SMILES", "InChIKey", "InChI", "Detected Feature Profile", "Primary Functional Group", "Secondary Functional Groups",
    "Taxonomy Path", "Taxonomy Hierarchy", "MW", "LogP", "TPSA", "Ionisation_Indicator", "Toxicophore_Profile", "All_Structural_Alerts", "Alerts", "Cluster ID", "Cluster Size", "Uncertainty_Summary", "Cluster_Class_Reasons",
)
# Columns of the detailed analysis, in order. A product's own structural class has its name in front, which is a parameter.
DETAILED = (
    "Compound Name", "CASRN", "Concentration", "Source", "Cleaned Compound Name", "Conc_Float", "Resolved Name", "Identity Status", "Original SMILES", "Standardized SMILES", "InChIKey", "InChI",
    "Classification Input Source", "Classification Structure SMILES", "Classification Standardization Version", "Classification Stereochemistry Status", "Structural_Evidence_Status", "Structural_Evidence_Version",
    "Chemical Class", "Corrected Chemical Class", "Structural Class", "Final Classification Record", "Classification Status", "Classification Rule ID", "Classification Rule Version", "Classification Scope",
    "Classification Review Recommended", "Classification Review Recommendation", "Classification Suggested Action", "Manual Review Flag", "Manual Review Reason", "Detected Feature Profile", "Confidence", "Tanimoto Analogs Found",
    "Primary Functional Group", "Secondary Functional Groups", "Secondary Functional Groups Basis", "Taxonomy Path", "Taxonomy Path Steps", "Matched Categories", "Direct Parent", "Taxonomy Dictionary Version", "Taxonomy Hierarchy",
    "Topology Profile", "MW", "LogP", "TPSA", "Min_EState", "Max_EState", "HBD", "HBA", "Rotatable_Bonds", "Formal_Charge", "Ring_Count", "Aromatic_Ring_Count", "Fraction_CSP3", "Heavy_Atom_Count", "Molecular_Refractivity",
    "Ionisation_Indicator", "Toxicophore_Profile", "All_Structural_Alerts", "Alerts", "Scaffold", "Cluster ID", "Compatibility Group", "Cluster Size", "Cluster Unique Structure Count", "Cluster_Status", "Domain", "Decision",
    "Compatibility Gate", "Compatibility Gate Reason", "Cluster Property Compatibility", "Cluster Property Compatibility Reason", "Duplicate Structure Count", "Identity Structure Consistency", "Identity Structure Consistency Reason",
    "Domain_Status", "Domain_Reasons", "Domain_Rule_Version", "Nearest_Neighbour_Tanimoto", "Cluster_Min_Pairwise_Tanimoto", "Cluster_Median_Pairwise_Tanimoto", "Cluster_Scaffold_Coverage", "Cluster_Representative_Scaffold",
    "Property_Outlier_Flags", "Ionisation_Consistency", "Toxicophore_Consistency", "Uncertainty_Summary", "Uncertainty_Rule_Version", "Cluster_Reasoning_Status", "Cluster_Nearest_Members", "Cluster_Nearest_Tanimoto",
    "Cluster_Consensus_Method", "Cluster_Membership_Parameters", "Cluster_Membership_Rationale", "SME_Review_Boundary", "Cluster_Reasoning_Rule_Version", "XAI_Status", "AI_Cluster_Reasoning", "AI_Evidence_Fields", "AI_Input_Hash",
    "AI_Prompt_Version", "AI_Response_Timestamp", "AI_Validation_Status", "AI_Response_Hash", "Classification Rationale", "Ontology Mapping Status", "Ontology Mapping Version", "Ontology Mapping Evidence", "Local Taxonomy Match Status",
    "Local Taxonomy Record ID", "Reference Taxonomy Path", "Local Taxonomy Reference",
)
# Names of the sheets in their order.
SHEETS = (
    "Workbook Guide", "Dashboard", "Workbook Contract", "Raw Data", "Summary", "Cluster Summary", "Detailed Analysis", "Uncertainty Register", "Cluster Evidence Matrix", "ChemOnt Classification", "Endpoint Evidence Ledger",
    "Clustering Policy", "Class Layer Policy", "Descriptor Layer Policy", "Topology Layer Policy", "Ionisation Layer Policy", "Toxicophore Layer Policy", "ChemOnt Layer Policy", "Distance Layer Metadata", "Structure Classification Audit",
)
#: Sheets that are there to be checked, not read.
HIDDEN = tuple(s for s in SHEETS if s.endswith("Policy") or s == "Distance Layer Metadata")


def view(df: DataFrame, columns, names: dict[str, str] | None = None) -> DataFrame:
    """The ``columns`` in their order, blank where ``df`` has none; ``names`` gives a column another name in the sheet."""
    blank = F.lit("")
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else blank).alias((names or {}).get(c, c)) for c in columns])


def assemble(compounds: DataFrame, others: dict[str, DataFrame], structural_class: str = "Structural Class") -> dict[str, DataFrame]:
    """The sheets of a run in their order: the two views of its compounds, and those of ``others`` that there are."""
    unknown = set(others) - set(SHEETS)
    if unknown:
        raise ValueError(f"no such sheets: {sorted(unknown)}")
    made = {**others, "Summary": view(compounds, SUMMARY), "Detailed Analysis": view(compounds, DETAILED, {"Structural Class": structural_class})}
    return {s: made[s] for s in SHEETS if s in made}
