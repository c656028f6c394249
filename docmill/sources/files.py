"""Files in and out: corpus folders, text formats, validation, sheets as CSV, Markdown tables, output names."""

from __future__ import annotations

import csv
import io
import struct
import zipfile

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.text import bound, strip
from docmill.operators.batches import category_of
from docmill.operators.ranks import ranked

IGNORED = (".git", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".idea", ".vscode")
MAGIC = (
    ("jpeg", "^FFD8FF"), ("png", "^89504E470D0A1A0A"), ("gif", "^474946383[79]61"), ("bmp", "^424D"), ("tiff", "^(49492A00|4D4D002A)"), ("webp", "^52494646.{8}57454250"), ("heic", "^.{8}66747970(68656963|68656978|6D696631)"),
    ("pdf", "^25504446"), ("rtf", "^7B5C727466"), ("ole", "^D0CF11E0A1B11AE1"), ("zip", "^504B0304"),
)
SAME = {"jpg": "jpeg", "tif": "tiff", "heif": "heic", "markdown": "md"}


def read_corpus(spark: SparkSession, folder: str, detected: bool = False) -> DataFrame:
    """``path, length, modificationTime, content`` of supported files below a folder, ignored folders left out. A caller who needs the order sorts by ``lower(path)``.

    Supported is told by the extension, or with ``detected`` by :func:`detect_format`, whose result is then a column ``detected``:
    a file of another name than its content counts by its content. No shuffle; a file is one row. The binary source leaves out files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # Only folders below the given one count, which may lie anywhere.
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().getPath().rstrip("/")
    local = F.regexp_replace("path", r"^[\w+.\-]+:(?://[^/]*)?", "")
    below = F.when(local.startswith(top + "/"), F.substring(local, len(top) + 1, 1 << 30)).otherwise(local)
    ignored = "/(?:" + "|".join(n.replace(".", r"\.") for n in IGNORED) + ")/"
    files = files.filter(~below.rlike(ignored))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    if not detected:
        return files.filter(category_of(ext) != "unknown")
    return files.withColumn("detected", detect_format(F.col("content"), ext)).filter(category_of(F.col("detected")) != "unknown")


def magic_format(content: Column) -> Column:
    """Format by the first bytes; null for other files."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MAGIC):
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def _columns_by(separator: str):
    return lambda line: F.size(F.split(line, "\\Q" + separator + "\\E", -1))


def detect_text_format(text: Column, ext: Column) -> Column:
    """``md``, ``csv`` or ``txt`` by the first 50 lines: Markdown signs first, then a constant number of separated columns."""
    lines = F.slice(F.split(text, "\r\n|\r|\n", 51), F.lit(1), F.lit(50))
    some = F.filter(lines, lambda x: strip(x) != "")
    fences = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*```")))
    md = (
        text.rlike(r"\A---\s*\n(?s).*?\n---")
        | F.exists(lines, lambda x: x.rlike(r"^#{1,6}\s+\S") | x.rlike(r"^\s*\|?[\s:]*-{3,}[\s:]*(\|[\s:]*-{3,}[\s:]*)+\|?\s*$") | x.rlike(r"\[\[[^\]]+\]\]") | x.rlike(r"\[[^\]]+\]\([^)]+\)"))
        | (fences >= 2)
    )
    least = F.when(F.lower(ext) == "csv", 2).otherwise(3)
    table = F.lit(False)
    for d in (",", "\t", ";", "|"):
        counts = F.transform(some, _columns_by(d))
        table = table | ((F.size(some) >= 2) & (F.size(F.array_distinct(counts)) == 1) & (F.get(counts, F.lit(0)) >= least))
    return F.when(md, "md").when(table, "csv").otherwise("txt")


#: Bytes of a file that the text test reads.
SAMPLE = 8192


def detect_file_format(content: Column, ext: Column) -> Column:
    """Format by the first bytes, else by text; null for other binary files. An empty file is text.

    Text has at most 10 % NUL, is UTF-8 or has the byte pattern of GBK, and over 85 % of its characters are printable or white space.
    A character that the end of the sample cuts doesn't count. GBK characters stand as ``x``, since only ASCII signs matter for the format.
    """
    # One character for each byte; characters of several bytes are looked at below.
    sample = F.decode(F.substring(content, 1, SAMPLE), "ISO-8859-1")
    cut = F.when(F.length(content) > SAMPLE, F.regexp_replace(sample, r"[\xc0-\xf7][\x80-\xbf]{0,2}\z", "")).otherwise(sample)
    pairs = F.regexp_replace(sample, r"[\x81-\xfe][\x40-\x7e\x80-\xfe]", "x")
    pairs = F.when(F.length(content) > SAMPLE, F.regexp_replace(pairs, r"[\x81-\xfe]\z", "")).otherwise(pairs)
    utf8 = F.encode(cut, "ISO-8859-1").cast("string")
    read = F.when(F.is_valid_utf8(utf8), utf8).when(~pairs.rlike(r"[\x80-\xff]"), pairs)

    def judged(text: Column) -> Column:
        odd = F.char_length(F.regexp_replace(text, r"[^\p{C}]|[\t-\r\x1c-\x1f\x85]", ""))
        few = F.char_length(sample) - F.char_length(F.regexp_replace(sample, r"\x00", "")) <= 0.1 * F.char_length(sample)
        return F.when((text == "") | (few & (odd < 0.15 * F.char_length(text))), detect_text_format(text, ext))

    return F.coalesce(magic_format(content), bound(read, judged))


#: Extensions that tell the format of files which their bytes don't.
KNOWN = ("rtf", "doc", "docx", "wps", "xls", "xlsx", "et", "odt", "pdf", "xps", "jpeg", "png", "gif", "bmp", "tiff", "heic", "txt", "md")
#: Extensions of packed files without a telling member; others are documents.
PACKED = ("xlsx", "xps", "ods", "odt", "ofd")
ODF = "application/vnd.oasis.opendocument."


def _packed_kind(content: bytes) -> str:
    """Format of a ZIP file by its members, read from its directory; empty where they don't tell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        starts = lambda p, end="": any(n.startswith(p) and n.endswith(end) for n in names)
        if "OFD.xml" in names or starts("Doc_"):
            return "ofd"
        if "mimetype" in names:
            with z.open("mimetype") as f:
                said = f.read(100).decode("utf-8", "replace").strip()
            if said in (ODF + "text", ODF + "spreadsheet"):
                return "odt" if said.endswith("text") else "ods"
        if "FixedDocumentSequence.fdseq" in names or starts("Documents/", ".fpage"):
            return "xps"
        return "xlsx" if starts("xl/") else "docx" if starts("word/") else ""


def _compound_kind(content: bytes) -> str:
    """``word``, ``excel`` or empty by the stream names of a compound file's directory, whose sectors a table chains."""
    size = 1 << struct.unpack_from("<H", content, 30)[0]
    table: list[int] = []
    for sector in struct.unpack_from("<109I", content, 76):
        if (sector + 2) * size <= len(content):
            table += struct.unpack_from(f"<{size // 4}I", content, (sector + 1) * size)
    sector, seen, names = struct.unpack_from("<I", content, 48)[0], set(), set()
    while sector < len(table) and sector not in seen:
        seen.add(sector)
        for at in range((sector + 1) * size, min((sector + 2) * size, len(content) - 127), 128):
            names.add(content[at : at + min(struct.unpack_from("<H", content, at + 64)[0], 64)].decode("utf-16-le", "replace").rstrip("\0"))
        sector = table[sector]
    return "word" if names & {"WordDocument", "1Table", "0Table", "Data"} else "excel" if names & {"Workbook", "Book", "BOOK"} else ""


@F.pandas_udf(T.StringType())
def _inner_kind(content: pd.Series) -> pd.Series:
    """What a packed or compound file holds; empty where that can't be read, null for null."""

    def kind(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return _packed_kind(bytes(b)) if b[:1] == b"P" else _compound_kind(bytes(b))
        except Exception:  # any damage: the extension decides
            return ""

    return content.map(kind)


def detect_format(content: Column, ext: Column) -> Column:
    """Format by first bytes, members of packed and streams of compound files, text, then extension; ``unknown`` where none tells.

    Only packed and compound files go to Python.
    """
    magic, e = magic_format(content), F.lower(ext)
    same = F.coalesce(F.create_map(*(F.lit(v) for kv in SAME.items() for v in kv))[e], e)
    inner = _inner_kind(F.when(magic.isin("zip", "ole"), content))
    packed = F.when(inner != "", inner).when(e.isin(*PACKED), e).otherwise("docx")
    sheet = (inner == "excel") | ((inner == "") & e.isin("xls", "xlsx", "et"))
    compound = F.when(sheet, F.when(e == "et", "et").otherwise("xls")).otherwise(F.when(e == "wps", "wps").otherwise("doc"))
    held = F.when(magic == "zip", packed).when(magic == "ole", compound)
    return F.coalesce(held, detect_file_format(content, ext), F.when(same.isin(*KNOWN), same), F.lit("unknown"))


def packed_file(members: dict[str, str]) -> bytes:
    """A ZIP file of texts by name, for queries and tests."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def compound_file(streams: tuple[str, ...]) -> bytes:
    """The header, table and directory of a compound file with empty streams, for queries and tests."""
    head = bytearray(512)
    head[:8] = bytes.fromhex("D0CF11E0A1B11AE1")
    struct.pack_into("<H", head, 30, 9)
    struct.pack_into("<I", head, 48, 1)
    struct.pack_into("<109I", head, 76, 0, *[0xFFFFFFFF] * 108)
    entries = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<H", 2 * len(n) + 2) + bytes(62) for n in ("Root Entry", *streams))
    return bytes(head) + struct.pack("<128I", 0xFFFFFFFD, 0xFFFFFFFE, *[0xFFFFFFFF] * 126) + entries.ljust(512, b"\0")


def validate_files(files: DataFrame, ext: str = "ext", detected: str = "detected") -> DataFrame:
    """``category, is_match, is_supported, is_valid, warning`` of files with extension, detected format and ``length``."""
    known = F.create_map(*(F.lit(v) for kv in SAME.items() for v in kv))
    same = lambda c: F.coalesce(known[F.lower(F.col(c))], F.lower(F.col(c)))
    match, supported = same(ext) == same(detected), category_of(F.lower(F.col(ext))) != "unknown"
    rows = files.withColumn("category", category_of(F.coalesce(F.lower(detected), F.lower(ext)))).withColumn("is_supported", supported)
    rows = rows.withColumn("is_match", F.coalesce(match, F.lit(False))).withColumn("is_valid", F.col("is_supported") & (F.col("length") > 0))
    warning = F.when(F.col("length") == 0, "empty").when(F.col(detected).isNull(), "unverifiable").when(~F.col("is_match"), "mismatch").otherwise("")
    return rows.withColumn("warning", warning)


def _decoded(content: bytes) -> str:
    for encoding in ("utf-8-sig", "gbk", "utf-16"):
        try:
            return content.decode(encoding)
        except UnicodeError:
            continue
    return content.decode("utf-8", "replace")


#: Characters of a CSV cell at most; a file with a longer one can't be read. Cells that are passed on at once.
CELL_CHARS, CELLS = 1 << 30, 50_000


def _csv_lines(content: bytes | None) -> list[list[str]]:
    text = _decoded(bytes(content)) if content is not None else ""
    head = text.splitlines()[:20]
    sep = max(",;\t|", key=lambda d: sum(line.count(d) for line in head))
    csv.field_size_limit(CELL_CHARS)
    try:
        return list(csv.reader(io.StringIO(text), delimiter=sep))
    except csv.Error:
        return []


def read_csv_cells(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys, row, col, value`` (from 1) of CSV files of unknown encoding and separator; no header, nothing converted.

    Files without content, and those that are no CSV, have no rows.
    """
    rows = files.select(*keys, F.col(content).alias("_c"))
    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "row int, col int, value string"])
    names = [*keys, "row", "col", "value"]

    def cells(batches):
        for pdf in batches:
            out: list[tuple] = []
            for *key, data in pdf.itertuples(index=False, name=None):
                for r, line in enumerate(_csv_lines(data), 1):
                    out += [(*key, r, c, v) for c, v in enumerate(line, 1)]
                    if len(out) >= CELLS:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(cells, schema)


def type_csv_cells(cells: DataFrame) -> DataFrame:
    """``vtype`` num for whole numbers without leading zero, else str; decimals stay text."""
    whole = F.col("value").rlike(r"\A(?:0|-?[1-9][0-9]{0,17})\z")
    return cells.withColumn("vtype", F.when(whole, "num").otherwise("str"))


def sheet_csv_lines(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row, line``: dense rows as CSV; missing cells are empty. ``write.partitionBy(keys).text`` makes one file set per sheet."""
    width = cells.groupBy(*keys).agg(F.max("col").alias("_w"))
    rows = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit(""))))).alias("_m")).join(width, keys)
    v = lambda c: F.coalesce(F.col("_m")[c], F.lit(""))
    quoted = lambda x: F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return rows.select(*keys, "row", F.array_join(F.transform(F.sequence(F.lit(1), F.col("_w").cast("int")), lambda c: quoted(v(c))), ",").alias("line"))


def _yaml_scalar(x: str | None) -> str:
    if x is None or x == "":
        return ""
    return yaml.safe_dump(str(x), default_flow_style=True, allow_unicode=True, width=1 << 30).strip().removesuffix("...").strip()


@F.pandas_udf(T.ArrayType(T.StringType()))
def yaml_scalars(values: pd.Series) -> pd.Series:
    """Texts as YAML scalars, quoted only where YAML needs it."""
    return values.map(lambda vs: [_yaml_scalar(v) for v in vs])


def render_front_matter(record: Column) -> Column:
    """YAML header of an array of ``key`` and ``values`` (array): one value in its line, several as list items."""
    flat = yaml_scalars(F.flatten(F.transform(record, lambda r: r["values"])))

    def lines(scalars: Column) -> Column:
        def entry(r: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(record, F.lit(1), i), F.lit(0), lambda a, x: a + F.size(x["values"]))
            own = F.slice(scalars, before + 1, F.size(r["values"]))
            items = F.array_join(F.transform(own, lambda v: F.concat(F.lit("\n  - "), v)), "")
            return F.concat(r["key"], F.lit(":"), F.when(F.size(own) == 1, F.rtrim(F.concat(F.lit(" "), F.get(own, F.lit(0))))).otherwise(items))

        return F.array_join(F.transform(record, entry), "\n")

    return F.concat(F.lit("---\n"), bound(flat, lines), F.lit("\n---\n"))


def render_markdown_table(headers: Column, rows: Column) -> Column:
    """Arrays as pipe table; pipes escaped, line feeds become blanks."""
    cell = lambda x: F.replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|"))
    line = lambda cs: F.concat(F.lit("| "), F.array_join(F.transform(cs, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda h: F.lit(" --- ")), "|"), F.lit("|"))
    none = F.array(F.transform(headers, lambda h, i: F.when(i == 0, "not recognised").otherwise("")))
    return F.concat_ws("\n", line(headers), rule, F.array_join(F.transform(F.when(F.size(rows) > 0, rows).otherwise(none), line), "\n"))


def output_names(files: DataFrame, keys: list[str], stem: Column, section: Column, stamp: Column, description: Column) -> DataFrame:
    """``name``: the stem without an old time stamp, section, stamp and description; names that meet get ``_001`` and on, by key."""
    bare = F.regexp_replace(stem, r"_\d{8}_\d{6}.*$", "")
    filled = lambda x: F.when(F.coalesce(x, F.lit("")) != "", x)
    rows = files.withColumn("name", F.concat_ws("_", bare, filled(section), filled(stamp), filled(description)))
    return ranked(rows, ["name"], keys, "_at").withColumn("_n", F.col("_at") - 1).withColumn("name", F.when(F.col("_n") > 0, F.concat("name", F.lit("_"), F.lpad(F.col("_n").cast("string"), F.greatest(F.lit(3), F.length(F.col("_n").cast("string"))), F.lit("0")))).otherwise(F.col("name"))).drop("_n", "_at")
