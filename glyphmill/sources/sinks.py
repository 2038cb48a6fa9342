"""Writers: partitions that are replaced, exports."""

from __future__ import annotations

import html
import json
import math
import re
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.sources.store import ObjectStore


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Writes Parquet by partition; partitions that `df` holds are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; a file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_lines(df: DataFrame, columns: Sequence[str], path: str, separator: str = " | ") -> None:
    """A text line per row, fields joined by the separator, nulls as nothing."""
    df.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).write.mode("overwrite").text(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(row): a row of an HTML table for each row, escaped."""
    from glyphmill.functions.text import escaped

    return df.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns], F.lit("</tr>")).alias("row"))


#: Fixed value: rows that a sheet of the format holds, its header included.
SHEET_ROWS = 1_048_576


def export_xlsx(df: DataFrame, path: str, sheet_rows: int = SHEET_ROWS) -> None:
    """An XLSX file with as many sheets as the rows need. Rows pass the driver one by one, none is kept."""
    escape = lambda x: re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", html.escape(x, quote=False))

    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    row = lambda values: f"<row>{''.join(map(cell, values))}</row>".encode()
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows, sheets = iter(df.toLocalIterator()), 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        more = next(rows, None)
        while sheets == 0 or more is not None:
            sheets += 1
            with z.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as out:
                out.write(f'<worksheet xmlns="{main}"><sheetData>'.encode() + row(df.columns))
                n = 1
                while more is not None and n < sheet_rows:
                    out.write(row(more))
                    more, n = next(rows, None), n + 1
                out.write(b"</sheetData></worksheet>")
        numbers = range(1, sheets + 1)
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="r{k}"/>' for k in numbers) + "</sheets></workbook>")
        link = '<Relationship Id="{}" Type="{}" Target="{}"/>'.format
        wrap = lambda x: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{x}</Relationships>'
        z.writestr("xl/_rels/workbook.xml.rels", wrap("".join(link(f"r{k}", f"{rel}/worksheet", f"worksheets/sheet{k}.xml") for k in numbers)))
        z.writestr("_rels/.rels", wrap(link("r1", f"{rel}/officeDocument", "xl/workbook.xml")))
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}worksheet+xml"/>' for k in numbers)
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/>{parts}</Types>')


def save_profiles(profiles: DataFrame, store: ObjectStore, key: str) -> dict[str, int]:
    """Writes (lang, word, weight) as one JSON file {language: {word: weight}}; gives the number of words by language.

    Profiles are small by their definition, a few hundred words of each language.
    """
    out: dict[str, dict[str, float]] = {}
    for r in profiles.select("lang", "word", F.col("weight").cast("double").alias("weight")).toLocalIterator():
        out.setdefault(r.lang, {})[r.word] = r.weight
    text = json.dumps({lang: dict(sorted(words.items())) for lang, words in sorted(out.items())}, ensure_ascii=False)
    store.put(key, text.encode())
    return {lang: len(words) for lang, words in out.items()}
