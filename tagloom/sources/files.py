"""Readers of number lists, tag schemes and publication XML."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_number_list(spark: SparkSession, path: str) -> DataFrame:
    """line_no, input_raw of the non-blank lines; line_no orders lines within a file and files by name."""
    rows = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    kept = rows.select("file", F.monotonically_increasing_id().alias("line_no"), F.trim(F.regexp_replace("value", "\r", "")).alias("input_raw"))
    return kept.where("input_raw <> ''").select("line_no", "input_raw")


_SCHEME = "name string, definition string, parent string, color string, hotkey string"


def read_tag_scheme(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEME).json(path, multiLine=True)


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _name(x) == name)


def _child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        e = None if e is None else next((c for c in e if _name(c) == name), None)
    return e


def _leading(e: ET.Element | None) -> str:
    """The text before the first child element."""
    return (e.text or "").strip() if e is not None else ""


def publication(doc: ET.Element) -> dict:
    """One exchange document; a missing country, number or kind is an error."""
    key = [doc.get(a) for a in ("country", "doc-number", "kind")]
    if not all(key):
        raise ValueError("a publication without country, number or kind")
    data = _child(doc, "bibliographic-data")
    out = {"docdb_id": ".".join(key), "country": key[0], "number": key[1], "kind": key[2], "family_id": doc.get("family-id")}
    dated = [d for d in _all(_child(data, "publication-reference"), "document-id") if d.get("document-id-type") == "docdb"] if _child(data, "publication-reference") is not None else []
    date = _leading(_child(dated[0], "date")) if dated else ""
    out["publication_date"] = f"{date[:4]}-{date[4:6]}-{date[6:]}" if re.fullmatch(r"\d{8}", date) else None
    ids = {}
    if (ref := _child(data, "application-reference")) is not None:
        ids = {d.get("document-id-type"): d for d in _all(ref, "document-id")}
    application = None
    if "epodoc" in ids:
        application = _leading(_child(ids["epodoc"], "doc-number")) or None
    if application is None and "docdb" in ids:
        application = (_leading(_child(ids["docdb"], "country")) + _leading(_child(ids["docdb"], "doc-number"))) or None
    out["application_number"] = application
    out["titles"] = {t.get("lang") or "": _leading(t) for t in (data if data is not None else []) if _name(t) == "invention-title"}
    out["abstracts"] = {a.get("lang") or "": "\n".join(_leading(p) for p in a if _name(p) == "p") for a in doc if _name(a) == "abstract"}
    out["applicants"] = [
        _leading(_child(a, "applicant-name", "name")) for a in (_all(data, "applicant") if data is not None else ()) if a.get("data-format") == "epodoc"
    ]
    out["ipc"] = [" ".join(_leading(t).split()) for c in (_all(data, "classification-ipc") if data is not None else ()) for t in c if _name(t) == "text"]
    parts = ("section", "class", "subclass", "main-group", "subgroup")
    out["cpc"] = [
        "{}{}{}{}/{}".format(*(_leading(_child(c, p)) for p in parts)) for c in (_all(data, "patent-classification") if data is not None else ())
    ]
    return out


_PUBLICATION = (
    "id bigint, docdb_id string, country string, number string, kind string, family_id string, publication_date string, application_number string, "
    "titles map<string,string>, abstracts map<string,string>, applicants array<string>, ipc array<string>, cpc array<string>, error string"
)
_COLUMNS = [c.split()[0] for c in re.sub(r"<[^>]*>", "", _PUBLICATION).split(", ")]


def _rows(fn, columns: list[str]):
    """mapInPandas function: rows of fn(xml root, further cells) for each response; a bad response gives its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for cells in pdf.itertuples(index=False):
                try:
                    found = fn(ET.fromstring(cells[1]), *cells[2:])
                    out += [{"id": cells[0], **r} for r in found]
                except (ET.ParseError, ValueError, TypeError) as e:
                    if "error" in columns:
                        out.append({"id": cells[0], "error": str(e) or type(e).__name__})
            frame = pd.DataFrame(out, columns=columns)
            yield frame.astype(object).where(frame.notna(), None)

    return run


def parse_publications(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows id, xml to one row per publication; a response that can't be read gives a row with its error only."""
    return raw.select("id", xml).mapInPandas(_rows(lambda root: [publication(d) for d in _all(root, "exchange-document")], _COLUMNS), _PUBLICATION)


def search_total(root: ET.Element) -> int:
    for e in root.iter():
        if e.get("total-result-count"):
            return int(e.get("total-result-count"))
    raise ValueError("a search page without a total")


def parse_search_pages(raw: DataFrame, xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(id, total, error; publications): a page without a total is an error."""
    totals = raw.select("id", xml).mapInPandas(_rows(lambda root: [{"total": search_total(root)}], ["id", "total", "error"]), "id bigint, total bigint, error string")
    return totals, parse_publications(raw, xml)


def fulltext_parts(root: ET.Element) -> list[dict]:
    kept = ("description", "claims")
    return [{"lang": e.get("lang"), "part": e.get("desc").lower()} for e in _all(root, "fulltext-instance") if (e.get("desc") or "").lower() in kept]


def parse_fulltext_inquiry(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """id, lang, part: which descriptions and claims there are."""
    return raw.select("id", xml).mapInPandas(_rows(fulltext_parts, ["id", "lang", "part"]), "id bigint, lang string, part string")


def images(root: ET.Element) -> list[dict]:
    first: dict[str, dict] = {}
    for e in _all(root, "document-instance"):
        if e.get("desc") in ("Drawing", "FirstPageClipping"):
            first.setdefault(e.get("desc"), {"desc": e.get("desc"), "link": e.get("link"), "pages": int(e.get("number-of-pages") or 0)})
    return list(first.values())


def parse_image_inquiry(raw: DataFrame, xml: str = "xml") -> DataFrame:
    """id, desc, link, pages: the first drawing and the first clipping."""
    return raw.select("id", xml).mapInPandas(_rows(images, ["id", "desc", "link", "pages"]), "id bigint, desc string, link string, pages bigint")


_LOST = (("tables", "Table"), ("table", "Table"), ("maths", "Formula"), ("math", "Formula"), ("chemistry", "Chemical structure"))


def _lost(e: ET.Element, n: int | None) -> str | None:
    """The note for a paragraph with a table, formula or structure."""
    for name, what in _LOST:
        if next(_all(e, name), None) is not None:
            return f"[{what} {n} not reproduced]" if n is not None else f"[{what} not reproduced]"
    return None


def _flat(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def description_text(root: ET.Element, lang: str) -> str | None:
    for d in _all(root, "description"):
        if (d.get("lang") or "").lower() == lang.lower():
            out, n = [], 0
            for e in d.iter():
                if _name(e) == "p":
                    n += 1
                    out.append(_lost(e, n) or _flat(e))
                elif _name(e) == "heading":
                    out.append(_flat(e))
            return "\n".join(x for x in out if x)
    return None


def claims_text(root: ET.Element, lang: str) -> str | None:
    for c in _all(root, "claims"):
        if (c.get("lang") or "").lower() == lang.lower():
            return "\n".join(x for x in (_lost(t, None) or _flat(t) for t in _all(c, "claim-text")) if x)
    return None


def extract_description(raw: DataFrame, lang: str, xml: str = "xml") -> DataFrame:
    """id, text of the description in a language; null if there is none."""
    rows = raw.select("id", xml, F.lit(lang).alias("lang"))
    return rows.mapInPandas(_rows(lambda root, lang: [{"text": description_text(root, lang)}], ["id", "text"]), "id bigint, text string")


def extract_claims(raw: DataFrame, lang: str, xml: str = "xml") -> DataFrame:
    rows = raw.select("id", xml, F.lit(lang).alias("lang"))
    return rows.mapInPandas(_rows(lambda root, lang: [{"text": claims_text(root, lang)}], ["id", "text"]), "id bigint, text string")
