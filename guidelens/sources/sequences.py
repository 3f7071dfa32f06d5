"""FASTA, GenBank and plain sequence files as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

FEATURE = "name:string,type:string,start:int,end:int,strand:int,qualifiers:map<string,array<string>>"
SCHEMA = f"file string, name string, description string, topology string, sequence string, features array<struct<{FEATURE}>>"
_LOCATION = re.compile(r"\d+")


def fasta(text: str) -> list[dict]:
    """Records of a FASTA text; white space goes, and only a nameless last record gets a name."""
    out: list[dict] = []
    for part in re.split(r"^>", text, flags=re.M)[1:]:
        head, _, body = part.partition("\n")
        out.append({"name": head.strip(), "description": None, "topology": "linear", "sequence": "".join(body.split()), "features": []})
    kept = [d for d in out if d["sequence"]]
    for d in kept[:-1]:
        d["name"] = d["name"] or ""
    if kept and not kept[-1]["name"]:
        kept[-1]["name"] = "Untitled Sequence"
    return kept


def _location(text: str) -> tuple[int, int, int]:
    """(start from 0, end, strand); joined parts count as one from first to last."""
    numbers = [int(n) for n in _LOCATION.findall(text)]
    if not numbers:
        return 0, 0, -1 if text.startswith("complement") else 1
    start = max(0, numbers[0] - 1)
    return start, (numbers[-1] if len(numbers) > 1 else start + 1), -1 if text.startswith("complement") else 1


def genbank(text: str) -> dict | None:
    """The first entry of a GenBank text; None if it doesn't open with LOCUS."""
    lines = text.splitlines()
    if not lines or not lines[0].startswith("LOCUS"):
        return None
    words = lines[0].split()
    doc = {"name": words[1] if len(words) > 1 else "Untitled", "description": None, "topology": "circular" if "circular" in lines[0] else "linear", "sequence": "", "features": []}
    section, key = "", ""
    for line in lines[1:]:
        if line.startswith("//"):
            break
        if line[:1].strip():
            section = line.split()[0]
            if section == "DEFINITION":
                doc["description"] = line[len("DEFINITION") :].strip()
        elif section == "ORIGIN":
            doc["sequence"] += re.sub(r"[\d\s]", "", line).upper()
        elif section == "FEATURES" and len(line) > 5 and line[5] != " ":
            kind, _, place = line.strip().partition(" ")
            if place.strip():
                start, end, strand = _location(place.strip())
                doc["features"].append({"name": kind, "type": kind, "start": start, "end": end, "strand": strand, "qualifiers": {}})
                key = ""
        elif section == "FEATURES" and doc["features"] and line[21:].strip():
            feature, body = doc["features"][-1], line[21:].strip()
            if body.startswith("/"):
                key, equals, value = body[1:].partition("=")
                value = re.sub(r'^"|"$', "", value) if equals else "true"
                feature["qualifiers"][key] = [value]
                if equals and key in ("label", "gene", "note") and feature["name"] == feature["type"]:
                    feature["name"] = value
            elif key:
                feature["qualifiers"][key][0] += " " + body.removesuffix('"')
    return doc


def plain(name: str, text: str) -> dict:
    """Letters of a text, upper-cased."""
    return {"name": name.rsplit(".", 1)[0], "description": None, "topology": "linear", "sequence": re.sub(r"[^A-Za-z]", "", text).upper(), "features": []}


def parsed(name: str, text: str) -> list[dict]:
    """By suffix, else by how the text opens; other texts are plain sequence."""
    low = name.lower()
    if low.endswith((".gb", ".gbk", ".genbank")) or text.startswith("LOCUS"):
        doc = genbank(text)
        return [doc] if doc else []
    if low.endswith((".fasta", ".fa", ".fna", ".fas")) or text.lstrip().startswith(">"):
        return fasta(text)
    return [plain(name, text)]


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """Every FASTA, GenBank or text file under a path: one row a sequence. Files are references, small ones."""
    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                name = p.rsplit("/", 1)[-1]
                rows = [{"file": name} | d for d in parsed(name, text)]
                for r in rows:
                    for f in r["features"]:
                        f["qualifiers"] = list(f["qualifiers"].items())
                yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS path", "value").mapInArrow(run, SCHEMA)
