"""Reports and reads out: serialised reads, sequences, nested results, reads of alleles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..functions.sequence import wrapped

CHUNK = 30_000  # characters of a stored piece of JSON


def fastq_record(read_id: Column, seq: Column, qual: Column, ordinal: Column) -> Column:
    """Four lines; a read without id is read_N, N from 1."""
    name = F.coalesce(F.nullif(read_id, F.lit("")), F.concat(F.lit("read_"), (ordinal + 1).cast("string")))
    return F.concat_ws("\n", F.concat(F.lit("@"), name), seq, F.lit("+"), qual)


def quality_string(values: Column) -> Column:
    """Phred scores as text, held in 0..93."""
    return F.array_join(F.transform(values, lambda q: F.char(F.least(F.greatest(q, F.lit(0)), F.lit(93)) + 33)), "")


def fasta_record(name: Column, seq: Column, width: int = 80) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped(seq, width), F.lit("\n"))


def genbank_record(name: Column, description: Column, accession: Column, seq: Column, topology: Column, features: Column, date: Column) -> Column:
    """A GenBank entry; features: array of (name, type, start, end, strand), starts 0-based; date as dd-MMM-yyyy."""
    size = F.length(seq).cast("string")
    place = lambda f: F.concat((f["start"] + 1).cast("string"), F.lit(".."), f["end"].cast("string"))
    feature = lambda f: F.concat(F.lit("     "), F.rpad(f["type"], 15, " "), F.lit(" "), F.when(f["strand"] == -1, F.concat(F.lit("complement("), place(f), F.lit(")"))).otherwise(place(f)), F.lit('\n                     /label="'), f["name"], F.lit('"\n'))
    low = F.lower(seq)
    line = lambda i: F.concat(F.lpad((i + 1).cast("string"), 9, " "), F.lit(" "), F.trim(F.regexp_replace(F.substring(low, i + 1, F.lit(60)), "(.{10})", "$1 ")), F.lit("\n"))
    origin = F.when(F.length(seq) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.length(seq) - 1, F.lit(60)), line), "")).otherwise("")
    return F.concat(
        F.lit("LOCUS       "), F.rpad(name, 16, " "), F.lit(" "), size, F.lit(" bp    DNA     "), topology, F.lit("   "), date, F.lit("\n"),
        F.lit("DEFINITION  "), F.coalesce(description, name), F.lit("\n"), F.lit("ACCESSION   "), accession, F.lit("\n"), F.lit("VERSION     "), accession, F.lit("\n"),
        F.lit("KEYWORDS    .\nSOURCE      .\n  ORGANISM  .\nFEATURES             Location/Qualifiers\n     source          1.."), size, F.lit("\n"),
        F.array_join(F.transform(features, feature), ""), F.lit("ORIGIN\n"), origin, F.lit("//\n"),
    )


def unique_sheets(table: DataFrame, name: str, order: str) -> DataFrame:
    """table with sheet: names that repeat, whatever their case, get a number from 2 on. Sheets are those of one workbook, so they are few."""
    base = names.sheet_name(F.col(name))
    nth = F.row_number().over(W.partitionBy(F.lower(base)).orderBy(order))
    tail = F.concat(F.lit(" "), nth.cast("string"))
    return table.withColumn("sheet", F.when(nth == 1, base).otherwise(F.concat(F.substring(base, F.lit(1), F.lit(31) - F.length(tail)), tail)))


def reads_of_alleles(reads: DataFrame, keys: tuple[str, ...], alleles: DataFrame) -> DataFrame:
    """Reads whose stored allele is in a list; nothing is aligned again."""
    return reads.join(alleles.select(*keys).distinct(), list(keys), "left_semi")


def nested(summary: DataFrame, alleles: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Each scope's summary with its alleles as an array by rank."""
    own = [c for c in alleles.columns if c not in scope]
    order = ["group_rank", *(c for c in own if c != "group_rank")]
    lists = alleles.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("alleles"))
    return summary.join(lists, list(scope), "left")


def to_chunks(table: DataFrame, key: str, value: str, size: int = CHUNK) -> DataFrame:
    """A text column cut into numbered pieces."""
    n = F.greatest(F.lit(1), F.ceil(F.length(value) / size)).cast("int")
    return table.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(value), i * size + 1, F.lit(size)))).alias("ordinal", "chunk"))


def from_chunks(chunks: DataFrame, key: str) -> DataFrame:
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk"))), lambda s: s["chunk"])
    return chunks.groupBy(key).agg(F.array_join(pieces, "").alias("value"))


def json_round_trip(table: DataFrame, column: str) -> DataFrame:
    """A struct column through JSON text and back."""
    schema = table.schema[column].dataType
    return table.withColumn("json", F.to_json(column)).withColumn(column, F.from_json("json", schema))
