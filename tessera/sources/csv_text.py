"""CSV sources: labelled questions, and labelled pixel rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = " \t\n\v\f\r"


def split_line(line: str) -> list[str]:
    """Fields of a line: a quote switches quoting and vanishes, a backslash keeps a quote that follows."""
    fields, field, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == "\\" and line[i + 1 : i + 2] == '"':
            field.append('"')
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append("".join(field))
            field = []
        else:
            field.append(c)
        i += 1
    return [*fields, "".join(field)]


def squeeze(text: str) -> str:
    """Trimmed; of each run of white space the first character stays."""
    out: list[str] = []
    for c in text.strip(_SPACE):
        if not (c in _SPACE and out and out[-1] in _SPACE):
            out.append(c)
    return "".join(out)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a file of three columns with a header, or of a folder's files: ids from 1 in the files' order.

    Files are in the order of their names, and only the first one begins with a header. A first pass counts the lines
    of each split; those before a split number its lines. ValueError if there is no row; a row without exactly three
    fields fails the job.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    blank = F.col("value") == ""
    splits = lines.withColumn("__n", F.monotonically_increasing_id()).groupBy("file", "at").agg(F.count_if(~blank).alias("n"), F.min_by(blank, "__n").alias("blank"))
    found = splits.orderBy("file", "at").collect()
    first = (found[0]["file"], found[0]["at"]) if found else None
    before, n = {}, 0
    for r in found:
        before[r["file"], r["at"]] = n
        n += r["n"] - (n == 0 and (r["file"], r["at"]) == first and not r["blank"])
    if not n:
        raise ValueError(f"no documents in {path}")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, next_id, header = None, 0, False
        for frame in frames:
            ids, texts = [], []
            for line, *own in zip(frame["value"], frame["file"], frame["at"], strict=True):
                if (own := tuple(own)) != split:
                    split, next_id, header = own, before[own] + 1, own == first
                if header or not line:
                    header = False
                    continue
                fields = split_line(line.rstrip("\r"))
                if len(fields) != 3:
                    raise ValueError(f"{len(fields)} fields where 3 are expected: {line[:80]!r}")
                ids.append(next_id)
                texts.append(squeeze(fields[2]))
                next_id += 1
            yield pd.DataFrame({"doc_id": ids, "text": texts})

    return lines.mapInPandas(parse, "doc_id long, text string")


def read_pixels(spark: SparkSession, path: str, *, pixels: int = 784, header: bool = True) -> DataFrame:
    """(id, vec): the label dropped, values divided by 255, what is no number 0; shorter rows are left out."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(pixels + 2)])
    rows = spark.read.csv(path, schema=schema, header=header, enforceSchema=True)
    values = F.array(*[F.coalesce(F.col(f"c{i}").try_cast("float"), F.lit(0.0)).cast("float") / F.lit(255.0) for i in range(1, pixels + 1)])
    whole = F.col(f"c{pixels}").isNotNull() & F.col(f"c{pixels + 1}").isNull()
    return rows.where(whole).select(F.monotonically_increasing_id().alias("id"), values.cast("array<float>").alias("vec"))
