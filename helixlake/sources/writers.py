"""FASTA and FASTQ files from DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODECS = {None: None, "": None, "none": None, "uncompressed": None, "gzip": "gzip", "bzip2": "bzip2", "zstd": "zstd"}


def fasta_text() -> Column:
    head = F.concat(F.lit(">"), F.coalesce("id", F.lit("")), F.coalesce(F.concat(F.lit(" "), F.col("description")), F.lit("")))
    return F.concat_ws("\n", head, F.coalesce("sequence", F.lit("")))


def fastq_text() -> Column:
    head = F.concat(F.lit("@"), F.coalesce("name", F.lit("")), F.coalesce(F.concat(F.lit(" "), F.col("description")), F.lit("")))
    return F.concat_ws("\n", head, F.coalesce("sequence", F.lit("")), F.lit("+"), F.coalesce("quality_scores", F.lit("")))


COLUMNS = {"fasta": (["id", "description", "sequence"], fasta_text), "fastq": (["name", "description", "sequence", "quality_scores"], fastq_text)}


def write_records(df: DataFrame, path: str, fmt: str, compression: str | None = None, single: bool = True) -> int:
    """Write ``df`` and give the bytes written.

    Columns are taken by name; one that is missing is an error; null names, descriptions and sequences are empty.  ``single`` makes one
    file at exactly ``path``, in the order of ``df``: parts are written in parallel and then joined (compressed members join as well),
    which only copies bytes.  Without it ``path`` is a directory of one file per partition, written in parallel.
    """
    fmt = fmt.lower()
    if fmt not in COLUMNS:
        raise ValueError(f"cannot write {fmt!r}; FASTA and FASTQ can be written")
    names, text = COLUMNS[fmt]
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{fmt} needs the columns {missing}")
    if compression is not None:
        compression = compression.lower()
    if compression not in _CODECS:
        raise ValueError(f"compression {compression!r}")
    spark = df.sparkSession
    lines = df.select(text().alias("value"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    folder = jvm.org.apache.hadoop.fs.Path(target.getParent() or jvm.org.apache.hadoop.fs.Path("."), f"_writing-{uuid.uuid4().hex}") if single else target
    options = {"compression": _CODECS[compression]} if _CODECS[compression] else {}
    lines.write.options(**options).text(folder.toString())
    parts = sorted((s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    size = sum(s.getLen() for s in parts)
    if single:
        fs.delete(target, False)
        if len(parts) == 1:
            fs.rename(parts[0].getPath(), target)
        else:
            out = fs.create(target)
            for p in parts:
                part = fs.open(p.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 4 << 20, False)
                part.close()
            out.close()
        fs.delete(folder, True)
    return size
