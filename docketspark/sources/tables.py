"""Readers and writers: typed tables, JSON columns, documents in folders, and keyed sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", columns: list[str] | None = None, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A table by format name; a schema is read as given and never inferred from text."""
    r = spark.read.format(fmt).options(**options)
    df = (r.schema(schema) if schema else r).load(path)
    return df.select(*columns) if columns else df


def decode_json(df: DataFrame, name: str, schema: str) -> DataFrame:
    """``name`` parsed beside the raw text: parsed struct in ``name_parsed``, null where it cannot be read."""
    return df.withColumn(f"{name}_parsed", F.from_json(name, schema, {"mode": "PERMISSIVE"}))


def read_documents(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("txt", "md", "html", "docx", "pdf")) -> DataFrame:
    """path, suffix, modificationTime, length, content (binary) of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes))


def docx_text(files: DataFrame) -> DataFrame:
    """path, text of .docx files: the runs of each paragraph, paragraphs on lines; '' if unreadable."""
    import pandas as pd

    @F.pandas_udf("string")
    def text_of(content: pd.Series) -> pd.Series:
        import io
        import zipfile
        from xml.etree import ElementTree

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

        def one(raw: bytes) -> str:
            try:
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
            except Exception:
                return ""
            return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))

        return content.map(one)

    return files.where("suffix = 'docx'").select("path", text_of("content").alias("text"))


def front_matter(df: DataFrame, text_col: str) -> DataFrame:
    """A '---' header of 'key: value' lines as a map, and the body after it."""
    head = F.regexp_extract(text_col, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^\s*[^:\s][^:]*:"))
    entry = F.transform(lines, lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]).alias("k"), F.trim(F.split(x, ":", 2)[1]).alias("v")))
    return df.withColumn("meta", F.map_from_entries(entry)).withColumn("body", F.regexp_replace(text_col, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", ""))


def block_digests(df: DataFrame, id_col: str, content_col: str, size: int = 262144) -> DataFrame:
    """Fixed-size blocks of binary content: digest, and the first offset at which it stands."""
    n = F.greatest(F.ceil(F.length(content_col) / size), F.lit(1)).cast("int")
    blocks = df.select(id_col, content_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    cut = F.substring(F.col(content_col), F.col("block") * size + 1, F.lit(size))
    return blocks.select(id_col, (F.col("block") * size).cast("long").alias("block_start"), F.sha2(cut, 256).alias("digest")).groupBy(id_col, "digest").agg(F.min("block_start").alias("first_offset"))


def insert_rows(target: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``target`` with ``rows`` appended: unknown columns dropped, missing ones defaulted or null."""
    defaults = defaults or {}
    picked = [
        (F.coalesce(F.col(f.name), defaults[f.name]) if f.name in defaults else F.col(f.name)) if f.name in rows.columns else defaults.get(f.name, F.lit(None))
        for f in target.schema
    ]
    return target.unionByName(rows.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(picked, target.schema))))


def update_rows(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """New values where the predicate holds (null counts as not); unknown columns are left out."""
    hit = F.coalesce(where, F.lit(False))
    return target.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns))


def upsert_rows(target: DataFrame, rows: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``rows`` replace those of the same key or are added; columns in ``keep`` stay as they were.

    One full outer join on the key; ``rows`` must hold a key once.
    """
    new = rows.select(*(F.col(c).alias(f"_n_{c}") for c in rows.columns), F.lit(True).alias("_new"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys))
    joined = target.withColumn("_old", F.lit(True)).join(new, on, "full_outer")

    def pick(c: str) -> Column:
        if c not in rows.columns:
            return F.col(c)
        if c in keep or c in keys:
            return F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}"))
        return F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c))

    return joined.select(*(pick(c).alias(c) for c in target.columns))


def delete_rows(target: DataFrame, where: Column | None = None) -> DataFrame:
    """Rows the predicate does not hold for; no predicate deletes all."""
    return target.where(F.lit(False)) if where is None else target.where(~F.coalesce(where, F.lit(False)))


def pivot_grid(cells: DataFrame, row: str, column: str, values: list, agg: Column) -> DataFrame:
    """One row per ``row`` with a column for each listed value; the list keeps it a single aggregate."""
    return cells.groupBy(row).pivot(column, values).agg(agg)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def log_line(ts: str, event: str, fields: dict[str, str]) -> Column:
    """'ts | event | key=value ...' with the fields that are not null, in the order given."""
    return F.concat_ws(" | ", ts, event, *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in fields.items()))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """One column of text as a folder of line files."""
    lines.write.mode(mode).text(path)


def stamp(df: DataFrame, key: str, value: str, names: list[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Key/value rows as one row with a column for each listed name; missing ones take their default."""
    one = df.groupBy().agg(*(F.max(F.when(F.col(key) == n, F.col(value))).alias(n) for n in names))
    return one.select(*(F.coalesce(F.col(n), F.lit(d)).alias(n) if (d := (defaults or {}).get(n)) is not None else F.col(n) for n in names))
