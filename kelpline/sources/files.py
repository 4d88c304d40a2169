"""File sources and sinks of label data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import WS


def entries(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Entries of a JSON file {version, entries: [...]}, with the version."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return spark.read.schema(f"version string, updatedAt string, entries array<struct<{ddl}>>").json(path, multiLine=True).select("version", F.explode("entries").alias("e")).select("version", "e.*")


def products(spark: SparkSession, path: str, country: str = "japan") -> DataFrame:
    """Rows of a tab-separated product export, plain or gzip, sold in a country. Short rows are dropped."""
    cols = ["countries_tags", "countries_en", "ingredients_text", "categories_tags"]
    df = spark.read.csv(path, sep="\t", header=True, quote="", mode="DROPMALFORMED").select(*cols)
    here = F.contains(F.lower("countries_tags"), F.lit(f"en:{country}")) | F.contains(F.lower("countries_en"), F.lit(country))
    return df.filter(here)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made records from JSON lines, arrays, or objects that wrap them as records, items or gt; bad lines are kept in ``_corrupt``."""
    item = "struct<raw:string,expected:string,hazard:boolean,note:string>"
    rec = f"file string, source string, productName string, category string, notes string, ingredients array<{item}>"
    inner = "array<struct<file:string,source:string,productName:string,category:string,notes:string,ingredients:array<" + item + ">>>"
    df = spark.read.schema(f"{rec}, records {inner}, items {inner}, gt {inner}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, recursiveFileLookup=True).withColumn("_many", F.coalesce("records", "items", "gt"))
    names = ["file", "source", "productName", "category", "notes", "ingredients"]
    single = df.filter("_many is null").select(*names, "_corrupt")
    many = df.filter("_many is not null").select(F.explode("_many").alias("r")).select("r.*", F.lit(None).cast("string").alias("_corrupt"))
    return single.unionByName(many)


def scan_records(log: DataFrame) -> DataFrame:
    """The scans of a log (type null or scan), one a sid and time, in order of arrival by time and sid."""
    return log.filter("rec_type is null or rec_type = 'scan'")


def log_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines log, and (bad_lines) how many couldn't be read."""
    df = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.filter("_corrupt is null").drop("_corrupt"), df.select("_corrupt").filter("_corrupt is not null").agg(F.count("*").alias("bad_lines"))


def triples(lines: DataFrame) -> DataFrame:
    """(rec, subject, label, certificate, org) of line-scanned Turtle: (file, line_no, line) rows.

    A line that starts with a non-blank subject opens a record; of the following lines the first label and the last
    certificate and organisation count. Records never leave their file, so files are scanned in parallel.
    """
    subject = F.col("line").rlike(r"^[^\s#@].*\s")
    w = Window.partitionBy("file").orderBy("line_no")
    r = lines.withColumn("rec", F.sum(F.when(subject, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("rec > 0")

    def value(p: str) -> F.Column:
        v = F.regexp_replace(F.regexp_extract("line", p + r"\s+(.+?)\s*$", 1), r"[;,.\s]+$", "")
        return F.when(F.col("line").rlike(p + r"\s"), F.regexp_replace(v, '^"|"(@[a-z]+)?$', ""))

    at = F.col("line_no")
    label, cert, org = value("label"), value("certificate"), value("organization")
    return r.groupBy("file", "rec").agg(
        F.min_by(F.when(subject, F.regexp_extract("line", r"^(\S+)", 1)), F.when(subject, at)).alias("subject"),
        F.min_by(label, F.when(label.isNotNull(), at)).alias("label"),
        F.max_by(cert, F.when(cert.isNotNull(), at)).alias("certificate"),
        F.max_by(org, F.when(org.isNotNull(), at)).alias("org"),
    )


def code_table(lines: DataFrame) -> DataFrame:
    """(code, name, status) of a text table of codes; an asterisk makes it doubtful; of each code the first row counts."""
    pattern = r"^\s*(\d{3,4}[a-zA-Z]?)\s+(\S.*)$"
    rows = lines.filter(F.col("line").rlike(pattern)).select("line_no", F.upper(F.regexp_extract("line", pattern, 1)).alias("code"), F.regexp_extract("line", pattern, 2).alias("rest"))
    name = F.regexp_replace(F.replace(F.split("rest", r"\s{2,}")[0], F.lit("*"), F.lit("")), f"^{WS}+|{WS}+\\z", "")
    status = F.when(F.contains("rest", F.lit("*")), "doubtful").otherwise("listed")
    return rows.groupBy("code").agg(F.min_by(F.struct(name.alias("name"), status.alias("status")), "line_no").alias("v")).select(F.concat(F.lit("E"), "code").alias("code"), "v.name", "v.status")


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file's content, checked against a hash; reading a changed file fails."""
    df = spark.read.format("binaryFile").load(path)
    return df.filter(F.assert_true(F.sha2("content", 256) == sha256, F.lit("the pinned input has changed")).isNull()).select("path", "length", "content")


def images(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,webp}") -> DataFrame:
    """(path, length) of the image files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def with_manifest(files: DataFrame, manifest: DataFrame, path: str = "path") -> DataFrame:
    """Files with the manifest's kind and source, by full path, else by last part."""
    from ..functions.text import basename, norm_path

    full = manifest.groupBy(norm_path(F.col("file")).alias("_f")).agg(F.min(F.struct("kind", "source")).alias("_a"))
    part = manifest.groupBy(basename(F.col("file")).alias("_b")).agg(F.min(F.struct("kind", "source")).alias("_c"))
    j = files.join(full, norm_path(F.col(path)) == F.col("_f"), "left").join(part, basename(F.col(path)) == F.col("_b"), "left")
    m = F.coalesce("_a", "_c")
    return j.select(*files.columns, m["kind"].alias("kind"), m["source"].alias("source"))


def keep_last(df: DataFrame, by: str, order: tuple[str, ...], n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def rotated(df: DataFrame, size: int, kinds: dict[str, int], kind: str = "rec_type", order: tuple[str, ...] = ("scanned_at", "rec_id")) -> DataFrame:
    """A log cut to the last rows of each kind if its lines together are longer than ``size`` characters."""
    total = df.select(F.length(F.to_json(F.struct("*"))).alias("n")).agg(F.sum("n")).first()[0] or 0
    if total <= size:
        return df
    k, by = F.coalesce(F.col(kind), F.lit("scan")), [F.col(c).desc() for c in order]
    # a distributed top-n for each of the few kinds
    parts = [df.filter(k == name).orderBy(*by).limit(n) for name, n in kinds.items()]
    return reduce(DataFrame.unionAll, parts) if parts else df.limit(0)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Compact JSON lines, nulls left out."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)
