"""Scans of source trees and document folders, and the key-checked store of intermediate products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File extensions by language.
LANGUAGES = {
    "python": ["py", "pyx"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx"], "java": ["java"], "csharp": ["cs"], "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx"], "php": ["php", "phtml", "inc"], "go": ["go"], "rust": ["rs"], "bash": ["sh", "bash"], "cmake": ["cmake"],
    "makefile": ["mk"], "tcl": ["tcl"], "config": ["cfg"], "toml": ["toml"],
}
#: Folders that a scan leaves out.
PRUNED = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache"]


def language_of(path: Column) -> Column:
    """The language of a path, by file name first and extension then; null for others."""
    name = F.lower(F.substring_index(path, "/", -1))
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1))
    pairs = [F.lit(x) for lang, exts in LANGUAGES.items() for e in exts for x in (e, lang)]
    return F.when(name == "cmakelists.txt", "cmake").when(name.isin("makefile", "gnumakefile"), "makefile").otherwise(F.create_map(*pairs)[ext])


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, language, content) of the files below a root in a supported language; pruned folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rel = F.when(F.instr(rel, root.rstrip("/") + "/") == 1, F.substring(rel, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(rel)
    found = files.select(rel.alias("path"), F.col("length").alias("size"), language_of(rel).alias("language"), F.decode("content", "UTF-8").alias("content"))
    return found.where(F.col("language").isNotNull() & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, PRUNED))))


def scan_documents(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".md", ".rst", ".txt")) -> DataFrame:
    """(path, text) of the documents below a root, each as one row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    wanted = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")
    return files.where(wanted).select("path", F.decode("content", "UTF-8").alias("text"))


def language_counts(files: DataFrame) -> DataFrame:
    """Files by language, most first."""
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy(F.desc("files"), "language")


def glob_to_regex(pattern: str) -> str:
    """A file-name pattern (* crosses folders) as a Java expression."""
    out = "".join({"*": ".*", "?": "."}.get(c) or (c if c in "[]" else "\\" + c if not c.isalnum() and c not in "_/ " else c) for c in pattern)
    return f"(?s)^{out}$".replace("[!", "[^")


def path_filter(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Include patterns match path or name (none: all); exclude ones match path, name, a folder in front, or a segment."""
    name = F.substring_index(path, "/", -1)
    hit = lambda p: path.rlike(glob_to_regex(p)) | name.rlike(glob_to_regex(p))
    keep, drop = F.lit(not include), F.lit(False)
    for p in include:
        keep = keep | hit(p)
    for p in exclude:
        drop = drop | hit(p) | path.startswith(p.rstrip("/") + "/") | F.array_contains(F.split(path, "/"), p.rstrip("/"))
    return keep & ~drop


def save(df: DataFrame, path: str, key: str) -> None:
    """Writes a product under its input key; Spark's commit protocol makes the write all or nothing."""
    df.withColumn("_key", F.lit(key)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The product saved under this key, or None if there is none or it has another key."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")):
        return None
    df = spark.read.parquet(path)
    return None if df.where(F.col("_key") != key).limit(1).count() else df.drop("_key")
