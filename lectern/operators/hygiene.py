"""Hygiene of files before they are published: names, secrets, copyright, size, folders.

files: root, path, size, text. Each check gives root, path, kind, level (blocking or warning), evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import fixed


def _name(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def _extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(_name(path), "[^.](\\.[^.]*)$", 1))


def _finding(kind: str, level: Column | str, evidence: Column) -> list[Column]:
    return [F.col("root"), F.col("path"), F.lit(kind).alias("kind"), (F.lit(level) if isinstance(level, str) else level).alias("level"), evidence.alias("evidence")]


def flag_names(files: DataFrame) -> DataFrame:
    """Names that speak of credentials: code is a warning, all else blocking."""
    level = F.when(_extension().isin(fixed.CODE_EXTENSIONS), "warning").otherwise("blocking")
    return files.filter(_name().rlike(fixed.RISKY_NAME)).select(_finding("name", level, F.format_string("%d B", "size")))


def _scanned(files: DataFrame, most_bytes: int = 2 * 1048576) -> DataFrame:
    return files.filter((F.col("size") <= most_bytes) & _extension().isin(fixed.TEXT_EXTENSIONS))


def flag_secrets(files: DataFrame, pattern: str = fixed.SECRET) -> DataFrame:
    """The first secret in a text file, its first 24 characters as evidence."""
    return _scanned(files).withColumn("hit", F.regexp_extract("text", pattern, 0)).filter("hit <> ''").select(_finding("secret", "blocking", F.substring("hit", 1, 24)))


def flag_copyright(files: DataFrame, pattern: str = fixed.COPYRIGHT_HINT, head: int = 4000, many: int = 3, large: int = 20000) -> DataFrame:
    """Hints of copyright in a text file's name or head: a name, several hits, or one in a large file."""
    hits = F.regexp_count(F.substring("text", 1, head), F.lit(pattern))
    found = _scanned(files).withColumn("hits", hits).filter(_name().rlike(pattern) | (F.col("hits") >= many) | ((F.col("hits") >= 1) & (F.col("size") > large)))
    return found.select(_finding("copyright", "warning", F.col("hits").cast("string")))


def flag_large(files: DataFrame, max_mb: float = 5.0) -> DataFrame:
    return files.filter(F.col("size") > max_mb * 1048576).select(_finding("large", "warning", F.format_string("%.1f MB", F.col("size") / 1048576)))


def _outside(files: DataFrame) -> DataFrame:
    """files with folders, those of the path, and risky, the first risky one and its place."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    named = F.transform("folders_", lambda f, i: F.struct(i.alias("i"), f.alias("f")))
    return files.withColumn("folders_", folders).withColumn("risky_", F.get(F.filter(named, lambda x: x["f"].rlike(fixed.RISKY_FOLDER)), F.lit(0)))


def _not_silent(rows: DataFrame, ignored: DataFrame) -> DataFrame:
    """rows (root, path) without those in a folder at the root that is ignored."""
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1))
    silent = ignored.select(F.col("root").alias("root_"), F.col("name").alias("name_")).distinct()
    return rows.withColumn("top_", top).join(silent, (F.col("root") == F.col("root_")) & (F.col("top_") == F.col("name_")), "left_anti").drop("top_")


def prune_folders(files: DataFrame, ignored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """root, path, size of files outside of ignored and risky folders, and a finding for each risky folder.

    ignored: root, name. A folder at the root that is ignored goes silently; a risky one, the first on a path, is
    blocking, but a warning at the root or if its name is ignored; what is inside is not looked at. Texts are not read.
    """
    listed = _outside(_not_silent(files.select("root", "path", "size"), ignored))
    clean = listed.filter("risky_ IS NULL").select("root", "path", "size")
    at = F.array_join(F.slice("folders_", 1, F.col("risky_.i") + 1), "/")
    found = listed.filter("risky_ IS NOT NULL").select("root", at.alias("path"), F.col("risky_.f").alias("name"), (F.col("risky_.i") == 0).alias("top")).distinct()
    known = found.join(ignored.select("root", "name").distinct().withColumn("known", F.lit(True)), ["root", "name"], "left")
    level = F.when(F.col("top") | F.coalesce("known", F.lit(False)), "warning").otherwise("blocking")
    return clean, known.select(_finding("folder", level, F.lit("")))


def scan(files: DataFrame, ignored: DataFrame, max_mb: float = 5.0, secret: str = fixed.SECRET, copyright_hint: str = fixed.COPYRIGHT_HINT) -> DataFrame:
    """All findings. Texts are searched where they lie, and only what is found meets the ignored folders, so no text moves."""
    seen = _outside(files).filter("risky_ IS NULL")
    checks = [flag_names(seen), flag_secrets(seen, secret), flag_copyright(seen, copyright_hint), flag_large(seen, max_mb)]
    return prune_folders(files, ignored)[1].unionByName(_not_silent(reduce(DataFrame.unionByName, checks), ignored))


def report(files: DataFrame, findings: DataFrame) -> DataFrame:
    """root, files, bytes, blocking, warnings, passed; a root whose files all lie in pruned folders has its findings, too."""
    sums = files.groupBy("root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    counts = findings.groupBy("root").agg(F.count_if(F.col("level") == "blocking").alias("blocking"), F.count_if(F.col("level") == "warning").alias("warnings"))
    joined = sums.join(counts, "root", "full").na.fill(0, ["files", "bytes", "blocking", "warnings"])
    return joined.withColumn("passed", F.col("blocking") == 0)


def top_findings(findings: DataFrame, most: int = 40) -> DataFrame:
    """The first findings of each list of a root, and how many more there are.

    Each task keeps its first most rows of a list before any move (Spark's group limit of a window), and
    counts are sums of counts, so that a root with very many findings is no large group anywhere.
    """
    place = F.row_number().over(W.partitionBy("root", "level").orderBy("path", "kind"))
    first = findings.withColumn("place", place).filter(F.col("place") <= most)
    counts = findings.groupBy("root", "level").agg(F.greatest(F.lit(0), F.count("*") - most).alias("more"))
    return first.join(counts, ["root", "level"]).select(*findings.columns, "place", "more")
