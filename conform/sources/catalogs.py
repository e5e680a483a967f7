"""Catalogs, settings and schema stores as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conform.functions.globs import pattern_rows

ENTRY = "struct<name:string,description:string,url:string,sourceUrl:string,fileMatch:array<string>,versions:map<string,string>>"
CATALOG = f"version int, title string, schemas array<{ENTRY}>, groups array<struct<name:string,description:string,schemas:array<string>>>"


def read_catalog(spark: SparkSession, path: str, ordinal: int = 0) -> DataFrame:
    """The entries of a catalog file: ``cat_ord, entry_ord, name, description, url, source_url, file_match, versions``."""
    return catalog_entries(spark.read.schema(CATALOG).option("multiLine", True).json(path), ordinal)


def catalog_entries(catalog: DataFrame, ordinal: int = 0) -> DataFrame:
    rows = catalog.select(F.posexplode("schemas").alias("entry_ord", "e"))
    return rows.select(F.lit(ordinal).alias("cat_ord"), "entry_ord", "e.name", "e.description", "e.url", F.col("e.sourceUrl").alias("source_url"), F.coalesce("e.fileMatch", F.array().cast("array<string>")).alias("file_match"), "e.versions")


def ranked_catalogs(catalogs: Sequence[DataFrame]) -> DataFrame:
    """Several catalogs as one, earlier ones first: registries, then the default catalog, then the public one."""
    out = None
    for i, c in enumerate(catalogs):
        c = c.withColumn("cat_ord", F.lit(i))
        out = c if out is None else out.unionByName(c)
    if out is None:
        raise ValueError("no catalog")
    return out


def parse_catalogs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked catalogs given as texts (``cat_ord, path, content``; null where reading failed): the entries of all that can be read, and a warning ``cat_ord, path, code, message`` for every other.

    Each catalog has a status of its own, so a broken one costs only its own entries.
    """
    shape = F.schema_of_variant(F.try_variant_get("__v", "$.schemas", "variant"))
    rows = texts.withColumn("__v", F.try_parse_json("content")).withColumn("__catalog", F.from_json("content", CATALOG, {"mode": "PERMISSIVE"}))
    said = F.when(F.col("content").isNull(), "cannot be read").when(F.col("__v").isNull(), "malformed JSON").when(F.coalesce(~shape.startswith("ARRAY"), F.lit(True)), "no list of schemas")
    rows = rows.withColumn("__said", said)
    entries = rows.filter("__said IS NULL").select(F.col("cat_ord").alias("__ord"), F.col("__catalog.schemas").alias("schemas"))
    entries = entries.select("__ord", F.posexplode("schemas").alias("entry_ord", "e")).filter("e IS NOT NULL")
    entries = entries.select(F.col("__ord").alias("cat_ord"), "entry_ord", "e.name", "e.description", "e.url", F.col("e.sourceUrl").alias("source_url"), F.coalesce("e.fileMatch", F.array().cast("array<string>")).alias("file_match"), "e.versions")
    return entries, rows.filter("__said IS NOT NULL").select("cat_ord", "path", F.lit("catalog").alias("code"), F.concat(F.lit("catalog skipped: "), "__said").alias("message"))


def read_catalogs(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`parse_catalogs` of files in the order of their rank; a path without a file is a warning too."""
    ranks = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "cat_ord int, path string")
    found = None
    for i, p in enumerate(paths):
        part = spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(p) if _exists(spark, p) else None
        if part is not None:
            part = part.select(F.lit(i).alias("cat_ord"), F.col("value").alias("content"))
            found = part if found is None else found.unionByName(part)
    texts = ranks.withColumn("content", F.lit(None).cast("string")) if found is None else ranks.join(found, "cat_ord", "left")
    return parse_catalogs(texts)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def catalog_patterns(spark: SparkSession, entries: Sequence[tuple[int, str, str, Sequence[str]]], cat_ord: int = 0) -> DataFrame:
    """``cat_ord, entry_ord, pat_ord, pattern, url, name, regex, turned, strategy, key`` of entries ``(ordinal, name, url, patterns)``.

    Negated and empty patterns are dropped; a pattern without a slash holds at any depth.
    """
    rows = [(cat_ord, o, i, p if "/" in p else f"**/{p}", url, name) for o, name, url, patterns in entries for i, p in enumerate(patterns) if p and not p.startswith("!")]
    return pattern_rows(spark, rows, ["cat_ord", "entry_ord", "pat_ord", "pattern", "url", "name"])


@dataclass
class Config:
    """Settings: excludes, mappings (pattern -> schema), registries, rewrites (prefix -> prefix) and overrides, in file order."""

    root: bool = False
    exclude: list[str] = field(default_factory=list)
    schemas: dict[str, str] = field(default_factory=dict)
    no_default_catalog: bool = False
    registries: list[str] = field(default_factory=list)
    rewrite: dict[str, str] = field(default_factory=dict)
    overrides: list[dict[str, Any]] = field(default_factory=list)

    KNOWN = ("root", "exclude", "schemas", "no-default-catalog", "registries", "rewrite", "override", "format")

    @classmethod
    def parse(cls, text: str) -> Config:
        """From TOML; unknown settings are errors."""
        import tomllib

        found = tomllib.loads(text)
        if unknown := set(found) - set(cls.KNOWN):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(bool(found.get("root")), list(found.get("exclude", [])), dict(found.get("schemas", {})), bool(found.get("no-default-catalog")), list(found.get("registries", [])), dict(found.get("rewrite", {})), list(found.get("override", [])))

    def under(self, parent: Config) -> Config:
        """This, with what a parent folder's settings add: lists follow, keys of the child win, registries are kept once."""
        return Config(parent.root, self.exclude + parent.exclude, parent.schemas | self.schemas, self.no_default_catalog or parent.no_default_catalog, list(dict.fromkeys(self.registries + parent.registries)), parent.rewrite | self.rewrite, self.overrides + parent.overrides)

    def mapping_table(self, spark: SparkSession) -> DataFrame:
        return pattern_rows(spark, [(i, p, u) for i, (p, u) in enumerate(self.schemas.items())], ["ord", "pattern", "url"])

    def rewrite_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(self.rewrite.items())], "ord int, `from` string, `to` string")

    def override_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, p, s, o.get("validate_formats")) for i, o in enumerate(self.overrides) for p, s in [*((f, None) for f in o.get("files", [])), *((None, s) for s in o.get("schemas", []))]]
        return spark.createDataFrame(rows, "ord int, file string, schema string, validate_formats boolean")


def merge_settings(chain: Sequence[Config]) -> Config:
    """Settings from a leaf folder up; those above the nearest root do not count."""
    out = chain[0] if chain else Config()
    for parent in chain[1:]:
        if out.root:
            break
        out = out.under(parent)
    return out


def settings_chain(configs: DataFrame, folders: DataFrame) -> DataFrame:
    """For every folder the settings that apply to it, nearest first, up to the nearest root: ``folder, dir, rank, body``.

    ``configs`` has ``dir, body, root``; ancestors are prefixes of the path, joined by equality.
    """
    from pyspark.sql import Window

    parts = F.split("folder", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rows = folders.select("folder", F.posexplode(prefixes).alias("depth", "dir")).join(configs, "dir")
    near = Window.partitionBy("folder").orderBy(F.desc("depth"))
    roots = F.sum(F.col("root").cast("int")).over(near.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("rank", F.row_number().over(near)).withColumn("__above", F.coalesce(roots, F.lit(0))).filter("__above = 0").select("folder", "dir", "rank", "body")


def folded_settings(configs: DataFrame, folders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The settings of every folder (``folder``), merged up to the nearest root as :func:`merge_settings` does, without the driver.

    ``configs`` has ``dir, root``, and of ``exclude, registries`` (arrays), ``schemas, rewrite`` (maps), ``no_default_catalog`` (boolean) what there is; a missing
    one counts as empty. The result: ``folder, exclude, registries, no_default_catalog``, lists child first, registries kept once; and the maps as rows ``folder, setting, ord, key, value``,
    where the nearest folder's value of a key stands and rows are numbered in the order of their folders.
    """
    from pyspark.sql import Window

    empty = {"exclude": "array<string>", "registries": "array<string>", "schemas": "map<string,string>", "rewrite": "map<string,string>", "no_default_catalog": "boolean"}
    whole = configs.withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in configs.columns})
    near = settings_chain(whole.select("dir", "root", F.struct(*empty).alias("body")), folders.select("folder").distinct())
    lists = near.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("rank", "body.exclude", "body.registries"))).alias("c"), F.coalesce(F.bool_or("body.no_default_catalog"), F.lit(False)).alias("no_default_catalog"))
    joined = lambda name: F.flatten(F.transform("c", lambda x: F.coalesce(x[name], F.array().cast("array<string>"))))
    lists = lists.select("folder", joined("exclude").alias("exclude"), F.array_distinct(joined("registries")).alias("registries"), "no_default_catalog")
    rows = None
    for setting in ("schemas", "rewrite"):
        part = near.select("folder", "rank", F.lit(setting).alias("setting"), F.posexplode(f"body.{setting}").alias("__pos", "key", "value"))
        rows = part if rows is None else rows.unionByName(part)
    first = Window.partitionBy("folder", "setting", "key").orderBy("rank", F.desc("__pos"))
    order = Window.partitionBy("folder", "setting").orderBy("rank", "__pos")
    rows = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").withColumn("ord", F.row_number().over(order) - 1)
    return lists, rows.select("folder", "setting", "ord", "key", "value")


def schema_store(spark: SparkSession, bodies: dict[str, Any], fetched_at: str = "1970-01-01 00:00:00") -> DataFrame:
    """``uri, uri_hash, content_hash, body, fetched_at`` of parsed schemas."""
    rows = spark.createDataFrame([(u, json.dumps(b, ensure_ascii=False)) for u, b in bodies.items()], "uri string, body string")
    return rows.select("uri", F.sha2("uri", 256).alias("uri_hash"), F.sha2("body", 256).alias("content_hash"), "body", F.to_timestamp(F.lit(fetched_at)).alias("fetched_at"))
