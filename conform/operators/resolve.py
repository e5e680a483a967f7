"""Which schema belongs to which document: inline reference, else user mapping, else catalog; then rewrites and overrides.

Pattern tables are small (users' settings and catalogs); their size is checked before they are broadcast. Above it
the joins on keys run as shuffled ones, and only patterns without any literal meet every path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.functions.text import normalize_path

#: Patterns up to which a pattern table is broadcast.
FEW_PATTERNS = 100_000


def _small(patterns: DataFrame) -> DataFrame:
    return F.broadcast(patterns) if patterns.count() <= FEW_PATTERNS else patterns


def _matches(path: Column) -> Column:
    """Whether a path matches a pattern row; ``turned`` patterns begin with an odd number of ``!``."""
    return F.rlike(path, F.col("regex")) != F.col("turned")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def all_matches(docs: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """Every (document, pattern) that match, by the plain theta join."""
    return docs.join(_small(patterns), _matches(F.col(path)))


def all_matches_by_strategy(docs: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """The same rows as :func:`all_matches`, by an index of the patterns: every join is one on a key, but for patterns without any literal.

    Literal paths, base names and extensions are keys of their own. All other globs are found by a text that their paths must begin with, end with or
    hold; prefixes, suffixes and substrings of a path are made for the lengths that occur (32, 32 and 6 at most), and the glob is compared with what they find.
    """
    small = _small(patterns)
    rows = docs.withColumns({"__base": basename(F.col(path)), "__ext": F.when(basename(F.col(path)).contains("."), F.substring_index(F.col(path), ".", -1))})
    lengths: dict[str, list[int]] = {}
    for r in patterns.select("strategy", F.length("key").alias("n")).distinct().collect():  # lengths of keys, no more than 32 for each kind that is used below
        lengths.setdefault(r[0], []).append(r[1])
    text = F.col(path)
    out = None
    for strategy, sizes in sorted(lengths.items()):
        few = small.filter(F.col("strategy") == strategy)
        if strategy in ("literal", "basename", "extension"):
            key = {"literal": path, "basename": "__base", "extension": "__ext"}[strategy]
            part = rows.join(few, F.col(key) == F.col("key"))
        elif strategy == "rest":
            part = rows.join(few, _matches(text))
        else:
            if strategy == "inner":
                each = [F.when(F.length(text) >= n, F.array_distinct(_substrings(text, n))) for n in sizes]
                keys = F.flatten(F.array_compact(F.array(*each)))
            else:
                side = F.left if strategy == "prefix" else F.right
                keys = F.array_compact(F.array(*[F.when(F.length(text) >= n, side(text, F.lit(n))) for n in sizes]))
            part = rows.withColumn("__key", F.explode(keys)).join(few, F.col("__key") == F.col("key")).filter(_matches(text)).drop("__key")
        out = part if out is None else out.unionByName(part)
    return (rows.join(small, F.lit(False)) if out is None else out).drop("__base", "__ext")


def _substrings(text: Column, size: int) -> Column:
    """All of a text's parts of a size."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))


def resolve_catalog(docs: DataFrame, patterns: DataFrame, id_col: str = "doc_id", path: str = "path", by_strategy: bool = True) -> DataFrame:
    """``id, match``: the first matching pattern of the first catalog, ``struct<cat_ord, entry_ord, pat_ord, pattern, url, name>``; documents without one are left out."""
    found = (all_matches_by_strategy if by_strategy else all_matches)(docs.select(id_col, path), patterns, path)
    match = F.struct("cat_ord", "entry_ord", "pat_ord", "pattern", "url", "name")
    return found.groupBy(id_col).agg(F.min_by(match, F.struct("cat_ord", "entry_ord", "pat_ord")).alias("match"))


def resolve_mapping(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", path: str = "path") -> DataFrame:
    """``id, mapped``: the first mapping whose pattern matches the path or the base name."""
    rows = docs.select(id_col, path)
    found = all_matches_by_strategy(rows, mappings, path).unionByName(all_matches_by_strategy(rows.withColumn(path, basename(F.col(path))), mappings, path))
    return found.groupBy(id_col).agg(F.min_by("url", "ord").alias("mapped"))


def apply_rewrites(docs: DataFrame, rules: DataFrame, uri: str = "schema_uri", out: str = "schema_uri") -> DataFrame:
    """Replace the longest matching prefix of a URI. The rules are few and broadcast; distinct URIs are few as well, so each is rewritten once."""
    rules = rules.withColumnsRenamed({"from": "__from", "to": "__to"})
    uris = docs.select(uri).distinct().filter(F.col(uri).isNotNull())
    best = uris.join(_small(rules), F.col(uri).startswith(F.col("__from"))).groupBy(uri).agg(F.max_by(F.struct("__from", "__to"), F.length("__from")).alias("__r"))
    new = F.when(F.col("__r").isNull(), F.col(uri)).otherwise(F.concat(F.col("__r.__to"), F.substring(F.col(uri), F.length("__r.__from") + 1, F.length(uri))))
    return docs.join(best, uri, "left").withColumn(out, new).drop("__r")


def resolve_uri_path(uri: Column, path: Column, source: Column, config_dir: str = "") -> Column:
    """``//x`` is under the settings' folder; a relative local URI is beside the file if the file names it, else under the settings' folder."""
    local = ~uri.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") & ~uri.startswith("/")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    root = F.lit(config_dir.rstrip("/") + "/" if config_dir else "")
    return (
        F.when(uri.startswith("//"), normalize_path(F.concat(root, F.substring(uri, F.lit(3), F.length(uri)))))
        .when(local & (source == "inline"), normalize_path(F.concat(folder, uri)))
        .when(local, normalize_path(F.concat(root, uri)))
        .otherwise(uri)
    )


def resolve_schema(docs: DataFrame, inline: Column, mappings: DataFrame | None = None, patterns: DataFrame | None = None, id_col: str = "doc_id", path: str = "path") -> DataFrame:
    """Add ``schema_uri, source`` (inline, mapping or catalog) and ``match``; both null where nothing applies."""
    out = docs.withColumn("__inline", inline)
    if mappings is not None:
        out = out.join(resolve_mapping(docs, mappings, id_col, path), id_col, "left")
    else:
        out = out.withColumn("mapped", F.lit(None).cast("string"))
    if patterns is not None:
        out = out.join(resolve_catalog(docs, patterns, id_col, path), id_col, "left")
    else:
        out = out.withColumn("match", F.lit(None).cast("struct<cat_ord:int,entry_ord:int,pat_ord:int,pattern:string,url:string,name:string>"))
    out = out.withColumn("schema_uri", F.coalesce("__inline", "mapped", "match.url"))
    source = F.when(F.col("__inline").isNotNull(), "inline").when(F.col("mapped").isNotNull(), "mapping").when(F.col("match").isNotNull(), "catalog")
    return out.withColumn("source", source).drop("__inline", "mapped")


def identify(docs: DataFrame, inline: Column, mappings: DataFrame | None = None, patterns: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """How each document's schema was found: ``id, path, schema_uri, source, matched_pattern, name``."""
    out = resolve_schema(docs, inline, mappings, patterns, id_col)
    by_catalog = F.col("source") == "catalog"
    return out.select(id_col, "path", "schema_uri", "source", F.when(by_catalog, F.col("match.pattern")).alias("matched_pattern"), F.when(by_catalog, F.col("match.name")).alias("name"))


def format_checks(docs: DataFrame, file_rules: Sequence[tuple[int, Sequence[str], Sequence[str], bool | None]], original: str = "original_uri", uri: str = "schema_uri", path: str = "path") -> DataFrame:
    """Add ``validate_formats``: the first rule with a matching file or schema pattern *and* a value decides, true without one.

    Schemas are matched as first found and as rewritten, paths without a leading ``./``. The rules belong to the settings, so they are part of the expression.
    """
    from conform.functions.globs import glob_match

    value, bare = F.lit(True), F.regexp_replace(path, r"^\./", "")
    for _, files, schemas, checks in sorted(file_rules, key=lambda r: -r[0]):
        if checks is None:
            continue
        hit = F.lit(False)
        for p in files:
            hit = hit | glob_match(bare, p)
        for p in schemas:
            hit = hit | F.coalesce(glob_match(F.col(original), p), F.lit(False)) | F.coalesce(glob_match(F.col(uri), p), F.lit(False))
        value = F.when(hit, F.lit(checks)).otherwise(value)
    return docs.withColumn("validate_formats", value)


def group_format_checks(docs: DataFrame, uri: str = "schema_uri") -> DataFrame:
    """A schema's formats are checked only if every document of its group wants it. Flags are added up before the shuffle, then joined back."""
    flags = docs.groupBy(F.col(uri).alias("__uri")).agg(F.bool_and("validate_formats").alias("group_formats"))
    return docs.join(flags, F.col(uri).eqNullSafe(F.col("__uri")), "left").drop("__uri")


def prefix_join(rows: DataFrame, keys: DataFrame, text: str, key: str) -> DataFrame:
    """All keys that are prefixes of a text, by equality on the text's prefixes of the lengths that keys have: one hash join, no comparison of all with all.

    The lengths that occur are read first, at most as many numbers as the longest key has characters; a row gives a prefix for each of them.
    """
    sizes = sorted(r[0] for r in keys.select(F.length(key)).filter(F.col(key).isNotNull()).distinct().collect())
    prefixes = F.array(*[F.when(F.length(text) >= n, F.left(F.col(text), F.lit(n))) for n in sizes]) if sizes else F.array().cast("array<string>")
    return rows.withColumn("__p", F.explode(F.array_compact(prefixes))).join(keys, F.col("__p") == F.col(key)).drop("__p")


def matching_any(docs: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """The documents whose path matches at least one row of a pattern table, each once; distinct paths are compared."""
    hit = all_matches_by_strategy(docs.select(path).distinct(), patterns.select("regex", "turned", "strategy", "key").distinct(), path).select(path).distinct()
    return docs.join(hit, path, "left_semi")


#: Pieces of a name of which one must stand unchanged in another within three edits, and how far it may have moved.
PIECES, MOVED = 4, 3


def _pieces(n: Column) -> Column:
    """Where a name of ``n`` characters is cut: ``array<struct<p, at, size>>``."""
    cut = lambda p: F.floor(n * p / PIECES).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda p: F.struct(p.alias("p"), (cut(p) + 1).alias("at"), (cut(p + 1) - cut(p)).alias("size")))


def _subsequences(name: Column) -> Column:
    """What is left of a name of at most six characters if any of them are taken out."""
    letters = F.filter(F.split(name, ""), lambda c: c != "")
    return F.aggregate(letters, F.array(F.lit("")), lambda done, c: F.array_distinct(F.concat(done, F.transform(done, lambda d: F.concat(d, c)))))


def _declared_keys(name: Column) -> Column:
    n = F.length(name)
    long = F.transform(_pieces(n), lambda x: F.concat_ws(":", n.cast("string"), x["p"].cast("string"), F.substring(name, x["at"], x["size"])))
    wide = F.when(F.octet_length(name) >= 2 * n, F.array(F.lit("wide"))).otherwise(F.array().cast("array<string>"))
    short = F.concat(F.transform(F.filter(_subsequences(name), lambda s: s != ""), lambda s: F.concat(F.lit("s:"), s)), wide, F.array(F.lit("any")))
    return F.when(n > MOVED, long).otherwise(short)


def _sought_keys(name: Column) -> Column:
    n = F.length(name)
    sizes = F.sequence(F.greatest(n - MOVED, F.lit(MOVED + 1)), F.greatest(n + MOVED, F.lit(MOVED + 1)))
    moved = lambda m, x: F.transform(F.sequence(F.greatest(x["at"] - MOVED, F.lit(1)), x["at"] + MOVED), lambda i: F.concat_ws(":", m.cast("string"), x["p"].cast("string"), F.substring(name, i, x["size"])))
    long = F.flatten(F.transform(sizes, lambda m: F.flatten(F.transform(_pieces(m), lambda x: moved(m, x)))))
    wide = F.when(F.octet_length(name) >= 2 * n, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>"))
    short = F.concat(F.transform(F.filter(_subsequences(name), lambda s: s != ""), lambda s: F.concat(F.lit("s:"), s)), F.array(F.lit("wide")), wide)
    return F.array_distinct(F.when(n <= 2 * MOVED, F.concat(long, short)).otherwise(long))


def suggest(unexpected: DataFrame, declared: DataFrame, on: Sequence[str], name: str = "property", known: str = "known", order: str = "ord") -> DataFrame:
    """Add ``suggestion``: the nearest declared name within three edits that are at most half of the longer name's bytes; the first of equals.

    Names meet by keys, not all with all: a name of more than three characters is cut into four pieces, and within three edits one of them stands unchanged, at most
    three places away. Shorter names meet by what is left when characters are taken out, or, if none is shared, as names of wide characters. What meets
    is verified. Distinct names are compared, so repeated ones cost nothing; a schema with very many names is spread by its keys.
    """
    low = lambda c: F.lower(F.col(c))
    sought = unexpected.select(*on, name).distinct().withColumn("__k", F.explode(_sought_keys(low(name))))
    keyed = declared.select(*on, known, order).withColumn("__k", F.explode(F.array_distinct(_declared_keys(low(known)))))
    pairs = sought.join(keyed, [*on, "__k"]).drop("__k").distinct()
    d = F.levenshtein(low(name), low(known), 3)  # -1 beyond three edits
    near = (d >= 0) & (d * 2 <= F.greatest(F.octet_length(name), F.octet_length(known)))
    best = pairs.withColumn("__d", d).filter(near).groupBy(*on, name).agg(F.min_by(known, F.struct("__d", order)).alias("suggestion"))
    return unexpected.join(best, [*on, name], "left")


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")
