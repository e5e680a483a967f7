"""Building a catalog of schemas, and flat tables of what a schema allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conform.functions.text import first_line, ref_name, version_key
from conform.functions.urls import filename_of, schema_page_url
from conform.operators.schemagraph import LISTS, _unquoted, lookup_pointer
from conform.plans.stored import meet, numbered, stored
from conform.sources.documents import FORMATS

LARGEST = 10 * 1024 * 1024
#: Root keys that stand first, in this order, in a written schema.
FIRST_KEYS = ("$schema", "$id", "title", "description", "$comment", "type")
CONSTRAINTS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "format", "minItems", "maxItems", "uniqueItems", "minContains", "maxContains", "minProperties", "maxProperties", "contentEncoding", "contentMediaType", "const", "default")


# -- entries ----------------------------------------------------------------


def first_entries(entries: DataFrame, key: str = "url", order: str = "entry_ord") -> DataFrame:
    """Entries without later ones of the same URL."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return entries.withColumn("__n", n).filter("__n = 1").drop("__n")


def source_entries(entries: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """A source's entries: first of each URL, none whose URL matches an exclude pattern."""
    from conform.functions.globs import glob_match

    rows = first_entries(entries)
    for p in exclude:
        rows = rows.filter(~glob_match(F.col("url"), p))
    return rows


def implicit_members(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Schema files of group folders (``group, key, path``) that no group lists (``group, key``)."""
    return files.join(listed.select("group", "key"), ["group", "key"], "left_anti")


def unique_slugs(rows: DataFrame, folder: str, slug: str, order: str) -> DataFrame:
    """Slugs made unique within a folder: ``x, x-2, x-3``."""
    n = F.row_number().over(Window.partitionBy(folder, slug).orderBy(order))
    return rows.withColumn("__n", n).withColumn(slug, F.when(F.col("__n") == 1, F.col(slug)).otherwise(F.concat(slug, F.lit("-"), F.col("__n").cast("string")))).drop("__n")


def unique_filenames(rows: DataFrame, folder: str, url: str, order: str) -> DataFrame:
    """Add ``file``: the URL's file name, with a number before its extension where it would come again. A number that gives a name which is
    taken is passed over: names that are equal after a first numbering are numbered once more, until none is.
    """
    own = filename_of(F.col(url))
    w = Window.partitionBy(folder, "__stem").orderBy(order)
    numbered = lambda k: F.when(k == 1, F.col("__stem")).otherwise(F.regexp_replace("__stem", r"(\.[^.]*)$", F.concat(F.lit("-"), k.cast("string"), F.lit("$1"))))
    out = rows.withColumns({"__own": own, "__stem": own})
    out = stored(out.withColumn("__k", F.row_number().over(w)).withColumn("file", numbered(F.col("__k"))), "file-names")
    while True:
        # of rows with the same name, one whose own name it is keeps it, else the first; the others count on
        rank = F.row_number().over(Window.partitionBy(folder, "file").orderBy((F.col("file") != F.col("__own")).cast("int"), order))
        clash = stored(out.withColumn("__r", rank), "file-names")
        if clash.filter("__r > 1").isEmpty():
            return clash.drop("__own", "__stem", "__k", "__r")
        last = F.max("__k").over(Window.partitionBy(folder, "__stem"))
        later = F.row_number().over(Window.partitionBy(folder, "__stem", (F.col("__r") > 1)).orderBy(order))
        k = F.when(F.col("__r") > 1, F.col("__last") + F.col("__later")).otherwise(F.col("__k"))
        out = clash.withColumns({"__last": last, "__later": later}).withColumn("__k", k).withColumn("file", F.when(F.col("__r") > 1, numbered(F.col("__k"))).otherwise(F.col("file"))).drop("__last", "__later", "__r")


def output_collisions(rows: DataFrame, dest: str) -> DataFrame:
    """Destinations that more than one entry would be written to."""
    return rows.groupBy(dest).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


#: Rules of one source that become part of a plan.
MOST_RULES = 2_000


def classify_entries(entries: DataFrame, rules: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Add ``dir`` to entries by rules ``dir, kind (url or match), pattern``; without one it is the source's name. Entries with several folders are returned apart, with an error.

    Parts between ``**`` have to stand in the text in order; rules are few, so their expressions are part of the plan; more than ``MOST_RULES`` are an error.
    """
    found = rules.take(MOST_RULES + 1)
    if len(found) > MOST_RULES:
        raise ValueError(f"a source has more than {MOST_RULES} rules")
    hits = [F.when((F.col("url") == r.pattern) if r.kind == "url" else _any_part(r.pattern), F.lit(r.dir)) for r in found]
    rows = entries.withColumn("__dirs", F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>"))
    fine = rows.filter(F.size("__dirs") <= 1).withColumn("dir", F.coalesce(F.get("__dirs", 0), F.lit(source))).drop("__dirs")
    several = rows.filter(F.size("__dirs") > 1).withColumn("message", F.concat(F.lit("matches several folders: "), F.array_join("__dirs", ", "))).drop("__dirs")
    return fine, several


def _any_part(pattern: str) -> Column:
    from conform.functions.globs import ordered_parts_match

    return F.exists("file_match", lambda m: ordered_parts_match(pattern, m))


def latest_versions(entries: DataFrame, store: DataFrame) -> DataFrame:
    """The version whose body is the latest's, the highest of several: ``name, version``. ``entries`` has ``name, url, versions``."""
    digest = store.select("uri", F.sha2("body", 256).alias("h"))
    latest = entries.join(digest, entries["url"] == digest["uri"]).select("name", "h")
    each = entries.select("name", F.explode("versions").alias("version", "vurl")).join(digest, F.col("vurl") == F.col("uri")).select("name", "version", "h")
    both = latest.join(each, ["name", "h"])
    plain = F.max(version_key(F.col("version")).isNull()).over(Window.partitionBy("name"))
    ranked = both.withColumn("__text", plain)
    best = ranked.groupBy("name", "__text").agg(F.max_by("version", F.struct(version_key(F.col("version")).alias("k"), F.col("version"))).alias("a"), F.max("version").alias("b"))
    return best.select("name", F.when(F.col("__text"), F.col("b")).otherwise(F.col("a")).alias("version"))


def with_defaults(entries: DataFrame) -> DataFrame:
    """Name and description from settings, then metadata, then the schema's title and the first line of its description, then the key; globs likewise."""
    return entries.select(
        "*", F.coalesce("config_name", "meta_name", "title", "key").alias("entry_name"), F.coalesce("config_description", "meta_description", first_line(F.col("schema_description"))).alias("entry_description"),
        F.coalesce(F.when(F.size("catalog_match") > 0, F.col("catalog_match")), "meta_match", "root_match", F.array().cast("array<string>")).alias("entry_match"),
    )


def parsers_of(globs: Column) -> Column:
    """The formats that file globs mean, distinct and in order."""
    ext = F.transform(globs, lambda g: F.regexp_extract(g, r"\.([^./\\*]+)$", 1))
    mapped = F.transform(ext, lambda e: F.try_element_at(F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v)]), e))
    return F.array_sort(F.array_distinct(F.array_compact(mapped)))


#: Messages of a compiler that do not make a schema invalid, since they come of what it cannot fetch.
TOLERATED = ("does not exist", "is not of type", "is not valid under any of the schemas listed in the", "does not match")


def tolerated(message: Column) -> Column:
    """Whether a message leaves a schema valid."""
    out = F.lit(False)
    for part in TOLERATED:
        out = out | message.contains(part)
    return out


def with_provenance(entries: DataFrame, errors: DataFrame) -> DataFrame:
    """Add ``provenance``: source, digest, whether the schema is invalid, globs, parsers, description."""
    bad = errors.filter(~tolerated(F.col("message"))).select(F.col("uri").alias("url")).distinct().withColumn("__bad", F.lit(True))
    rows = entries.join(bad, "url", "left")
    return rows.withColumn("provenance", F.struct(F.col("source_url").alias("source"), F.sha2("body", 256).alias("source_sha256"), F.coalesce("__bad", F.lit(False)).alias("invalid"), F.col("file_match"), parsers_of(F.col("file_match")).alias("parsers"), F.col("description").alias("catalog_description"))).drop("__bad")


def too_large(store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schemas within the size limit, and an error row for each that is not."""
    n = F.octet_length("body")
    return store.filter(n <= LARGEST), store.filter(n > LARGEST).select("uri", F.concat(F.lit("schema is larger than 10 MiB: "), n.cast("string")).alias("message"))


def root_key_order(nodes: DataFrame) -> DataFrame:
    """Root keywords with their place in a written schema: known ones first, the others as they came."""
    known = F.array_position(F.array(*[F.lit(k) for k in FIRST_KEYS]), F.col("key"))
    return nodes.withColumn("pos", F.when(F.col("parent") == "", F.when(known > 0, known).otherwise(100 + F.col("pos"))).otherwise(F.col("pos")))


def united_entries(parts: Sequence[DataFrame]) -> DataFrame:
    """The entries of groups and sources as one table, in their order, the first of each URL; ``entry_ord`` is counted on."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no entries")
    first = F.row_number().over(Window.partitionBy("url").orderBy("__part", "entry_ord"))
    kept = out.withColumn("__n", first).filter("__n = 1").drop("__n")
    return numbered(kept.withColumnRenamed("entry_ord", "__ord"), ["__part", "__ord", "url"], "entry_ord").drop("__part", "__ord")


def groups_of(entries: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and sizes of each group (same-named ones together), and entries in none."""
    members = membership.groupBy("group").agg(F.array_sort(F.collect_list("name")).alias("schemas"), F.count(F.lit(1)).alias("n"))
    return members, entries.join(membership.select("name").distinct(), "name", "left_anti")


def catalog_document(entries: DataFrame, groups: DataFrame, title: str) -> DataFrame:
    """The catalog as one JSON document. A catalog has a row for each schema, so its text is what one file can hold."""
    one = F.struct("entry_ord", F.to_json(F.struct("name", "description", "url", F.col("file_match").alias("fileMatch"), "versions")).alias("j"))
    schemas = entries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ",").alias("s"))
    parts = groups.agg(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(F.col("group").alias("name"), "schemas")))), ",").alias("g"))
    return schemas.crossJoin(parts).select(F.concat(F.lit(f'{{"version":1,"title":"{title}","schemas":['), "s", F.lit('],"groups":['), "g", F.lit("]}")).alias("value"))  # one row each


def write_schemas(rows: DataFrame, path: str) -> None:
    """Schemas laid out by group and slug: ``group, slug, version, body``."""
    rows.write.mode("overwrite").partitionBy("group", "slug").parquet(path)


def search_index(entries: DataFrame, membership: DataFrame, base: str) -> DataFrame:
    """``n, d, f, u, g``: name, description, globs, page and group of every entry with a page."""
    page = schema_page_url(F.col("url"), base)
    rows = entries.join(membership, "name", "left").filter(page.isNotNull())
    return rows.select(F.col("name").alias("n"), F.coalesce("description", F.lit("")).alias("d"), F.array_join("file_match", ", ").alias("f"), page.alias("u"), F.col("group").alias("g"))


# -- what schemas allow -----------------------------------------------------


def _facts(nodes: DataFrame) -> DataFrame:
    """One row for each schema position with its plain keywords beside each other: ``uri, owner, ...``."""
    text = lambda k: F.max(F.when(F.col("key") == k, F.coalesce("text", F.lit("")))).alias(k.strip("$") + "_text")
    kids = nodes.filter("prole = 'schema'").groupBy("uri", F.col("parent").alias("owner"))
    return kids.agg(text("type"), text("description"), text("markdownDescription"), text("default"), text("const"), text("title"), text("$ref"), F.max((F.col("key") == "enum")).alias("has_enum"), F.max(F.col("key") == "oneOf").alias("has_one"), F.max(F.col("key") == "anyOf").alias("has_any"))


def _list_of(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """The elements of an array keyword as texts: ``uri, owner, name``."""
    rows = nodes.filter(F.col("pkey").eqNullSafe(F.lit(key)) & F.col("text").isNotNull())
    cell = F.struct("pos", "text")
    return rows.groupBy("uri", F.regexp_replace("parent", f"/{key}$", "").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["text"]).alias(name))


def type_labels(nodes: DataFrame) -> DataFrame:
    """``uri, owner, label`` of every schema position: type (``x[]`` where items have a label, unions with ``|``), else the reference's name, the branches, ``const: v``, ``enum``.

    Labels of items and branches are worked out from the innermost outwards, a round for each level of them.
    """
    facts = meet(_facts(nodes), _list_of(nodes, "type", "types"), ["uri", "owner"], "left")
    own = F.when(F.col("types").isNotNull(), F.array_join(F.transform("types", lambda x: F.replace(x, F.lit('"'), F.lit(""))), " | ")).when(F.col("type_text") != "", F.replace("type_text", F.lit('"'), F.lit("")))
    ref = F.when(F.col("ref_text") != "", ref_name(_unquoted(F.col("ref_text"))))
    last = F.coalesce(F.when(F.col("const_text") != "", F.concat(F.lit("const: "), "const_text")), F.when(F.col("has_enum"), F.lit("enum")))
    rows = stored(facts.select("uri", "owner", own.alias("own"), ref.alias("ref"), last.alias("last")).withColumn("label", F.coalesce("own", "ref", "last")), "labels")
    step = r"/(items|(?:oneOf|anyOf)/\d+)$"
    while True:
        inner = rows.filter(F.col("label").isNotNull() & F.col("owner").rlike(step)).select("uri", F.regexp_replace("owner", step, "").alias("owner"), F.regexp_extract("owner", step, 1).alias("at"), "label")
        cell = F.struct(F.regexp_extract("at", r"(\d+)$", 1).cast("int").alias("i"), F.col("label").alias("t"))
        several = lambda word: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at").startswith(word), cell))), lambda c: c["t"]), " | ")
        below = inner.groupBy("uri", "owner").agg(F.max(F.when(F.col("at") == "items", F.col("label"))).alias("item"), several("oneOf").alias("one"), several("anyOf").alias("any"))
        branches = F.coalesce(F.when(F.col("one") != "", F.col("one")), F.when(F.col("any") != "", F.col("any")))
        label = F.when((F.col("own") == "array") & F.col("item").isNotNull(), F.concat("item", F.lit("[]"))).otherwise(F.coalesce("own", "ref", branches, "last"))
        after = stored(meet(rows, below, ["uri", "owner"], "left").select("uri", "owner", "own", "ref", "last", label.alias("label"), (~F.col("label").eqNullSafe(label)).alias("moved")), "labels")
        rows = after.drop("moved")
        if after.filter("moved").isEmpty():
            return rows.select("uri", "owner", "label")


def _labels(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    return type_labels(nodes) if labels is None else labels


def schema_properties(nodes: DataFrame, depth: int = 3, labels: DataFrame | None = None) -> DataFrame:
    """``uri, owner, name, depth, label, required, description, default_value, const_value, enum_values, examples, ord``: required ones first among equals of an owner.

    A property that is a reference within its schema is described by what it refers to, however many references lead there; one that leads
    elsewhere has the reference's name as its label. ``labels`` are those of :func:`type_labels`, where they are known already.
    """
    props = nodes.filter((F.col("prole") == "map") & (F.col("pkey") == "properties"))
    props = props.select("uri", F.col("id"), F.regexp_replace("parent", "/properties$", "").alias("owner"), F.col("key").alias("name"), F.col("pos").alias("ord"))
    level = (F.length("id") - F.length(F.replace("id", F.lit("/properties/"), F.lit("")))) / len("/properties/")
    props = props.withColumn("depth", level.cast("int")).filter(F.col("depth") <= depth)
    names = nodes.filter((F.col("pkey") == "required") & (F.col("jtype") == "STRING")).select("uri", F.regexp_replace("parent", "/required$", "").alias("owner"), _unquoted(F.col("text")).alias("name")).distinct().withColumn("required", F.lit(True))
    props = stored(props, "schema-properties")
    props = meet(props, lookup_pointer(nodes, props.select("uri", "id").distinct()), ["uri", "id"], "left").withColumn("at", F.coalesce("found", "id"))
    at = lambda df: df.withColumnRenamed("owner", "at")
    rows = meet(props, names, ["uri", "owner", "name"], "left")
    for more in (_facts(nodes), _labels(nodes, labels), _list_of(nodes, "enum", "enum_values"), _list_of(nodes, "examples", "examples")):
        rows = meet(rows, at(more), ["uri", "at"], "left")
    description = F.coalesce(_unquoted(F.col("markdownDescription_text")), _unquoted(F.col("description_text")))
    return rows.select("uri", "owner", "name", "depth", "label", F.coalesce("required", F.lit(False)).alias("required"), description.alias("description"), F.col("default_text").alias("default_value"), F.col("const_text").alias("const_value"), "enum_values", "examples", "ord")


def in_reading_order(properties: DataFrame) -> DataFrame:
    """Required properties first, else as written; for output only."""
    return properties.orderBy("uri", "owner", F.desc("required"), "ord")


def schema_constraints(nodes: DataFrame) -> DataFrame:
    """``uri, owner, keyword, value`` of every constraint."""
    return nodes.filter((F.col("prole") == "schema") & F.col("key").isin(*CONSTRAINTS) & F.col("text").isNotNull()).select("uri", F.col("parent").alias("owner"), F.col("key").alias("keyword"), F.col("text").alias("value"))


def schema_variants(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``uri, owner, keyword, ord, label`` of every branch: its title, else its reference's name, its type, or ``variant``."""
    rows = nodes.filter((F.col("prole") == "list") & F.col("pkey").isin(*LISTS[:3]))
    facts = _facts(nodes).select("uri", F.col("owner").alias("id"), "title_text", "ref_text")
    rows = meet(meet(rows, facts, ["uri", "id"], "left"), _labels(nodes, labels).withColumnRenamed("owner", "id"), ["uri", "id"], "left")
    name = F.coalesce(F.when(F.col("title_text") != "", _unquoted(F.col("title_text"))), F.when(F.col("ref_text") != "", ref_name(_unquoted(F.col("ref_text")))), "label", F.lit("variant"))
    return rows.select("uri", F.regexp_replace("parent", r"/(allOf|anyOf|oneOf)$", "").alias("owner"), F.col("pkey").alias("keyword"), F.col("pos").alias("ord"), name.alias("label"), F.col("ref_text").isNotNull().alias("by_reference"))


def schema_definitions(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    rows = nodes.filter((F.col("prole") == "map") & F.col("pkey").isin("$defs", "definitions"))
    return meet(rows, _labels(nodes, labels).withColumnRenamed("owner", "id"), ["uri", "id"], "left").select("uri", F.col("key").alias("name"), "label")


def schema_examples(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("pkey") == "examples") & F.col("text").isNotNull()).select("uri", F.regexp_replace("parent", "/examples$", "").alias("owner"), F.col("pos").alias("ord"), F.col("text").alias("value"))


def additional_and_items(nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Where items or additional properties have a schema of their own: ``uri, owner, keyword, label``."""
    rows = nodes.filter((F.col("prole") == "schema") & F.col("key").isin("additionalProperties", "items") & (F.col("jtype") == "OBJECT"))
    return meet(rows, _labels(nodes, labels).withColumnRenamed("owner", "id"), ["uri", "id"], "left").select("uri", F.col("parent").alias("owner"), F.col("key").alias("keyword"), "label")


def explain(nodes: DataFrame, violations: DataFrame, pointer: str, schema: str = "schema_uri") -> DataFrame:
    """Properties at a schema pointer with the violations under each: ``uri, name, label, required, errors``. Violations name their schema in the column ``schema``.

    Violations are counted by schema and by the step below the pointer first, so two small tables are joined by equality.
    """
    from conform.functions.text import instance_prefix, pointer_decode

    rows = schema_properties(nodes).filter(F.col("owner") == pointer)
    above = F.concat(instance_prefix(F.lit(pointer)), F.lit("/"))
    near = violations.filter(F.startswith(F.col("instance_path"), above)).select(F.col(schema).alias("uri"), pointer_decode(F.substring_index(F.substring("instance_path", F.length(above) + 1, F.length("instance_path")), "/", 1)).alias("name"))
    counts = near.groupBy("uri", "name").agg(F.count(F.lit(1)).alias("errors"))
    return rows.join(counts, ["uri", "name"], "left").select("uri", "name", "label", "required", F.coalesce("errors", F.lit(0)).alias("errors"))
