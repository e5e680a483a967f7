"""Documents: scanned, split into lines where they hold one value a line, and parsed into VARIANT."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conform.functions.globs import glob_to_regex
from conform.plans.stored import stored, worked_out

#: Extensions and the formats that they mean.
FORMATS = {"json": "jsonc", "jsonc": "jsonc", "json5": "json5", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "mdx": "markdown"}
ERROR = "struct<offset:int,message:string>"
JSON5 = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "allowNonNumericNumbers": "true", "allowBackslashEscapingAnyCharacter": "true"}


def format_of(path: Column) -> Column:
    """The format that a path's extension means; null for another."""
    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for name in dict.fromkeys(FORMATS.values()):
        out = out.when(ext.isin(*[k for k, v in FORMATS.items() if v == name]), F.lit(name))
    return out


def excluded(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path, without a leading ``./``, matches any of the patterns."""
    bare = F.regexp_replace(path, r"^\./", "")
    out = F.lit(False)
    for p in patterns:
        regex, turned = glob_to_regex(p)
        out = out | (~bare.rlike(regex) if turned else bare.rlike(regex))
    return out


def scan_documents(spark: SparkSession, paths: Sequence[str] = (".",), exclude: Sequence[str] = (), known_only: bool = True) -> DataFrame:
    """``doc_id, path, content, io_error`` of the files under the given paths, each once; ``.git`` is skipped.

    Spark's file sources never list names that begin with a dot or an underscore; a landing job has to rename those.
    The filters are on the path, before contents are decoded. Contents that are no UTF-8 become error rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(list(paths) or ["."])
    rows = files.filter(~F.col("path").rlike(r"/\.git/")).filter(~excluded(F.regexp_replace("path", "^[a-z]+:/*", "/"), exclude))
    if known_only:
        rows = rows.filter(format_of(F.col("path")).isNotNull())
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = rows.select("path", text.alias("content"), F.when(text.isNull(), "stream did not contain valid UTF-8").alias("io_error")).dropDuplicates(["path"])
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "content", "io_error")


def table_documents(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    """The rows of any table as JSON documents ``doc_id, path, content``."""
    return rows.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(f"{name}/"), F.col(id_col).cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(*rows.columns)).alias("content"))


#: A string in quotes. Possessive and unrolled: Java walks it in a loop, however long it is, and never goes back into it.
DOUBLE, SINGLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"'[^'\\]*+(?:\\.[^'\\]*+)*+'"


def strip_jsonc(content: Column, strings: str = DOUBLE) -> Column:
    """Comments and trailing commas taken out, strings left alone."""
    bare = F.regexp_replace(content, rf"(?s)({strings})|//[^\n]*+|/\*.*?\*/", "$1")
    return F.regexp_replace(bare, rf"(?s)({strings})|,(?=\s*+[}}\]])", "$1")


def parse_jsonc(content: Column) -> Column:
    """JSON with comments and trailing commas as VARIANT; null if malformed. Plain JSON, the usual case, is parsed once."""
    bare = F.regexp_replace(content, "^﻿", "")
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(strip_jsonc(bare)))


def parse_json5(content: Column) -> Column:
    """JSON5, as far as Spark's parser goes: comments, trailing commas, plain keys, single quotes, escapes, not-a-numbers."""
    wrapped = F.concat(F.lit('{"v":'), strip_jsonc(F.regexp_replace(content, "^﻿", ""), f"{DOUBLE}|{SINGLE}"), F.lit("}"))
    return F.coalesce(F.try_parse_json(content), F.try_variant_get(F.from_json(wrapped, "v variant", JSON5)["v"], "$", "variant"))


#: A token of JSON with comments; what is none is one character.
_TOKEN = (
    r'(?s)"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null|[ \t\r\n]++|//[^\n]*+|/\*.*?\*/|.'
)


def syntax_error(content: Column) -> Column:
    """The byte offset of the first token that cannot stand where it stands in JSON with comments and trailing commas, the text's length if it ends too early; null for a text without such a token.

    A token automaton: the text is cut into tokens by one pattern, and a fold over them carries what may follow (``v`` a value, ``e`` a value or the array's
    end, ``k`` a key or the object's end, ``c`` a colon, ``n`` a comma or an end) and the open brackets.
    """
    bare = F.regexp_replace(content, "^\ufeff", "")
    start = F.octet_length(content) - F.octet_length(bare)
    state = lambda want, stack, at, bad: F.struct(want.alias("want"), stack.alias("stack"), at.cast("int").alias("at"), bad.cast("int").alias("bad"))
    none = F.lit(None).cast("int")

    def step(s: Column, token: Column) -> Column:
        want, stack, first = s["want"], s["stack"], F.left(token, F.lit(1))
        blank = first.isin(" ", "\t", "\r", "\n") | token.startswith("//") | token.startswith("/*")
        takes = want.isin("v", "e")
        scalar = token.rlike(r'^(?:"..*|-?[0-9].*|true|false|null)$')
        text = (first == '"') & (F.length(token) > 1)
        top = F.left(stack, F.lit(1))
        closes = ((token == "}") & ((want == "k") | ((want == "n") & (top == "o")))) | ((token == "]") & ((want == "e") | ((want == "n") & (top == "a"))))
        after = (
            F.when(blank, want).when(closes, "n").when(takes & (token == "{"), "k").when(takes & (token == "["), "e").when(takes & (scalar | text), "n")
            .when((want == "k") & text, "c").when((want == "c") & (token == ":"), "v").when((want == "n") & (token == ",") & (top == "o"), "k").when((want == "n") & (token == ",") & (top == "a"), "e")
        )
        open_ = F.when(closes, F.substring(stack, F.lit(2), F.length(stack))).when(takes & (token == "{"), F.concat(F.lit("o"), stack)).when(takes & (token == "["), F.concat(F.lit("a"), stack)).otherwise(stack)
        bad = F.coalesce(s["bad"], F.when(after.isNull(), s["at"]))
        return state(F.coalesce(after, want), open_, s["at"] + F.octet_length(token), bad)

    first = state(F.lit("v"), F.lit(""), start, none)
    end = lambda s: F.coalesce(s["bad"], F.when((s["want"] != "n") | (s["stack"] != ""), s["at"]))
    return F.aggregate(F.regexp_extract_all(bare, F.lit(_TOKEN), F.lit(0)), first, step, end)


PARSED = "struct<json:string,message:string,offset:int,kind:string>"


def _library_parser() -> Callable[[Column, Column], Column]:
    """``(kind, text) -> struct<json, message, offset, kind>`` for YAML and TOML, in Arrow batches; the libraries' own grammars. Only these two columns travel.

    Of the kind ``any``, YAML and TOML are tried; a text that YAML takes for one plain string, as it does with many, is left to the later formats.
    """

    def one(kind: str | None, text: str | None, yaml: Any, tomllib: Any, json: Any) -> tuple[str | None, str | None, int | None, str | None]:
        if text is None or kind not in ("yaml", "toml", "any"):
            return None, None, None, kind
        if kind == "any":
            found = one("yaml", text, yaml, tomllib, json)
            return found if found[0] is not None and not found[0].startswith('"') else one("toml", text, yaml, tomllib, json)
        try:
            if kind == "toml":
                return json.dumps(tomllib.loads(text), default=str), None, None, kind
            if yaml is None:
                return None, "no YAML parser", 0, kind
            loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
            return json.dumps(yaml.load(text.replace("\ufeff", ""), loader), default=str), None, None, kind
        except Exception as e:  # a parser's error is a row
            mark = getattr(e, "problem_mark", None)
            return None, (str(e).splitlines() or [""])[0], len(text[: mark.index].encode("utf-8")) if mark is not None else 0, kind

    @F.pandas_udf(PARSED)
    def parse(kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        import json
        import tomllib

        try:
            import yaml
        except ImportError:  # gated: the parser may be missing on a cluster
            yaml = None
        found = [one(k, x, yaml, tomllib, json) for k, x in zip(kinds, texts, strict=True)]
        return pd.DataFrame({"json": [x[0] for x in found], "message": [x[1] for x in found], "offset": pd.array([x[2] for x in found], dtype="Int32"), "kind": [x[3] for x in found]})

    return parse


def frontmatter(content: Column) -> Column:
    """``struct<kind, body>`` of a Markdown text's leading block: ``---`` is YAML, ``+++`` is TOML; HTML comments before it are skipped."""
    lead = r"(?s)^\x{FEFF}?(?:\s*<!--.*?-->)*\s*"
    yaml = F.regexp_extract(content, lead + r"---[^\S\n]*\n(.*?)(?:(?<=\n)|^)---[^\S\n]*(?:\n|\z)", 1)
    toml = F.regexp_extract(content, lead + r"\+\+\+[^\S\n]*\n(.*?)(?:(?<=\n)|^)\+\+\+[^\S\n]*(?:\n|\z)", 1)
    is_yaml, is_toml = content.rlike(lead + r"---[^\S\n]*\n"), content.rlike(lead + r"\+\+\+[^\S\n]*\n")
    return F.when(is_yaml, F.struct(F.lit("yaml").alias("kind"), yaml.alias("body"))).when(is_toml, F.struct(F.lit("toml").alias("kind"), toml.alias("body")))


def normalize_documents(docs: DataFrame, any_format: Column | None = None) -> DataFrame:
    """Add ``format, instance VARIANT, parse_error``. A document whose extension means nothing is skipped unless ``any_format`` holds; then JSON with
    comments, YAML, TOML, JSON5 and Markdown are tried in this order, and ``format`` says which it was; one that is none of them is left out.

    JSON stays native; only rows of YAML, TOML and Markdown pass through the batched parsers.
    """
    rows = docs.withColumn("format", format_of(F.col("path")))
    if any_format is not None:
        rows = rows.withColumn("format", F.coalesce("format", F.when(any_format, "any")))
    json_rows = rows.filter(F.col("format").isin("jsonc", "json5"))
    instance = F.when(F.col("format") == "json5", parse_json5(F.col("content"))).otherwise(parse_jsonc(F.col("content")))
    json_rows = worked_out(json_rows, instance=instance)
    json_rows = json_rows.withColumn("parse_error", F.when(F.col("instance").isNull(), F.struct(F.when(F.col("format") == "jsonc", syntax_error(F.col("content"))).alias("offset"), F.lit("malformed JSON").alias("message"))).cast(ERROR))
    parse = _library_parser()
    other = rows.filter(F.col("format").isin("yaml", "toml", "markdown")).withColumn("__front", F.when(F.col("format") == "markdown", frontmatter(F.col("content"))))
    kind = F.when(F.col("format") == "markdown", F.col("__front.kind")).otherwise(F.col("format"))
    body = F.when(F.col("format") == "markdown", F.col("__front.body")).otherwise(F.col("content"))
    other = other.withColumn("__kind", kind).withColumn("__p", parse(F.col("__kind"), body))
    other = worked_out(other, instance=F.when(F.col("__kind").isNull(), F.parse_json(F.lit("null"))).otherwise(F.try_parse_json("__p.json")))
    other = other.withColumn("parse_error", F.when(F.col("__p.message").isNotNull(), F.struct(F.col("__p.offset").alias("offset"), F.col("__p.message").alias("message"))).cast(ERROR)).drop("__front", "__kind", "__p")
    out = json_rows.unionByName(other)
    if any_format is None:
        return out
    unknown = rows.filter("format = 'any'").withColumn("__json", parse_jsonc(F.col("content"))).withColumn("__front", F.when(F.col("__json").isNull(), frontmatter(F.col("content"))))
    unknown = unknown.withColumns({"__p": parse(F.when(F.col("__json").isNull(), F.lit("any")), F.col("content")), "__q": parse(F.col("__front.kind"), F.col("__front.body"))})
    tried = [(F.lit("jsonc"), F.col("__json")), (F.col("__p.kind"), F.try_parse_json("__p.json")), (F.lit("json5"), parse_json5(F.col("content"))), (F.lit("markdown"), F.try_parse_json("__q.json"))]
    unknown = unknown.withColumn("__found", F.coalesce(*[F.when(v.isNotNull(), F.struct(name.alias("format"), v.alias("instance"))) for name, v in tried])).filter("__found IS NOT NULL")
    unknown = unknown.withColumns({"format": F.col("__found.format"), "instance": F.col("__found.instance"), "parse_error": F.lit(None).cast(ERROR)})
    return out.unionByName(unknown.select(*out.columns))


def checkable(docs: DataFrame, uri: str = "schema_uri", instance: str = "instance") -> tuple[DataFrame, DataFrame]:
    """Documents that are checked, and ``reason, n`` of those that are not: null instances (Markdown without front matter) and documents without a schema."""
    reason = F.when(F.col(instance).isNull(), "unparsed").when(F.is_variant_null(instance), "null").when(F.col(uri).isNull(), "no schema")
    marked = docs.withColumn("__reason", reason)
    return marked.filter("__reason IS NULL").drop("__reason"), marked.filter("__reason IS NOT NULL").groupBy(F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def group_sizes(docs: DataFrame, uri: str = "schema_uri") -> DataFrame:
    """``uri, documents``: how many documents each schema has; counted before the shuffle."""
    return docs.filter(F.col(uri).isNotNull()).groupBy(uri).agg(F.count(F.lit(1)).alias("documents"))


def explode_jsonl(docs: DataFrame) -> DataFrame:
    """One row for each line that is not empty: ``doc_id, path, line, byte_offset, raw, instance``, the byte-order mark and line ends taken off."""
    bare = F.regexp_replace("content", "^﻿", "")
    mark = F.octet_length("content") - F.octet_length(bare)
    lines = docs.select("doc_id", "path", mark.alias("__mark"), F.posexplode(F.split(bare, "\n", -1)).alias("__i", "__raw"))
    size = F.sum(F.octet_length("__raw") + 1).over(Window.partitionBy("doc_id", "path").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("byte_offset", F.coalesce(size, F.lit(0)) + F.col("__mark")).withColumn("raw", F.regexp_replace("__raw", "\r$", ""))
    return lines.filter(F.trim("raw") != "").select("doc_id", "path", (F.col("__i") + 1).alias("line"), "byte_offset", "raw", F.try_parse_json("raw").alias("instance"))


def jsonl_failures(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of files whose lines all parse, and the first bad line of every other file."""
    bad = F.min(F.when(F.col("instance").isNull(), F.col("line"))).over(Window.partitionBy("path"))
    marked = lines.withColumn("__bad", bad)
    return marked.filter("__bad IS NULL").drop("__bad"), marked.filter("line = __bad").drop("__bad", "instance")


def jsonl_syntax_errors(bad: DataFrame) -> DataFrame:
    """Where the bad lines of :func:`jsonl_failures` break: ``path, line, column`` (in characters, from 1)``, offset`` (in bytes, in the file)."""
    at = F.coalesce(syntax_error(F.col("raw")), F.lit(0))
    before = F.decode(F.substring(F.encode("raw", "UTF-8"), F.lit(1), F.col("__at")), "UTF-8")
    return bad.withColumn("__at", at).select("path", "line", (F.length(before) + 1).alias("column"), (F.col("byte_offset") + F.col("__at")).alias("offset"))


def jsonl_schema_mismatches(lines: DataFrame) -> DataFrame:
    """Lines whose ``$schema`` differs from the first that their file declares: ``path, line, expected, found``."""
    uri = F.try_variant_get("instance", '$["$schema"]', "string")
    first = F.first(F.col("found"), ignorenulls=True).over(Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return lines.withColumn("found", uri).withColumn("expected", first).filter("found <> expected").select("path", "line", "expected", "found")


def inline_schema(format_: Column, content: Column, instance: Column) -> Column:
    """The schema that a document names itself: the ``$schema`` property, a YAML modeline in the leading comments, or a TOML comment."""
    prop = F.try_variant_get(instance, '$["$schema"]', "string")
    mark = lambda m: F.nullif(F.trim(F.regexp_extract(content, rf"^\x{{FEFF}}?(?:(?!\h*#\s*{m})\h*+(?:#[^\n]*+)?+\n)*+\h*#\s*{m}(\S[^\n]*)", 1)), F.lit(""))
    modeline, comment = mark(r"yaml-language-server:\s*\$schema="), mark(r"(?::schema|\$schema:)\s+")
    return F.when(format_ == "toml", comment).when(format_ == "yaml", F.coalesce(modeline, prop)).otherwise(prop)


NODE = "struct<pointer:string,parent:string,key:string,pos:int,depth:int,jtype:string,v:variant>"


def _jtype(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def node_array(value: Column, deepest: int = 12, pointer: Column | None = None, base: Column | None = None) -> Column:
    """All values inside a VARIANT as an array of structs: one expression, nested as deep as ``deepest``; pointers and depths continue those given."""
    step = lambda k: F.concat(F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))

    def children(v: Column) -> Column:
        entries = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e, i: F.struct(e["key"].alias("key"), i.alias("pos"), e["value"].alias("v")))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: F.struct(i.cast("string").alias("key"), i.alias("pos"), x.alias("v")))
        return F.coalesce(entries, items)

    def under(v: Column, at: Column, parent: Column, key: Column, pos: Column, depth: int) -> Column:
        level = F.lit(depth) if base is None else base + depth
        own = F.array(F.struct(at.alias("pointer"), parent.alias("parent"), key.alias("key"), pos.alias("pos"), level.alias("depth"), _jtype(v).alias("jtype"), v.alias("v")))
        if depth >= deepest:
            return own
        below = F.flatten(F.transform(children(v), lambda c: under(c["v"], F.concat(at, step(c["key"])), at, c["key"], c["pos"], depth + 1)))
        return F.concat(own, F.coalesce(below, F.array().cast(f"array<{NODE}>")))

    none = F.lit(None).cast("string")
    return under(value, F.lit("") if pointer is None else pointer, none, none, F.lit(0), 0)


def explode_nodes(docs: DataFrame, instance: str = "instance", id_col: str = "doc_id", deepest: int = 12, whole: bool = True) -> DataFrame:
    """A row for every value of every document: ``doc_id, pointer, parent, key, pos, depth, jtype, v``; no shuffle.

    One scan gives ``deepest`` levels. Containers that stand at the last level are written and opened in another round, until none is left; a stream,
    or ``whole=False``, has only the first round, and what is deeper stays inside its ancestor's row.
    """
    rows = docs.filter(F.col(instance).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(node_array(F.col(instance), deepest)).alias("n")).select("doc_id", "n.*")
    if not whole or docs.isStreaming:
        return rows
    out, part, level = rows, rows, deepest
    while True:
        part = stored(part.filter((F.col("depth") == level) & F.col("jtype").isin("OBJECT", "ARRAY")).select("doc_id", "pointer", "depth", "v"), "deep-nodes")
        if part.isEmpty():
            return out
        nodes = node_array(F.col("v"), deepest, F.col("pointer"), F.col("depth"))
        part = part.select("doc_id", F.explode(F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0)))).alias("n")).select("doc_id", "n.*")
        out, level = out.unionByName(part), level + deepest


def convert_documents(docs: DataFrame, to: str) -> DataFrame:
    """Add ``converted``: the instance as JSON, YAML or TOML text. JSON is native; the others are written in Arrow batches."""
    if to == "json":
        return docs.withColumn("converted", F.to_json("instance"))
    rows = docs.withColumn("__json", F.to_json("instance")).drop("instance")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        def toml(value: dict, prefix: str = "") -> str:
            plain = [f"{json.dumps(k)} = {json.dumps(v)}" for k, v in value.items() if not isinstance(v, dict) and v is not None]
            tables = [f"\n[{prefix}{json.dumps(k)}]\n{toml(v, f'{prefix}{json.dumps(k)}.')}" for k, v in value.items() if isinstance(v, dict)]
            return "\n".join(plain + tables)

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            value = json.loads(text)
            if to == "yaml":
                import yaml

                return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)
            return toml(value) + "\n" if isinstance(value, dict) else None

        for frame in frames:
            frame["converted"] = [one(x) for x in frame["__json"]]
            yield frame.drop(columns="__json")

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__json")
    return rows.mapInPandas(run, f"{ddl}, converted string")
