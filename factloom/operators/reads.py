"""What code reads and calls, from its text with comments left out: URLs (X2), calls of a front end (X3), outbound sinks (X4), data usage.

Files are (root_name, rel_path, content), one row a path. Matches that start in a comment do not count; a file without content has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import extension
from . import lexing
from .scans import locate_patterns

FILE = lexing.FILE

# Fixed values.
CODE_FILES = ("go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rb", "java", "kt", "swift", "cs", "php", "rs", "scala", "dart", "vue")
ABSOLUTE_URL = r"[\"'`](https?://[a-zA-Z0-9][a-zA-Z0-9.\-]*[^\"'`\s]*)[\"'`]"
DYNAMIC_URL = r"[\"'`](https?://[^\"'`]*?)(\$\{|\"\s*\+|'\s*\+|`\s*\+)"
NO_ENDPOINTS = (
    "http://www.w3.org/", "https://www.w3.org/", "http://schemas.xmlsoap.org/", "http://schema.org/", "https://schema.org/", "http://www.apache.org/licenses/", "https://opensource.org/licenses/", "http://purl.org/",
    "http://xmlns.com/", "https://spdx.org/licenses/",
)
LINK_ATTRIBUTE = r"(?i)(?:href|src|srcset|action|formaction|cite|poster|xmlns|content|integrity)\s*=\s*$"

JS_FILES = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue")
AWS_OPERATIONS = (
    "PutObject", "GetObject", "DeleteObject", "HeadObject", "CopyObject", "PresignGetObject", "PresignPutObject", "PresignHeadObject", "ListObjectsV2", "SendEmail", "SendRawEmail", "SendTemplatedEmail", "SendBulkTemplatedEmail",
    "PutItem", "GetItem", "UpdateItem", "DeleteItem", "BatchWriteItem", "BatchGetItem", "SendMessage", "SendMessageBatch", "ReceiveMessage", "Upload", "Download",
)
CONTEXT = r"(?:\w*[Cc]tx\w*|c|context\s*\.\s*(?:TODO|Background)\s*\(\s*\)|\w+\s*\.\s*Context\s*\(\s*\))"
#: Extensions, what the file must contain, pattern, package, member (none: the pattern's group), confidence.
SINKS = (
    (("go",), ("net/smtp",), r"\bsmtp\.SendMail\s*\(", "net/smtp", "SendMail", "high"),
    (("go",), ("aws-sdk-go",), rf"\.({'|'.join(AWS_OPERATIONS)})\s*\(\s*{CONTEXT}\s*,", "aws-sdk-go", None, "medium"),
    (("go",), ("net/http",), r"\bhttp\.(Get|Post|PostForm|Head)\s*\(", "net/http", None, "medium"),
    (JS_FILES, ("axios",), r"\baxios\s*\.\s*(get|post|put|patch|delete|head|request)\s*\(", "axios", None, "medium"),
    (JS_FILES, ("axios",), r"\baxios\s*\(", "axios", "request", "medium"),
    (JS_FILES, (), r"(?<![.\w])fetch\s*\(", "fetch", "fetch", "low"),
)

CLIENTS = ("httpClient", "authRequest", "axios", "fetch", "request", "api", "http")
METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "request")
UI_SOURCES = ("ts", "tsx", "js", "jsx", "vue", "svelte")
#: A call with its first argument, and what ends it there if it is one literal.
UI_CALL = (
    rf"\b({'|'.join(CLIENTS)})\s*\.\s*({'|'.join(METHODS)})\s*(?:<[^()]*>)?\s*\(\s*"
    r"(`(?:[^`\\]|\\[\s\S])*+`|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|[^\s,)])(\s*[,)])?"
)
BASE_ALIAS = r"(?:const|let|var)\s+([\w$]+)\s*=\s*`\$\{\s*([\w.$]+)\s*\}([^`$]*)`"

ORM_CALL = r"(?=[dms])\b(?:models|db|sequelize)\.([A-Za-z_$][\w$]*)\.(\w+)\s*\("
GO_TABLE = r"\.Table\s*\(\s*([\w.]+)"
OPERATIONS = {
    "find": "read", "findall": "read", "findone": "read", "findbypk": "read", "findandcountall": "read", "count": "read", "aggregate": "read", "create": "write", "bulkcreate": "write", "update": "write",
    "upsert": "write", "save": "write", "increment": "write", "decrement": "write", "destroy": "delete", "truncate": "delete",
}
GO_WRITES, GO_DELETES = ("Create", "Save", "Update", "Updates", "FirstOrCreate", "Insert"), ("Delete",)
GO_READS = ("Find", "First", "Last", "Take", "Scan", "Pluck", "Count", "Rows", "Select")


def with_extension(files: DataFrame, exts: tuple[str, ...]) -> DataFrame:
    return files.select(*FILE, "content").where(F.col("content").isNotNull() & extension(F.col("rel_path")).isin(*exts))


def is_endpoint(url: Column) -> Column:
    """A host that something may be fetched from: no namespace or licence, and no single word without a port."""
    authority = F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/]+)", 1)
    host = F.element_at(F.split(authority, ":"), 1)
    named = reduce(Column.__or__, (F.startswith(url, F.lit(p)) for p in NO_ENDPOINTS))
    return ~named & (host.contains(".") | host.contains("-") | authority.contains(":") | (host == "localhost"))


def outbound_urls(files: DataFrame) -> DataFrame:
    """(root_name, rel_path, line, column, target, confidence, reason) of quoted absolute URLs in code. One that is put together at run time is one row without a target,
    and no other match starts inside its range; targets of links and identifiers are no calls."""
    code = with_extension(files, CODE_FILES).where(F.contains("content", F.lit("://")))
    built = lexing.locate(code, DYNAMIC_URL, ("url", "mark")).select(*FILE, *lexing.PLACE, "url", "before", F.lit(True).alias("built"))
    stated = lexing.locate(code, ABSOLUTE_URL, ("url",)).select(*FILE, *lexing.PLACE, "url", "before", F.lit(False).alias("built"))
    stated = stated.where(is_endpoint(F.col("url")) & ~F.col("before").rlike(LINK_ATTRIBUTE))
    found = lexing.outside(built.unionByName(stated), lexing.comments(code))
    upto = Window.partitionBy(*FILE).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("held", F.max(F.when(F.col("built"), F.col("end"))).over(upto)).where("built or not coalesce(held > start, false)")
    reason = F.concat(F.lit('destination is built at runtime from "'), "url", F.lit('…"'))
    return found.select(*FILE, "line", "column", F.when(~F.col("built"), F.col("url")).alias("target"), F.when(F.col("built"), "unresolved").otherwise("medium").alias("confidence"), F.when(F.col("built"), reason).alias("reason"))


def outbound_sinks(files: DataFrame, sinks: tuple = SINKS) -> DataFrame:
    """(root_name, rel_path, line, column, package_name, member_name, confidence) of calls that leave through a library; a sink counts only in files that contain its package."""
    patterns = tuple(("external-call", exts, form, package, confidence, 0 if member else 1) for exts, _, form, package, member, confidence in sinks)
    found = locate_patterns(files, patterns, tuple(s[1] for s in sinks))
    code = with_extension(files, tuple({e for s in sinks for e in s[0]}))
    known = F.array(*(F.struct(F.lit(package).alias("package"), F.lit(member).cast("string").alias("member"), F.lit(confidence).alias("confidence")) for _, _, _, package, member, confidence in sinks))
    out = lexing.outside(found, lexing.comments(code)).withColumn("s", F.get(known, F.col("of")))
    return out.select(*FILE, "line", "column", F.col("s.package").alias("package_name"), F.coalesce("s.member", "detail").alias("member_name"), F.col("s.confidence").alias("confidence"))


def url_template(body: Column) -> Column:
    """struct(base, path) of a template's body: the last name of a leading interpolation, and the path without a query, interpolated segments as :param; null where
    it gives neither, or a path that does not start with a slash."""
    lead = r"^\$\{\s*([\w.$]+)\s*\}"
    base = F.nullif(F.element_at(F.split(F.regexp_extract(body, lead, 1), r"\."), -1), F.lit(""))
    rest = F.element_at(F.split(F.regexp_replace(body, lead, ""), "[?#]"), 1)
    path = F.array_join(F.transform(F.split(rest, "/"), lambda s: F.when(s.contains("${"), ":param").otherwise(s)), "/")
    good = F.when(path == "", base.isNotNull()).otherwise(path.startswith("/"))
    return F.when(good, F.struct(base.alias("base"), F.when(path == "", "/").otherwise(path).alias("path")))


def base_aliases(files: DataFrame) -> DataFrame:
    """(root_name, rel_path, alias, base, prefix): constants of a file that add a path to another base; the last declaration of a name holds."""
    found = lexing.locate(files, BASE_ALIAS, ("alias", "of", "prefix")).where("prefix = '' or prefix like '/%'")
    last = F.max_by(F.struct(F.element_at(F.split("of", r"\."), -1).alias("base"), "prefix"), "start")
    return found.groupBy(*FILE, "alias").agg(last.alias("a")).select(*FILE, "alias", "a.base", "a.prefix")


def ui_calls(files: DataFrame) -> DataFrame:
    """(root_name, rel_path, line, column, method, base, target, confidence, failure) of calls of HTTP helpers. A base that the file derives from another is followed one
    level; a URL that is no template or path at the call is a call without a target, with the failure."""
    code = with_extension(files, UI_SOURCES).where(F.col("content").rlike(r"\.\s*(get|post|put|patch|delete|head|options|request)\s*[<(]"))
    calls = lexing.outside(lexing.locate(code, UI_CALL, ("client", "verb", "argument", "closed")).select(*FILE, *lexing.PLACE, "verb", "argument", "closed"), lexing.comments(code, hash_comments=False))
    body, quote, whole = F.expr("substring(argument, 2, length(argument) - 2)"), F.left("argument", F.lit(1)), F.col("closed") != ""
    read = calls.withColumn("t", F.when(whole & (quote == "`"), url_template(body))).withColumn("path", F.when(whole & quote.isin("'", '"') & body.startswith("/"), body))
    read = read.select(*FILE, "line", "column", F.when(F.col("verb") != "request", F.upper("verb")).alias("method"), F.col("t.base").alias("named"), F.col("t.path").alias("t_path"), "path")
    both = read.join(base_aliases(code).withColumnRenamed("alias", "named"), [*FILE, "named"], "left")
    longer = F.concat("prefix", F.when(F.col("t_path") == "/", "").otherwise(F.col("t_path")))
    through = F.when(F.col("prefix").isNotNull(), F.when(longer == "", "/").otherwise(longer)).otherwise(F.col("t_path"))
    target, base = F.coalesce(through, "path"), F.coalesce("base", "named")
    confidence = F.when(F.col("path").isNotNull() | base.isNotNull(), "high").when(F.col("t_path").isNotNull(), "medium").otherwise("low")
    failure = F.when(target.isNull(), "the request URL is not a template literal or path string at the call site")
    return both.select(*FILE, "line", "column", "method", base.alias("base"), target.alias("target"), confidence.alias("confidence"), failure.alias("failure"))


def declared_tables(files: DataFrame) -> DataFrame:
    """(root_name, style, name, table_name): the tables that model files name (by file and by definition, in lower case) and that constants of Go files hold. Of several the last
    holds, by path and place."""
    models = with_extension(files, ("js", "ts")).where(F.col("rel_path").rlike(r"(?<!\w)models?/"))
    stated = models.select("root_name", "rel_path", F.regexp_extract("content", r"tableName:\s*['\"]([^'\"]+)['\"]", 1).alias("table_name"), F.regexp_extract("content", r"(?:sequelize\.define|define)\s*\(\s*['\"]([^'\"]+)['\"]", 1).alias("defined"))
    file_name = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"\.[jt]s$", "")
    orm = stated.where("table_name <> ''").select("root_name", "rel_path", F.lit(0).cast("long").alias("start"), F.lit("orm").alias("style"), F.explode(F.array_distinct(F.array(F.lower(file_name), F.lower("defined")))).alias("name"), "table_name")
    constants = lexing.locate(with_extension(files, ("go",)).where(F.col("rel_path").rlike("(?i)table|constant")), r"\b([A-Z]\w*)\s+(?:\w+\s*)?=\s*\"([\w.$-]+)\"", ("name", "table_name"))
    both = orm.where("name <> ''").unionByName(constants.select("root_name", "rel_path", "start", F.lit("go").alias("style"), "name", "table_name"))
    return both.groupBy("root_name", "style", "name").agg(F.max_by("table_name", F.struct("rel_path", "start")).alias("table_name"))


#: What a statement is made of: strings, brackets, line ends and all between them.
STATEMENT_PARTS = r"""'(?:[^'\\]|\\[\s\S])*+\\?(?:'|\z)|"(?:[^"\\]|\\[\s\S])*+\\?(?:"|\z)|`[^`]*+(?:`|\z)|[(\[{]|[)\]}]|\n|[^'"`()\[\]{}\n]++"""


def statement(text: Column) -> Column:
    """The text up to the end of its statement: a line's end outside quotes and brackets after something else than a dot, an open parenthesis or a comma. A fold over the parts of
    the text that carries a few characters of state, and no text."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("last"), F.lit(-1).alias("stop"))

    def step(s: Column, part: Column) -> Column:
        first, seen = F.left(part, F.lit(1)), F.right(F.rtrim(part, F.lit(" \t\x0b\f\r")), F.lit(1))
        ends = (part == "\n") & (s["depth"] <= 0) & ~s["last"].isin(".", "(", ",")
        moved = F.when(first.isin("(", "[", "{"), 1).when(first.isin(")", "]", "}"), -1).otherwise(0)
        last = F.when(part == "\n", "").when(seen == "", s["last"]).otherwise(seen)
        after = F.struct((s["at"] + F.length(part)).alias("at"), (s["depth"] + moved).alias("depth"), last.alias("last"), F.when(ends, s["at"]).otherwise(F.lit(-1)).alias("stop"))
        return F.when(s["stop"] >= 0, s).otherwise(after)

    stop = F.aggregate(F.regexp_extract_all(text, F.lit(STATEMENT_PARTS), F.lit(0)), start, step, lambda s: s["stop"])
    return F.left(text, F.when(stop < 0, F.length(text)).otherwise(stop))


def data_usage(files: DataFrame) -> DataFrame:
    """(root_name, rel_path, line, column, mechanism, entity, operation, confidence, reason) of model calls and of .Table(name) chains. A model without a declared table keeps its own
    name; a .Table of which no segment is a declared constant (the right-most counts) is unresolved. The operation of a chain is read in its statement, at most 2,000
    characters of it: the first write or deletion, else a read."""
    code = with_extension(files, ("go", "js", "ts", "cjs", "mjs"))
    is_go, tables = F.col("rel_path").endswith(".go"), declared_tables(files)
    # only files that can hold a call are read for it and for comments
    models = code.where(~is_go & reduce(Column.__or__, (F.contains("content", F.lit(f"{n}.")) for n in ("models", "db", "sequelize"))))
    chained = code.where(is_go & F.contains("content", F.lit(".Table")))
    named = F.create_map(*(F.lit(x) for kv in OPERATIONS.items() for x in kv))
    calls = lexing.outside(lexing.locate(models, ORM_CALL, ("model", "verb")).select(*FILE, *lexing.PLACE, "model", "verb"), lexing.comments(models, hash_comments=False))
    calls = calls.withColumns({"name": F.lower("model"), "operation": F.try_element_at(named, F.lower("verb"))}).where("operation is not null")
    calls = calls.join(tables.where("style = 'orm'").drop("style"), ["root_name", "name"], "left")
    missing = F.concat(F.lit('no table name is declared for model "'), "name", F.lit('"; the model name is kept in its place'))
    orm = calls.select(*FILE, "line", "column", F.lit("sequelize").alias("mechanism"), F.coalesce("table_name", "name").alias("entity"), "operation", F.when(F.col("table_name").isNull(), "low").otherwise("high").alias("confidence"), F.when(F.col("table_name").isNull(), missing).alias("reason"))

    verbs = F.regexp_extract_all(statement(F.left(F.concat("match", "ahead"), F.lit(2000))), F.lit(r"\.\s*(\w+)\s*\("), F.lit(1))
    changes = F.filter(F.transform("verbs", lambda v: F.when(v.isin(*GO_WRITES), "write").when(v.isin(*GO_DELETES), "delete")), lambda v: v.isNotNull())
    operation = F.coalesce(F.get(changes, F.lit(0)), F.when(F.exists("verbs", lambda v: v.isin(*GO_READS)), "read"), F.lit("unknown"))
    found = lexing.locate(chained, GO_TABLE, ("expression",), ahead=2000, more={"verbs": verbs}).select(*FILE, *lexing.PLACE, "expression", "verbs")
    chains = lexing.outside(found, lexing.comments(chained, hash_comments=False))
    segments = chains.select(*FILE, "start", F.posexplode(F.split("expression", r"\.")).alias("at", "name"))
    right = segments.join(tables.where("style = 'go'").drop("style"), ["root_name", "name"]).groupBy(*FILE, "start").agg(F.max_by("table_name", "at").alias("table_name"))
    known = F.col("table_name").isNotNull()
    unresolved = F.concat(F.lit('"'), "expression", F.lit('" does not resolve to a declared table name'))
    go = chains.join(right, [*FILE, "start"], "left").select(
        *FILE, "line", "column", F.lit("gorm").alias("mechanism"), F.col("table_name").alias("entity"), F.when(known, operation).otherwise("unknown").alias("operation"), F.when(known, "high").otherwise("unresolved").alias("confidence"), F.when(~known, unresolved).alias("reason"),
    )
    return orm.unionByName(go)
