"""Names, words and files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONFIG_NAMES = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", "bitbucket-pipelines.yml", "Makefile", ".gitignore", ".dockerignore", ".editorconfig")
CONFIG_EXTENSIONS = ("yml", "yaml", "toml", "ini", "cfg")
DOC_EXTENSIONS = ("md", "mdx", "rst", "adoc", "txt")
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "svg", "woff", "woff2", "ttf", "otf", "eot", "zip", "tar", "gz", "rar", "7z",
    "pdf", "mp3", "mp4", "mov", "wav", "so", "dylib", "dll", "exe", "class", "jar", "wasm",
)
LANGUAGES = {"go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "vue": "vue", "py": "python", "java": "java", "kt": "kotlin", "rb": "ruby", "php": "php", "rs": "rust", "cs": "csharp", "swift": "swift", "sql": "sql"}
INFRASTRUCTURE = (
    r"\bauth(entication|orization)?\b|\bmiddleware\b|\blog(ger|ging)?\b|\bconfig(uration)?\b|\b(db|database|conn(ection)?|pool)\b|\butil(s|ity|ities)?\b"
    r"|\bhelper(s)?\b|\bcommon\b|\bshared\b|\bclient\b|\berror(s|handler)?\b|\bvalidat(e|or|ion)\b"
)

#: Words that name no feature; pass your own list where a project has others.
STOPWORDS = ("api", "internal", "public", "private", "app", "index", "main", "common", "core", "shared", "util", "helper", "config", "test", "get", "post", "put", "delete", "list", "new", "update", "create", "find", "data", "info", "item", "page", "view", "service", "model", "route", "module", "system", "type", "error", "log", "user")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower case, without the dot; empty for names without one or that only start with a dot."""
    return F.regexp_extract(F.lower(base_name(path)), r"^.+\.([^.]*)$", 1)


def is_test_path(path: Column) -> Column:
    name = F.lower(base_name(path))
    in_folder = F.exists(F.split(F.lower(path), "/"), lambda s: s.isin("test", "tests", "__tests__"))
    return name.rlike(r"(^|[._-])test[._-]|[._-]test$|\.spec\.") | in_folder


def classify_path(path: Column) -> Column:
    """test, schema-migration, configuration, documentation, binary-asset, source or null; the first that fits."""
    name, ext = base_name(path), extension(path)
    migrations = F.exists(F.split(F.lower(path), "/"), lambda s: s.isin("migration", "migrations"))
    return (
        F.when(is_test_path(path), "test")
        .when((ext == "sql") | migrations, "schema-migration")
        .when(name.isin(*CONFIG_NAMES) | ext.isin(*CONFIG_EXTENSIONS) | (name == ".env") | name.startswith(".env."), "configuration")
        .when(ext.isin(*DOC_EXTENSIONS) | F.lower(name).rlike(r"^readme(\.|$)"), "documentation")
        .when(ext.isin(*BINARY_EXTENSIONS), "binary-asset")
        .when(ext.isin(*LANGUAGES), "source")
    )


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(table, extension(path))


def looks_generated(content: Column) -> Column:
    head = F.lower(F.substring(content, 1, 500))
    return head.contains("generated") & head.contains("do not edit")


def spaced(text: Column) -> Column:
    """camelCase with blanks where words meet."""
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def words(text: Column) -> Column:
    parts = F.split(F.lower(spaced(text)), "[^a-z0-9]+")
    return F.filter(parts, lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))


def singular(word: Column) -> Column:
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("ses") | word.endswith("xes") | word.endswith("hes"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), cut(1))
        .otherwise(word)
    )


def entity_term(name: Column, prefix: Column | None = None, stopwords: Iterable[str] = STOPWORDS) -> Column:
    """The first singular word of a table's name that is no stop word, the shared prefix (null: none) removed."""
    low = F.lower(name)
    if prefix is not None:
        low = F.when(prefix.isNotNull() & low.startswith(prefix), F.substring(low, F.length(prefix) + 1, F.length(low))).otherwise(low)
    kept = F.filter(F.transform(words(low), singular), lambda w: ~w.isin(*stopwords))
    return F.try_element_at(kept, F.lit(1))


def name_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(spaced(text)), "[^a-z0-9]+"), lambda w: F.length(w) > 1)


def last_part(subject: Column) -> Column:
    return F.element_at(F.split(subject, r"\."), -1)


def field_token(subject: Column) -> Column:
    return F.try_element_at(name_tokens(last_part(subject)), F.lit(-1))


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(spaced(text), "[_-]+", " ")))


def readable_subject(subject: Column) -> Column:
    return F.lower(F.regexp_replace(spaced(last_part(subject)), "[_-]+", " "))


def subject_key(subject: Column) -> Column:
    """The last word of the last dotted part."""
    found = F.filter(F.split(F.lower(F.regexp_replace(spaced(last_part(subject)), "[_-]+", " ")), r"\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lower(last_part(subject)))


def readable_member(name: Column, set_name: Column) -> Column:
    """A constant as words, without the leading words its set carries and without trailing single letters; one word is always left."""
    own = F.filter(F.split(_plain(name), r"\s+"), lambda w: w != "")
    theirs = F.split(_plain(set_name), r"\s+")
    drop = F.aggregate(own, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + (a["on"] & F.array_contains(theirs, w)).cast("int")).alias("n"), (a["on"] & F.array_contains(theirs, w)).alias("on")), lambda a: a["n"])
    rest = F.slice(own, F.least(drop, F.size(own) - 1) + 1, F.size(own))
    tail = F.aggregate(F.reverse(rest), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + (a["on"] & (F.length(w) == 1)).cast("int")).alias("n"), (a["on"] & (F.length(w) == 1)).alias("on")), lambda a: a["n"])
    return F.array_join(F.slice(rest, 1, F.size(rest) - F.least(tail, F.size(rest) - 1)), " ")


def looks_infrastructural(name: Column) -> Column:
    return spaced(name).rlike("(?i)" + INFRASTRUCTURE)
