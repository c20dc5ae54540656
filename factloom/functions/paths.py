"""Targets, paths and route patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
NOT_AN_INTEGRATION = (
    r"(?i)^(localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\])|(\.local(:[0-9]+)?$)"
    r"|^(www\.)?(github|stackoverflow|vuejs|reactjs|npmjs|apidocjs|code\.visualstudio|developer\.mozilla|twitter|x)\.(com|org|net)$"
)
PLACEHOLDER = r"(?i)^(x+|example|test|foo|bar|your[-_]?[A-Za-z0-9_]*)\.|\bexample\.(com|org)$"
URL = r"^[a-zA-Z][A-Za-z0-9_+.-]*://[^/]*(/[^?#]*)?"


def path_of(target: Column) -> Column:
    """The path of a URL or of a bare path, without query and fragment; null for anything else."""
    inside = F.regexp_extract(target, URL, 1)
    return F.when(target.rlike(URL), F.when(inside == "", "/").otherwise(inside)).when(target.startswith("/"), F.element_at(F.split(target, "[?#]"), 1))


def host_of(target: Column) -> Column:
    return F.nullif(F.regexp_extract(target, r"^[a-zA-Z][A-Za-z0-9_+.-]*://([^/?#]*)", 1), F.lit(""))


def trim_slashes(path: Column) -> Column:
    cut = F.regexp_replace(path, "/+$", "")
    return F.when(cut == "", "/").otherwise(cut)


def comparable_path(path: Column) -> Column:
    """Parameters flattened to :p and a leading version or api segment dropped, for finding one endpoint served twice."""
    flat = F.regexp_replace(trim_slashes(path), r"/(:[^/]+|\{[^/]*\}|<[^/]*>)", "/:p")
    return trim_slashes(F.regexp_replace(flat, r"^/(v[0-9]+|api)(?=/|$)", ""))


def resolve_dots(path: Column) -> Column:
    """. and .. resolved lexically; a leading .. has nothing to climb and goes."""
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s.isin("", "."), acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def segments(path: Column) -> Column:
    return F.split(trim_slashes(path), "/")


def is_parameter(segment: Column) -> Column:
    return segment.startswith(":") | (segment.startswith("{") & segment.endswith("}")) | (segment.startswith("<") & segment.endswith(">"))


def wildcard_at(pattern_segments: Column) -> Column:
    """0-based place of the first segment that starts with *, or null."""
    return F.nullif(F.array_position(F.transform(pattern_segments, lambda s: s.startswith("*")), True) - 1, F.lit(-1)).cast("int")


def segments_match(pattern: Column, path: Column) -> Column:
    """Segment arrays: parameters match one segment each, a wildcard is terminal and matches the rest, else lengths agree. No
    regular expression is made from data."""
    star = wildcard_at(pattern)
    n = F.coalesce(star, F.size(pattern))
    enough = F.when(star.isNotNull(), F.size(path) >= star).otherwise(F.size(path) == F.size(pattern))
    return enough & F.forall(F.zip_with(F.slice(pattern, 1, n), F.slice(path, 1, n), lambda p, s: is_parameter(p) | p.eqNullSafe(s)), lambda ok: ok)


def route_matches(pattern: Column, path: Column) -> Column:
    return segments_match(segments(pattern), segments(path))


def specificity(pattern: Column) -> Column:
    """2 a literal segment, 1 a parameter, up to the wildcard."""
    parts = segments(pattern)
    before = F.slice(parts, 1, F.coalesce(wildcard_at(parts), F.size(parts)))
    one = lambda s: F.when(s.startswith(":") | s.startswith("{") | s.startswith("<"), 1).otherwise(2)
    return F.aggregate(before, F.lit(0), lambda a, s: a + one(s))


def method_matches(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (F.upper(a) == F.upper(b))


def is_real_integration(host: Column) -> Column:
    bare = F.regexp_replace(host, ":[0-9]+$", "")
    return ~host.rlike(NOT_AN_INTEGRATION) & ~bare.rlike(NOT_AN_INTEGRATION) & ~host.rlike(PLACEHOLDER)


def parse_url_template(arg: Column) -> Column:
    """struct(base, path) of a template such as ${config.base}/a/${id}?x: the last dotted part of a leading ${}, and the path with
    interpolated segments as :param and without the query."""
    base = F.nullif(F.element_at(F.split(F.regexp_extract(arg, r"^\$\{([^}]*)\}", 1), r"\."), -1), F.lit(""))
    rest = F.element_at(F.split(F.regexp_replace(arg, r"^\$\{[^}]*\}", ""), r"\?"), 1)
    path = F.array_join(F.transform(F.split(rest, "/"), lambda s: F.when(s.contains("${"), ":param").otherwise(s)), "/")
    return F.struct(base.alias("base"), F.nullif(path, F.lit("")).alias("path"))


def join_route_path(prefix: Column, sub: Column) -> Column:
    joined = F.regexp_replace(F.concat_ws("/", F.coalesce(prefix, F.lit("")), F.coalesce(sub, F.lit(""))), "/+", "/")
    return trim_slashes(F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined)))


def parse_route_name(name: Column) -> Column:
    """struct(method, path) of names such as GET /x; method null where none is stated."""
    form = r"^([A-Z]+)\s+(/.*)$"
    return F.struct(F.nullif(F.regexp_extract(name, form, 1), F.lit("")).alias("method"), F.when(name.rlike(form), F.regexp_extract(name, form, 2)).otherwise(name).alias("path"))


def route_surface(method: Column, rel_path: Column) -> Column:
    """client for a route without a method in a component file, else server."""
    return F.when(method.isNull() & rel_path.rlike(r"\.(vue|svelte|jsx|tsx)$"), "client").otherwise("server")
