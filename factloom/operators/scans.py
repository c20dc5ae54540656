"""Text scans: one row per match with line and column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import extension
from . import lexing

# Kind, extensions (none: all), pattern, label, confidence, the group that is the detail (0: none).
JS, JVM, GO = ("ts", "js"), ("java", "kt"), ("go",)
CONVENTIONS = (
    ("validation-rule", GO, r'binding:"([^"]+)"', "binding", "high", 1),
    ("validation-rule", GO, r'validate:"([^"]+)"', "validate", "high", 1),
    ("validation-rule", JS, r"@(Is[A-Z]\w*|Min|Max|Length|IsNotEmpty|IsOptional)\s*\(", "decorator", "high", 1),
    ("validation-rule", JVM, r"@(NotNull|NotBlank|NotEmpty|Size|Valid|Pattern|Email)\b", "bean-validation", "high", 1),
    ("transaction-boundary", JVM, r"@Transactional\b", "@Transactional", "high", 0),
    ("transaction-boundary", GO, r"\.Begin(?:Tx)?\s*\(", "Begin", "medium", 0),
    ("transaction-boundary", GO + JS, r"\.[Tt]ransaction\s*\(", "transaction", "medium", 0),
    ("error-handling", GO, r"if\s+err\s*!=\s*nil\s*\{", "err-check", "high", 0),
    ("error-handling", JS + JVM + ("py", "rb", "swift"), r"\bcatch\b\s*[({]", "catch", "high", 0),
    ("error-handling", ("py",), r"(?m)^\s*except\b", "except", "high", 0),
    ("auth-annotation", JS, r"@(UseGuards|Roles|Authenticated|RequirePermission)\s*\(([^)]*)\)", "guard", "high", 2),
    ("auth-annotation", JVM, r"@(PreAuthorize|Secured|RolesAllowed)\s*\(([^)]*)\)", "spring-security", "high", 2),
    ("auth-annotation", GO, r"\b(\w*(?:Auth|Authorize|Authenticate|RequireLogin)\w*)\s*\(", "auth-middleware", "low", 1),
    ("scheduled-task", JS, r"\.scheduleJob\s*\(\s*['\"]([^'\"]+)['\"]", "scheduleJob", "high", 1),
    ("scheduled-task", JS, r"\bcron\.schedule\s*\(\s*['\"]([^'\"]+)['\"]", "cron.schedule", "high", 1),
    ("scheduled-task", JS, r"new\s+CronJob\s*\(\s*['\"]([^'\"]+)['\"]", "CronJob", "high", 1),
    ("scheduled-task", GO, r'\.AddFunc\s*\(\s*(?:"([^"]+)")?', "AddFunc", "high", 1),
    ("scheduled-task", JVM, r"@Scheduled\s*\(([^)]*)\)", "@Scheduled", "high", 1),
    ("scheduled-task", JS, r"\bsetInterval\s*\(", "setInterval", "low", 0),
    ("notification-call", JS, r"\.sendMail\s*\(", "sendMail", "high", 0),
    ("notification-call", JS, r"\.messaging\s*\(\s*\)\s*\.\s*send\w*\s*\(", "messaging().send", "high", 0),
    ("notification-call", GO, r"\bsmtp\.SendMail\s*\(", "smtp.SendMail", "high", 0),
    ("notification-call", GO, r"\w+\.PostMessage\s*\(", "PostMessage", "medium", 0),
    ("notification-call", GO + JS, r"\b\w*(?:SendEmail|SendSlackMessage|SendPush|sendNotification|notifyUser)\w*\s*\(", "notify-helper", "low", 0),
    ("data-access", (), r"\b(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b", "sql", "medium", 1),
    ("data-access", GO, r"\.(Find|First|Create|Save|Updates?|Delete|Where)\s*\(", "orm", "low", 1),
    ("data-access", JS, r"\.(findOne|findMany|findAll|createQueryBuilder|insertInto|deleteFrom)\s*\(", "orm", "low", 1),
)
#: Texts without any of these need not be searched for the label's pattern; plain substrings are found much faster than patterns that start with a word.
NEEDLES = {
    "binding": ("binding:",), "validate": ("validate:",), "decorator": ("@Is", "@M", "@Length"), "Begin": (".Begin",), "transaction": ("ransaction",), "err-check": ("nil",), "catch": ("catch",), "except": ("except",), "guard": ("@",), "spring-security": ("@",),
    "auth-middleware": ("Auth", "RequireLogin"), "scheduleJob": ("scheduleJob",), "cron.schedule": ("cron",), "CronJob": ("CronJob",), "AddFunc": ("AddFunc",), "setInterval": ("setInterval",), "sendMail": ("sendMail",), "messaging().send": ("messaging",),
    "smtp.SendMail": ("SendMail",), "PostMessage": ("PostMessage",), "notify-helper": ("SendEmail", "SendSlackMessage", "SendPush", "sendNotification", "notifyUser"), "sql": ("SELECT", "INSERT", "UPDATE", "DELETE"),
}
TEST_NAMES = (
    r"(?<![.\w])(?:it|test|describe|context)\s*\(\s*[\"'`]([^\"'`]{3,200})[\"'`]", r"\bfunc\s+(Test[A-Za-z0-9_]{2,120})\s*\(", r"\bfunc\s+(test[A-Za-z0-9_]{2,120})\s*\(", r"\bdef\s+(test_[A-Za-z0-9_]{2,120})\s*\(",
    r"@Test\b[\s\S]{0,200}?\b(?:void|fun)\s+([A-Za-z_][A-Za-z0-9_]{2,120})\s*\(", r"#\[test\][\s\S]{0,200}?\bfn\s+([A-Za-z_][A-Za-z0-9_]{2,120})\s*\(",
)


def locate_patterns(files: DataFrame, patterns: tuple, needles: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(root_name, rel_path, of, start, end, line, column, detail) of every match of pattern number of among patterns (as CONVENTIONS has them) in files with its extension and any of its
    needles (none: all). A group that takes no part in a match is an empty detail."""
    exts = {e for p in patterns for e in p[1]}
    wanted = files.select("root_name", "rel_path", extension(F.col("rel_path")).alias("ext"), F.coalesce("content", F.lit("")).alias("content"))
    if all(p[1] for p in patterns):
        wanted = wanted.where(F.col("ext").isin(*exts))
    forms = [lexing.ascii_boundaries(p[2]) for p in patterns]
    held = lambda own: reduce(Column.__or__, (F.contains("content", F.lit(x)) for x in own or ("",)))
    fits = [(F.col("ext").isin(*p[1]) if p[1] else F.lit(True)) & held(own) & F.col("content").rlike(form) for form, p, own in zip(forms, patterns, needles)]
    parts = F.array_compact(F.array(*(F.when(fit, F.struct(F.lit(k).alias("of"), lexing.pieces(F.col("content"), form).alias("x"))) for k, (fit, form) in enumerate(zip(fits, forms)))))
    found = wanted.select("root_name", "rel_path", F.explode(parts).alias("p")).select("root_name", "rel_path", "p.of", F.posexplode("p.x").alias("pos", "x"))
    found = found.select("root_name", "rel_path", "of", "pos", "x.match", "x.gap").where("match is not null")
    own = [F.regexp_extract("match", form, p[5]) if p[5] else F.lit(None).cast("string") for form, p in zip(forms, patterns)]
    detail = F.coalesce(*(F.when(F.col("of") == k, c) for k, c in enumerate(own)))
    return lexing.placed(found.select("root_name", "rel_path", "of", "pos", "gap", "match", detail.alias("detail")), ["root_name", "rel_path", "of"])


def scan_patterns(files: DataFrame, patterns: tuple = CONVENTIONS) -> DataFrame:
    """(root_name, rel_path, kind, label, confidence, detail, line, column) of every match of the patterns for a file's extension; a file that no pattern is for is not looked at."""
    at = locate_patterns(files, patterns, tuple(NEEDLES.get(p[3], ()) if p in CONVENTIONS else () for p in patterns))
    named = F.array(*(F.struct(F.lit(p[0]).alias("kind"), F.lit(p[3]).alias("label"), F.lit(p[4]).alias("confidence")) for p in patterns))
    return at.withColumn("n", F.get(named, F.col("of"))).select("root_name", "rel_path", "n.kind", "n.label", "n.confidence", "detail", "line", "column")


#: Which files have which comments, test names and labels.
SLASH_FILES = ("go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "kt", "swift", "cs", "rs", "scala", "dart", "php", "c", "h", "cpp", "hpp")
HASH_FILES = ("py", "rb", "sh", "yaml", "yml")
TEST_FILES = ("go", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "swift", "java", "kt", "rs")
UI_FILES = ("vue", "jsx", "tsx", "html", "svelte")


def doc_items(files: DataFrame) -> DataFrame:
    """(root_name, rel_path, line, form, text) of the comments that say something, three characters at least (X8): block comments without their stars, // comments of consecutive lines joined
    by blanks, # comments line by line; by extension."""
    wanted = files.select("root_name", "rel_path", "content", extension(F.col("rel_path")).alias("ext")).where("content is not null")
    slash, hashed = wanted.where(F.col("ext").isin(*SLASH_FILES)), wanted.where(F.col("ext").isin(*HASH_FILES))
    blocks = lexing.locate(slash, r"/\*\*?([\s\S]*?)\*/", ("body",))
    body = F.transform(F.split("body", "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\*?\s?", ""), r"\s+$", ""))
    blocks = blocks.select("root_name", "rel_path", "line", F.lit("block").alias("form"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+\z", "").alias("text"))
    line = lambda df, form: df.select("root_name", "rel_path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "x")).where(F.col("x").rlike(form)).select("root_name", "rel_path", "pos", F.trim(F.regexp_replace(F.regexp_extract("x", form, 1), r"^\s+|\s+$", "")).alias("t"))
    runs = line(slash, r"^\s*//\s?(.*)$").withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy("root_name", "rel_path").orderBy("pos")))
    runs = runs.groupBy("root_name", "rel_path", "run").agg((F.min("pos") + 1).cast("long").alias("line"), F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("b"))
    runs = runs.select("root_name", "rel_path", "line", F.lit("lines").alias("form"), F.trim(F.array_join(F.transform("b", lambda x: x["t"]), " ")).alias("text"))
    single = line(hashed, r"^\s*#\s?(.+)$").select("root_name", "rel_path", (F.col("pos") + 1).cast("long").alias("line"), F.lit("hash").alias("form"), F.col("t").alias("text"))
    return blocks.unionByName(runs).unionByName(single).where("length(text) >= 3")


def doc_comments(files: DataFrame, marker: str = "//") -> DataFrame:
    """(root_name, rel_path, start_line, lines, text): runs of consecutive comment lines, as gaps and islands."""
    lines = files.select("root_name", "rel_path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).where(F.trim("line").startswith(marker))
    w = Window.partitionBy("root_name", "rel_path").orderBy("pos")
    island = lines.withColumn("island", F.col("pos") - F.row_number().over(w))
    body = F.array_sort(F.collect_list(F.struct("pos", F.trim(F.substring(F.trim("line"), len(marker) + 1, 1_000_000)).alias("t"))))
    g = island.groupBy("root_name", "rel_path", "island").agg((F.min("pos") + 1).cast("long").alias("start_line"), F.count("*").alias("lines"), body.alias("b"))
    return g.select("root_name", "rel_path", "start_line", "lines", F.array_join(F.transform("b", lambda x: x["t"]), "\n").alias("text"))


def _named(files: DataFrame, patterns: tuple[str, ...], exts: tuple[str, ...], name: str) -> DataFrame:
    wanted = files.where(extension(F.col("rel_path")).isin(*exts)) if exts else files
    found = F.flatten(F.array(*(F.regexp_extract_all("content", F.lit(lexing.ascii_boundaries(p)), F.lit(1)) for p in patterns)))
    return wanted.select("root_name", "rel_path", F.explode(found).alias(name)).distinct()


def test_names(files: DataFrame, patterns: tuple[str, ...] = TEST_NAMES, exts: tuple[str, ...] = TEST_FILES) -> DataFrame:
    """(root_name, rel_path, name), distinct; in files with one of the extensions (none: all)."""
    return _named(files, patterns, exts, "name")


# Fixed values.
UI_LABELS = (r"(?:label|title|placeholder|aria-label)\s*=\s*[\"']([^\"'{}<>]{2,120})[\"']", r">\s*([A-Z][A-Za-z0-9 ,.'’!?-]{3,80})\s*<")


def ui_labels(files: DataFrame, patterns: tuple[str, ...] = UI_LABELS, exts: tuple[str, ...] = UI_FILES) -> DataFrame:
    """(root_name, rel_path, label), distinct, of markup files (X9), without white space around it."""
    label = F.regexp_replace("label", r"^\s+|\s+\z", "")
    return _named(files, patterns, exts, "label").withColumn("label", label).where("label <> ''").distinct()


def config_keys(files: DataFrame) -> DataFrame:
    """(root_name, rel_path, key): the names, never the values, of KEY=value lines of .env files and of key: lines of YAML files."""
    line = files.where(F.col("rel_path").rlike(r"(^|/)\.env[^/]*$|\.(ya?ml|properties)$")).select("root_name", "rel_path", F.explode(F.split("content", "\n")).alias("line"))
    form = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.-]*)\s*[=:](?:\s|$|[^:=/])"
    return line.where(F.col("line").rlike(form)).select("root_name", "rel_path", F.regexp_extract("line", form, 1).alias("key")).distinct()


def json_config_keys(files: DataFrame, deepest: int = 4) -> DataFrame:
    """(root_name, rel_path, key): the dotted paths of the objects of .json files down to so many levels; values are not kept."""
    at = files.where(F.col("rel_path").endswith(".json")).select("root_name", "rel_path", F.lit("").alias("above"), F.from_json("content", "map<string,string>").alias("m"))
    out = None
    for _ in range(deepest):
        e = at.select("root_name", "rel_path", "above", F.explode("m").alias("k", "v")).withColumn("key", F.concat("above", "k"))
        found = e.select("root_name", "rel_path", "key")
        out = found if out is None else out.unionByName(found)
        at = e.where(F.ltrim("v").startswith("{")).select("root_name", "rel_path", F.concat("key", F.lit(".")).alias("above"), F.from_json("v", "map<string,string>").alias("m"))
    return out.distinct()


def read_manifests(files: DataFrame) -> DataFrame:
    """(root_name, dir, ecosystem, name, version_constraint, scope) of package.json, composer.json, go.mod, requirements files, Cargo.toml,
    pyproject.toml, Pipfile and pom.xml (placeholders as written)."""
    base = F.element_at(F.split("rel_path", "/"), -1)
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    f = files.select("root_name", folder.alias("dir"), base.alias("base"), "content")
    scopes = {"dependencies": "runtime", "devDependencies": "development", "peerDependencies": "peer", "optionalDependencies": "optional"}
    js = f.where("base = 'package.json'").withColumn("j", F.from_json("content", ", ".join(f"{k} map<string,string>" for k in scopes)))
    entries = F.flatten(F.array(*(_entries(k, s) for k, s in scopes.items())))
    npm = js.select("root_name", "dir", F.lit("npm").alias("ecosystem"), F.explode(entries).alias("e")).select("root_name", "dir", "ecosystem", "e.*")
    line = f.select("root_name", "dir", "base", F.explode(F.split("content", "\n")).alias("line"))
    mod = r"^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+(v[^\s]+)"
    go = line.where((F.col("base") == "go.mod") & F.col("line").rlike(mod)).select("root_name", "dir", F.lit("go").alias("ecosystem"), F.regexp_extract("line", mod, 1).alias("name"), F.regexp_extract("line", mod, 2).alias("version_constraint"), F.when(F.col("line").contains("// indirect"), "transitive").otherwise("runtime").alias("scope"))
    req = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([=<>!~]=?[^;#\s]*)?"
    pip = line.where(F.col("base").rlike(r"^requirements.*\.txt$") & F.col("line").rlike(req)).select("root_name", "dir", F.lit("pip").alias("ecosystem"), F.regexp_extract("line", req, 1).alias("name"), F.nullif(F.regexp_extract("line", req, 2), F.lit("")).alias("version_constraint"), F.lit("runtime").alias("scope"))
    php = f.where("base = 'composer.json'").withColumn("j", F.from_json("content", "`require` map<string,string>, `require-dev` map<string,string>"))
    php = php.select("root_name", "dir", F.lit("composer").alias("ecosystem"), F.explode(F.concat(_entries("`require`", "runtime"), _entries("`require-dev`", "development"))).alias("e")).select("root_name", "dir", "ecosystem", "e.*").where("name <> 'php' and name not like 'ext-%'")
    toml = _sections(f.where(F.col("base").isin("Cargo.toml", "pyproject.toml", "Pipfile")))
    scope = F.when(F.col("section").rlike("dev|test"), "development").when(F.col("section").rlike("build"), "build").when(F.col("section").rlike("optional"), "optional").otherwise("runtime")
    pair = r"^\s*\"?([A-Za-z0-9_.@/-]+)\"?\s*=\s*(.*?)\s*$"
    table = toml.where(F.col("section").rlike(r"(^|\.)((dev|build)-)?(dependencies|packages|dev-packages)$") & F.col("line").rlike(pair))
    value = F.regexp_extract("line", pair, 2)
    stated = F.when(value.startswith("{"), F.nullif(F.regexp_extract(value, r'version\s*=\s*"([^"]*)"', 1), F.lit(""))).otherwise(F.regexp_replace(value, '"', ""))
    eco = F.when(F.col("base") == "Cargo.toml", "cargo").otherwise("pip")
    named = table.select("root_name", "dir", eco.alias("ecosystem"), F.regexp_extract("line", pair, 1).alias("name"), stated.alias("version_constraint"), scope.alias("scope")).where("not (ecosystem = 'pip' and name = 'python')")
    listed = toml.where("base = 'pyproject.toml' and section = 'project'").groupBy("root_name", "dir").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("body"))
    wanted = F.regexp_extract_all(F.regexp_extract("body", r"(?s)(?:^|\n)dependencies\s*=\s*\[(.*?)(?:\n\s*\]|\]\s*(?:\n|$))", 1), F.lit('"([^"]+)"'), F.lit(1))
    need = r"^([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*([^;]*)"
    project = listed.select("root_name", "dir", F.explode(wanted).alias("d")).select("root_name", "dir", F.lit("pip").alias("ecosystem"), F.regexp_extract("d", need, 1).alias("name"), F.nullif(F.trim(F.regexp_extract("d", need, 2)), F.lit("")).alias("version_constraint"), F.lit("runtime").alias("scope"))
    pom = f.where("base = 'pom.xml'").select("root_name", "dir", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("d"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("d", rf"<{t}>([^<]*)</{t}>", 1)), F.lit(""))
    maven = pom.select("root_name", "dir", F.lit("maven").alias("ecosystem"), F.concat_ws(":", tag("groupId"), tag("artifactId")).alias("name"), tag("version").alias("version_constraint"), F.when(tag("scope") == "test", "development").when(tag("optional") == "true", "optional").otherwise("runtime").alias("scope"))
    return npm.unionByName(go).unionByName(pip).unionByName(php).unionByName(named).unionByName(project).unionByName(maven)


def _sections(files: DataFrame) -> DataFrame:
    """(root_name, dir, base, pos, line, section): lines under their [section] header, comments and headers left out."""
    line = files.select("root_name", "dir", "base", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    head = F.nullif(F.regexp_extract("line", r"^\s*\[+([^\]]+)\]+\s*$", 1), F.lit(""))
    w = Window.partitionBy("root_name", "dir", "base").orderBy("pos")
    return line.withColumn("section", F.coalesce(F.last_value(head, F.lit(True)).over(w), F.lit(""))).where(head.isNull() & ~F.col("line").rlike(r"^\s*#"))


# Manifests that are known and not read.
UNREAD = {"build.gradle": "gradle", "build.gradle.kts": "gradle", "Gemfile": "bundler", "mix.exs": "hex", "Package.swift": "swift", "pubspec.yaml": "pub", "setup.py": "pip", "stack.yaml": "haskell"}


def manifest_gaps(files: DataFrame) -> DataFrame:
    """(root_name, ecosystem): manifests in formats that are not read, once per root and ecosystem."""
    base = F.element_at(F.split("rel_path", "/"), -1)
    known = F.try_element_at(F.create_map(*(F.lit(x) for kv in UNREAD.items() for x in kv)), base)
    return files.select("root_name", F.coalesce(known, F.when(base.endswith(".csproj"), "nuget")).alias("ecosystem")).where("ecosystem is not null").distinct()


def manifest_platforms(files: DataFrame) -> DataFrame:
    """(root_name, dir, platform, version_constraint): engines of package.json, the go line of go.mod, requires-python of pyproject.toml."""
    base, folder = F.element_at(F.split("rel_path", "/"), -1), F.regexp_replace("rel_path", "/?[^/]*$", "")
    f = files.select("root_name", folder.alias("dir"), base.alias("base"), "content")
    js = f.where("base = 'package.json'").select("root_name", "dir", F.explode(F.from_json("content", "engines map<string,string>")["engines"]).alias("platform", "version_constraint"))
    one = lambda name, platform, form: f.where(F.col("base") == name).select("root_name", "dir", F.lit(platform).alias("platform"), F.nullif(F.regexp_extract("content", form, 1), F.lit("")).alias("version_constraint")).where("version_constraint is not null")
    return js.unionByName(one("go.mod", "go", r"(?m)^go\s+(\S+)")).unionByName(one("pyproject.toml", "python", r'(?m)^requires-python\s*=\s*"([^"]+)"'))


def manifest_executables(files: DataFrame) -> DataFrame:
    """(root_name, dir, name): the bin entries of package.json and the scripts of pyproject.toml."""
    base, folder = F.element_at(F.split("rel_path", "/"), -1), F.regexp_replace("rel_path", "/?[^/]*$", "")
    f = files.select("root_name", folder.alias("dir"), base.alias("base"), "content")
    js = f.where("base = 'package.json'").select("root_name", "dir", F.explode(F.map_keys(F.from_json("content", "bin map<string,string>")["bin"])).alias("name"))
    py = _sections(f.where("base = 'pyproject.toml'")).where("section in ('project.scripts', 'tool.poetry.scripts')").select("root_name", "dir", F.regexp_extract("line", r"^\s*\"?([A-Za-z0-9_.-]+)\"?\s*=", 1).alias("name")).where("name <> ''")
    return js.unionByName(py).distinct()


def _entries(field: str, scope: str):
    held = F.coalesce(F.map_entries(F.col(f"j.{field}")), F.array().cast("array<struct<key:string,value:string>>"))
    return F.transform(held, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version_constraint"), F.lit(scope).alias("scope")))


def read_lockfiles(files: DataFrame) -> DataFrame:
    """(root_name, dir, name, version): every pair that go.sum, yarn.lock, pnpm-lock.yaml, composer.lock, poetry.lock, uv.lock, Cargo.lock, Gemfile.lock and package-lock.json (top
    level and workspace members, no nested copies, no git or file sources) state."""
    base = F.element_at(F.split("rel_path", "/"), -1)
    folder = F.regexp_replace("rel_path", "/?[^/]*$", "")
    f = files.select("root_name", folder.alias("dir"), base.alias("base"), "content")
    line = f.select("root_name", "dir", "base", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    sums = r"^([^\s]+)\s+v([^\s/]+)\s+h1:"
    go = line.where((F.col("base") == "go.sum") & F.col("line").rlike(sums)).select("root_name", "dir", F.regexp_extract("line", sums, 1).alias("name"), F.regexp_extract("line", sums, 2).alias("version"))
    head = F.nullif(F.regexp_extract("line", r'^"?((?:@[^/"]+/)?[^@"\s]+)@', 1), F.lit(""))
    w = Window.partitionBy("root_name", "dir").orderBy("pos")
    yarn = line.where("base = 'yarn.lock'").withColumn("name", F.last_value(head, F.lit(True)).over(w)).withColumn("version", F.nullif(F.regexp_extract("line", r'^\s+"?version"?:?\s+"?([^"\s]+)"?', 1), F.lit(""))).where("version is not null").select("root_name", "dir", "name", "version")
    lock = f.where("base = 'package-lock.json'").withColumn("j", F.from_json("content", "packages map<string,struct<version:string,resolved:string,link:boolean>>"))
    e = lock.select("root_name", "dir", F.explode("j.packages").alias("path", "p"))
    form = r"^(?:(.+)/)?node_modules/((?:@[^/]+/)?[^/]+)$"
    e = e.select("root_name", "dir", "p", F.regexp_extract("path", form, 1).alias("member"), F.regexp_extract("path", form, 2).alias("name"))
    e = e.where((F.col("name") != "") & ~F.col("member").contains("node_modules") & F.col("p.version").isNotNull() & ~F.coalesce(F.col("p.link"), F.lit(False)) & ~F.coalesce(F.col("p.resolved"), F.lit("")).rlike("^(git|git\\+|file:|link:|portal:|workspace:)"))
    npm = e.select("root_name", F.concat_ws("/", F.nullif("dir", F.lit("")), F.nullif("member", F.lit(""))).alias("dir"), "name", F.col("p.version").alias("version"))
    php = f.where("base = 'composer.lock'").withColumn("j", F.from_json("content", "packages array<struct<name:string,version:string>>, `packages-dev` array<struct<name:string,version:string>>"))
    none = F.array().cast("array<struct<name:string,version:string>>")
    php = php.select("root_name", "dir", F.explode(F.concat(F.coalesce("j.packages", none), F.coalesce("j.packages-dev", none))).alias("e")).select("root_name", "dir", "e.name", F.regexp_replace("e.version", "^v", "").alias("version"))
    pnpm = r"^\s{2}'?/?((?:@[^/@']+/)?[^/@'\s(]+)[@/]([0-9][^:'(\s]*)(?:\([^)]*\))*'?:\s*(?:\{.*)?$"
    at = line.where((F.col("base") == "pnpm-lock.yaml") & F.col("line").rlike(pnpm)).select("root_name", "dir", F.regexp_extract("line", pnpm, 1).alias("name"), F.regexp_extract("line", pnpm, 2).alias("version"))
    block = line.where(F.col("base").isin("poetry.lock", "Cargo.lock", "uv.lock"))
    opened = F.sum(F.col("line").rlike(r"^\[\[package\]\]").cast("int")).over(Window.partitionBy("root_name", "dir", "base").orderBy("pos"))
    field = lambda k: F.min_by(F.nullif(F.regexp_extract("line", rf'^{k} = "([^"]*)"', 1), F.lit("")), F.when(F.col("line").rlike(rf"^{k} = "), F.col("pos")))
    toml = block.withColumn("block", opened).where("block > 0").groupBy("root_name", "dir", "base", "block").agg(field("name").alias("name"), field("version").alias("version")).where("name is not null and version is not null").select("root_name", "dir", "name", "version")
    gem = r"^ {4}([A-Za-z0-9][A-Za-z0-9_.-]*) \(([0-9][^)\s]*)\)$"
    ruby = line.where((F.col("base") == "Gemfile.lock") & F.col("line").rlike(gem)).select("root_name", "dir", F.regexp_extract("line", gem, 1).alias("name"), F.regexp_extract("line", gem, 2).alias("version"))
    return go.unionByName(yarn).unionByName(npm).unionByName(php).unionByName(at).unionByName(toml).unionByName(ruby).distinct()
