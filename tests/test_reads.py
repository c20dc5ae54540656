"""Places, comments and what code reads and calls, against brute force and on planted files."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.operators import effects, lexing, reads, scans

FILES = "root_name string, rel_path string, content string"


def frame(spark, files):
    return spark.createDataFrame([("r", p, c) for p, c in files.items()], FILES)


def brute_comments(text, hashes):
    """The offsets inside comments, by one pass of a state machine."""
    state, inside, i = "code", set(), 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if state == "code":
            state = "line" if two == "//" or (c == "#" and hashes) else "block" if two == "/*" else c if c in "'\"`" else "code"
        elif state == "line" and c == "\n":
            state = "code"
        elif state == "block" and two == "*/":
            inside |= {i, i + 1}
            state, i = "code", i + 2
            continue
        elif state in ("'", '"', "`"):
            if c == "\\":
                i += 2
                continue
            state = "code" if c == state else state
        if state in ("line", "block"):
            inside.add(i)
        i += 1
    return inside


@pytest.mark.parametrize("hashes", [True, False])
def test_comments_are_those_of_a_state_machine(spark, hashes):
    r = random.Random(4)
    pieces = ["/", "*", "//", "/*", "*/", "#", "'", '"', "`", "\\", "\n", "a", " ", "é", "🙂", "*/x", "/*/"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(800)] + ["", "/", "'", "\\", "/*", "'\\", '"a\\"//b" // c', "x /* y */ z"]
    got = {}
    for row in lexing.comments(frame(spark, {str(i): t for i, t in enumerate(texts)}), hashes).collect():
        got.setdefault(int(row.rel_path), set()).update(range(row.start, row.end))
    assert all(got.get(i, set()) == brute_comments(t, hashes) for i, t in enumerate(texts))


def test_places_of_matches(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("ab\né ") for _ in range(r.randint(0, 60))) for _ in range(200)]
    got = {(int(x.rel_path), x.start, x.end, x.line, x.column, x.match, x.g) for x in lexing.locate(frame(spark, {str(i): t for i, t in enumerate(texts)}), r"a(\n?b)?", ("g",)).collect()}
    import re

    want = {(i, m.start(), m.end(), t.count("\n", 0, m.start()) + 1, m.start() - t.rfind("\n", 0, m.start()), m[0], m[1] or "") for i, t in enumerate(texts) for m in re.finditer(r"a(\n?b)?", t)}
    assert got == want


def test_many_matches_take_linear_time(spark):
    """200,000 matches, strings with 200,000 escapes and as many comments in one text."""
    text = 'x.Begin(\n"' + "\\n" * 200_000 + '"\n' + "SELECT /* c */\n" * 200_000
    files = frame(spark, {"a.go": text})
    began = time.time()
    assert scans.scan_patterns(files).groupBy("label").count().orderBy("label").collect() == [("Begin", 1), ("sql", 200_000)]
    assert lexing.comments(files).agg(F.count("*"), F.max("end")).first() == (200_000, len(text) - 1)
    assert time.time() - began < 60


def test_urls(spark):
    code = '''const a = "https://api.example.com/v1";
// "https://comment.example.com/"
/* "https://block.example.com" */ x('http://localhost/a'); y("http://local"); z("http://svc:80/q")
fetch(`https://x.example.com/${id}/y`) + "https://beside.example.com/";
u = "https://z.example.com/" + p; s = "http://www.w3.org/2000/svg"; q = '// no comment'; w = "http://auth-service/x"
<a href="https://link.example.com/">l</a> <img src = 'https://img.example.com/a'>
# "https://hash.example.com/"
'''
    got = sorted((x.line, x.column, x.target, x.confidence) for x in reads.outbound_urls(frame(spark, {"a.ts": code, "b.md": code, "c.go": ""})).collect())
    assert got == [
        (1, 11, "https://api.example.com/v1", "medium"), (3, 37, "http://localhost/a", "medium"), (3, 81, "http://svc:80/q", "medium"), (4, 7, None, "unresolved"), (4, 42, "https://beside.example.com/", "medium"),
        (5, 5, None, "unresolved"), (5, 94, "http://auth-service/x", "medium"),
    ]
    reasons = {x.reason for x in reads.outbound_urls(frame(spark, {"a.ts": code})).collect() if x.reason}
    assert reasons == {'destination is built at runtime from "https://x.example.com/…"', 'destination is built at runtime from "https://z.example.com/…"'}


def test_sinks(spark):
    files = {
        "a.go": 'import "net/smtp"\nimport "github.com/aws/aws-sdk-go-v2"\nsmtp.SendMail(a)\nc.GetObject(ctx, in)\nc.GetObject(key)\nc.PutItem(context.TODO(), x)\nhttp.Get(u) // no import of the package\n// smtp.SendMail(x)\n',
        "b.go": 'import "net/http"\nhttp.PostForm(u)\nsmtp.SendMail(x)\nhttp.NewRequest(u)\n',
        "c.ts": "import axios from 'axios'\naxios('/x')\naxios.get('/y')\nfetch ('/z')\na.fetch('/z')\nprefetch('/z')\n/* fetch('/z') */ s3.NewClient()\n",
        "d.vue": "axios('/x'); window.fetch(1)",
    }
    got = sorted((x.rel_path, x.line, x.package_name, x.member_name, x.confidence) for x in reads.outbound_sinks(frame(spark, files)).collect())
    assert got == [
        ("a.go", 3, "net/smtp", "SendMail", "high"), ("a.go", 4, "aws-sdk-go", "GetObject", "medium"), ("a.go", 6, "aws-sdk-go", "PutItem", "medium"), ("b.go", 2, "net/http", "PostForm", "medium"),
        ("c.ts", 2, "axios", "request", "medium"), ("c.ts", 3, "axios", "get", "medium"), ("c.ts", 4, "fetch", "fetch", "low"), ("d.vue", 1, "axios", "request", "medium"),
    ]


def test_ui_calls(spark):
    code = """const v2 = `${config.mainApi}/v2`; let odd = `${x.y}z`;
axios.get(`${cfg.base}/a/${id}/b?q=1`)
httpClient.post<App.Base<Leave>>(`${v2}/leaves`, body)
api.delete('/plain'); api.delete('/plain' + x); http.request(`${v2}`)
axios.put(url, body)
axios.patch(`no/slash`); other.get('/x'); api.get()
// axios.get('/comment')
request.head(`${odd}/k`); http.options(`/bare/${a}-b`)
"""
    got = sorted((x.line, x.column, x.method or "", x.base or "", x.target or "", x.confidence, x.failure is None) for x in reads.ui_calls(frame(spark, {"a.tsx": code, "b.go": code})).collect())
    assert got == [
        (2, 1, "GET", "base", "/a/:param/b", "high", True), (3, 1, "POST", "mainApi", "/v2/leaves", "high", True), (4, 1, "DELETE", "", "/plain", "high", True), (4, 23, "DELETE", "", "", "low", False), (4, 49, "", "mainApi", "/v2", "high", True),
        (5, 1, "PUT", "", "", "low", False), (6, 1, "PATCH", "", "", "low", False), (8, 1, "HEAD", "odd", "/k", "high", True), (8, 27, "OPTIONS", "", "/bare/:param", "medium", True),
    ]


def test_data_usage(spark):
    files = {
        "src/models/Leave.js": "sequelize.define('LeaveReq', {}, { tableName: 'wcp_leave' })", "src/models/none.js": "define('Nope', {})", "src/x.js": "models.leave.findAll({})\ndb.LeaveReq.destroy ()\nmodels.other.bulkCreate(a)\nmodels.leave.build()\n// models.leave.count()\nthis.#x = models.Leave.count()",
        "constant/tables.go": 'const (\n  TbLv TableName = "wcp_leave"\n  TbLog = "wcp_log"\n)', "late/table.go": 'TbLog = "log2"',
        "svc/a.go": 'db.Table(constant.TbLog.String).\n  Where("a", 1).\n  Updates(x)\ndb.Table(TbLv).Find(&y)\ndb.Table(c.TbLv.TbLog).Find(x).\n\tDelete(y)\ndb.Table(unknown.Name).Create(z)\ndb.Table(TbLv)\ndb.Create(q)\ndb.Table("raw").Find(x)\n// db.Table(TbLv)\ndb.Table(TbLv).Where("x\\")\n", `a\nb`,\n f(1)).Count(n)\n',
    }
    got = sorted((x.rel_path, x.line, x.mechanism, x.entity or "", x.operation, x.confidence, (x.reason or "")[:9]) for x in reads.data_usage(frame(spark, files)).collect())
    assert got == [
        ("src/x.js", 1, "sequelize", "wcp_leave", "read", "high", ""), ("src/x.js", 2, "sequelize", "wcp_leave", "delete", "high", ""), ("src/x.js", 3, "sequelize", "other", "write", "low", "no table "), ("src/x.js", 6, "sequelize", "wcp_leave", "read", "high", ""),
        ("svc/a.go", 1, "gorm", "log2", "write", "high", ""), ("svc/a.go", 4, "gorm", "wcp_leave", "read", "high", ""), ("svc/a.go", 5, "gorm", "log2", "delete", "high", ""), ("svc/a.go", 7, "gorm", "", "unknown", "unresolved", '"unknown.'),
        ("svc/a.go", 8, "gorm", "wcp_leave", "unknown", "high", ""), ("svc/a.go", 12, "gorm", "wcp_leave", "read", "high", ""),
    ]


def test_doc_items(spark):
    files = {"a.ts": "/** One\n * two\n */ x\n// a\n  // b \n\n// no\n//c\n/* . */", "b.py": "# hash one\nx = 1 # not a line of its own\n#  two  \n#", "c.md": "# title"}
    got = sorted((x.rel_path, x.line, x.form, x.text) for x in scans.doc_items(frame(spark, files)).collect())
    assert got == [("a.ts", 1, "block", "One\ntwo"), ("a.ts", 4, "lines", "a b"), ("a.ts", 7, "lines", "no c"), ("b.py", 1, "hash", "hash one"), ("b.py", 3, "hash", "two")]


def test_auth_words(spark):
    rows = {"userSession": "authentication", "authorMiddleware": "unresolved", "superuser": "unresolved", "JWT-check": "authentication", "passport": "unresolved", "requireLogin": "authentication", "": "unresolved", None: "unresolved"}
    df = spark.createDataFrame([(k, None) for k in rows], "m string, r string")
    assert {r.m: r.c for r in df.select("m", effects.auth_check_of(F.col("m"), F.col("r")).alias("c")).collect()} == rows
    hints = spark.createDataFrame([("requirePassport",), ("isGuarded",), ("loginUser",)], "c string").select(effects.looks_like_auth(F.col("c")).alias("x")).collect()
    assert [r.x for r in hints] == [True, True, False]
