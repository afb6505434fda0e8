"""Search, trigrams, symbols, imports, semantic search, the index and its upkeep, on small corpora of source files."""

import math
import os
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import paths, regexes
from quillon.operators import diagnostics, index, search, semantic, symbols, trigrams
from quillon.sources import files as sources
from quillon.streaming import changes

TOKEN = "CANARY_7f3a"
CORPUS = {
    "src/auth.rs": f"\n// {TOKEN}\n\npub struct AuthManager {{\n    secret: String,\n}}\n\nimpl AuthManager {{\n    pub fn new() -> Self {{ todo!() }}\n    pub fn authenticate(&self) -> bool {{ true }}\n    fn verify_token(&self) {{}}\n}}\n",
    "src/database.rs": f"\n// {TOKEN}\npub struct DatabasePool;\nimpl DatabasePool {{\n    pub fn execute_query(&self) {{\n        // stub: return empty result set\n    }}\n    pub fn execute_sql_transaction(&self) {{}}\n}}\n",
    "src/main.rs": f"\n// {TOKEN}\nmod auth;\nmod database;\nfn main() {{\n    auth::start();\n}}\n",
    "lib/utils.py": f'\n# {TOKEN}\ndef helper_calculate_hash(x):\n    return x\n\n\nclass UserValidator:\n    """def not_a_function():"""\n    def check(self):\n        pass\n',
    "lib/models.py": f"\n# {TOKEN}\nfrom .utils import UserValidator\nimport utils\n\nclass User:\n    pass\n\nclass Post:\n    pass\n",
    "frontend/app.js": f"\n// {TOKEN}\nimport {{ x }} from './helpers';\nconst y = require('./helpers.js');\nclass AppController {{\n  start() {{ }}\n}}\nfunction boot() {{}}\n",
    "frontend/helpers.js": "export function help() {}\n",
    "tests/auth_test.rs": f"\n// {TOKEN}\nmod tests {{\n    fn test_login() {{}}\n    fn test_logout() {{}}\n}}\n",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, f"/w/project/{p}", c) for i, (p, c) in enumerate(CORPUS.items())], "file_id bigint, path string, content string").cache()


@pytest.fixture(scope="module")
def engine(files):
    extracted = symbols.extract(files).cache()
    links = symbols.edges(symbols.import_table(extracted), files)
    return search.Engine(files, symbols.symbol_table(extracted), links, trigrams.postings(files), ["/w/project"])


def found(df):
    return [(r["file_path"].removeprefix("project/"), r["line_number"]) for r in df.collect()]


def test_canary(engine):
    rows = engine.search(TOKEN, 50).collect()
    assert len(rows) == 7 and all(r["score"] > 0 and TOKEN in r["content"] and r["line_number"] == 2 for r in rows)
    assert all(r["content"].encode()[r["match_start"] : r["match_end"]].decode() == TOKEN for r in rows)
    assert len(found(engine.search(TOKEN.lower(), include="*.rs"))) == 4
    assert not [p for p, _ in found(engine.search(TOKEN, exclude="*/tests/*")) if p.startswith("tests")]
    assert {p for p, _ in found(engine.search(TOKEN, include="**/*.py"))} == {"lib/utils.py", "lib/models.py"}
    assert len(found(engine.search(TOKEN, 3))) == 3
    assert found(engine.search("   ")) == [] and found(engine.search("no_such_token")) == []
    assert found(engine.search("pub struct AuthManager")) == [("src/auth.rs", 4)]


def test_symbol_search(engine):
    rows = engine.search("AuthManager", symbols=True).collect()
    assert rows[0]["file_path"] == "project/src/auth.rs" and all(r["is_symbol"] for r in rows) and {r["line_number"] for r in rows} == {4, 8}
    assert found(engine.search("stub: return empty", symbols=True)) == []
    assert ("src/auth.rs", 0) in found(engine.search("auth", symbols=True))
    scores = {r["content"].strip(): r["score"] for r in engine.search("user", symbols=True).collect()}
    assert scores["class User:"] > 1.9 * scores["class UserValidator:"]


def test_regex_search(engine):
    assert {p.rpartition(".")[2] for p, _ in found(engine.search(r"pub fn \w+", regex=True))} == {"rs"}
    assert {p.rpartition(".")[2] for p, _ in found(engine.search(r"class \w+", regex=True))} == {"py", "js"}
    with pytest.raises(ValueError):
        engine.search("(", regex=True)
    # Alternatives of which the longest is in no file: the others are still found.
    assert found(engine.search("AuthManager|NoSuchLongLiteral", regex=True))


def test_index_equals_full_scan(engine, files):
    plain = search.Engine(files, engine.symbols, engine.edges, None, engine.roots)
    for query in ("auth", "fn", "_", "User", "CLASS", "return", "helpers"):
        for options in ({}, {"symbols": True}):
            assert engine.search(query, 1000, **options).collect() == plain.search(query, 1000, **options).collect()
    for query in ("String|Vec|stub", "(auth)?x", r"\w+_\w+", "(?i)AUTHMANAGER", "test_log(in|out)"):
        assert engine.search(query, 1000, regex=True).collect() == plain.search(query, 1000, regex=True).collect()


def test_scores(engine):
    row = next(r for r in engine.search("AuthManager").collect() if r["line_number"] == 4)
    line = "pub struct AuthManager {"
    assert row["score"] == pytest.approx(2 * 3 * 1.5 / (1 + math.log1p(len(line) / 100)) * (1 + 0.5 * math.log10(1)), abs=1e-8)
    assert row["dependency_count"] == 1 and row["is_symbol"]


def test_dependencies(engine):
    assert [r["path"] for r in engine.dependents("src/auth.rs").collect()] == ["project/src/main.rs"]
    assert {r["path"] for r in engine.dependencies("main.rs").collect()} == {"project/src/auth.rs", "project/src/database.rs"}
    assert [r["path"] for r in engine.dependents("helpers.js").collect()] == ["project/frontend/app.js"]
    assert [r["path"] for r in engine.dependents("lib/utils.py").collect()] == ["project/lib/models.py"]


def test_content_and_context(engine):
    row = engine.content("src/main.rs").first()
    assert row["content"] == CORPUS["src/main.rs"] and row["line_count"] == 7 and row["size_bytes"] == len(CORPUS["src/main.rs"])
    w = engine.window("src/main.rs", 100, 2).first()
    assert (w["start_line"], w["end_line"], w["total_lines"]) == (5, 7, 7)
    (r,) = engine.search("pub struct AuthManager", context=2).collect()
    assert r["context_before"] == [f"// {TOKEN}", ""] and r["context_after"] == ["    secret: String,", "}"]
    assert engine.find("no/such").count() == 0
    assert [r["file_path"] for r in engine.stream("DatabasePool", 1)] == ["project/src/database.rs"]


def test_fast_mode(engine):
    few = search.Engine(engine.files, engine.symbols, engine.edges, engine.postings, engine.roots, fast_files=2, auto_fast=3)
    assert len({p for p, _ in found(few.search(TOKEN, mode="fast"))}) == 2
    assert few.info(few.candidates([TOKEN.lower()]), search.RankMode.AUTO).first().asDict() == {"mode": "fast", "total_candidates": 7, "candidates_searched": 2}
    assert few.info(few.candidates([TOKEN.lower()]), search.RankMode.FULL).first()["candidates_searched"] == 7
    assert search.RankMode.parse("FAST") is search.RankMode.FAST and search.RankMode.parse(None) is search.RankMode.AUTO


def test_auto_mode_is_whole(engine):
    few = search.Engine(engine.files, engine.symbols, engine.edges, engine.postings, engine.roots, fast_files=2, auto_fast=3)
    for query, options in ((TOKEN, {}), (r"CANARY_\w+", {"regex": True}), ("a", {"symbols": True})):
        whole = few.search(query, 1000, mode="full", **options).collect()
        assert few.search(query, 1000, **options).collect() == whole and len({r["file_id"] for r in whole}) > 2


def test_per_file_cap_and_empty(spark):
    df = spark.createDataFrame([(1, "/a/big.txt", "hit\n" * 500), (2, "/a/empty.txt", ""), (3, "/a/hit_me.txt", "none"), (4, "/a/null.txt", None)], "file_id bigint, path string, content string")
    e = search.Engine(df)
    rows = e.text("hit", 1000).collect()
    assert sum(r["file_id"] == 1 for r in rows) == 100
    assert [(r["line_number"], r["score"], r["content"]) for r in rows if r["file_id"] == 3] == [(0, 3.0, "/a/hit_me.txt")]
    assert search.Engine(df.limit(0)).text("hit").count() == 0


def test_trigrams(spark, files):
    rows = {}
    for r in trigrams.postings(files).collect():
        rows.setdefault(r["file_id"], set()).add(r["trigram"])
    for r in files.collect():
        b, s = r["content"].lower().encode(), r["path"].rpartition("/")[2].rpartition(".")[0].encode()
        assert rows[r["file_id"]] == {(x[i] << 16) | (x[i + 1] << 8) | x[i + 2] for x in (b, s) for i in range(len(x) - 2)}
    posts = trigrams.postings(files)
    assert {r[0] for r in trigrams.candidates(posts, ["databasepool"]).collect()} == {1}
    assert {r[0] for r in trigrams.candidates(posts, ["databasepool", "appcontroller"]).collect()} == {1, 5}
    assert trigrams.candidates(posts, ["x"]).count() == len(CORPUS)
    bits = trigrams.bitmap_candidates(trigrams.bitmaps(posts), "databasepool").select(F.bitmap_count("bitmap")).collect()
    assert [r[0] for r in bits] == [1]


def test_stored_lists(spark, files, tmp_path, monkeypatch):
    """Lists hold the same as postings, are stored as they are made, without a shuffle, and give it after updates and compaction as well."""
    monkeypatch.setattr(trigrams, "AT_ONCE", 7)
    texts = [None, "", "ab", "größe größe", "x" * 40, "doc_1"]
    want = {(g, 10 * i) for i, t in enumerate(texts) for x in (t, "stem") for g in trigrams.of(x or "")}
    batches = [pa.RecordBatch.from_arrays([pa.array([10 * i]), pa.array([t], pa.string()), pa.array(["stem"])], ["file_id", "content", "stem"]) for i, t in enumerate(texts)]
    for segment in (1, 20, 1 << 21):
        monkeypatch.setattr(trigrams, "SEGMENT", segment)
        got = [(int(k >> 32), ids[int(k & 0xFFFFFFFF)].as_py()) for keys, ids in trigrams._segments(iter(batches)) for k in keys]
        assert len(got) == len(want) and set(got) == want
    assert "Exchange" not in plan_of(trigrams.lists(files))
    folder = str(tmp_path / "index")
    index.save(files, folder)
    raw = spark.read.parquet(f"{folder}/{index.manifest(spark, folder)['base']}/postings")
    assert raw.columns == ["trigram", "file_ids"] and raw.count() < trigrams.postings(files).count()
    index.update(spark, folder, spark.createDataFrame([("/w/project/src/auth.rs", "modified", 1, 1, "fn other() {}"), ("/w/project/src/main.rs", "deleted", 1, 2, None)], "path string, op string, ts int, seq int, content string"))
    for _ in range(2):
        now = index.load(spark, folder)
        assert sorted(now.postings.select("trigram", "file_id").collect()) == sorted(trigrams.postings(now.files).collect()) and now.files.count() == len(CORPUS) - 1
        index.compacted(spark, folder)


def test_index_of_tiny_files(spark):
    """A file without any trigram is found by the index too, where the pattern asks for none."""
    df = spark.createDataFrame([(1, "/a/x", "ab"), (2, "/a/long_name.txt", "about it")], "file_id bigint, path string, content string")
    indexed, plain = search.Engine(df, postings=trigrams.postings(df)), search.Engine(df)
    for query, options in (("ab", {}), (r"a\w", {"regex": True}), ("x", {"symbols": True})):
        assert found(indexed.search(query, **options)) == found(plain.search(query, **options)) and "/a/x" in {p for p, _ in found(indexed.search(query, **options))}
    assert "Join" not in plan_of(indexed.search(r"\w+", regex=True))
    assert "lower(content" in plan_of(indexed.search("about|other", regex=True))  # before the join
    assert found(indexed.search("About|ABOUT|about", regex=True)) == [("/a/long_name.txt", 1)]


def test_lost_files(engine, spark):
    assert diagnostics.lost_files(engine).count() == 0
    more = engine.postings.unionByName(spark.createDataFrame([(1, -1), (2, -1)], "trigram int, file_id bigint"))
    damaged = search.Engine(engine.files, postings=more)
    assert [r[0] for r in diagnostics.lost_files(damaged).collect()] == [-1] and "HashAggregate" in plan_of(diagnostics.lost_files(damaged))


SOURCES = {
    "rs": ("pub async fn go() {}\nstruct S;\nenum E { A }\ntrait T {}\nimpl<T> T for S {}\ntype A = u8;\nconst C: u8 = 1;\n/* fn no() {} */\n// fn neither()", {"go": "Function", "S": "Struct", "E": "Enum", "T": "Trait", "A": "Type", "C": "Constant"}),
    "ts": ("export interface I {}\nexport class C {}\ntype T = string;\nexport enum E {}\nexport async function f() {}", {"I": "Interface", "C": "Class", "T": "Type", "E": "Enum", "f": "Function"}),
    "go": ("func Run() {}\nfunc (s *S) Do() {}\ntype S struct {\n}\ntype R interface {\n}\ntype N int\nconst K = 1\nvar V = 2", {"Run": "Function", "Do": "Method", "S": "Struct", "R": "Interface", "N": "Type", "K": "Constant", "V": "Variable"}),
    "java": ("public class A {\n  public A() {\n  }\n  private static int run(int x) {\n    return go(x);\n  }\n}\ninterface B {\n}\nenum D { X }", {"A": "Class", "run": "Method", "B": "Interface", "D": "Enum"}),
    "cs": ("namespace N.M\n{\n  public class A\n  {\n    public int P { get; set; }\n    public void Do(int x)\n    {\n    }\n  }\n  struct Q {}\n}", {"N.M": "Class", "A": "Class", "P": "Method", "Do": "Method", "Q": "Struct"}),
    "cpp": ("namespace n {\nclass A {\n};\nstruct B {\n};\nenum class E { X };\nint add(int a) {\n  return sum(a);\n}\n}", {"n": "Class", "A": "Class", "B": "Struct", "E": "Enum", "add": "Function"}),
    "rb": ("module M\n  class C\n    def self.go?\n    end\n  end\nend", {"M": "Class", "C": "Class", "go?": "Method"}),
    "php": ("<?php\ninterface I {}\nclass C {\n  public function go() {}\n}\nfunction f() {}\ntrait T {}", {"I": "Interface", "C": "Class", "go": "Method", "f": "Function", "T": "Trait"}),
    "sh": ("function a {\n}\nb() {\n}", {"a": "Function", "b": "Function"}),
    "py": ("async def f():\n    pass\nclass C:\n    @property\n    def m(self): ...\nx = \"\"\"\ndef no(): ...\n\"\"\"", {"f": "Function", "C": "Class", "m": "Function"}),
    "pyi": ("def f(:\nclass C:\n    def m(self): ...", {"f": "Function", "C": "Class", "m": "Function"}),
    "gemspec": ("def a\nend", {"a": "Method"}),
    "mts": ("export class C {}", {"C": "Class"}),
    "json": ('{"def": 1}', {}),
    "txt": ("def f(): pass", {}),
}


@pytest.mark.parametrize("ext", SOURCES)
def test_symbols_of_language(ext):
    content, want = SOURCES[ext]
    got = symbols.symbols(content, ext)
    assert {n: k for n, k, *_ in reversed(got)} | want == {n: k for n, k, *_ in reversed(got)} and {n for n, *_ in got} == set(want)
    assert [x[2] for x in got] == sorted(x[2] for x in got)


def test_imports():
    assert symbols.imports("use crate::a::B;\nmod x;\n", "rs") == [("crate::a::B", 0, "Rust"), ("x", 1, "Rust")]
    assert symbols.imports("import os, sys\nfrom .a.b import c\n", "py") == [("os", 0, "Python"), (".a.b", 1, "Python")]
    assert [x[0] for x in symbols.imports("import a from './a'\nimport './b'\nconst c = require(\"../c\")\n", "ts")] == ["./a", "./b", "../c"]
    assert symbols.imports("import x", "java") == []


def test_resolution_order(spark):
    df = spark.createDataFrame([(1, "/r/a/x.js", ""), (2, "/r/a/y.ts", ""), (3, "/r/b/y.js", ""), (4, "/r/b/z", ""), (5, "/r/a/foo.service.ts", "")], "file_id bigint, path string, content string")
    asked = spark.createDataFrame([(1, "./y", 0), (1, "../b/y", 1), (1, "y", 2), (1, "z", 3), (1, "nothing", 4), (1, "./foo.service", 5), (1, "..", 6), (1, "x.js", 7)], "file_id bigint, import_path string, line int")
    got = {r["import_path"]: r["to_id"] for r in symbols.resolved(asked, df).collect()}
    assert got == {"./y": 2, "../b/y": 3, "y": 3, "z": 4, "nothing": None, "./foo.service": 5, "..": None, "x.js": 1}
    assert {r["import_path"] for r in symbols.pending(asked, df).collect()} == {"nothing", ".."}


def test_chunks(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(1, 26))))], "file_id bigint, content string")
    assert [(r["start_line"], r["end_line"]) for r in semantic.chunks_by_size(df, 10, 2).orderBy("chunk_no").collect()] == [(1, 10), (9, 18), (17, 25), (25, 25)]
    with pytest.raises(ValueError):
        semantic.chunks_by_size(df, 5, 5)


def test_semantic(engine, files, spark):
    indexed = semantic.index(files, engine.symbols)
    rows = indexed.collect()
    assert all(r["symbol_name"] is None or r["chunk_type"] in ("Function", "Class") for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)
    got = semantic.search(indexed, "execute sql transaction", 5).collect()

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    q = semantic.encode("execute sql transaction")
    want = sorted((-round(cosine(r["embedding"], q), 9), r["chunk_id"]) for r in rows)[:5]
    assert [round(r["similarity"], 6) for r in got] == [round(-s, 6) for s, _ in want]
    assert semantic.search(indexed, " ").count() == 0
    assert semantic.stats(indexed).first().asDict() == {"num_chunks": len(rows), "num_files": len(CORPUS), "dim": 128}
    long = semantic.bucket_counts(files, "file_id", "content").collect()
    for r in files.collect():
        counts = [0] * 128
        for x in long:
            if x["file_id"] == r["file_id"]:
                counts[x["bucket"]] = x["n"]
        assert cosine(counts, semantic.encode(r["content"])) == pytest.approx(1)


def test_index_on_disk(spark, files, tmp_path):
    config = index.fingerprint(["/b", "/a"], ["RS"], exclude=["x"])
    assert config == index.fingerprint(["/a", "/b"], ["rs"], exclude=["x"]) != index.fingerprint(["/a"], ["rs"])
    index.save(files, str(tmp_path / "index"), config)
    engine = index.load(spark, str(tmp_path / "index"), ["/w/project"], config)
    assert len(found(engine.search(TOKEN))) == 7 and [r["path"] for r in engine.dependents("src/auth.rs").collect()] == ["project/src/main.rs"]
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "index"), config="other")
    out = diagnostics.diagnostics(engine)
    assert out["summary"].first()["health"] == "Healthy", out["tests"].collect()
    assert out["stats"].first()["num_files"] == len(CORPUS)
    assert {r["extension"]: r["count"] for r in out["extensions"].collect()} == {"rs": 4, "py": 2, "js": 2}


def test_reconcile(spark):
    old = spark.createDataFrame([("a", 1, 1, "b1"), ("b", 1, 1, "b1"), ("c", 1, 1, "b1"), ("d", 1, 1, "b1"), ("e", 1, 1, "b2")], "path string, mtime bigint, size bigint, source_base_path string")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 2), ("e", 1, 1), ("f", 1, 1)], "path string, mtime bigint, size bigint")
    assert dict(index.reconcile(old, new, ["b2"]).collect()) == {"a": "Valid", "b": "Stale", "c": "Stale", "d": "Removed", "e": "Removed", "f": "New"}
    assert [r["path"] for r in index.not_indexed(new, old).collect()] == ["f"]
    links = spark.createDataFrame([(1, 2), (2, 3)], "from_id bigint, to_id bigint")
    ids = spark.createDataFrame([(1, 10), (2, 20)], "old_id bigint, new_id bigint")
    assert [tuple(r) for r in index.remapped(links, ids).collect()] == [(10, 20)]


def test_stream_of_changes(spark, files, tmp_path):
    log, check, inbox = (str(tmp_path / x) for x in ("log", "check", "in"))
    rows = [("/w/project/src/main.rs", "modified", 1, "fn changed() {}"), ("/w/project/src/main.rs", "modified", 2, "fn latest() {}"), ("/w/project/src/auth.rs", "deleted", 3, None), ("/w/new.rs", "modified", 4, "fn new() {}")]

    def put(some):
        df = spark.createDataFrame(some, "path string, op string, seq bigint, content string").withColumn("ts", F.timestamp_seconds("seq"))
        df.select("path", "op", "ts", "seq", "content").coalesce(1).write.mode("append").parquet(inbox)

    put(rows[:2])
    changes.apply_to_log(changes.log_stream(spark, inbox), log, check).start().awaitTermination()
    put(rows[2:])
    changes.apply_to_log(changes.log_stream(spark, inbox), log, check).start().awaitTermination()
    now = {r["path"]: r["content"] for r in changes.current(files, log).collect()}
    assert now["/w/project/src/main.rs"] == "fn latest() {}" and "/w/project/src/auth.rs" not in now and now["/w/new.rs"] == "fn new() {}" and len(now) == len(CORPUS)
    assert changes.compacted(files, log, str(tmp_path / "base")).count() == len(CORPUS)


def test_sources(spark, tmp_path):
    made = {
        "a.txt": b"plain text", "b.py": "größe = 1".encode(), "c.txt": "größe und maß, viele wörter".encode("cp1252"), "d.txt": b"\xff\xfe" + "wide".encode("utf-16-le"), "e.txt": b"\xfe\xff" + "wide".encode("utf-16-be"),
        "f.txt": b"\xef\xbb\xbfmark", "g.txt": "これは日本語の文章です".encode("shift_jis"), "h.bin": b"x", "i.txt": b"a\x00b", "j.js": b"x" * 100_001, "k.c": b"{" * 501, "sub/l.rs": b"fn main() {}", "target/m.rs": b"fn no() {}", "n.md": b"",
    }
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    raw = sources.discover(spark, [str(tmp_path)], exclude=["**/target/**"])
    got = {r["path"].removeprefix(f"{tmp_path}/"): r for r in sources.prepared(raw).collect()}
    assert set(got) == set(made) - {"h.bin", "target/m.rs", "n.md"}  # the scan has no rows of empty files
    assert {n: got[n]["content"] for n in "cdefg" for n in [n + ".txt"]} == {"c.txt": "größe und maß, viele wörter", "d.txt": "wide", "e.txt": "wide", "f.txt": "mark", "g.txt": "これは日本語の文章です"}
    assert {n for n in got if got[n]["reason"]} == {"i.txt", "j.js", "k.c"}
    assert sources.load(spark, [str(tmp_path)], extensions=["rs"]).select(paths.name("path")).collect()[0][0] in ("l.rs", "m.rs")
    assert sources.without(raw, [f"{tmp_path}/a.txt"]).count() == raw.count() - 1
    stream = changes.watched(spark, str(tmp_path), ["**/target/**"])
    changes.apply_to_log(stream, f"{tmp_path}-log", f"{tmp_path}-check").start().awaitTermination()
    log = {r["path"].removeprefix(f"{tmp_path}/"): r for r in spark.read.parquet(f"{tmp_path}-log").collect()}
    assert log["sub/l.rs"]["content"] == "fn main() {}" and log["c.txt"]["content"] == "größe und maß, viele wörter" and log["i.txt"]["op"] == "deleted"


def test_watcher(spark, tmp_path):
    """New, changed and removed files, character sets, a batch that is run again; the index follows, and files keep their ids."""
    root, log, state, folder = tmp_path / "root", str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "index")
    root.mkdir()
    write = lambda name, data, time: ((root / name).write_bytes(data), os.utime(root / name, (time, time)))
    write("auth.rs", b"pub fn authenticate() {}", 1000)
    write("main.rs", b"mod auth;\nfn main() {}", 1000)
    write("old.txt", b"nothing new here", 1000)
    watcher = changes.Watcher(spark, [str(root)], log, state, ["skipped"])
    watcher.batch(0)
    rows = lambda n: {(r["path"].rpartition("/")[2], r["op"], r["content"]) for r in spark.read.parquet(f"{log}/batch={n}").collect()}
    assert {x[:2] for x in rows(0)} == {("auth.rs", "modified"), ("main.rs", "modified"), ("old.txt", "modified")}
    index.save(changes.current(spark.createDataFrame([], "file_id bigint, path string, content string"), log), folder)
    ids = {r["path"]: r["file_id"] for r in index.load(spark, folder).files.collect()}
    write("auth.rs", b"pub fn logout() {}", 2000)
    write("wide.txt", "größe".encode("cp1252"), 500)  # older than what is known
    write("bad.txt", b"a\x00b", 2000)
    write("skipped.txt", b"not watched", 2000)
    (root / "old.txt").unlink()
    for _ in range(2):
        watcher.batch(1)
        assert rows(1) == {("auth.rs", "modified", "pub fn logout() {}"), ("wide.txt", "modified", "größe"), ("bad.txt", "deleted", None), ("old.txt", "deleted", None)}
    watcher.batch(2)
    assert rows(2) == set()
    index.update(spark, folder, spark.read.parquet(f"{log}/batch=1"))
    for _ in range(2):
        now = index.load(spark, folder, [str(root)])
        assert {r["path"].rpartition("/")[2]: r["file_id"] == ids.get(r["path"]) for r in now.files.collect()} == {"auth.rs": True, "main.rs": True, "wide.txt": False}
        assert now.search("authenticate").count() == 0 and now.search("logout", symbols=True).count() == 1 and now.search("größe").count() == 1
        assert [r["path"] for r in now.dependents("auth.rs").collect()] == ["root/main.rs"]
        plain = search.Engine(now.files, now.symbols, now.edges, None, now.roots)
        assert now.search("fn").collect() == plain.search("fn").collect() and now.search("logout", mode="fast").collect() == plain.search("logout", mode="fast").collect()
        assert now.postings.join(now.files, "file_id", "left_anti").count() == 0
        index.compacted(spark, folder)
    query = changes.Watcher(spark, [str(root)], str(tmp_path / "log2"), str(tmp_path / "state2")).start(str(tmp_path / "check2"), "1 second")
    while not (query.lastProgress or {}).get("batchId", 0) > 0:
        assert query.exception() is None
        time.sleep(0.2)
    query.stop()
    assert spark.read.parquet(str(tmp_path / "log2")).filter("op = 'modified'").count() == 4


def test_index_of_paths(spark, tmp_path):
    (tmp_path / "a.py").write_text("def go(): ...")
    (tmp_path / "b.bin").write_bytes(b"def")
    engine = index.of_paths(spark, [str(tmp_path)], f"{tmp_path}-index")
    assert engine.search("go", symbols=True).count() == 1 and engine.files.count() == 1


def test_semantic_store(spark, files, tmp_path):
    folder = str(tmp_path / "chunks")
    numbered = sources.numbered(files)  # ids as large as those of discovered files
    semantic.save(semantic.index(numbered), folder)
    first = semantic.load(spark, folder)
    assert first.count() == first.select("chunk_id").distinct().count() == len(CORPUS)
    again = semantic.reload(spark, folder, numbered.limit(3))
    assert again.count() == 3 and first.count() == len(CORPUS)
    with pytest.raises(ValueError):
        semantic.load(spark, folder, "other")
    cache = semantic.Cache(first, 2)
    a = cache.search("execute sql")
    assert cache.search(" execute sql ") is a and len(cache.search("user", 1)) == 1 and cache.search("post") and cache.stats() == {"size": 2, "capacity": 2, "hits": 1, "misses": 3, "hit_rate": 0.25}
    assert diagnostics.summary(diagnostics.semantic_tests(first)).first()["health"] == "Healthy"
    wrong = first.withColumn("embedding", F.slice("embedding", 1, 5)).withColumn("start_line", F.lit(0))
    assert {r["name"] for r in diagnostics.semantic_tests(wrong).filter("not passed").collect()} >= {"vectors", "chunk_places"}
    status = diagnostics.status(search.Engine(files, postings=trigrams.postings(files)), first).first()
    assert status["health"] == status["semantic_health"] == "Healthy" and status["num_chunks"] == len(CORPUS)
    assert {r["chunk_type"]: r["n"] for r in semantic.chunk_types(first).collect()} == {"Fixed": len(CORPUS)}


def test_bitmaps_of_spread_ids(spark, files):
    posts = trigrams.postings(sources.numbered(files)).cache()
    for share in (1 << 20, 3):
        numbers = trigrams.dense(posts, share).collect()
        assert sorted(r["number"] for r in numbers) == list(range(1, len(CORPUS) + 1))
    maps = trigrams.bitmaps(posts, trigrams.dense(posts))
    assert maps.count() == posts.select("trigram").distinct().count()
    assert {(r["trigram"], r["n"]) for r in maps.select("trigram", F.bitmap_count("bitmap").alias("n")).collect()} == {tuple(r) for r in trigrams.frequencies(posts).collect()}


def test_plan_of_search(engine, files):
    """A top-k, no sort of all matches; the lines of a file are split once."""
    for found in (engine.search("auth"), search.Engine(files).search("auth"), engine.search("fn", regex=True), engine.search("auth", symbols=True)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    assert plan_of(search.Engine(files).search("auth")).count("split(") <= 3  # both branches of one expression


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_depth_saturates():
    rng = random.Random(0)
    for _ in range(200):
        t = "".join(rng.choice("{}()[]x") for _ in range(40))
        now = most = 0
        for c in t:
            now = now + 1 if c in "{([" else max(0, now - 1) if c in "})]" else now
            most = max(most, now)
        assert sources.depth(t.encode()) == most


def test_percentiles(spark):
    values = sorted(random.Random(1).choices(range(50), k=333))
    got = diagnostics.percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
    assert list(got) == [values[len(values) * p // 100] for p in (50, 95, 99)]


def test_needles(spark):
    """Every needle of a seeded corpus is found at its line."""
    rng = random.Random(42)
    rows, needles = [], []
    for f in range(30):
        lines = [f"let x{i} = {rng.randrange(1000)};" for i in range(rng.randint(10, 60))]
        for i in rng.sample(range(len(lines)), 2):
            lines[i] = f"// NEEDLE_{f}_{i}"
            needles.append((f, i))
        rows.append((f, f"/s/src/module_{f // 10}/file_{f}.rs", "\n".join(lines)))
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string").cache()
    e = search.Engine(df, postings=trigrams.postings(df).cache())
    for f, i in needles[::6]:
        hits = [(r["file_id"], r["line_number"]) for r in e.text(f"NEEDLE_{f}_{i}", 100).collect() if re.search(rf"NEEDLE_{f}_{i}\b", r["content"])]
        assert hits == [(f, i + 1)]
    assert regexes.literals(r"NEEDLE_\d+_\d+") == ["needle_"]
    assert e.regex(r"NEEDLE_\d+_\d+", 1000).count() == len(needles)
