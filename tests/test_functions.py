"""Text, paths, globs and regular expressions against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import paths, regexes, text

TEXTS = ["", "a", "a\n", "a\r\n\r\nb\n", "\n\n", "Größe ÉÀ x", "İ dotted", "漢字 and more", "x" * 700, "é" * 400 + "needle" + "é" * 400, "needle" + "y" * 900, "z" * 900 + "NEEDLE"]


def rust_lines(t):
    return [x.removesuffix("\r") for x in t.removesuffix("\n").split("\n")] if t else []


def ascii_fold(t):
    return "".join(c.lower() if c.isascii() else c for c in t)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")


def column(frame, expression):
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_lines(frame):
    assert column(frame, text.lines("t")) == [rust_lines(t) for t in TEXTS]


def test_match(frame):
    for needle in ("needle", "é", "à", "x", "", "字"):
        assert column(frame, text.has("t", needle)) == [needle in ascii_fold(t) for t in TEXTS]
        want = [len(ascii_fold(t)[: ascii_fold(t).find(needle)].encode()) if needle in ascii_fold(t) else None for t in TEXTS]
        assert column(frame, text.match_start("t", needle)) == want


def cut(line, start, end):
    raw = line.encode()
    if len(raw) <= 500:
        return line, start, end, False
    low, high = max(0, start - 200), min(len(raw), end + 200)
    while low > 0 and raw[low] & 0xC0 == 0x80:
        low -= 1
    while high < len(raw) and raw[high] & 0xC0 == 0x80:
        high += 1
    front = "…" if low else ""
    return front + raw[low:high].decode() + ("…" if high < len(raw) else ""), start - low + 3 * bool(low), end - low + 3 * bool(low), True


def test_around_match(frame):
    rows = frame.filter(text.has("t", "needle")).withColumn("s", text.match_start("t", "needle"))
    got = rows.orderBy("i").select(text.around_match(F.col("t"), F.col("s"), F.col("s") + 6)).collect()
    want = [cut(t, len(t.lower()[: t.lower().find("needle")].encode()), len(t.lower()[: t.lower().find("needle")].encode()) + 6) for t in TEXTS if "needle" in t.lower()]
    assert [tuple(r[0]) for r in got] == want


def test_small_ones(frame):
    assert column(frame, text.length_factor("t")) == pytest.approx([max(1 / (1 + math.log1p(len(t.encode()) / 100)), 0.3) for t in TEXTS])
    assert [len(x.encode()) for x in column(frame, text.safe_prefix("t", 501))] == [len(t.encode()[:501].decode(errors="ignore").encode()) for t in TEXTS]
    assert column(frame, text.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(2.0))))[0] == pytest.approx(0.5**0.5)
    assert column(frame, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0))))[0] == 0 and column(frame, text.cosine(F.array(F.lit(1.0)), F.array(F.lit(2.0), F.lit(1.0))))[0] == 0
    assert column(frame, text.bucket(F.lit("hello")))[0] == sum(b"hello") % 128
    assert column(frame, text.tokens(F.lit("The cat_sat, Größe é 42 1234")))[0] == ["the", "cat", "sat", "größe", "1234"]
    sizes = [(500, "500 bytes"), (1536, "1.50 KB"), (3 << 20, "3.00 MB"), (5 << 30, "5.00 GB")]
    assert [column(frame, text.human_bytes(F.lit(n).cast("bigint")))[0] for n, _ in sizes] == [s for _, s in sizes]
    assert column(frame, text.thousands(F.lit(1234567)))[0] == "1_234_567"
    assert [column(frame, text.duration(F.lit(n)))[0] for n in (5, 65, 3665, 90000)] == ["5s", "1m 5s", "1h 1m 5s", "1d 1h 0m"]


PATHS = ["/p/src/main.rs", "/p/src/a/b.py", "/p/lib/x.test.js", "/p/tests/.hidden", "/p/README", "C:\\p\\src\\w.cs", "/p/src.rs", "/q/target/debug/x.o", "/p/src/[x].ts"]


def test_paths(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "i int, p string")
    assert column(df, paths.stem("p")) == ["main", "b", "x.test", ".hidden", "README", "w", "src", "x", "[x]"]
    assert column(df, paths.extension("p")) == ["rs", "py", "js", "", "", "cs", "rs", "o", "ts"]
    assert column(df, paths.display("p", ["/p/src", "/p"]))[:3] == ["src/main.rs", "src/a/b.py", "p/lib/x.test.js"]
    assert column(df, paths.display("p", ["/p"]))[7] == "/q/target/debug/x.o"
    assert column(df, paths.has_binary_extension("p")) == [p.endswith(".o") for p in PATHS]
    assert column(df, paths.is_source("p")) == ["/src/" in p or "/lib/" in p or "\\src\\" in p for p in PATHS]
    assert column(df, paths.watched_out("p", ["**/target/**"])) == ["target" in p for p in PATHS]
    assert column(df, paths.in_scope("p", ["/P/src"])) == [p.lower().startswith("/p/src") for p in PATHS]


@pytest.mark.parametrize(
    ("include", "exclude", "want"),
    [
        ("*.rs", "", [0, 6]), ("src/**", "", [0, 1, 5, 8]), ("src/**/*.rs", "", [0]), ("*.{rs,py}", "", [0, 1, 6]), ("", "src/**;*.o", [2, 3, 4, 6]), ("**/src/**", "*.py", [0, 5, 8]), ("/p/*", "", [0, 1, 2, 3, 4, 6, 8]),
        ("?????.rs;*.js", "", [2, 6]), ("[!a-m]*.js", "", [2]), (" ; ", "", [*range(9)]), ("*[[]x].ts", "", [8]),
    ],
)
def test_globs(spark, include, exclude, want):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(PATHS)], "i int, p string")
    assert sorted(r["i"] for r in df.filter(paths.selected("p", include, exclude)).collect()) == want


def test_bad_globs():
    for bad in ("[a", "{a,b"):
        with pytest.raises(ValueError):
            paths.glob_regex(bad)


REGEXES = ["process_data", "String|Vec|HashMap", "(abcd)?x", r"fn \w+", ".*data.*", "(?i)NeedLe", "a|bcd", "(foo|bar)baz", "ab+c", r"MyClass\.\w+", "(abc){2}", "x{0,3}yyy", "[abc]def", "(one|two|thirty)+four", "^start", "end$", "abc|abcd|", "(?:foo(?:bar)?)"]


def test_literals_are_sound():
    rng = random.Random(0)
    alphabet = ["String", "Vec", "HashMap", "abcd", "x", "fn ", "data", "needle", "NEEDLE", "foo", "bar", "baz", "abc", "yyy", "def", "one", "thirty", "four", "start", "end", "bcd", "process_data", "MyClass.", " "]
    for pattern in REGEXES:
        need = regexes.literals(pattern)
        for _ in range(300):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 5)))
            if need and re.search(pattern, t):
                assert any(x in t.lower() for x in need), (pattern, t)


def test_literals_are_found():
    want = {"process_data": ["process_data"], "String|Vec|HashMap": ["hashmap", "string", "vec"], "(abcd)?x": [], r"fn \w+": ["fn "], "a|bcd": [], "(abc){2}": ["abcabc"], "ab+c": []}
    assert {p: regexes.literals(p) for p in want} == want
    for bad in ("(", "a(?=b)", r"(a)\1", "(?<!x)y"):
        with pytest.raises(ValueError):
            regexes.java(bad)
