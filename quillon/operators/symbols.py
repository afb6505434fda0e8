"""Symbols and imports of source files, by patterns of lines for each language; Python by its own parser, where a file can be parsed.

For the others there is no full parser here: a definition is found where its line looks like one, which holds for code that is laid out as
usual. Languages of data and markup (JSON, TOML, YAML, HTML, CSS, Markdown) have no definitions. Lines within block comments and multi-line strings are blanked first.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import paths

_ID = r"([A-Za-z_$][\w$]*)"
_RUST_VIS = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_JVM_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|async|readonly|synchronized|native|default|strictfp|unsafe|extern|new)\s+)*"
_TYPE = r"[A-Za-z_][\w.<>\[\],?:&* ]*?"


def _rules(*rules: tuple[str, str]) -> list[tuple[str, re.Pattern[str]]]:
    return [(kind, re.compile(pattern)) for kind, pattern in rules]


_TYPESCRIPT = _rules(
    ("Function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_ID}"),
    ("Class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_ID}"),
    ("Interface", rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+{_ID}"),
    ("Type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{_ID}\s*(?:<[^=]*>)?\s*="),
    ("Enum", rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{_ID}"),
)
_C = _rules(
    ("Class", rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+{_ID}[^;]*$"),
    ("Class", rf"^\s*(?:inline\s+)?namespace\s+{_ID}"),
    ("Struct", rf"^\s*(?:typedef\s+)?(?:template\s*<[^>]*>\s*)?(?:struct|union)\s+{_ID}\s*(?::[^;]*)?(?:\{{.*)?$"),
    ("Enum", rf"^\s*(?:typedef\s+)?enum\s+(?:class\s+|struct\s+)?{_ID}"),
    ("Function", rf"^\s*(?:template\s*<[^>]*>\s*)?(?!(?:return|else|new|delete|throw|case|using|typedef|goto)\b)(?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])(?:[\w:~]+::)?{_ID}\s*\([^;]*$"),
)
_JVM = _rules(
    ("Class", rf"^\s*{_JVM_MOD}class\s+{_ID}"),
    ("Interface", rf"^\s*{_JVM_MOD}interface\s+{_ID}"),
    ("Enum", rf"^\s*{_JVM_MOD}enum\s+{_ID}"),
    ("Class", rf"^\s*{_JVM_MOD}record\s+(?:struct\s+)?{_ID}\s*[(<]"),
    ("Struct", rf"^\s*{_JVM_MOD}struct\s+{_ID}"),
    ("Class", rf"^\s*namespace\s+([\w.]+)"),
    ("Method", rf"^\s*{_JVM_MOD}(?:<[^>]*>\s*)?(?!(?:return|else|new|throw|if|for|while|switch|catch|using|lock|await|case)\b){_TYPE}\s+{_ID}\s*(?:<[^>]*>)?\s*\([^;]*\)?\s*(?:throws\s+[\w.,\s]+)?(?:where\s.*)?(?:\{{.*|=>.*)?$"),
    ("Method", rf"^\s*(?:public|private|protected|internal)\s+{_ID}\s*\([^;]*\)?\s*(?::\s*(?:base|this)\b.*)?\{{?.*$"),
    ("Method", rf"^\s*(?:(?:public|private|protected|internal|static|virtual|override|abstract|required)\s+)+{_TYPE}\s+{_ID}\s*\{{\s*(?:get|set|init)\b"),
)
RULES: dict[str, list[tuple[str, re.Pattern[str]]]] = {
    "rs": _rules(
        ("Function", rf"^\s*{_RUST_VIS}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+{_ID}"),
        ("Struct", rf"^\s*{_RUST_VIS}struct\s+{_ID}"),
        ("Enum", rf"^\s*{_RUST_VIS}enum\s+{_ID}"),
        ("Trait", rf"^\s*{_RUST_VIS}(?:unsafe\s+)?trait\s+{_ID}"),
        ("Class", rf"^\s*(?:unsafe\s+)?impl(?:\s*<[^>]*>)?\s+(?:[\w:<>,\s'&]+\s+for\s+)?(?:[\w]+::)*{_ID}"),
        ("Type", rf"^\s*{_RUST_VIS}type\s+{_ID}"),
        ("Constant", rf"^\s*{_RUST_VIS}(?:const|static)\s+(?:mut\s+)?(?!fn\b|unsafe\b|async\b|extern\b){_ID}\s*:"),
    ),
    "py": _rules(("Function", rf"^\s*(?:async\s+)?def\s+{_ID}"), ("Class", rf"^\s*class\s+{_ID}")),
    "js": _rules(*[(k, p.pattern) for k, p in _TYPESCRIPT if k in ("Function", "Class")]),
    "ts": _TYPESCRIPT,
    "go": _rules(
        ("Method", rf"^func\s+\([^)]*\)\s*{_ID}"),
        ("Function", rf"^func\s+{_ID}"),
        ("Struct", rf"^\s*(?:type\s+)?{_ID}(?:\[[^\]]*\])?\s+struct\b"),
        ("Interface", rf"^\s*(?:type\s+)?{_ID}(?:\[[^\]]*\])?\s+interface\b"),
        ("Type", rf"^type\s+{_ID}(?!.*\b(?:struct|interface)\b)\s+\S"),
        ("Constant", rf"^const\s+{_ID}"),
        ("Variable", rf"^var\s+{_ID}"),
    ),
    "java": _JVM,
    "cs": _JVM,
    "c": [r for r in _C if r[0] != "Class"],
    "cpp": _C,
    "rb": _rules(("Method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"), ("Class", rf"^\s*class\s+(?:\w+::)*{_ID}"), ("Class", rf"^\s*module\s+(?:\w+::)*{_ID}")),
    "php": _rules(
        ("Method", rf"^\s+(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?{_ID}"),
        ("Function", rf"^function\s+&?{_ID}"),
        ("Class", rf"^\s*(?:(?:final|abstract|readonly)\s+)*class\s+{_ID}"),
        ("Interface", rf"^\s*interface\s+{_ID}"),
        ("Trait", rf"^\s*trait\s+{_ID}"),
        ("Enum", rf"^\s*enum\s+{_ID}"),
    ),
    "sh": _rules(("Function", rf"^\s*function\s+{_ID}"), ("Function", rf"^\s*{_ID}\s*\(\)")),
}
LANGUAGES = {
    **{x: x for x in RULES}, "jsx": "js", "mjs": "js", "cjs": "js", "tsx": "ts", "h": "c", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hxx": "cpp", "hh": "cpp", "mts": "ts", "cts": "ts", "pyw": "py", "pyi": "py", "rake": "rb", "gemspec": "rb", "bash": "sh", "zsh": "sh",
}
_BLOCKS = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_STRINGS = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)", re.S)
_COMMENT = {"py": "#", "rb": "#", "sh": "#"}

_RUST_USE = re.compile(r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);", re.M)
_RUST_MOD = re.compile(r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?mod\s+([A-Za-z_]\w*)", re.M)
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b", re.M)
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+([\w.]+)", re.M)
_JS_IMPORT = re.compile(r"^\s*import\s+(?:[^'\"();]*?\bfrom\s*)?['\"]([^'\"]+)['\"]", re.M)
_JS_REQUIRE = re.compile(r"(?<![\w.])require\(\s*['\"]?([^'\"()]+?)['\"]?\s*\)")


def _blanked(content: str, language: str) -> str:
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    if language == "py":
        return _STRINGS.sub(blank, content)
    return content if language in ("rb", "sh") else _BLOCKS.sub(blank, content)


def _python(content: str) -> list[tuple[str, str, int, int]] | None:
    """The definitions of a Python file by its own parser; null where it can't be parsed."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    kinds = {ast.FunctionDef: "Function", ast.AsyncFunctionDef: "Function", ast.ClassDef: "Class"}
    return sorted(((n.name, kinds[type(n)], n.lineno - 1, n.col_offset) for n in ast.walk(tree) if type(n) in kinds), key=lambda x: x[2:])


def symbols(content: str, extension: str) -> list[tuple[str, str, int, int]]:
    """(name, type, line, column) of the definitions of a file, in order of line."""
    language = LANGUAGES.get(extension.lower())
    if language is None:
        return []
    if language == "py" and (found := _python(content)) is not None:
        return found
    out, comment = [], _COMMENT.get(language, "//")
    for i, line in enumerate(_blanked(content, language).split("\n")):
        if line.lstrip().startswith(comment):
            continue
        for kind, rule in RULES[language]:
            if m := rule.match(line):
                out.append((m[1], kind, i, len(line) - len(line.lstrip())))
                break
    return out


def imports(content: str, extension: str) -> list[tuple[str, int, str]]:
    """(path, line, type) of the imports of a file, in order of line."""
    language = LANGUAGES.get(extension.lower())
    rules = {"rs": ((_RUST_USE, _RUST_MOD), "Rust"), "py": ((_PY_FROM, _PY_IMPORT), "Python"), "js": ((_JS_IMPORT, _JS_REQUIRE), "JavaScript"), "ts": ((_JS_IMPORT, _JS_REQUIRE), "JavaScript")}
    if language not in rules:
        return []
    found, kind = rules[language]
    body = _blanked(content, language)
    out = [(m[1].strip(), body.count("\n", 0, m.start(1)), kind) for rule in found for m in rule.finditer(body)]
    return sorted(((p, line, k) for p, line, k in out if p), key=lambda x: x[1])


def extract(files: DataFrame) -> DataFrame:
    """(file_id, symbols, imports) of each file, from one reading. A file that can't be read so has none of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (
            pa.list_(pa.struct([("name", pa.string()), ("symbol_type", pa.string()), ("line", pa.int32()), ("col", pa.int32())])),
            pa.list_(pa.struct([("import_path", pa.string()), ("line", pa.int32()), ("import_type", pa.string())])),
        )
        for b in batches:
            pairs = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            made = [
                [[dict(zip(("name", "symbol_type", "line", "col"), s)) for s in symbols(c or "", e or "")] for c, e in pairs],
                [[dict(zip(("import_path", "line", "import_type"), s)) for s in imports(c or "", e or "")] for c, e in pairs],
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m, k) for m, k in zip(made, kinds)]], ["file_id", "symbols", "imports"])

    only = files.filter(F.lower(paths.extension("path")).isin(*LANGUAGES)).select("file_id", "content", paths.extension("path").alias("e"))
    return only.mapInArrow(run, "file_id bigint, symbols array<struct<name:string,symbol_type:string,line:int,col:int>>, imports array<struct<import_path:string,line:int,import_type:string>>")


def symbol_table(extracted: DataFrame) -> DataFrame:
    return extracted.select("file_id", F.inline("symbols")).withColumn("is_definition", F.lit(True))


def import_table(extracted: DataFrame) -> DataFrame:
    return extracted.select("file_id", F.inline("imports"))


def file_names(files: DataFrame) -> DataFrame:
    """The symbol that each file's name is."""
    return files.select("file_id", paths.stem("path").alias("name"), F.lit("FileName").alias("symbol_type"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.lit(True).alias("is_definition"))


# Import resolution

EXTENSIONS = ("", "rs", "py", "js", "ts", "jsx", "tsx")


def _clean(path: Column) -> Column:
    """Without steps to here and up."""
    parts = F.filter(F.split(path, "/"), lambda x: x != ".")
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(walked, "/")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_id, import_path, line, to_id): the file that each import stands for, null for none.

    An import that begins with a dot is a path beside the file, with one of the usual extensions; any other, and one that isn't there, is
    the name of the first file that has it, as it is or with an extension. Each import has a few keys to look up, so
    this is one equi-join; the best key wins.
    """
    of = files.select(F.col("file_id").alias("from_id"), F.regexp_replace(paths.slashes("path"), "/[^/]*$", "").alias("parent"))
    # Imports that are written alike from the same file are one.
    asked = imports.select(F.col("file_id").alias("from_id"), "import_path", "line").join(of, "from_id")
    whole = F.concat_ws("/", "parent", F.col("import_path"))
    replaced = lambda e: F.concat(F.regexp_replace(whole, r"(?<=[^/.])\.[^./]*$", ""), F.lit("." + e))
    dotted = F.startswith("import_path", F.lit("."))
    beside = [F.when(dotted, F.struct(F.lit(k).alias("rank"), F.concat(F.lit("p:"), _clean(replaced(e) if e else whole)).alias("key"))) for k, e in enumerate(EXTENSIONS)]
    last = F.regexp_extract("import_path", r"([^/]+)/*$", 1)
    named = [F.when((last != "") & (last != ".."), F.struct(F.lit(10 + k).alias("rank"), F.concat(F.lit("n:"), last, F.lit("." + e if e else "")).alias("key"))) for k, e in enumerate(EXTENSIONS)]
    keys = asked.withColumn("k", F.explode_outer(F.array_compact(F.array(*beside, *named)))).select("from_id", "import_path", "line", "k.rank", "k.key")
    known = files.select(F.explode(F.array(F.concat(F.lit("p:"), paths.slashes("path")), F.concat(F.lit("n:"), paths.name("path")))).alias("key"), "file_id").groupBy("key").agg(F.min("file_id").alias("to_id"))
    best = keys.join(known, "key", "left").groupBy("from_id", "import_path", "line")
    return best.agg(F.min_by("to_id", F.when(F.col("to_id").isNotNull(), F.col("rank"))).alias("to_id"))


def edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(from_id, to_id), each once."""
    return resolved(imports, files).filter("to_id is not null").select("from_id", "to_id").distinct()


def pending(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports that no file stands for."""
    return resolved(imports, files).filter("to_id is null").drop("to_id")
