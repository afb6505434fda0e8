"""Tables as corpora: documents as files, with symbols and imports that are made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import symbols
from quillon.operators.search import Engine

HEADWORD = "^([A-Z][a-z]{5,})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, content)"""
    folder = F.element_at(F.array(*map(F.lit, ("src", "lib", "tests", "docs"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), folder, F.lit("/"), "source", F.lit("/doc_"), "doc_id", F.lit("."), "lang")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("text").alias("content"))


def headwords(files: DataFrame) -> DataFrame:
    """The long words that lines begin with, as symbols."""
    lines = files.select("file_id", F.posexplode(text.lines("content")).alias("line", "l"))
    return lines.filter(F.rlike("l", F.lit(HEADWORD))).select(
        "file_id", F.regexp_extract("l", HEADWORD, 1).alias("name"), F.lit("Function").alias("symbol_type"), "line", F.lit(0).alias("col"), F.lit(True).alias("is_definition")
    )


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports: each document names the one of half its number, odd ones as a path beside them."""
    name = F.concat(F.when(F.col("doc_id") % 2 == 1, "./").otherwise(""), F.lit("doc_"), F.floor(F.col("doc_id") / 2), F.lit("."), "lang")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), name.alias("import_path"), F.lit(0).alias("line"), F.lit("Python").alias("import_type"))


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(documents(spark, sf_dir), roots=["/corpus"], **options)


def linked_engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    files = documents(spark, sf_dir)
    return Engine(files, headwords(files), symbols.edges(halves(spark, sf_dir), files), roots=["/corpus"], **options)


# The same in SQL

FILES = """f as (select doc_id as file_id, '/corpus/' || case doc_id % 4 when 0 then 'src' when 1 then 'lib' when 2 then 'tests' else 'docs' end || '/' || source || '/doc_' || doc_id || '.' || lang as path,
  text as content, lang from documents)"""
LINES = r"""ls as (select *, case when content = '' then []::VARCHAR[] else list_transform(string_split(regexp_replace(content, '\n$', ''), chr(10)), lambda x: regexp_replace(x, '\r$', '')) end as ls from f),
l as (select file_id, path, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from ls)"""
NO_LINKS = "dep as (select 0::BIGINT as to_id, 0 as n where false), sym as (select 0::BIGINT as file_id, '' as name, 0 as i where false)"
LINKS = f"""dep as (select b.file_id as to_id, count(distinct a.file_id)::INT as n from f a join f b on b.file_id = a.file_id // 2 and a.lang = b.lang group by 1),
sym as (select file_id, regexp_extract(line, '{HEADWORD}', 1) as name, i from l where regexp_matches(line, '{HEADWORD}'))"""


def fold(x: str) -> str:
    return f"translate({x}, '{text.UPPER}', '{text.LOWER}')"
