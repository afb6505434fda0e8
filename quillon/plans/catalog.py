"""Registered queries of the search engine, each over its whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import paths, text
from quillon.operators import diagnostics, index, search, semantic, symbols, trigrams
from quillon.plans import corpora
from quillon.plans.corpora import FILES, LINES, LINKS, NO_LINKS, documents, engine, fold, linked_engine, table
from quillon.sources import files as sources
from quillon.sources import storage

Query = Callable[[SparkSession, str], DataFrame]
MOST = 50
WORDS, SHORT, NOTHING = "license", "zz", "no such phrase anywhere"
PATTERN, ALTERNATION = "[Ll]icen[sc]e[a-z]*", "Apache|MIT License|CC BY"
INCLUDE, EXCLUDE = "src/**;lib/**", "*.de"
STEM = "doc_12"
PHRASE = "apache license version"


def shown(found: DataFrame) -> DataFrame:
    return found.select(*search.RESULT)


# Stored indexes: one for each session and folder of tables, built by the first query that needs it.

_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame, str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        folder = f"{storage.shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
        build(documents(spark, sf_dir), folder)
        _STORED[key] = folder
    return _STORED[key]


def stored_engine(spark: SparkSession, sf_dir: str) -> search.Engine:
    return index.load(spark, _stored(spark, sf_dir, "index", index.save), ["/corpus"])


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.load(spark, _stored(spark, sf_dir, "chunks", lambda files, folder: semantic.save(semantic.index(files), folder)))


# SQL of searches

SELECTED = f"""file_id, file_path, line_number::INT as line_number, case when cut then case when low > 0 then '{text.ELLIPSIS}' else '' end || decode(unhex(substr(hx, 2 * low + 1, 2 * (high - low)))) || case when high < size then '{text.ELLIPSIS}' else '' end else line end as content,
(case when cut and low > 0 then m0 - low + 3 else m0 end)::INT as match_start, (case when cut and low > 0 then m1 - low + 3 else m1 end)::INT as match_end, cut as content_truncated, score, is_symbol, dependency_count"""


def _window_sql(found: str) -> str:
    """Rows with the bytes from low to high of lines that are cut: where characters begin, about the match."""
    inside = lambda at: f"substr(hx, 2 * ({at}) + 1, 2) between '80' and 'BF'"
    snap = lambda at, s: f"case when not ({inside(at)}) then {at} when not ({inside(f'{at} {s} 1')}) then {at} {s} 1 when not ({inside(f'{at} {s} 2')}) then {at} {s} 2 else {at} {s} 3 end"
    return f"""(select *, case when l0 = 0 then 0 else {snap('l0', '-')} end as low, case when h0 >= size then size else {snap('h0', '+')} end as high
  from (select *, hex(encode(line)) as hx, strlen(line)::BIGINT as size, greatest(m0 - {text.WINDOW}, 0)::BIGINT as l0, least(m1 + {text.WINDOW}, strlen(line))::BIGINT as h0 from ({found})))"""


SOURCE = "case when contains(path, '/src/') or contains(path, '/lib/') then 1.5 else 1.0 end"
LENGTH = "greatest(1 / (1 + ln(1 + strlen(line) / 100.0::DOUBLE)), 0.3::DOUBLE)"
BOOST = "case when coalesce(n, 0) > 0 then 1 + 0.5 * log10(n) else 1.0 end"


def _lines_sql(match: Callable[[str], str], place: Callable[[str], tuple[str, str]], factor: str, links: str = NO_LINKS, chosen: str = "true", most: int = MOST, more: str = "") -> str:
    stem = "regexp_extract(path, '([^/]*)\\.[^./]*$', 1)"
    m0, m1 = place("line")
    return f"""with {FILES}, {LINES}, {links}{more},
p as (select *, 'corpus' || substr(path, 8) as file_path from f where {chosen}),
m as (select l.*, file_path from l join p using (file_id) where {match('line')} qualify row_number() over (partition by file_id order by i) <= 100),
r as (select m.*, exists (select 1 from sym where sym.file_id = m.file_id and sym.i = m.i) as def, exists (select 1 from sym where sym.file_id = m.file_id and sym.i = m.i and {match('sym.name')}) as is_symbol from m),
s as (select r.*, coalesce(n, 0)::INT as dependency_count, {m0} as m0, {m1} as m1, strlen(line) > 500 as cut, i + 1 as line_number,
  round(case when def or i = 0 then 3.0::DOUBLE else 1.0 end * {SOURCE} * {LENGTH} * {factor} * {BOOST}, 9) as score from r left join dep on to_id = file_id),
n as (select file_id, path, file_path as line, file_path, coalesce(n, 0)::INT as dependency_count, round(3.0::DOUBLE * {BOOST}, 9) as score from p left join dep on to_id = file_id where {match(stem)} and file_id not in (select file_id from m)),
u as (select file_id, file_path, line, line_number, m0, m1, cut, score, is_symbol, dependency_count from s
  union all select file_id, file_path, line, 0, coalesce({m0}, 0), coalesce({m1}, 0), false, score, true, dependency_count from n)
select {SELECTED} from {_window_sql(f"select * from u order by score desc, file_id, line_number, m0 limit {most}")}"""


def _text_place(low: str) -> Callable[[str], tuple[str, str]]:
    def place(x: str) -> tuple[str, str]:
        at = f"instr({fold(x)}, '{low}')"
        start = f"case when {at} > 0 then strlen(substr({x}, 1, {at} - 1)) end"
        return start, f"{start} + {len(low.encode())}"

    return place


def text_sql(query: str, links: str = NO_LINKS, chosen: str = "true", most: int = MOST, more: str = "") -> str:
    low = query.lower()
    factor = f"case when contains(line, '{query}') then 2.0 else 1.0 end * case when starts_with({fold('ltrim(line)')}, '{low}') then 1.5 else 1.0 end"
    return _lines_sql(lambda x: f"contains({fold(x)}, '{low}')", _text_place(low), factor, links, chosen, most, more)


def regex_sql(pattern: str, most: int = MOST) -> str:
    def place(x: str) -> tuple[str, str]:
        hit = f"regexp_extract({x}, '{pattern}')"
        start = f"case when regexp_matches({x}, '{pattern}') then strlen(substr({x}, 1, instr({x}, {hit}) - 1)) end"
        return start, f"{start} + strlen({hit})"

    factor = f"case when regexp_matches(ltrim(line), '^(?:{pattern})') then 1.5 else 1.0 end"
    return _lines_sql(lambda x: f"regexp_matches({x}, '{pattern}')", place, factor, most=most)


def _glob_sql(include: str, exclude: str, path: str = "'corpus' || substr(path, 8)") -> str:
    keep = " or ".join(f"regexp_matches({path}, '{paths.glob_regex(p)}')" for p in paths.patterns(include)) or "true"
    drop = " or ".join(f"regexp_matches({path}, '{paths.glob_regex(p)}')" for p in paths.patterns(exclude)) or "false"
    return f"({keep}) and not ({drop})"


def symbol_sql(query: str, most: int = MOST) -> str:
    low = query.lower()
    place = _text_place(low)
    m0, m1 = place("line")
    p0, p1 = place("file_path")
    stem = "regexp_extract(path, '([^/]*)\\.[^./]*$', 1)"
    factor = f"case when contains(line, '{query}') then 2.0::DOUBLE else 1.0 end * case when starts_with({fold('ltrim(line)')}, '{low}') then 1.5 else 1.0 end * case when lower(name) = '{low}' then 2.0 else 1.0 end"
    return f"""with {FILES}, {LINES}, {LINKS},
p as (select *, 'corpus' || substr(path, 8) as file_path from f left join dep on to_id = file_id),
s as (select p.file_id, file_path, line, l.i + 1 as line_number, {m0} as m0, {m1} as m1, strlen(line) > 500 as cut, round(3.0::DOUBLE * {SOURCE.replace("path", "p.path")} * {LENGTH} * {factor} * {BOOST}, 9) as score, coalesce(n, 0)::INT as dependency_count
  from sym join l on sym.file_id = l.file_id and sym.i = l.i join p on p.file_id = l.file_id where contains({fold('name')}, '{low}')),
u as (select * from s union all select file_id, file_path, file_path, 0, coalesce({p0}, 0), coalesce({p1}, 0), false, round(3.0::DOUBLE * {BOOST}, 9), coalesce(n, 0)::INT from p where contains({fold(stem)}, '{low}'))
select {SELECTED.replace("is_symbol", "true as is_symbol")} from {_window_sql(f"select * from u order by score desc, file_id, line_number, m0 limit {most}")}"""


SYMBOL = "tion"

# Queries

_FAST = """,
fs as (select f.file_id, round((1.0 + case when contains(lower(path), '/src/') or contains(lower(path), '/lib/') then 2.0 else 0.0 end) * case when regexp_matches(lower(path), '[/\\\\](test|example)') then 0.7 else 1.0 end, 9) as score from f),
best as (select file_id from fs order by score desc, file_id limit 2000)"""

GRAMS = """f as (select doc_id as file_id, hex(encode(lower(text))) as h, hex(encode('doc_' || doc_id)) as s from documents),
g as (select distinct file_id, ('0x' || substr(h, 2 * i + 1, 6))::INT as trigram from (select file_id, h, unnest(range(0, (length(h) // 2 - 2)::BIGINT)) as i from f where length(h) >= 6)
  union select distinct file_id, ('0x' || substr(s, 2 * i + 1, 6))::INT from (select file_id, s, unnest(range(0, (length(s) // 2 - 2)::BIGINT)) as i from f))"""


def trigram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = trigrams.postings(documents(spark, sf_dir))
    return trigrams.frequencies(posts).agg(F.count("*").alias("num_trigrams"), F.sum("df").alias("num_postings"))


def posting_df_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trigrams.frequencies(trigrams.postings(documents(spark, sf_dir))).orderBy(F.desc("df"), "trigram").limit(100)


def trigram_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = trigrams.bitmaps(trigrams.postings(documents(spark, sf_dir)))
    return maps.groupBy("trigram").agg(F.sum("df").alias("df"), F.sum(F.bitmap_count("bitmap")).alias("bits"))


def indexed_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stored_engine(spark, sf_dir).text(WORDS, MOST))


def indexed_regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(stored_engine(spark, sf_dir).regex(ALTERNATION, MOST))


def updated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file of a stored index, with its number of postings, after a tenth of the files was deleted, another changed, and some came anew."""
    folder = f"{storage.shared_dir(spark)}/quillon/updated-{uuid.uuid4().hex}"
    files = documents(spark, sf_dir)
    index.save(files, folder)
    kind = F.col("file_id") % 10
    changed = files.filter(kind < 3).select(
        F.when(kind == 2, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(kind == 0, "deleted").otherwise("modified").alias("op"),
        F.timestamp_seconds("file_id").alias("ts"), F.col("file_id").alias("seq"), F.concat(F.lit("changed file "), "file_id").alias("content"),
    )
    index.update(spark, folder, changed)
    now = index.tables(spark, folder)
    posts = now["postings"].groupBy("file_id").agg(F.count("*").alias("postings"))
    new = F.endswith("path", F.lit(".new"))
    return now["files"].join(posts, "file_id", "left").select("path", F.when(~new, F.col("file_id")).alias("old_id"), F.octet_length("content").alias("bytes"), "postings")


def search_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return e.info(e.candidates([WORDS], INCLUDE, EXCLUDE), search.RankMode.FAST, WORDS)


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    found = e.with_context(e.text(WORDS, MOST), 2)
    return found.select("file_id", "line_number", "score", F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.orderBy("vec_id").select("embedding").first()
    found = semantic.nearest(vectors, first[0], 20, tie=["vec_id"])
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.search(stored_chunks(spark, sf_dir), PHRASE)
    return found.select("file_id", "chunk_no", "start_line", "end_line", "chunk_type", F.md5("text").alias("digest"), "similarity")


def _persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, "old_").otherwise("doc_"), "doc_id")
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("mtime"), F.octet_length("text").cast("bigint").alias("size"), F.col("source").alias("source_base_path"))


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    path = F.concat(F.when(F.col("doc_id") % 7 == 0, "new_").otherwise("doc_"), "doc_id")
    return table(spark, sf_dir, "documents").select(path.alias("path"), (F.col("n_chars") + changed).alias("mtime"), F.octet_length("text").cast("bigint").alias("size"))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents twice, some under other names or changed."""
    return index.reconcile(_persisted(spark, sf_dir), _present(spark, sf_dir), ["src3"])


def paths_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.substring("source", 4, 9).cast("int")
    sources_of = lambda other, suffix: table(spark, sf_dir, "documents").select(F.when(other, F.concat("source", F.lit(suffix))).otherwise(F.col("source")).alias("path"))
    return index.paths_diff(sources_of(number % 3 == 0, "_new"), sources_of(number % 2 == 1, "_old"))


def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as changes of one file of each user; another one stays as it is."""
    events = table(spark, sf_dir, "events")
    users = events.select("user_id").distinct().select("user_id", F.posexplode(F.array(F.lit("user_"), F.lit("home_"))))
    base = users.select((F.col("user_id") * 2 + F.col("pos")).alias("file_id"), F.concat("col", "user_id").alias("path"), F.lit("base").alias("content"))
    changes = events.select(F.concat(F.lit("user_"), "user_id").alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("op"), "ts", F.col("event_id").alias("seq"), F.col("props").alias("content"))
    return index.upserted(base, changes).select("file_id", "path", "content")


def safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, four fifths of them with something in front that makes them unsafe."""
    front = F.element_at(F.array(*[F.lit(x) for x in ("", "x" * 100_001 + "\n", "{" * 501 + "\n", "\0\n", "\x01" * 1000 + "\n")]), (F.col("page_id") % 5 + 1).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(front, "html").alias("content"))
    return sources.gate(pages).select("page_id", "reason", sources.longest_line("content").alias("longest_line"))


def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.resolved(corpora.halves(spark, sf_dir), documents(spark, sf_dir)).select("from_id", "import_path", "to_id")


def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.in_degree(symbols.edges(corpora.halves(spark, sf_dir), documents(spark, sf_dir)))


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = linked_engine(spark, sf_dir)
    return search.file_scores(e.files, e.symbols, e.edges)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return diagnostics.index_stats(files, stored_engine(spark, sf_dir).postings, symbols.edges(corpora.halves(spark, sf_dir), files))


def pending_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.pending(corpora.halves(spark, sf_dir), documents(spark, sf_dir)).select("from_id", "import_path")


def remapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after each file got another id, those of one language none."""
    files = documents(spark, sf_dir)
    ids = files.filter(~F.endswith("path", F.lit(".de"))).select(F.col("file_id").alias("old_id"), (F.col("file_id") * 10 + 1).alias("new_id"))
    return index.remapped(symbols.edges(corpora.halves(spark, sf_dir), files), ids)


def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.symbol_counts(corpora.headwords(documents(spark, sf_dir)))


def chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return semantic.chunk_types(semantic.chunks(files, corpora.headwords(files)))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.percentiles(table(spark, sf_dir, "events"), "value")


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return files.select(
        "file_id", paths.name("path").alias("name"), paths.stem("path").alias("stem"), paths.extension("path").alias("extension"), paths.display("path", ["/corpus/src", "/corpus"]).alias("display"),
        paths.has_binary_extension(F.concat("path", F.element_at(F.array(F.lit(".PNG"), F.lit(".gz"), F.lit("")), (F.col("file_id") % 3 + 1).cast("int")))).alias("binary"), paths.in_scope("path", ["/Corpus/src"]).alias("in_scope"), paths.selected("path", "tests/**", "*.en").alias("selected"),
        text.human_bytes(F.octet_length("content")).alias("human"), text.thousands(F.octet_length("content")).alias("thousands"), text.duration(F.octet_length("content")).alias("duration"),
    )


def window_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).window("doc_7.en", 3, 2)
    return found.select("file_id", "file_path", "start_line", "end_line", "total_lines", F.array_join("lines", "\n").alias("lines"))


def file_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).content("doc_7.en")


def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    lines = F.transform(text.lines("content"), F.octet_length)
    return files.select("file_id", F.size(lines).alias("line_count"), F.array_max(lines).alias("longest"))


def self_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stored index, and of one that is damaged: a file twice, postings of a file that isn't there."""
    whole = stored_engine(spark, sf_dir)
    twice = whole.files.unionByName(whole.files.orderBy("file_id").limit(1))
    damaged = replace(whole, files=twice, postings=whole.postings.unionByName(spark.createDataFrame([(1, -1)], "trigram int, file_id bigint")))
    state = lambda name, e: diagnostics.summary(diagnostics.self_tests(e)).select(F.lit(name).alias("state"), "total", "passed", "failed", "health")
    return state("whole", whole).unionByName(state("damaged", damaged))


def chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.chunks_by_size(documents(spark, sf_dir), 10, 2).select("file_id", "chunk_no", F.md5("text").alias("digest"), "start_line", "end_line", "chunk_type")


def chunk_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return semantic.chunks_by_symbol(files, corpora.headwords(files)).select("file_id", F.md5("text").alias("digest"), "start_line", "end_line", "chunk_type", "symbol_name")


def queries() -> dict[str, Query]:
    return {
        "text_search": lambda s, d: shown(engine(s, d).text(WORDS, MOST)),
        "text_search_short": lambda s, d: shown(engine(s, d).text(SHORT, MOST)),
        "text_search_nomatch": lambda s, d: shown(engine(s, d).text(NOTHING, MOST)),
        "text_search_boosted": lambda s, d: shown(linked_engine(s, d).text("Ther", 200)),
        "filtered_search": lambda s, d: shown(engine(s, d).text(WORDS, MOST, INCLUDE, EXCLUDE)),
        "fast_ranked_search": lambda s, d: shown(engine(s, d).text("the", MOST, mode=search.RankMode.FAST)),
        "filename_fallback": lambda s, d: shown(engine(s, d).text(STEM, 1000)),
        "per_file_cap": lambda s, d: shown(engine(s, d).text("e", 1000)),
        "regex_search": lambda s, d: shown(engine(s, d).regex(PATTERN, MOST)),
        "regex_alternation": lambda s, d: shown(engine(s, d).regex(ALTERNATION, MOST)),
        "indexed_text_search": indexed_text_search,
        "indexed_regex_search": indexed_regex_search,
        "symbol_search": lambda s, d: shown(linked_engine(s, d).by_symbol(SYMBOL, 200)),
        "search_info": search_info,
        "context_window": context_window,
        "window_of_file": window_of_file,
        "file_content": file_content,
        "line_stats": line_stats,
        "path_functions": path_functions,
        "trigram_candidates": lambda s, d: trigrams.candidates(stored_engine(s, d).postings, [WORDS]),
        "search_auto": lambda s, d: shown(engine(s, d).search(f" {WORDS} ", MOST)),
        "updated_index": updated_index,
        "pending_imports": pending_imports,
        "remapped_edges": remapped_edges,
        "symbol_counts": symbol_counts,
        "chunk_types": chunk_types,
        "trigram_vocab": trigram_vocab,
        "posting_df_topk": posting_df_topk,
        "trigram_bitmaps": trigram_bitmaps,
        "extension_breakdown": lambda s, d: diagnostics.extension_breakdown(documents(s, d)),
        "index_stats": index_stats,
        "base_scores": base_scores,
        "latency_percentiles": latency_percentiles,
        "chunk_by_size": chunk_by_size,
        "chunk_by_symbol": chunk_by_symbol,
        "hashed_embedding": lambda s, d: semantic.bucket_counts(table(s, d, "documents"), "doc_id", "text"),
        "vector_topk": vector_topk,
        "semantic_search": semantic_search,
        "import_resolution": import_resolution,
        "in_degree": in_degree,
        "dependents": lambda s, d: linked_engine(s, d).dependents("doc_9.en"),
        "dependencies": lambda s, d: linked_engine(s, d).dependencies("doc_19.en"),
        "reconcile": reconcile,
        "paths_diff": paths_diff,
        "apply_changes": apply_changes,
        "safety_gate": safety_gate,
        "self_tests": self_tests,
    }


def oracle_sql() -> dict[str, str]:
    halves = "h as (select a.file_id as from_id, b.file_id as to_id, a.path as from_path, b.path as to_path from f a join f b on b.file_id = a.file_id // 2 and a.lang = b.lang)"
    shown_path = "'corpus' || substr(path, 8)"
    find = lambda name: f"(select file_id from f where path like '%{name}' order by file_id limit 1)"
    return {
        "text_search": text_sql(WORDS),
        "text_search_short": text_sql(SHORT),
        "text_search_nomatch": text_sql(NOTHING),
        "text_search_boosted": text_sql("Ther", LINKS, most=200),
        "filtered_search": text_sql(WORDS, chosen=_glob_sql(INCLUDE, EXCLUDE)),
        "fast_ranked_search": text_sql("the", chosen="file_id in (select file_id from best)", more=_FAST),
        "filename_fallback": text_sql(STEM, most=1000),
        "per_file_cap": text_sql("e", most=1000),
        "search_auto": text_sql(WORDS),
        "pending_imports": f"with {FILES} select a.file_id as from_id, case when a.file_id % 2 = 1 then './' else '' end || 'doc_' || (a.file_id // 2) || '.' || a.lang as import_path from f a where not exists (select 1 from f b where b.file_id = a.file_id // 2 and a.lang = b.lang)",
        "remapped_edges": f"with {FILES}, {halves} select distinct from_id * 10 + 1 as from_id, to_id * 10 + 1 as to_id from h where from_path not like '%.de' and to_path not like '%.de'",
        "symbol_counts": f"with {FILES}, {LINES}, {LINKS} select file_id, (count(*) + 1)::INT as symbol_count from sym group by file_id",
        "chunk_types": f"""with {FILES}, {LINES}, {LINKS}, c as (select unnest(range(1, len(ls) + 1, 45)) from ls where len(ls) > 0 and file_id not in (select file_id from sym))
select 'Function' as chunk_type, count(*) as n from sym having count(*) > 0 union all select 'Fixed', count(*) from c having count(*) > 0""",
        "updated_index": """with k as (select doc_id, doc_id % 10 as k, '/corpus/' || case doc_id % 4 when 0 then 'src' when 1 then 'lib' when 2 then 'tests' else 'docs' end || '/' || source || '/doc_' || doc_id || '.' || lang as path, text from documents),
f as (select doc_id as file_id, path, 'doc_' || doc_id as stem, case when k = 1 then 'changed file ' || doc_id else text end as text from k where k <> 0
  union all select null, path || '.new', 'doc_' || doc_id || '.' || split_part(path, '.', 2), 'changed file ' || doc_id from k where k = 2),
x as (select *, hex(encode(lower(text))) as h, hex(encode(lower(stem))) as s from f),
g as (select path, substr(h, 2 * i + 1, 6) as gram from (select path, h, unnest(range(0, (length(h) // 2 - 2)::BIGINT)) as i from x where length(h) >= 6)
  union select path, substr(s, 2 * i + 1, 6) from (select path, s, unnest(range(0, (length(s) // 2 - 2)::BIGINT)) as i from x))
select path, file_id as old_id, strlen(text)::INT as bytes, postings from f join (select path, count(*) as postings from g group by path) using (path)""",
        "semantic_search": f"""with {FILES}, {LINES}, c as (select *, unnest(range(1, len(ls) + 1, 45)) as a from ls where len(ls) > 0 and strlen(content) <= 1000000),
t as (select file_id, ((a - 1) // 45)::INT as chunk_no, a::INT as start_line, least(a + 49, len(ls))::INT as end_line, array_to_string(list_slice(ls, a, a + 49), chr(10)) as text from c),
w as (select file_id, chunk_no, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) as w from t),
u as (select file_id, chunk_no, bucket, count(*)::DOUBLE as n from (select file_id, chunk_no, (list_sum(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::BIGINT + 1, 2))::INT)) % 128)::INT as bucket from w where strlen(w) > 2) group by all),
q as (select * from (values {", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(semantic.encode(PHRASE)) if v)}) as q(bucket, v)),
s as (select file_id, chunk_no, coalesce(sum(n * v), 0) / sqrt(sum(n * n)) as similarity from u left join q using (bucket) group by all)
select file_id, chunk_no, start_line, end_line, 'Fixed' as chunk_type, md5(text) as digest, round(coalesce(similarity, 0), 6) as similarity from t left join s using (file_id, chunk_no) order by similarity desc, file_id, chunk_no limit 20""",
        "regex_search": regex_sql(PATTERN),
        "regex_alternation": regex_sql(ALTERNATION),
        "indexed_text_search": text_sql(WORDS),
        "indexed_regex_search": regex_sql(ALTERNATION),
        "symbol_search": symbol_sql(SYMBOL, 200),
        "search_info": f"with {FILES} select 'fast' as mode, count(*) as total_candidates, least(count(*), 2000) as candidates_searched from f where {_glob_sql(INCLUDE, EXCLUDE)}",
        "context_window": f"""with {FILES}, {LINES}, t as ({text_sql(WORDS)})
select t.file_id, t.line_number, t.score, array_to_string(list_slice(ls, greatest(line_number - 2, 1), line_number - 1), chr(10)) as context_before, array_to_string(list_slice(ls, line_number + 1, line_number + 2), chr(10)) as context_after
from t join ls using (file_id)""",
        "window_of_file": f"""with {FILES}, {LINES} select file_id, {shown_path} as file_path, greatest(c - 2, 1)::INT as start_line, least(c + 2, len(ls))::INT as end_line, len(ls)::INT as total_lines,
array_to_string(list_slice(ls, greatest(c - 2, 1), least(c + 2, len(ls))), chr(10)) as lines from (select *, greatest(least(3, len(ls)), 1) as c from ls where file_id = {find("doc_7.en")})""",
        "file_content": f"with {FILES}, {LINES} select file_id, {shown_path} as file_path, content, strlen(content)::INT as size_bytes, len(ls)::INT as line_count from ls where file_id = {find('doc_7.en')}",
        "line_stats": f"with {FILES}, {LINES} select file_id, len(ls)::INT as line_count, list_max(list_transform(ls, lambda x: strlen(x)))::INT as longest from ls",
        "path_functions": f"""with {FILES}, b as (select *, strlen(content) as b, regexp_extract(path, '[^/]*$') as name from f)
select file_id, name, regexp_replace(name, '\\.[^.]*$', '') as stem, lang as extension, case when starts_with(path, '/corpus/src/') then substr(path, 9) else {shown_path} end as display, file_id % 3 <> 2 as "binary", starts_with(path, '/corpus/src') as in_scope,
{_glob_sql("tests/**", "*.en", "path")} as selected,
case when b >= 1048576 then printf('%.2f MB', b / 1048576.0::DOUBLE) when b >= 1024 then printf('%.2f KB', b / 1024.0::DOUBLE) else b || ' bytes' end as human, replace(format('{{:,}}', b), ',', '_') as thousands,
case when b >= 86400 then printf('%dd %dh %dm', b // 86400, (b // 3600) % 24, (b // 60) % 60) when b >= 3600 then printf('%dh %dm %ds', b // 3600, (b // 60) % 60, b % 60) when b >= 60 then printf('%dm %ds', b // 60, b % 60) else printf('%ds', b) end as duration from b""",
        "trigram_candidates": f"with {GRAMS} select file_id from g where trigram in ({', '.join(map(str, trigrams.of(WORDS)))}) group by file_id having count(*) = {len(trigrams.of(WORDS))}",
        "trigram_vocab": f"with {GRAMS} select count(distinct trigram) as num_trigrams, count(*)::BIGINT as num_postings from g",
        "posting_df_topk": f"with {GRAMS} select trigram, count(*) as df from g group by trigram order by df desc, trigram limit 100",
        "trigram_bitmaps": f"with {GRAMS} select trigram, count(*) as df, count(*) as bits from g group by trigram",
        "extension_breakdown": "select lang as extension, count(*) as count, sum(strlen(text))::BIGINT as total_bytes from documents group by lang order by count desc, extension limit 20",
        "index_stats": f"with {GRAMS.replace('f as (', 'd as (', 1).replace('from f ', 'from d ').replace('from f)', 'from d)')}, {FILES}, {halves} select (select count(*) from f) as num_files, (select sum(strlen(content))::BIGINT from f) as content_bytes, (select count(distinct trigram) from g) as num_trigrams, (select count(*) from h) as num_edges, (select count(distinct to_id) from h) as files_with_dependents",
        "base_scores": f"""with {FILES}, {LINES}, {LINKS}, c as (select file_id, count(*) as s from sym group by 1)
select f.file_id, (coalesce(s, 0) + 1)::INT as symbol_count, contains(path, '/src/') or contains(path, '/lib/') as is_src_lib,
round((1.0::DOUBLE + case when contains(path, '/src/') or contains(path, '/lib/') then 2.0 else 0.0 end + least(log2(coalesce(s, 0) + 1), 4.0) + case when n > 0 then least(log2(n), 5.0) else 0.0 end) * case when contains(path, '/test') then 0.7 else 1.0 end, 9) as base_score,
'doc_' || f.file_id as stem_lower from f left join c using (file_id) left join dep on to_id = f.file_id""",
        "latency_percentiles": "with s as (select list(value order by value) as v, count(*) as n from events where value is not null) select "
        + ", ".join(f"v[least(floor(n * {p} / 100)::BIGINT, n - 1) + 1] as p{p}" for p in (50, 95, 99)) + " from s",
        "chunk_by_size": f"""with {FILES}, {LINES}, c as (select *, unnest(range(1, len(ls) + 1, 8)) as a from ls where len(ls) > 0)
select file_id, ((a - 1) // 8)::INT as chunk_no, md5(array_to_string(list_slice(ls, a, a + 9), chr(10))) as digest, a::INT as start_line, least(a + 9, len(ls))::INT as end_line, 'Fixed' as chunk_type from c""",
        "chunk_by_symbol": f"""with {FILES}, {LINES}, {LINKS}
select file_id, md5(array_to_string(list_slice(ls, greatest(i - 1, 0) + 1, greatest(i - 1, 0) + 50), chr(10))) as digest, (greatest(i - 1, 0) + 1)::INT as start_line, least(greatest(i - 1, 0) + 50, len(ls))::INT as end_line, 'Function' as chunk_type, name as symbol_name
from sym join ls using (file_id)""",
        "hashed_embedding": """with w as (select doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) as w from documents)
select doc_id, (list_sum(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::BIGINT + 1, 2))::INT)) % 128)::INT as bucket, count(*) as n from w where strlen(w) > 2 group by all""",
        "vector_topk": "select vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (select embedding::DOUBLE[] from embeddings order by vec_id limit 1)), 6) as similarity from embeddings order by list_cosine_similarity(embedding::DOUBLE[], (select embedding::DOUBLE[] from embeddings order by vec_id limit 1)) desc, vec_id limit 20",
        "import_resolution": f"with {FILES} select a.file_id as from_id, case when a.file_id % 2 = 1 then './' else '' end || 'doc_' || (a.file_id // 2) || '.' || a.lang as import_path, b.file_id as to_id from f a left join f b on b.file_id = a.file_id // 2 and a.lang = b.lang",
        "in_degree": f"with {FILES}, {halves} select to_id, count(distinct from_id) as dependents from h group by 1",
        "dependents": f"with {FILES}, {halves} select from_id as file_id, 'corpus' || substr(from_path, 8) as path from h where to_id = {find('doc_9.en')}",
        "dependencies": f"with {FILES}, {halves} select to_id as file_id, 'corpus' || substr(to_path, 8) as path from h where from_id = {find('doc_19.en')}",
        "reconcile": """with o as (select case when doc_id % 10 = 0 then 'old_' else 'doc_' end || doc_id as path, n_chars as m0, strlen(text) as s0, source from documents),
n as (select case when doc_id % 7 = 0 then 'new_' else 'doc_' end || doc_id as path, n_chars + case when doc_id % 11 = 0 then 1 else 0 end as m1, strlen(text) as s1 from documents)
select coalesce(o.path, n.path) as path, case when o.path is null then 'New' when n.path is null or source = 'src3' then 'Removed' when m0 <> m1 or s0 <> s1 then 'Stale' else 'Valid' end as status from o full outer join n on o.path = n.path""",
        "paths_diff": """with w as (select distinct source || case when substr(source, 4)::INT % 3 = 0 then '_new' else '' end as path from documents), k as (select distinct source || case when substr(source, 4)::INT % 2 = 1 then '_old' else '' end as path from documents)
select path, 'add' as change from w where path not in (select path from k) union all select path, 'remove' from k where path not in (select path from w)""",
        "apply_changes": """with c as (select user_id, event_type, props, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
select user_id * 2 as file_id, 'user_' || user_id as path, props as content from c where r = 1 and event_type <> 'error' and props is not null union all select distinct user_id * 2 + 1, 'home_' || user_id, 'base' from events""",
        "safety_gate": """with l as (select page_id, page_id % 5 as k, list_max(list_transform(string_split(html, chr(10)), lambda x: strlen(x))) as n from pages)
select page_id, case k when 0 then null when 1 then 'line too long' when 2 then 'nested too deeply' else 'binary content' end as reason, greatest(n, case k when 0 then 0 when 1 then 100001 when 2 then 501 when 3 then 1 else 1000 end)::INT as longest_line from l""",
        "self_tests": "select 'whole' as state, 5::BIGINT as total, 5::BIGINT as passed, 0::BIGINT as failed, 'Healthy' as health union all select 'damaged', 5, 3, 2, 'Degraded'",
    }
