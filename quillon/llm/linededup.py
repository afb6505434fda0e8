"""Line dedup: content-defined chunks of lines, and runs of more than 50 words, that occur before, anywhere in the corpus, are removed.

1. Each line has a hash. A rolling hash over the hashes of a line and of the one before it chooses the chunk boundaries, so
   they move along with the text when lines are put in or taken out elsewhere. Chunks of two lines or more are units that can
   go, and so are whole texts of two lines or more. A chunk that begins or ends among other lines, or within one, is another chunk; for this, and for long lines, there are
   runs: ``RUN`` words in a row, wherever they begin and end. A word is what stands between ASCII white space.
2. Of the hashes of ``SEED`` words in a row, the lowest of each run (its seed) depends on nothing but the run, so equal runs have
   equal seeds at the same place, wherever they lie. The hashes of units and seeds alone are counted first, no text.
3. Only units and seeds whose hash occurs more than once send text, for a seed that of all runs that have it, and the bytes themselves are compared,
   so equal hashes of different texts stay apart. Each run belongs to one seed, so no repeated run is missed.
4. Whole texts that occur before (two hashes of together 128 bits) send nothing: all their units and runs are repeated. So copies don't pile up around a hash.

Defined results: the first occurrence stays, in order of id (null ids last), hash of the text, and position; in one document a run
counts as repeated only where it doesn't overlap its first occurrence. Longer repeats are the sum of their runs. In a line that loses words the others
are joined by single spaces; a line that loses all goes; a document that loses something and has no words left is dropped. A null text stays null, an
empty text stays empty; rows of one id that have the same text count as one document and get the same decisions, and so do rows without an
id; rows of one id with different texts are told apart by the text; further columns pass through. Cuts bring words together, so the result can
hold new repeats. A task holds the different runs around one seed in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from quillon.llm.common import done_with, free, once, quoted, with_text, written
from quillon.llm.grams import _STEP, buffers, mix, slices

#: One in so many line pairs ends a chunk.
DIVISOR = 3
#: Lines of a chunk that can go, at least.
LEAST_LINES = 2
#: A repeated run of so many words goes.
RUN = 51
#: Words of a seed.
SEED = 8
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UNIT = 0x5DEECE66D


# Chunks of lines


def line_hash(line: bytes) -> int:
    """28 bits of a hash that other engines have too."""
    return int.from_bytes(md5(line, usedforsecurity=False).digest()[:4], "big") >> 4


def units(text: bytes, divisor: int = DIVISOR, least_lines: int = LEAST_LINES) -> list[tuple[int, int, bytes]]:
    """(first line, last line, text) of the chunks of a text that can go."""
    if b"\n" not in text:
        return []
    lines, out = text.split(b"\n"), []
    begin, before, end = 0, 0, len(lines) - 1
    for k, line in enumerate(lines):
        h = line_hash(line)
        if (before * 31 + h) % divisor == 0 or k == end:
            if k - begin + 1 >= least_lines:
                out.append((begin, k, b"\n".join(lines[begin : k + 1])))
            begin = k + 1
        before = h
    return out


def unit_hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, _UNIT) - (1 << 63)


# Runs of words


def seeds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each seed of all rows: its hash, row, the first and the last word (of all rows) where a run of it begins; then the first word of each row."""
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4)) + (np.zeros(len(offsets), dtype=np.int64),)
    if not len(data):
        return none
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1] | edge[1:-1]))
    if len(starts) < RUN:
        return none
    lengths = np.flatnonzero(inside & np.append(~inside[1:] | edge[1:-1], True)) + 1 - starts
    hashes = np.zeros(len(starts), dtype=np.uint64)
    eights = np.ndarray(len(data), dtype="<u8", buffer=np.append(data, np.zeros(8, dtype=np.uint8)), strides=(1,))
    todo, at = np.arange(len(starts)), starts
    while len(todo):  # eight bytes of each word that has more
        over = lengths[todo] - (at - starts[todo])
        part = eights[at] << (8 * (8 - np.minimum(over, 8))).astype(np.uint64)
        hashes[todo] = mix(hashes[todo] * _STEP + part + np.minimum(over, 8).astype(np.uint64))
        more = over > 8
        todo, at = todo[more], at[more] + 8
    rows = np.searchsorted(offsets, starts, side="right") - 1
    # Polynomials of 2, 4, 8 words.
    power, sums, k = int(_STEP), hashes, 1
    while k < SEED:
        sums = sums[:-k] * np.uint64(power) + sums[k:]
        power, k = power * power % 2**64, 2 * k
    grams = mix(sums)
    # The lowest, and the first of equal ones, over 1, 2, 4 ... places.
    low, place, width, wanted = grams, np.arange(len(grams)), 1, RUN - SEED + 1
    while width < wanted:
        step = min(width, wanted - width)
        right = low[step:] < low[:-step]
        low, place, width = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step]), width + step
    begins = np.flatnonzero(rows[: len(place)] == rows[RUN - 1 :])
    if not len(begins):
        return none
    seed = place[begins]
    new = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (begins[1:] != begins[:-1] + 1)))
    last = begins[np.append(new[1:], len(begins)) - 1]
    return grams[seed[new]].view(np.int64), rows[begins[new]], begins[new], last, np.searchsorted(rows, np.arange(len(offsets) - 1))


def _raw(part: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    data, offsets = buffers(part)
    return data, offsets, data.tobytes()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, d) of all units and seeds."""
    for b in batches:
        for first, part in slices(b.column(1)):
            data, offsets, raw = _raw(part)
            h, row, *_ = seeds(data, offsets)
            found = [(r, unit_hash(x)) for r, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())) for _, _, x in units(raw[a:z])]
            rows = pa.array(np.concatenate([row, np.array([r for r, _ in found], dtype=np.int64)]) + first)
            hashes = pa.array(np.concatenate([h, np.array([x for _, x in found], dtype=np.int64)]))
            yield pa.RecordBatch.from_arrays([hashes, b.column(0).take(rows)], ["h", "d"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, t, i, p, z, x) of each unit and seed whose hash is among the last column but one: from word p all runs of a seed (z is -1), or lines p to z.

    The last column has the whole copies, which send nothing.
    """
    before = None
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        whole = [k in [(x["t"], x["u"]) for x in later] if later else False for k, later in zip(keys, b.column(b.num_columns - 1).to_pylist())]
        for first, part in slices(b.column(2)):
            data, offsets, raw = _raw(part)
            h, row, begin, last, words = seeds(data, offsets)
            wanted = b.column(b.num_columns - 2).slice(first, len(part))
            often = np.isin(h, wanted.flatten().to_numpy(zero_copy_only=False))
            out: list[tuple[int, int, int, int, bytes]] = []
            h, row, begin, last = h[often].tolist(), row[often], begin[often], last[often]
            bounds = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
            begin, last, words = begin.tolist(), last.tolist(), words.tolist()
            for r in range(len(part)):
                if keys[first + r] == before or whole[first + r]:  # repeated rows follow each other
                    continue
                before = keys[first + r]
                text, mine = raw[offsets[r] : offsets[r + 1]], set(wanted[r].as_py())
                if bounds[r] < bounds[r + 1]:
                    split = text.split()
                    for k in range(bounds[r], bounds[r + 1]):
                        p = begin[k] - words[r]
                        out.append((h[k], first + r, p, -1, b" ".join(split[p : last[k] - words[r] + RUN])))
                for a, z, x in units(text):
                    if (k := unit_hash(x)) in mine:
                        out.append((k, first + r, a, z, x))
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))]
            of = [b.column(k).take(columns[1]) for k in (0, 3)]
            yield pa.RecordBatch.from_arrays([columns[0], *of, *columns[2:]], ["h", "t", "i", "p", "z", "x"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, i, p, z, run): the words p to z - 1 (run) or the lines p to z that go, from windows in order of hash and place."""
    now, seen, whole = None, {}, {}
    for b in batches:
        rows, froms, tos, runs = [], [], [], []
        for r, (h, t, i, p, z, x) in enumerate(zip(*[b.column(k).to_pylist() for k in range(6)])):
            if h != now:
                now, seen, whole = h, {}, {}
            doc = (t, i)
            if z >= 0:
                if (first := whole.setdefault((x, True), (doc, p))) != (doc, p):
                    rows.append(r)
                    froms.append(p)
                    tos.append(z)
                    runs.append(False)
                continue
            if (first := whole.setdefault(x, doc)) != doc:  # its runs came before, in other documents
                rows.append(r)
                froms.append(p)
                tos.append(p + x.count(b" ") + 1)
                runs.append(True)
                continue
            ends = [e - 1 for e in accumulate(len(w) + 1 for w in x.split(b" "))]
            begins, end = [0, *[e + 1 for e in ends]], -1
            for g in range(len(ends) - RUN + 1):
                other, q = seen.setdefault(x[begins[g] : ends[g + RUN - 1]], (doc, p + g))
                if other != doc or p + g >= q + RUN:
                    if p + g <= end:
                        tos[-1] = p + g + RUN
                    else:
                        rows.append(r)
                        froms.append(p + g)
                        tos.append(p + g + RUN)
                        runs.append(True)
                    end = p + g + RUN
        took = pa.array(rows, pa.int64())
        columns = [b.column(1).take(took), b.column(2).take(took), pa.array(froms, pa.int32()), pa.array(tos, pa.int32()), pa.array(runs, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["t", "i", "p", "z", "run"])


def cut(text: str | None, cuts: list[int] | None) -> str | None:
    """``text`` without what goes; null if no word is left.

    cuts: numbers of a first word (or line), one after the last word (or a last line), and a bit that is set for words; -1: the whole text came before.
    """
    if text is None:
        return None
    raw = text.encode()
    if -1 in cuts:
        return None if b"\n" in raw or len(raw.split()) >= RUN else text
    words = sorted((c >> 32, (c & 0xFFFFFFFF) >> 1) for c in cuts if c & 1)
    gone = {k for c in cuts if not c & 1 for k in range(c >> 32, ((c & 0xFFFFFFFF) >> 1) + 1)}
    out, at, k = [], 0, 0
    for n, line in enumerate(raw.split(b"\n")):
        mine = line.split()
        end, rest, here = at + len(mine), [], at
        while k < len(words) and words[k][0] < end:
            a, z = words[k]
            rest += mine[here - at : max(a, here) - at]
            here = max(here, min(z, end))
            if z > end:
                break
            k += 1
        if n not in gone:
            if here == at:
                out.append(line)
            elif rest := rest + mine[here - at :]:
                out.append(b" ".join(rest))
        at = end
    left = b"\n".join(out)
    return left.decode() if left == raw or left.split() else None


# The whole


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated units and runs, in the columns of ``docs``."""
    t, u, d = free(docs, "t", "u", "d")
    text = quoted(text_col)
    of_id = lambda c: F.xxhash64(c, c.isNull())
    # A document is its id and its text: t and u, and d is of both. s is a second hash of the text.
    keyed = docs.withColumns({t: F.xxhash64(text), u: of_id(quoted(id_col))}).withColumn(d, F.xxhash64(quoted(t), quoted(u)))
    names = keyed.filter(text != "").select(quoted(id_col).alias("i"), quoted(t).alias("t"), quoted(u).alias("u"), quoted(d).alias("d"), F.xxhash64(F.md5(text)).alias("s"))
    copies = names.groupBy("t", "s").agg(F.min(F.struct(F.col("i").isNull(), "i", "u")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("t", "s", F.col("first.u").alias("first"))
    later = written(names.join(copies, ["t", "s"]).filter("u <> first").select("d", "t", "u").distinct(), "copies")

    kind = docs.schema[id_col].dataType
    hashed = written(keyed.select(quoted(d).alias("d"), text.alias("x")).mapInArrow(_hashes, "h bigint, d bigint"), "hashes")
    often = hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    wanted = hashed.join(often, "h", "left_semi").groupBy("d").agg(F.collect_set("h").alias("hs"))
    wanted = written(wanted.join(later.groupBy("d").agg(F.collect_list(F.struct("t", "u")).alias("later")), "d", "left"), "wanted")
    done_with(hashed)

    # The documents are shuffled once: both joins with them have the same key and the same columns, so neither may have one that the other doesn't need.
    counts = ["n_chars"] if dict(docs.dtypes).get("n_chars") in ("bigint", "int") else []  # made anew by with_text
    carried = keyed.select(quoted(t), quoted(u), text, quoted(id_col), quoted(d), *[quoted(c) for c in docs.columns if c not in (text_col, id_col, *counts)])
    asked = wanted.select(F.col("d").alias("wd"), F.col("hs").alias("whs"), F.col("later").alias("wlater"))
    wd, whs, wlater = free([*docs.columns, t, u, d], "wd", "whs", "wlater")
    asked = asked.toDF(wd, whs, wlater)
    both = carried.join(asked, quoted(d) == quoted(wd)).select(*map(quoted, carried.columns), quoted(whs), quoted(wlater))
    both = both.toDF("t", "u", "x", "i", *[f"c{k}" for k in range(len(carried.columns) - 4)], "hs", "later")
    windows = both.mapInArrow(_windows, StructType([StructField(n, k) for n, k in (("h", LongType()), ("t", LongType()), ("i", kind), ("p", IntegerType()), ("z", IntegerType()), ("x", BinaryType()))]))
    placed = windows.repartition("h").sortWithinPartitions("h", F.col("i").asc_nulls_last(), "t", "p")
    found = placed.mapInArrow(_repeated, f"t bigint, i {kind.simpleString()}, p int, z int, run boolean").withColumn("u", of_id(F.col("i")))
    code = F.shiftleft(F.col("p").cast("bigint"), 32) + F.col("z") * 2 + F.col("run").cast("bigint")
    found = found.select(F.xxhash64("t", "u").alias("d"), "t", "u", code.alias("c"))
    cuts = found.unionByName(later.select("d", "t", "u", F.lit(-1).cast("bigint").alias("c"))).groupBy("d").agg(F.collect_set(F.struct("t", "u", "c")).alias("cuts"))
    wcuts, mine, left = free([*docs.columns, t, u, d, wd], "wcuts", "mine", "left")
    all_docs = carried.join(cuts.toDF(wd, wcuts), quoted(d) == quoted(wd), "left").withColumns({x: F.lit(None).cast(docs.schema[x].dataType) for x in counts})
    own = F.filter(quoted(wcuts), lambda c: (c["t"] == quoted(t)) & (c["u"] == quoted(u)))
    all_docs = once(all_docs, **{mine: F.transform(own, lambda c: c["c"])})
    hit = F.coalesce(F.size(quoted(mine)) > 0, F.lit(False))
    # Not deterministic as far as the optimizer knows: it would run twice otherwise, in the filter and in the projection.
    done = F.udf(cut, "string", useArrow=True).asNondeterministic()(F.when(hit, text), F.when(hit, quoted(mine)))
    rest = all_docs.withColumn(left, done).filter(~hit | quoted(left).isNotNull())
    return with_text(rest, F.when(hit, quoted(left)).otherwise(text), text_col).select(*[quoted(x) for x in docs.columns])


def sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL over the driver's columns, where ids are unique and not null."""
    word = r"[^ \t\n\x0b\f\r]+"
    return rf"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from {table} where text <> ''),
h as (select *, ('0x' || substr(md5(line), 1, 7))::BIGINT as h, regexp_extract_all(line, '{word}') as ws from l),
e as (select *, (coalesce(lag(h) over w, 0) * 31 + h) % {DIVISOR} = 0 as last, coalesce(sum(len(ws)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::BIGINT as w0 from h window w as (partition by doc_id order by k)),
c as (select *, coalesce(sum(last::INT) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as chunk from e),
u as (select doc_id, chunk, string_agg(line, chr(10) order by k) as u, min(k) as a from c group by all having count(*) >= {LEAST_LINES}),
g as (select doc_id, chunk from u qualify row_number() over (partition by u order by doc_id, a) > 1),
d as (select doc_id, regexp_extract_all(text, '{word}') as ws from {table} where text <> ''),
r as (select doc_id, unnest(list_transform(range(0, len(ws) - {RUN - 1}), lambda i: array_to_string(list_slice(ws, i + 1, i + {RUN}), ' '))) as run, unnest(range(0, len(ws) - {RUN - 1})) as p from d where len(ws) >= {RUN}),
f as (select doc_id, p, first_value(doc_id) over w as d0, first_value(p) over w as p0 from r window w as (partition by run order by doc_id, p)),
o as (select doc_id from {table} where contains(text, chr(10)) qualify row_number() over (partition by text order by doc_id) > 1),
x as (select distinct doc_id, unnest(range(p, p + {RUN})) as j from f where doc_id <> d0 or p >= p0 + {RUN}),
w as (select doc_id, k, unnest(ws) as word, w0 + generate_subscripts(ws, 1) - 1 as j from c),
y as (select w.doc_id, k, bool_or(x.j is not null) as hit, string_agg(word, ' ' order by w.j) filter (where x.j is null) as rest from w left join x on x.doc_id = w.doc_id and x.j = w.j group by all),
z as (select c.doc_id, c.k, case when hit then rest else line end as line from c left join g on g.doc_id = c.doc_id and g.chunk = c.chunk left join y on y.doc_id = c.doc_id and y.k = c.k where g.doc_id is null),
t as (select doc_id, string_agg(line, chr(10) order by k) as text from z where line is not null group by doc_id
  union all select doc_id, text from {table} where text = '' or text is null)
select d.doc_id, t.text, d.lang, d.source, length(t.text)::BIGINT as n_chars from t join {table} d using (doc_id) where (t.text is null or t.text = d.text or regexp_matches(t.text, '{word}')) and doc_id not in (select doc_id from o)"""
