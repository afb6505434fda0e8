"""Line dedup, packing, WARC bundles, nearest neighbours, n-gram join, the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow.fs
import pytest
import zstandard
from helpers import DOCS, clashing, docs, plain, same_as_sql
from pyspark.sql import functions as F

from quillon.llm import ann, bpe, graph, jaccard, linededup, packing, warc

HARD = [None, "", "\n\n", "x" * 100_000, (7, "tie."), (7, "tie."), (None, "no id."), (None, "no id."), (8, None), "!!! ???"]
WORDS = [a + b for a in ("ba", "ce", "di", "fo", "gu", "ha", "je", "ki") for b in ("nd", "rt", "ls", "mp", "ck", "st", "tt")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# Line dedup


def corpus(rng):
    shared = ["\n".join(prose(rng, rng.randint(3, 9)) for _ in range(rng.randint(2, 12))) for _ in range(6)] + [prose(rng, 60)]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randint(2, 9)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        texts.append("\n".join(parts))
    return texts


def slow_dedup(rows):
    """The rules by dictionaries of all units and runs. rows: (id, text) with different ids or texts."""
    key = lambda r: (r[0] is None, r[0] or 0)
    chunks, runs, whole, out = {}, {}, set(), []
    for i, text in sorted(set(rows), key=key):
        copy = text in whole and "\n" in (text or "")
        whole.add(text)
        if not text:
            out.append((i, text))
            continue
        lines = text.split("\n")
        gone, begin, before = set(), 0, 0
        for k, line in enumerate(lines):
            h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
            if (before * 31 + h) % 3 == 0 or k == len(lines) - 1:
                if k > begin and chunks.setdefault("\n".join(lines[begin : k + 1]), (i, text, begin)) != (i, text, begin):
                    gone.update(range(begin, k + 1))
                begin = k + 1
            before = h
        words, cut = re.findall("[^ \t\n\x0b\f\r]+", text), set()
        for p in range(len(words) - 50):
            e, t, q = runs.setdefault(tuple(words[p : p + 51]), (i, text, p))
            if (e, t) != (i, text) or p >= q + 51:
                cut.update(range(p, p + 51))
        left, at = [], 0
        for k, line in enumerate(lines):
            mine = re.findall("[^ \t\n\x0b\f\r]+", line)
            rest = [w for j, w in enumerate(mine, at) if j not in cut]
            at += len(mine)
            if k not in gone and (rest or not mine):
                left.append(line if len(rest) == len(mine) else " ".join(rest))
        new = "\n".join(left)
        if not copy and (new == text or new.split()):
            out.append((i, new))
    return out


def deduped(df):
    return plain((r["doc_id"], r["text"]) for r in linededup.dedup(df).collect())


def test_line_dedup_equals_sql(spark):
    rng = random.Random(0)
    texts = corpus(rng)
    df = docs(spark, [*texts, texts[0], texts[3], "", None, "one line", "one line", "\n\n", "\n\n", "a\n\n\nb", "c\n\n\nb", " \t two  spaces\r\n" * 30, "x " + " \t two  spaces\r\n" * 30])
    same_as_sql(linededup.dedup(df), linededup.sql(), documents=df)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    shared = ["\n".join(prose(rng, w) for _ in range(n)) for n, w in [(4, 15), (5, 20), (3, 40), (10, 10), (1, 50), (1, 51), (1, 300), (51, 1)] * 3]
    texts = ["first " + rng.choice([" ", "\n", "\n\n"]).join([prose(rng, rng.randint(1, 40)), rng.choice(shared), prose(rng, 3), rng.choice(shared), prose(rng, rng.randint(1, 90))]) for _ in range(80)]
    texts += ["water " * 400, "a b " * 90, *corpus(rng), texts[3], texts[5], texts[3], *HARD, "é\u3000" * 60, "wörter " * 50, "water " * 400]
    rows = [x if isinstance(x, tuple) else (k, x) for k, x in enumerate(texts)]
    want = slow_dedup(rows)
    got = deduped(docs(spark, texts).repartition(5))
    assert set(got) == set(plain(want)) and sum(len((t or "").split()) for _, t in want) < 0.7 * sum(len((t or "").split()) for _, t in set(rows))
    assert got.count((7, "tie.")) == 2 and got.count((None, "no id.")) == 2  # repeated rows


def test_line_dedup_is_shift_resistant(spark):
    rng = random.Random(1)
    block = [prose(rng, 6) for _ in range(400)]
    rest = dict(deduped(docs(spark, ["\n".join(block), "\n".join(["a new first line", *block])])))
    assert rest == {0: "\n".join(block), 1: "a new first line"}


def test_passages_over_lines_and_within_one(spark):
    rng = random.Random(12)
    lines = ["\n".join(prose(rng, w) for _ in range(n)) for n, w in ((4, 15), (5, 20), (3, 40), (10, 10))]
    inner = prose(rng, 60)
    texts = [f"{prose(rng, 5)}\n{x}\n{prose(rng, 6)}" for x in lines] + [f"before it {inner} after it"]
    later = [f"top {k}\n\n{x}\nend {k}" for k, x in enumerate(lines)] + [f"so then: {inner} and on", inner]
    assert dict(deduped(docs(spark, texts + later))) == dict(enumerate(texts)) | {5 + k: f"top {k}\n\nend {k}" for k in range(4)} | {9: "so then: and on"}


def test_line_dedup_edges(spark):
    rng = random.Random(2)
    passage = prose(rng, 70)
    many = "\n".join(prose(rng, 5) for _ in range(20_000))
    copies = [f"{prose(rng, 8)}\n{prose(rng, 8)}\n{prose(rng, 60)}"] * 300  # a third of all rows
    df = clashing(spark, [*HARD, "start\n" + passage, passage + "\nend", many, *copies, *[prose(rng, 5) for _ in range(600)]])
    out = linededup.dedup(df)
    assert out.columns == df.columns
    rows = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert {(10, "start\n" + passage), (11, "end"), (12, many), (0, None), (1, ""), (7, "tie."), (None, "no id."), (13, copies[0])} <= rows
    assert not {i for i, _ in rows} & set(range(14, 313))
    assert linededup.dedup(df.limit(0)).count() == 0


# Packing


def slow_pack(sizes, capacity):
    """The same rules by search through all bins."""
    left = list(range(len(sizes)))
    bins = []
    large = [i for i in left if sizes[i] * 3 > capacity // 3 * 3 and sizes[i] > capacity // 3]
    free = large[:]
    while free:
        i = free.pop(0)
        load = [i]
        for j in free:
            if sizes[i] + sizes[j] <= capacity:
                load.append(j)
                free.remove(j)
                break
        bins.append(load)
    for i in left:
        if i in large:
            continue
        gaps = [(capacity - sum(sizes[j] for j in b), k) for k, b in enumerate(bins)]
        fits = [(g, k) for g, k in gaps if g >= sizes[i]]
        if fits:
            bins[min(fits)[1]].append(i)
        else:
            bins.append([i])
    return sorted(sorted(sizes[j] for j in b) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_assign_equals_slow_version(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(3, 3000))
    sizes = np.sort(rng.integers(1, capacity + 1, 120) // (1 + rng.integers(0, 6, 120)) + 1).clip(1, capacity)[::-1]
    bins, begins = packing.assign(sizes, capacity)
    loads = {}
    for s, b, at in zip(sizes.tolist(), bins.tolist(), begins.tolist()):
        loads.setdefault(b, []).append((at, s))
    for load in loads.values():
        load.sort()
        assert [a for a, _ in load] == np.cumsum([0, *[s for _, s in load]])[:-1].tolist() and sum(s for _, s in load) <= capacity
        assert sum(s > capacity // 3 for _, s in load) <= 2
    got = sorted(sorted(s for _, s in load) for load in loads.values())
    want = slow_pack(sizes.tolist(), capacity)
    assert len(got) == len(want) and sum(sum(b) ** 2 for b in got) == pytest.approx(sum(sum(b) ** 2 for b in want), rel=0.02)


def test_pack(spark):
    rng = random.Random(3)
    texts = [*HARD, *["x" * rng.randint(1, 900) for _ in range(300)], "y" * 5000]
    for df in (docs(spark, texts), clashing(spark, texts)):
        for options in ({}, {"shard_items": 50}):
            rows = packing.pack(df, capacity=1000, **options).collect()
            plain_texts = [t[1] if isinstance(t, tuple) else t for t in texts]
            assert sum(r["size"] for r in rows) == sum(len(t) for t in plain_texts if t)
            loads = {}
            for r in rows:
                loads.setdefault(r["bin"], []).append((r["place"], r["size"]))
            for load in loads.values():
                end = 0
                for place, size in sorted(load):
                    assert place == end
                    end += size
                assert end <= 1000
            long = sorted((r["piece"], r["begin"], r["size"]) for r in rows if r["doc_id"] == len(texts) - 1)
            assert long == [(k, 1000 * k, 1000) for k in range(5)]
    assert packing.pack(docs(spark, [])).count() == 0 and packing.pack(docs(spark, ["", None])).count() == 0


def test_packed_tokens(spark):
    """Every token is in one sequence once, pieces of a document in their order, and bins are as full as by characters."""
    rng = random.Random(5)
    texts = [*HARD[:5], *[prose(rng, rng.randint(1, 200)) for _ in range(80)], prose(rng, 3000)]
    encoded = bpe.encode(docs(spark, [*texts, (7, "tie."), (7, "tie."), (None, texts[9])]))
    want = sorted(tuple(r["tokens"]) for r in encoded.collect() if r["tokens"])
    rows = packing.sequences(encoded, capacity=512, shard_items=40).collect()
    pieces = {}
    for r in rows:
        assert len(r["tokens"]) <= 512 and len(r["starts"]) == len(r["doc_ids"]) and r["starts"] == sorted(r["starts"])
        for i, a, z in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], len(r["tokens"])]):
            pieces.setdefault(i, []).append(tuple(r["tokens"][a:z]))
    assert sum(len(r["tokens"]) for r in rows) == sum(map(len, want))
    short = [x for x in want if len(x) < 512]
    assert sorted(x for own in pieces.values() for x in own if len(own) == 1 or x in short)[: len(short)] and all(x in [y for own in pieces.values() for y in own] for x in short)
    long = next(x for x in want if len(x) > 2000)
    assert sorted(p for p in pieces[len(texts) - 1]) == sorted(long[k : k + 512] for k in range(0, len(long), 512))
    packed = packing.pack(encoded, capacity=512, size=F.size("tokens"))
    stats = packing.fill(packed, 512).first()
    assert stats["filled"] > 0.9 and stats["bins"] == packed.select("bin").distinct().count()
    assert packing.sequences(encoded.limit(0)).count() == 0


# WARC


def test_bundles_round_trip(spark, tmp_path):
    pages = ["<p>one</p>", "", None, "é" * 5000, "x" * 30_000, "<p>one</p>", "\r\n\r\nWARC/1.1\r\n\r\n"] + [f"<p>{i}</p>" * 50 for i in range(80)]
    rows = [(None if i == 3 else i, f"http://x/{i}\r\nY: z" if i % 2 else None, h, 1, 1, "f") for i, h in enumerate(pages)] + [(0, None, "<p>one</p>", 1, 1, "f")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, frame int, id int, bundle string").repartition(3)
    folder = f"file://{tmp_path}/bundles"
    index = warc.write(df, folder, frame_bytes=4000, bundle_bytes=3000)
    back = warc.read(index, folder)
    assert plain((r["page_id"], r["html"]) for r in back.collect()) == plain((r[0], r[2]) for r in rows)
    known = index.collect()
    assert len({r["bundle"] for r in known}) > 3
    # Any reader of the format can use a bundle: the frames one after the other, and the footer's offsets.
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for name in {r["bundle"] for r in known}:
        with fs.open_input_file(f"{root}/{name}") as f:
            table = warc.read_seek_table(f)
            f.seek(0)
            raw = f.read()
        assert {(r["frame"], r["frame_begin"], r["frame_size"]) for r in known if r["bundle"] == name} == {(i, a, n) for i, (a, n, _) in enumerate(table)}
        whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert whole.count(b"WARC-Record-ID") == sum(r["bundle"] == name for r in known) and len(whole) == sum(x[2] for x in table)
    assert not [p for p in (tmp_path / "bundles").iterdir() if p.name.startswith(".part")]
    same = [r["record_id"] for r in known if r["page_id"] == 0]
    assert len(same) == 2 and len(set(same)) == 1
    assert warc.write(df.limit(0), f"{folder}-none").count() == 0


# Nearest neighbours


def nearest_by_brute_force(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = ann.squares(u, u)
    np.fill_diagonal(d, 9)
    return {i: set(np.argsort(d[i], kind="stable")[:k].tolist()) for i in range(len(x))}


@pytest.mark.parametrize("options", [{"cell_rows": 600}, {"cell_rows": 100, "sample": 700}, {"cell_rows": 1 << 20}, {"cell_rows": 20, "sample": 100}])
def test_neighbours_recall(spark, options):
    """One cell, several, cells that are split into parts; trees that are fitted on all vectors and on some."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 16)) + 3 * rng.normal(0, 1, 16) for _ in range(3)]).astype(np.float32)
    x[10] = x[11]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, place int").repartition(4)
    queries = df.filter("vec_id % 3 = 1")
    rows = ann.neighbours(df, queries, k=5, leaf_rows=20, calibration=150, **options).collect()
    truth = nearest_by_brute_force(x, 5)
    assert len(rows) == 5 * queries.count() and {r["vec_id"] % 3 for r in rows} == {1}
    assert sum(r["neighbour"] in truth[r["vec_id"]] for r in rows) >= 0.93 * len(rows)
    assert [(r["place"], round(r["distance"], 3)) for r in rows if r["vec_id"] == 10 and r["neighbour"] == 11] == [(1, 0.0)]


def test_visits_are_widened_where_they_bring_most():
    assert ann.widened([[1, 1, 1, 9], [1, 2], []], 4) == [1, 1]
    assert ann.widened([[1, 1, 1, 9], [1, 2], []], 6) == [9, 2] and ann.widened([[], [3]], 1) == [0, 3] and ann.widened([[]], 0) == [1]


def test_neighbours_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 0.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for ids, out in ((df, int), (df.withColumn("vec_id", df["vec_id"].cast("string")), str)):
        got = {}
        for r in sorted(ann.neighbours(ids, k=3).collect(), key=lambda r: (r["vec_id"], r["place"])):
            got.setdefault(r["vec_id"], []).append(r["neighbour"])
        one, two, eight, nine = map(out, (1, 2, 8, 9))
        assert set(got) == {one, two, eight, nine} and got[one][0] == nine and one not in got[one] and two not in got[two] and set(got[one]) == {two, eight, nine}
    assert ann.neighbours(df.limit(0)).count() == 0 and ann.neighbours(df.filter("vec_id = 3")).count() == 0 and ann.neighbours(df, df.limit(0)).count() == 0
    # A hot vector: of its ids the least are the neighbours of each.
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)] + [(5000 + i, [1.0, i / 50]) for i in range(50)], "vec_id bigint, embedding array<float>")
    rows = ann.neighbours(equal, equal.filter("vec_id % 100 = 0 and vec_id < 3000"), k=2, leaf_rows=8, cell_rows=20).collect()
    assert sorted((r["vec_id"], r["neighbour"], r["distance"] < 1e-3) for r in rows) == sorted((i, n, True) for i in range(0, 3000, 100) for n in [x for x in range(3) if x != i][:2])
    long = spark.createDataFrame([(i, [float(i + k) for k in range(5000)]) for i in range(20)], "vec_id bigint, embedding array<float>")
    assert ann.neighbours(long, k=2).count() == 40


# N-gram join


def grams(text, n=jaccard.N):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def slow_pairs(rows):
    known = [(i, grams(t)) for i, t in rows if i is not None and grams(t)]
    return {(min(i, j), max(i, j)): len(a & b) / len(a | b) for k, (i, a) in enumerate(known) for j, b in known[:k] if len(a & b) >= jaccard.THRESHOLD * len(a | b)}


def copies(rng):
    rows = []
    for g in range(12):
        words = prose(rng, rng.randint(1, 120)).split()
        for _ in range(rng.randint(1, 7)):
            mine = words[:]
            for _ in range(rng.randint(0, 6)):
                mine[rng.randrange(len(mine))] = rng.choice(WORDS)
            rows.append(" ".join(mine).title() if g % 2 else " ".join(mine) + ".")
    passage = prose(rng, 30)
    rows += [prose(rng, 40) + " " + passage for _ in range(10)] + [rows[0], rows[0], rows[5]]
    return [*enumerate(rows)]


def slow_classes(rows):
    """doc_id, class_id, links of rows with different ids."""
    root, links = {i: i for i, _ in rows if i is not None}, dict.fromkeys((i for i, _ in rows if i is not None), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in slow_pairs(rows):
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(i, find(i), links[i]) for i in root]


@pytest.mark.parametrize("options", [{}, {"block_grams": 100}, {"key_bits": 5}, {"hubs": True}])
def test_join_equals_brute_force(spark, options, monkeypatch):
    if options.pop("hubs", False):  # all ties by way of hubs, all n-grams hot
        monkeypatch.setattr(jaccard, "HUB", 0)
        monkeypatch.setattr(jaccard, "LEAST_HOT", 2)
    rng = random.Random(len(options))
    rows = copies(rng)
    got = jaccard.join(docs(spark, rows).repartition(3), **options)
    want = slow_classes(rows)
    assert got.columns == ["doc_id", "class_id", "links"] and plain(got.collect()) == plain(want) and sum(x[2] for x in want) > 40


def test_join_equals_sql(spark):
    df = docs(spark, [*copies(random.Random(9)), (900, ""), (901, None), (902, "!!"), (903, "one"), (904, "One."), (905, "É à é"), (906, "é À É")])
    same_as_sql(jaccard.join(df), jaccard.sql(), documents=df)


def test_join_unit_of_a_large_class():
    """Millions of pairs take no step of Python each; links are exact, for pairs near the threshold too."""
    rng = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([np.flatnonzero(rng.random(300) < rng.uniform(0.5, 1)) + 10_000, rng.integers(0, 2_000, 20)])) for _ in range(3_000)]
    rows = [(k % 2, k, 1 + k % 3, len(s) + k % 5, s) for k, s in enumerate(sets)]
    held = np.zeros((len(sets), 10_300), dtype=np.float32)
    for k, s in enumerate(sets):
        held[k, s] = 1
    overlap = held @ held.T
    sizes, documents = (np.array([r[i] for r in rows], dtype=np.int64) for i in (3, 2))
    near = overlap / (sizes[:, None] + sizes - overlap) >= jaccard.THRESHOLD
    np.fill_diagonal(near, False)
    assert 0.2 < near.mean() < 0.98
    began = time.process_time()
    whole = list(jaccard._unit([(0, *r[1:]) for r in rows], 0, 0, jaccard.THRESHOLD))
    assert time.process_time() - began < 15
    assert {k: n for k, _, n in whole} == {k: n for k, n in enumerate((near @ documents).tolist()) if n}
    across = near & (np.arange(len(sets))[:, None] % 2 != np.arange(len(sets)) % 2)
    assert {k: n for k, _, n in jaccard._unit(rows, 0, 1, jaccard.THRESHOLD)} == {k: n for k, n in enumerate((across @ documents).tolist()) if n}


def test_join_components_share_a_trie_but_blocks_do_not(spark, monkeypatch):
    rows = copies(random.Random(3))
    want = plain(slow_classes(rows))
    for together, block_grams in ((0, 10**6), (10**6, 10**6), (10**6, 60)):
        monkeypatch.setattr(jaccard, "TOGETHER", together)
        assert plain(jaccard.join(docs(spark, rows), block_grams=block_grams).collect()) == want


def test_join_edges(spark):
    df = clashing(spark, [*HARD, "long " + prose(random.Random(1), 20_000), "short. word", "Short word"])
    rows = plain(jaccard.join(df).collect())
    assert rows == plain([(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (7, 7, 1), (7, 7, 1), (8, 8, 0), (9, 9, 0), (10, 10, 0), (11, 11, 1), (12, 11, 1)])
    assert jaccard.join(df.limit(0)).count() == 0
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert plain(kept.select("doc_id").collect()) == plain([(i,) for i in (0, 1, 2, 3, 7, 7, None, None, 8, 9, 10, 11)])
    assert jaccard.keep_one(df.limit(0)).count() == 0


def groups_kept(rows):
    return {i for i, root, _ in slow_classes(rows) if i == root}


def test_one_of_each_group_stays(spark):
    rows = copies(random.Random(11))
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, rows)).collect()}
    assert kept == groups_kept(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


# The pipeline


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    line = lambda: prose(rng, rng.randint(6, 12)).capitalize() + "."
    passage = prose(rng, 60).capitalize() + "."
    rows, labels = [], []
    for i in range(240):
        body = [line() for _ in range(rng.randint(3, 9))]
        toxic = i % 5 == 0
        if toxic:
            body[1] = "You scum and idiot " + body[1]
        if i % 7 == 1:
            body.insert(1, passage)
        rows.append((i, "\n".join(body)))
        labels.append((i, 1, int(toxic)))
    rows += [(500, rows[1][1]), (501, rows[2][1].replace("nd", "xx", 1)), (502, "menu | a | b | c"), (503, None), (504, ""), (505, "Such sc u m is an 1d10t and $cum here today, my friend.")]
    df = docs(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, inputs = [], []
    for name, stage in pipeline.STAGES:
        inputs.append(now.select("doc_id", "text").collect() if "text" in now.columns else [])
        now = stage(spark, now, str(tmp_path))
        seen.append({r["doc_id"] for r in now.select("doc_id").collect()})
        if name != pipeline.STAGES[-1][0]:
            assert now.columns == df.columns
    assert not {i for i in range(0, 240, 5)} & seen[0] and 505 not in seen[0] and 502 in seen[0]
    assert seen[1] == seen[0] - {502, 503, 504}
    assert seen[3] == groups_kept(inputs[3])
    assert seen[4] == seen[3]
    out = pipeline.run(spark, str(tmp_path))
    assert plain(out.collect()) == plain(now.collect()) and out.groupBy("bin").agg({"size": "sum"}).filter("`sum(size)` > 32768").count() == 0


def test_pipeline_edges(spark, tmp_path):
    """Null ids and texts, repeated rows, further columns with the names that operators use, and empty tables."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    line = lambda: prose(rng, 9).capitalize() + "."
    good = "\n".join(line() for _ in range(4))
    df = clashing(spark, [*HARD, (50, good), (50, good), (51, good), (None, "\n".join(line() for _ in range(3))), (52, "\n".join(line() for _ in range(3)))])
    labels = spark.createDataFrame([(50, 1, 0), (None, None, 1), (52, 1, None)], "doc_id bigint, quality int, toxic int")
    for k, (d, x) in enumerate(((df, labels), (df.limit(0), labels.limit(0)))):
        folder = f"{tmp_path}/{k}"
        d.write.parquet(f"{folder}/documents.parquet")
        x.write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            now = stage(spark, now, folder)
            assert now.columns == df.columns
        rows = pipeline.run(spark, folder).collect()
        assert sorted({r["doc_id"] for r in rows}, key=str) == ([50, 52, 7, None] if k == 0 else [])


def test_schema_of_documents():
    assert DOCS.startswith("doc_id bigint")
