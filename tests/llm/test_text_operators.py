"""License scans, byte-pair encoding, HTML, quality rules, toxicity."""

import base64
import itertools
import random
import time
import tracemalloc

import numpy as np
import pytest
from helpers import CLASH, DOCS, clashing, docs, plain, same_as_sql
from pyspark.sql import functions as F

from quillon.llm import bpe, htmlcut, licenses, quality, toxicity

HARD = [None, "", " ", "\n\n", "x" * 200_000, "word " * 30_000, "a b c", "\u0000퟿ é ß 漢字", (7, "tie."), (7, "tie."), (None, "no id."), (8, None)]


# License scans


@pytest.fixture(scope="module")
def automaton():
    return licenses.Automaton(licenses.TEMPLATES)


def test_matching_statistics(automaton):
    templates = [licenses.tokens(t) for _, t in licenses.TEMPLATES]
    known = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    rng = random.Random(3)
    for _ in range(8):
        words = []
        for _ in range(15):
            t = rng.choice(templates)
            i = rng.randrange(len(t))
            words += t[i : i + rng.randrange(1, 12)] + ["unknown"] * (rng.random() < 0.2)
        want = []
        for e in range(len(words)):
            n = 0
            while n <= e and tuple(words[e - n : e + 1]) in known:
                n += 1
            want.append(n)
        got = list(automaton.statistics([automaton.ids.get(w, 0) for w in words]))
        assert [n for _, n in got] == want
        for e, (v, n) in enumerate(got):
            if n:
                places = {(k, p) for k, t in enumerate(templates) for p in range(n - 1, len(t)) if t[p - n + 1 : p + 1] == words[e - n + 1 : e + 1]}
                assert set(automaton.places[v]) == places


@pytest.mark.parametrize("number", range(len(licenses.TEMPLATES)))
def test_each_template_is_found(automaton, number):
    name, text = licenses.TEMPLATES[number]
    found = automaton.scan(licenses.tokens("some words before. " + text + " and words after"))
    assert name in [automaton.names[k] for k, *_ in found]


def test_changed_template_is_chained(automaton):
    words = licenses.tokens(licenses.TEMPLATES[0][1])
    words[30:32] = ["other", "words"]
    (find,) = automaton.scan(words)
    assert automaton.names[find[0]] == "MIT" and find[1] == 0 and find[3] == len(words) - 2


def test_whole_license_is_one_find(automaton):
    for name, text in licenses.TEMPLATES:
        if len(licenses.tokens(text)) > 130:
            ((k, a, b, n),) = automaton.scan(licenses.tokens("Copyright 2020. " + text + " end"))
            assert automaton.names[k] == name and n == len(licenses.tokens(text)) and (a, b) == (2, 2 + n)


def test_part_of_template_is_not_enough(automaton):
    assert automaton.scan(licenses.tokens("rights reserved all")) == []
    assert automaton.scan(licenses.tokens("GNU General Public License, version")) == []


def slow_chains(anchors, gap):
    """The same by search through all chains: the heaviest goes first, then the heaviest of what it leaves."""
    anchors = sorted(anchors)

    def follows(a, b):
        (d0, t0, n0), (d, t, n) = a, b
        over = max(0, d0 + n0 - d, t0 + n0 - t)
        return n - over if d0 < d and t0 < t and over < n and d - d0 - n0 <= gap and t - t0 - n0 <= gap else None

    def paths(i):
        yield anchors[i][2], [i]
        for j in range(i):
            if (more := follows(anchors[j], anchors[i])) is not None:
                yield from ((w + more, [*p, i]) for w, p in paths(j))

    heaviest = [max(w for w, _ in paths(i)) for i in range(len(anchors))]
    return heaviest


def test_chains_are_the_heaviest():
    rng = random.Random(7)
    for _ in range(200):
        anchors = list({(rng.randrange(30), rng.randrange(30), rng.randint(1, 5)) for _ in range(rng.randint(1, 9))})
        gap = rng.randint(0, 8)
        got = licenses.chains(anchors, gap)
        want = slow_chains(anchors, gap)
        assert got[0][0] == max(want) and all(w in want for w, *_ in got)
        assert sum(w == max(want) for w, *_ in got) >= 1 and [w for w, *_ in got] == sorted((w for w, *_ in got), reverse=True)


def test_offsets_are_of_the_text_as_it_is(spark):
    texts = ["İİİ Released under the MIT License", "ΣΑΣ İ. All rights reserved"]
    rows = licenses.scan(docs(spark, texts)).collect()
    assert [texts[r["doc_id"]][r["begin"] : r["end"]] for r in sorted(rows)] == ["Released under the MIT License", "All rights reserved"]


def test_scan(spark):
    texts = [*HARD, "A. Released under the MIT License.", "A. Released under the MIT License.", "All rights reserved. " * 3000]
    for df in (docs(spark, texts), clashing(spark, texts)):
        rows = licenses.scan(df).collect()
        assert sorted((r["doc_id"], r["license"]) for r in rows if r["license"] == "MIT") == [(12, "MIT"), (13, "MIT")]
        assert sum(r["doc_id"] == 14 for r in rows) == 3000
        assert all(texts[r["doc_id"]][r["begin"] : r["end"]] in ("Released under the MIT License", "All rights reserved") for r in rows)
    assert licenses.scan(docs(spark, [])).count() == 0


# Byte-pair encoding


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(bpe.vocabulary()))


def brute(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges(codec):
    rng = random.Random(5)
    for k in range(150):
        word = bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40))) if k % 2 else rng.choice([b"ab", b"the", b" ", b"aaaa"]) * rng.randrange(1, 30)
        want = brute(word, codec.ranks)
        assert bpe.merge_short(word, codec.ranks) == want
        assert bpe.merge_long(word, codec.ranks) == want


def test_equals_other_encoder(codec):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in (t if isinstance(t, str) else "" for t in HARD):
        assert codec.encode(text) == other.encode_ordinary(text)


def test_round_trip(spark):
    texts = [*HARD, "<|endoftext|>"]
    for df in (docs(spark, texts), clashing(spark, texts)):
        made = bpe.encode(df, check=True)
        assert made.columns[: len(df.columns)] == df.columns
        name = made.columns[len(df.columns)]
        back = bpe.decode(made, tokens_col=name)
        rows = back.collect()
        assert len(rows) == len(texts)
        assert all(r["text"] == r["decoded"] for r in rows)
        assert all(r[made.columns[-1]] is (None if r["text"] is None else True) for r in rows)
    assert bpe.tokenised(docs(spark, [])).count() == 0
    odd = spark.createDataFrame([([1, None],), ([10**9],), (None,), ([],)], "tokens array<int>")
    assert [r["decoded"] for r in bpe.decode(odd).collect()] == [None, None, None, ""]


def test_vocabulary_is_a_parameter(tmp_path, spark):
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)) + base64.b64encode(b"ab") + b" 256\n")
    rows = bpe.tokenised(docs(spark, ["abab c"]), str(path)).collect()
    assert rows[0]["tokens"] == [256, 256, 32, 99] and rows[0]["round_trip"]


# HTML

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<article><h1>Storm at sea</h1><p>The first ships came back on Monday. Nobody was hurt, they said &amp; went home.</p><p>A second storm is on its way, so the harbour stays closed.</p></article>
<footer>&copy; Example</footer></body></html>"""


def test_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randint(1, 7)
        c, b = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i) if rng.random() < 0.5]
        cost = lambda s: sum(c[i] if s[i] else b[i] for i in range(n)) + sum(k for i, j, k in edges if s[i] != s[j])  # noqa: B023, E731
        assert cost(htmlcut.min_cut(c, b, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=n))))


def test_extract(spark):
    pages = [PAGE, PAGE, None, "", "<p>a", "<<<", "</p></p>x<div><b>k", "<script>if(a<b)", PAGE * 200, "plain words only. " * 5000]
    schema = "page_id bigint, url string, html string, text string, n_blocks int"
    df = spark.createDataFrame([(i if i != 4 else None, None, h, "x", 1) for i, h in enumerate(pages)], schema)
    rows = htmlcut.extract(df).collect()
    assert len(rows) == len(pages)
    by = {r["page_id"]: r for r in rows}
    assert by[0]["text"].startswith("Storm at sea\nThe first ships") and "& went" in by[0]["text"]
    assert "Home" not in by[0]["text"] and "Example" not in by[0]["text"]
    assert by[0]["text"] == by[1]["text"] and by[2]["text"] is None and by[3]["text"] == ""
    assert htmlcut.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<head><title>x</title><body><p>Text</p>",
        "<html><head><meta charset=utf-8><title>x</title><p>Text",
        "<head><title>x</title>Text",
        "<head><title>x</title><b>Text</b>",
        "<body><button>Go<p>Text</p></body>",
        "<body><select><option>A<option>B<div>Text</div></body>",
        "<body><object data=x><param name=y><p>Text</p></body>",
        "<ul><li><button>Go<li>Text</ul>",
        "<p>Te<svg class=icon />xt</p>",
        "<p>Te<iframe src='a'/>xt</p>",
        "<div><button>Go<p>Text</p><button>Off</button></div>",
        "<body><button><div>Go</div></button><object><object>a</object>b</object><svg><text>c</text></svg><p>Text</p>",
    ],
)
def test_hidden_elements_end(page):
    assert [b.text for b in htmlcut.blocks(page)] == ["Text"]


@pytest.mark.parametrize("page", ["<a " * 50_000, "<a href='x" * 20_000, '<a ">"' * 20_001 + '"', "<div>" * 20_000 + "</p>" * 20_000, "<div>x" * 20_000, "<!--" * 20_000, "</script" * 20_000, "<script>" * 20_000, "<li>a<p>b" * 8_000, "&lt" * 40_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    htmlcut.blocks(page)
    assert time.process_time() - began < 1


def test_code_keeps_its_white_space():
    assert [b.text for b in htmlcut.blocks("<p> a  b </p><pre>\nif x:\n    y <b>= 1</b>\n\n    z()\n</pre><p>c")] == ["a b", "if x:\n    y = 1\n\n    z()", "c"]


def test_steps_between_elements():
    tree = []
    found = htmlcut.blocks("<div><p>a</p><ul><li>b<li>c</ul></div>d", tree)
    assert [htmlcut.apart(found[0].node, b.node, tree) for b in found] == [0, 3, 3, 2]


def test_classifier_holds_without_tags():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(8, 30))).capitalize() + "."

    def page(tags):
        a, b, c = ("nav", "article", "footer") if tags else ("div", "div", "div")
        links = "".join(f"<li><a href='/x'>{word().title()}</a></li>" for _ in range(6))
        body = "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(6))
        return f"<body><{a}><ul>{links}</ul></{a}><{b}>{body}</{b}><{c}>{word()} {word()}</{c}></body>"

    weights = htmlcut.train([page(True) for _ in range(60)])
    right = total = 0
    for _ in range(40):
        tree = []
        found = htmlcut.blocks(page(False), tree)
        for b, side in zip(found, htmlcut.min_cut(*htmlcut.graph(found, weights, tree))):
            right += side == (b.tag == "p")
            total += 1
    assert right / total > 0.9


# Quality rules

GOOD = "This is a fine line with words. And another sentence follows here."
LINES = [GOOD, "Home | News | About | Contact", "CLICK HERE NOW", "Click here to win.", "no end", "$$$ %%% ^^^ &&& *** ((( .", "", "  ", "very very very very very very very very.", "Ça va très bien, merci. Größe: 3.", "今天天气很好。我们去公园。", "本当ですか？", "没有句号"]


def test_quality_equals_sql(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 8))) for _ in range(120)] + [None, "", "\n", GOOD, GOOD]
    df = docs(spark, texts)
    same_as_sql(quality.clean(df), quality.sql(), documents=df)


def test_quality_edges(spark):
    texts = [*HARD, GOOD, GOOD, "\n".join([GOOD] * 5000)]
    df = clashing(spark, texts)
    out = quality.clean(df)
    assert out.columns == df.columns
    kept = plain(out.select("doc_id").collect())
    assert {(12,), (13,), (14,), (7,)} <= set(kept) and kept.count((7,)) == 2 and (None,) in kept and (8,) not in kept
    assert quality.clean(df, keep_null=True).filter("text is null").count() == 2
    assert quality.clean(df.limit(0)).count() == 0


def test_quality_takes_bad_lines_only(spark):
    text = "\n".join([GOOD, "Home | News | About | Contact", GOOD, GOOD])
    row = quality.clean(docs(spark, [text])).first()
    assert row["text"] == "\n".join([GOOD] * 3) and row["n_chars"] == len(row["text"])


# Toxicity

MEAN = ["idiot", "scum", "pathetic", "worthless"]
CALM = "the of and to in is it that with for on this by tree house river stone bread water light paper green".split()


def labelled(spark, extra=(), n=400):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CALM) for _ in range(40)]
        if i % 4 == 0:
            for w in rng.sample(MEAN, 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    df = docs(spark, rows + list(extra))
    return df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


DISGUISED = ["1d10t", "i d i o t", "idiooot", "w0rthl3ss", "p4thet1c", "$cum", "s.c.u.m", "1diot", "IDIOT", "wort-hless"]


def test_toxicity(spark):
    extra = [(1000 + k, f"the tree {x} and the river {x} is green") for k, x in enumerate(DISGUISED)]
    calm = [(2000, "the tree and 100 rivers on 5th street"), (2001, "a b c d e f"), (2002, "H3LLO th3r3"), (2003, None), (2004, ""), (2005, "water " * 30_000), (2006, "a " * 20_000)]
    twice = [(3000, "scum and idiot"), (3000, "scum and idiot"), (None, "pathetic idiot scum")]
    df, labels = labelled(spark, [*extra, *calm, *twice])
    rows = toxicity.scan(df, labels).collect()
    found = [r["doc_id"] for r in rows]
    assert {i for i in found if i is not None and i < 1000} == set(range(0, 400, 4))
    assert {1000 + k for k in range(len(DISGUISED))} <= set(found)
    assert not {i for i, _ in calm} & set(found)
    assert found.count(3000) == 2 and None in found and all(r["toxic"] and r["words"] for r in rows)
    kept = toxicity.clean(df, labels)
    assert kept.columns == df.columns and kept.count() + len(rows) == df.count()


def found_in(spark, phrases):
    df, labels = labelled(spark, [(1000 + k, x) for k, x in enumerate(phrases)])
    return {r["doc_id"] - 1000: set(r["words"]) for r in toxicity.scan(df, labels).filter("doc_id >= 1000").collect()}


def test_toxicity_of_split_words(spark):
    words = {"i-d-i-o-t": "idiot", "id-iot": "idiot", "pathe-tic": "pathetic", "id'iot": "idiot", "sc’um": "scum", "s-c-u-m": "scum", "well-water": None, "tree's": None}
    got = found_in(spark, [f"the tree {x} and the river" for x in words])
    assert {k: w for k, w in enumerate(words.values()) if w} == {k: next(iter(w)) for k, w in got.items()}


def test_toxicity_of_spaced_words_beside_punctuation(spark):
    words = {"i d i o t.": "idiot", "i d i o t, and": "idiot", "s c u m!": "scum", "(s c u m)": "scum", '"s c u m" he': "scum", "“i d i o t”": "idiot", "a b c. d e f, g": None}
    got = found_in(spark, [f"the tree is {x} the river" for x in words])
    assert got == {k: {w} for k, w in enumerate(words.values()) if w}
    assert toxicity.runs_alone('x "a b c. d e f g! h i'.split()) == ["a b c", "d e f g"]


def test_toxicity_of_words_in_pieces(spark):
    """Two pieces or more, of any length, with other disguises within."""
    words = {"id iot": "idiot", "sc u m": "scum", "s cum": "scum", "sc um.": "scum", "path etic": "pathetic", "worth less": "worthless", "(worth less)": "worthless", "id 10t": "idiot", "1d iot": "idiot", "$c um": "scum", "pa the t1c": "pathetic", "id - iot": "idiot", "id ioooot": "idiot", "SC UM": "scum", "scu, m": None, "sc. um": None}
    got = found_in(spark, [f"the tree is {x} of the river" for x in words])
    assert got == {k: {w} for k, w in enumerate(words.values()) if w}
    calm = ["the path and etic", "so me tree", "the worth of less", "a sc of the um"] + ["worth less"] * 200  # words of their own, which are often there
    assert found_in(spark, [f"the river {x} and green" for x in calm]) == {}


def test_columns_of_labels(spark):
    df, labels = labelled(spark)
    named = labels.select(F.col("doc_id").alias("the.id"), F.col("toxic").alias("bad"))
    assert plain(toxicity.scan(df, named, label_id="the.id", label_col="bad").collect()) == plain(toxicity.scan(df, labels).collect())


def test_toxicity_reach():
    """Tokens that are not decoded have no word of the lexicon in their restored form."""
    words = ["bully", "ugly", "filth", "ass", "idiot", "scum", "worthless", "größe"]
    rng = np.random.default_rng(3)
    table = rng.normal(-3, 2, toxicity.CLASSES**3).astype(np.float32)
    decoder, reach, weights = toxicity.Decoder(table), toxicity.Reach(words), set(words)
    swaps = {v: k for k, vs in toxicity.LOOKS.items() for v in vs}
    hits = skipped = 0
    for _ in range(4000):
        out = []
        for c in words[rng.integers(len(words))]:
            kind = rng.integers(9)
            out.append(c * int(rng.integers(2, 4)) if kind == 0 else swaps.get(c, c) if kind == 1 else c + "-_.7²"[rng.integers(5)] if kind == 2 else "" if kind == 3 and rng.integers(3) == 0 else c)
        token = "".join(out) + ["", "x", "!", "-ly"][rng.integers(4)]
        full = {w for w in toxicity.readings(token, decoder) if w in weights}
        assert {w for w in toxicity.readings(token, decoder, reach) if w in weights} == full, token
        hits += bool(full)
        skipped += not reach.may(token)
    assert hits > 100 and skipped > 100


def test_toxicity_holds_little_at_once():
    """Before, a task kept what it knew of 500,000 tokens, however long these were, and half a million numbers as objects."""
    rng = np.random.default_rng(2)
    words = ["grubnal", "zortik"]
    pieces = toxicity.Pieces(words, {"grubnal": 50}, 10_000)
    decoder = toxicity.Decoder(rng.normal(-3, 1, toxicity.CLASSES**3).astype(np.float32))
    assert decoder.table.itemsize == 4
    scorer = toxicity.Scorer(decoder, dict.fromkeys(words, 4.0), pieces, toxicity.Reach(words))
    letters = list("abcdefghijklmnopqrstuvwxyz")
    token = lambda n: "".join(rng.choice(letters, n))
    assert scorer.words("gr8t " + token(5_000) + " Zortik, grubnal!") == set(words)
    tracemalloc.start()
    for _ in range(100):
        scorer.words(" ".join(token(100) for _ in range(100)) + " " + token(20_000))
    assert tracemalloc.get_traced_memory()[0] < 1_500_000  # of tokens of 3 MB
    tracemalloc.stop()
    known = toxicity.Recent(10)
    for k in range(1_000):
        known.put(str(k), (k,))
        assert known.get(str(k)) == (k,) and known.get("0") == (0,)  # what is asked for stays
    known.put("x" * 1_000, (1,))
    assert len(known.now) + len(known.before) <= 20 and known.get("x" * 1_000) is None and known.get("999") == (999,)


def scorer_of(words):
    decoder = toxicity.Decoder(np.random.default_rng(4).normal(-3, 2, toxicity.CLASSES**3).astype(np.float32))
    return toxicity.Scorer(decoder, dict.fromkeys(words, 4.0), toxicity.Pieces(words, dict.fromkeys(words, 100), 10_000), toxicity.Reach(words))


def test_toxicity_looks_at_few_tokens_in_full(monkeypatch):
    """Before, each token was read and cut to its skeletons."""
    scorer, rng, read = scorer_of(["filth", "idiot", "scum"]), random.Random(4), []
    monkeypatch.setattr(toxicity, "readings", lambda t, *x: read.append(t) or ())
    calm = ["".join(rng.choices("enorthwv", k=9)) + ["", ",", "$$$", "!!"][k % 4] for k in range(1000)]
    assert scorer.words(" ".join(calm)) == set() and len(read) < 10


def test_toxicity_of_first_pieces_with_merged_letters():
    """Before, a token that begins with li, il, gb or bg was never a first piece."""
    assert scorer_of(["liar", "bully"]).words("a lia r he is") == {"liar"}


def test_toxicity_leaves_out_nothing_that_matters():
    words = ["bully", "ugly", "filth", "ass", "idiot", "liar", "scum", "its", "größe"]
    scorer, pieces, rng = scorer_of(words), toxicity.Pieces(words, {}, 1), np.random.default_rng(4)
    swaps = {v: k for k, vs in toxicity.LOOKS.items() for v in vs}
    left = first = going = 0

    def token():
        w = words[rng.integers(len(words))]
        a = int(rng.integers(len(w)))
        w = w if rng.integers(3) else w[:a] if rng.integers(2) else w[a:]
        kinds = [(c, int(rng.integers(14))) for c in w]
        w = "".join(c * int(rng.integers(2, 4)) if k == 0 else swaps.get(c, c) if k == 1 else c + "-.7²"[rng.integers(4)] if k == 2 else "lgbixe"[rng.integers(6)] if k == 3 else c for c, k in kinds)
        return ["", "", "", "“", "(", "$"][rng.integers(6)] + w + ["", "", "", "!", "$$$", ".", "!!.", "!+$", ",!!", "||"][rng.integers(10)]

    tokens = [t for _ in range(6000) if (t := token())]
    for t, after in zip(tokens, tokens[1:]):
        core, bare, _, on = pieces.token(t)
        begins = bool(core) and on and not bare.isdisjoint(pieces.begins)
        assert scorer.pieces.begin(t) == begins
        full = {w for w in toxicity.readings(t, scorer.decoder) if w in words}
        if not scorer.matters(t):
            assert not full and not begins and not toxicity.lone(t), t
            left += 1
        first += begins
        if begins and not scorer.pieces.follows(t, after):
            joins, y = pieces.token(after)[2], pieces.token(after)[1]
            assert not joins or y and not {toxicity._RUN.sub(r"\1", a + b) for a in bare for b in y} & (pieces.begins | pieces.whole), (t, after)
            going += 1
        assert set(scorer.token(t)[0]) == full and scorer.token(t)[1:] == (begins, toxicity.lone(t)), t
    assert left > 500 and first > 200 and going > 50


def test_toxicity_edges(spark):
    df, labels = labelled(spark, n=40)
    assert toxicity.scan(df, labels.limit(0)).count() == 0
    assert toxicity.scan(df, labels.withColumn("toxic", F.lit(None).cast("int"))).count() == 0
    assert toxicity.scan(df.limit(0), labels).count() == 0
    odd = clashing(spark, HARD)
    out = toxicity.clean(odd, labels)
    assert out.columns == odd.columns and out.count() == len(HARD)


def test_viterbi_is_the_best_path():
    import numpy as np

    rng = np.random.default_rng(0)
    decoder = toxicity.Decoder(rng.normal(-3, 1, toxicity.CLASSES**3).astype(np.float32))

    def cost(text, total):
        a = b = 0
        for z in [int(toxicity._CLASS[x]) for x in (text + " ").encode()]:
            if z == 0 and b == 0:
                continue
            total += decoder.table[(a * toxicity.CLASSES + b) * toxicity.CLASSES + z]
            a, b = b, z
        return total

    for span in ("1d10t", "a$b", "x!!1", "o0o", "b b c", "sscc"):
        arcs = decoder.lattice(span, False)
        best = max(cost("".join(t for t, _ in path), sum(c for _, c in path)) for path in itertools.product(*arcs))
        got = decoder.restore(span)
        ways = [sum(c for _, c in path) for path in itertools.product(*arcs) if " ".join("".join(t for t, _ in path).split()) == got]
        assert max(cost(got, w) for w in ways) == pytest.approx(best, abs=1e-4) or got != " ".join(got.split())


def test_schemas():
    assert DOCS.split(",")[0] == CLASH.split(",")[0]
