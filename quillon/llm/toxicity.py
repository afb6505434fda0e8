"""Toxicity behind disguises: text is restored by Viterbi decoding under a character language model, then scored.

Three passes. The lexicon comes from
labelled documents (a bounded sample, ``labelled``): words with the log odds of being in a toxic document; the
threshold of a document's sum is chosen by two-fold cross-validation on the sample. The language model counts the byte trigrams (in classes: letters, bytes
beyond ASCII, all else as a word boundary) of the whole corpus, and how often the words of the lexicon and their parts are tokens; partitions add up their
counts, the tables have a fixed size. The third pass restores and scores every document.

A word that may be disguised (digits, symbols, hyphens or apostrophes among letters, a letter three times in a row, doubled letters, letters
that stand alone one after the other, pieces of words that make a word of the lexicon together) becomes a lattice: a character can stand for itself, for the letters it looks like,
or for nothing if it is a symbol or a gap; a run of one letter for one or two of it. The path that the language model and
the cost of each disguise make the most likely is the restored text. Pieces count as a word where the corpus makes that likelier than that
they stand there as words of their own. Other words have one path and are taken as they are.

Defined results: a null or empty text is not toxic; repeated rows get the same result each; null ids are passed on; an
empty table gives no rows; without labelled documents of both kinds there is no lexicon and nothing is toxic. In
``clean`` further columns pass through, in ``scan`` they don't matter.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField

from quillon.llm.common import free, map_rows, quoted, written
from quillon.llm.grams import buffers, slices

#: The most labelled documents that the lexicon is fitted on.
LABELLED = 20_000
#: Toxic documents of the sample that must have a word, and the least log odds, for the lexicon.
SUPPORT, LEAST_ODDS = 4, 3.5
#: In the choice of the threshold a clean document that is flagged counts as so many toxic ones that are missed.
FALSE_ALARM = 3.0
THRESHOLDS = tuple(x / 2 for x in range(6, 31))
#: Bytes of text that a task holds as Python strings at once (a longer text counts as a whole).
PART_BYTES = 1_000_000
#: What is known of tokens is kept for twice so many at most (of tokens as pieces, for fewer), and for none longer than so many characters.
KNOWN, KNOWN_PIECES, LONGEST_KNOWN = 100_000, 60_000, 64

#: What else a character can stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c", "¡": "i",
}
AS_LETTER, AS_NOTHING, LOOK_DROPPED, AS_GAP, DIGIT_DROPPED, DIGIT_GAP, ONE_OF_RUN, TWO_OF_RUN = -0.5, -0.7, -1.5, -2.0, -8.0, -6.0, -1.0, -0.3
#: A word is cut into pieces one time in a thousand, per cut.
CUT = math.log(1000)
LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = ".,;:?\"'()[]{}«»“”‘’…¿-_*&#%^~=/\\<>`"
_ENDS = "!+$|"
_DOUBLE = re.compile(r"([^\W\d_])\1")
_HAS_LETTER = re.compile(r"[^\W\d_]")
_LOOK_SYMBOL = re.compile(r"[@$!|+(<€£¢¡]")
#: A letter or what looks like one.
_ALONE = re.compile(r"[^\W_]|[@$!|+(<€£¢¡]")

CLASSES = 91
_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 63)


#: What is known of a token that matters in no way.
NOTHING = ((), False, "")


class Recent:
    """What is known of tokens: of the last ones, ``most`` to twice as many."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.now: dict[str, object] = {}
        self.before: dict[str, object] = {}

    def get(self, token: str) -> object | None:
        got = self.now.get(token)
        if got is None:
            got = self.before.get(token)
            if got is not None:
                self.put(token, got)
        return got

    def put(self, token: str, got: object) -> None:
        if len(token) > LONGEST_KNOWN:
            return
        if len(self.now) >= self.most:
            self.now, self.before = {}, self.now
        self.now[token] = got


class Dull:
    """Tokens that matter in no way: of the last ones, ``most`` to twice as many."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.now: set[str] = set()
        self.before: set[str] = set()

    def others(self, tokens: set[str]) -> set[str]:
        """The tokens that aren't known to be dull."""
        tokens = tokens - self.now
        again = tokens & self.before
        tokens -= again
        for t in again:
            self.add(t)
        return tokens

    def add(self, token: str) -> None:
        if len(token) > LONGEST_KNOWN:
            return
        if len(self.now) >= self.most:
            self.now, self.before = set(), self.now
        self.now.add(token)


# The language model


def corpus_counts(docs: DataFrame, text_col: str, pieces: Iterable[str] = ()) -> tuple[np.ndarray, dict[str, int], int]:
    """How often each triple of byte classes occurs in the corpus (runs of boundaries count as one), how often each of some tokens, and the number of all tokens."""
    names = sorted(pieces)
    number = {t: k for k, t in enumerate(names)}
    size = CLASSES**3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, every, total = np.zeros(size, dtype=np.int64), [0] * len(names), 0
        for b in batches:
            for _, part in slices(b.column(0)):
                last = np.zeros(0, dtype=np.int32)
                for _, few in slices(part, PART_BYTES):  # arrays of a few MB go back to the system
                    data, offsets = buffers(few)
                    x = _CLASS[np.insert(data, offsets[:-1], 32)] if len(data) else np.zeros(0, dtype=np.int32)
                    x = np.concatenate([last, x, np.zeros(2, dtype=x.dtype)])
                    x = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
                    if len(x) > 2:
                        sums += np.bincount((x[:-2] * CLASSES + x[1:-1]) * CLASSES + x[2:], minlength=size)
                    last = x[-2:-1].copy()
                if number:
                    for text in part:
                        tokens = (text.as_py() or "").lower().split()
                        total += len(tokens)
                        for t in filter(number.__contains__, tokens):
                            every[number[t]] += 1
        counts = np.concatenate([sums, np.array([*every, total], dtype=np.int64)])
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["code", "n"])

    got = docs.select(quoted(text_col).alias("text")).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + len(names) + 1, dtype=np.int64)
    out[got["code"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out[:size], dict(zip(names, out[size:-1].tolist())), int(out[-1])


def log_odds_table(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed with P(c | b) and P(c)."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 0.5) / (uni.sum() + 0.5 * CLASSES)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    p3 = (tri + 20 * p2) / (tri.sum(2, keepdims=True) + 20)
    return np.log(p3).astype(np.float32).reshape(-1)


class Decoder:
    """Restores words under a table of log probabilities."""

    def __init__(self, table: np.ndarray) -> None:
        self.packed = table

    @cached_property
    def table(self) -> array:
        return array("f", self.packed.astype(np.float32, copy=False).tobytes())

    def __getstate__(self) -> dict:
        return {"packed": self.packed}

    @staticmethod
    def lattice(span: str, strict: bool) -> list[list[tuple[str, float]]]:
        """What each place can stand for, and at which cost; a space stands for a boundary.

        strict: one or two symbols that look like a letter are one.
        """
        out: list[list[tuple[str, float]]] = []
        # Letters that stand alone and repeat are a run like those that don't.
        span = re.sub(r"(\S)(?: \1){2,}(?=\s|$)", lambda m: m[1] * (len(m[0]) // 2 + 1), span)
        i = 0
        while i < len(span):
            c, j = span[i], i + 1
            while j < len(span) and span[j] == c:
                j += 1
            if c.isalpha():
                if j - i == 1:
                    out.append([(c, 0.0)])
                elif j - i == 2:
                    out.append([(c + c, 0.0), (c, ONE_OF_RUN - 1.5)])
                else:
                    out.append([(c, ONE_OF_RUN), (c + c, TWO_OF_RUN)])
            elif c.isspace():
                out.append([("", AS_NOTHING), (" ", AS_GAP)])
            else:
                looks = [(x, AS_LETTER) for x in LOOKS.get(c, "")]
                if j - i > 1:
                    looks += [(x + x, 2 * AS_LETTER) for x in LOOKS.get(c, "")]
                drop = DIGIT_DROPPED if c.isalnum() else AS_NOTHING if j - i > 2 or not looks else LOOK_DROPPED
                if strict and looks and j - i < 3:
                    out.append(looks)
                    i = j
                    continue
                out.append([*looks, ("", drop), (" ", DIGIT_GAP if c.isalnum() else AS_GAP)])
            i = j
        return out

    def restore(self, span: str, strict: bool = False) -> str:
        """The most likely reading of a span."""
        lp = self.table
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        coded: dict[str, list[int]] = {}
        for arcs in [*self.lattice(span, strict), [(" ", 0.0)]]:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in beam.items():
                for text, cost in arcs:
                    codes = coded.get(text)
                    if codes is None:
                        codes = coded[text] = [int(_CLASS[x]) for x in text.encode()]
                    x, y, s = a, b, score + cost
                    if codes == [0] and y == 0:
                        codes, text = [], ""  # no two boundaries
                    for z in codes:
                        s += lp[(x * CLASSES + y) * CLASSES + z]
                        x, y = y, z
                    if (x, y) not in after or after[(x, y)][0] < s:
                        after[(x, y)] = (s, (path, text) if text else path)
            beam = after
        path, parts = max(beam.values(), key=lambda v: v[0])[1], []
        while path is not None:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts)).strip()


def _core(token: str) -> str:
    """A token without the punctuation around it."""
    core = token.strip(_EDGE)
    while len(core) > 1 and core[-1] in _ENDS:
        core = core[:-1].rstrip(_EDGE) or core[-1]
    return core


def lone(token: str) -> str:
    """The character that a token is but for punctuation around it; nothing if it is more, or isn't a letter or like one."""
    core = token if len(token) < 2 else _core(token)
    return core if len(core) == 1 and _ALONE.match(core) else ""


def runs_alone(tokens: list[str], chars: dict[str, str] | None = None) -> list[str]:
    """The runs of three or more characters that stand alone. (Two, and longer pieces, are looked up in the lexicon: see ``Pieces``.)

    Punctuation before a character begins a run, punctuation after it ends one. chars: ``lone`` of the tokens that have one, where it is known.
    """
    alone, run = [], []
    if chars is None:
        chars = {t: c for t in set(tokens) if (c := lone(t))}
    if chars:
        for t in [*tokens, ""]:
            c = chars.get(t)
            if run and (c is None or t[0] != c):
                if len(run) > 2:
                    alone.append(" ".join(run))
                run = []
            if c is None:
                continue
            run.append(c)
            if t[-1] != c:
                if len(run) > 2:
                    alone.append(" ".join(run))
                run = []
    return alone


#: Characters that can stand for each other are one here: the letters that a look-alike leaves open, and look-alikes with their letters.
_MERGED = str.maketrans({"l": "i", "g": "b", **{c: ("i" if "i" in x else "b" if "b" in x else x[0].replace("l", "i").replace("g", "b")) for c, x in LOOKS.items()}})
_RUN = re.compile(r"(.)\1+")
_OTHER = re.compile(r"[\W_]+")
_BARE = re.compile(r"[\W_@$!|+(<€£¢¡]+")


def skeletons(core: str) -> set[str]:
    """What is left of a token where disguises make no difference: symbols that look like letters as such, and as nothing."""
    return {_RUN.sub(r"\1", _OTHER.sub("", core.translate(_MERGED))), _RUN.sub(r"\1", _BARE.sub("", core).translate(_MERGED))}


class Reach:
    """Tells the tokens that no path of a lattice leads from to a word of the lexicon, so that these need not be decoded.

    A letter stands for itself, alone or twice; between the letters of a word there can be what isn't a letter, and look-alikes in their place.
    """

    def __init__(self, words: Iterable[str]) -> None:
        words = set(words)
        self.plain = {_RUN.sub(r"\1", w) for w in words}
        like: dict[str, str] = {}
        for c in {*"lg", *LOOKS}:
            like[c.translate(_MERGED)] = like.get(c.translate(_MERGED), "") + c
        one = lambda x: "[" + re.escape(x + like.get(x, "")) + "]"
        shapes = sorted({_RUN.sub(r"\1", w.translate(_MERGED)) for w in words} - {""})
        self.shape = re.compile("|".join("".join(f"{one(x)}(?:{one(x)}|[\\W\\d_])*" for x in s) for s in shapes) or r"(?!)")

    def may(self, core: str) -> bool:
        if core.isalpha():
            return _RUN.sub(r"\1", core) in self.plain
        # What is no letter to ``isalpha`` but to the pattern is left to the decoder.
        return self.shape.search(core) is not None or not "".join(LETTERS.findall(core)).isalpha()


class Pieces:
    """Finds tokens that follow each other and make a word of the lexicon together.

    counts: of the words of the lexicon and the parts of these, as tokens of the corpus; total: of all tokens.
    """

    def __init__(self, words: Iterable[str], counts: dict[str, int], total: int) -> None:
        self.whole = {x for w in words for x in skeletons(w)} - {""}
        self.begins = {x[:k] for x in self.whole for k in range(1, len(x))}
        self.starts = self.begins | self.whole
        self.heads: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.counts, self.total = counts, total
        self.known = Recent(KNOWN_PIECES)

    @staticmethod
    def parts(words: Iterable[str]) -> set[str]:
        """The words and all that they can be cut into."""
        return {w[a:z] for w in words for a in range(len(w)) for z in range(a + 1, len(w) + 1)}

    def likely(self, word: str, run: list[str]) -> bool:
        """Whether it is likelier that the word was cut than that its pieces stand there as words."""
        log = lambda t: math.log(self.counts.get(t, 0) + 0.5)
        return log(word) - sum(map(log, run)) + (len(run) - 1) * (math.log(self.total + 1) - CUT) > 0

    def token(self, t: str) -> tuple[str, set[str], bool, bool]:
        """Its core, the skeletons of that, whether it may go on a word, and whether the next token may go on with it."""
        got = self.known.get(t)
        if got is None:
            core = _core(t)
            got = core, skeletons(core) - {""}, t.startswith(core), t.endswith(core)
            self.known.put(t, got)
        return got

    def head(self, letters: str) -> bool:
        """Whether a word of the lexicon begins as these letters do, or is them. (The skeleton of a beginning begins the skeleton.)"""
        four = letters[:4]
        may = self.heads.get(four)
        if may is None:  # most go by their first four letters
            if len(self.heads) >= KNOWN_PIECES:
                self.heads.clear()
            may = self.heads[four] = _RUN.sub(r"\1", four.translate(_MERGED)) in self.starts
        return may and _RUN.sub(r"\1", letters.translate(_MERGED)) in self.starts

    def begin(self, t: str) -> bool:
        """Whether a token may be the first piece."""
        core, bare, _, on = self.token(t)
        return bool(core) and on and not bare.isdisjoint(self.begins)

    def follows(self, t: str, after: str) -> bool:
        """Whether a token may go on what t begins, by its first three characters: most can't."""
        three = after[:3]
        may = self.pairs.get((t, three))
        if may is None:
            y = three.translate(_MERGED)
            may = not three.isalpha() or any(_RUN.sub(r"\1", x + y) in self.starts for x in self.token(t)[1])
            if len(t) <= LONGEST_KNOWN:
                if len(self.pairs) >= KNOWN_PIECES:
                    self.pairs.clear()
                self.pairs[t, three] = may
        return may

    def spans(self, tokens: list[str], first: set[str]) -> set[str]:
        """The runs of two tokens or more that may be a word. first: the tokens that can begin one."""
        out = set()
        for i in [i for i, t in enumerate(tokens[:-1]) if t in first]:
            t = tokens[i]
            if not self.follows(t, tokens[i + 1]):
                continue
            core, now, _, on = self.token(t)
            run = [core]
            for j in range(i + 1, len(tokens)):
                t = tokens[j]
                core, bare, joins, more = self.token(t)
                if not on or not joins:
                    break
                if bare:  # symbols alone can stand for nothing
                    now = {_RUN.sub(r"\1", x + y) for x in now for y in bare}
                run.append(core)
                if bare and not now.isdisjoint(self.whole):
                    out.add(" ".join(run))
                now &= self.begins
                on = more
                if not now:
                    break
        return out


def readings(token: str, decoder: Decoder, reach: Reach | None = None) -> tuple[str, ...]:
    """The words of a token as it stands, and those of its restored form where that is another. reach: of the only words that matter in it."""
    core = token.strip(_EDGE)
    plain = core.rstrip(_ENDS)
    if LETTERS.fullmatch(plain) and not _DOUBLE.search(plain):
        words = LETTERS.findall(plain)
        if plain == core:
            return tuple(words)
    else:
        words = LETTERS.findall(token)
    if not _HAS_LETTER.search(core) or reach is not None and not reach.may(core):
        return tuple(words)
    found = {*words, *LETTERS.findall(decoder.restore(core))}
    if _LOOK_SYMBOL.search(core):
        found.update(LETTERS.findall(decoder.restore(core, strict=True)))
    return tuple(found)


# The lexicon


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, labelled: int = LABELLED, label_id: str = "doc_id", label_col: str = "toxic") -> tuple[dict[str, float], float]:
    """The words with their weights, and the threshold, from a sample of labelled documents by hash of their id."""
    known = labels.select(quoted(label_id).alias("doc_id"), quoted(label_col).alias("toxic"))
    known = known.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("x"), (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("half"))
    texts = docs.select(quoted(id_col).alias("i"), quoted(text_col).alias("t")).filter("t is not null")
    # At most ``labelled`` rows of three numbers are broadcast, whatever the size of the tables.
    sample = written(texts.join(F.broadcast(known), "i"), "labelled")
    words = sample.select("i", "x", "half", F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}]+"))).alias("w")).filter("w <> ''")
    sizes = {(r["x"], r["half"]): r["n"] for r in sample.groupBy("x", "half").agg(F.count("*").alias("n")).collect()}
    n = {x: sizes.get((x, True), 0) + sizes.get((x, False), 0) for x in (0, 1)}
    if not n[0] or not n[1]:
        return {}, math.inf
    count = lambda x, half: F.count_if((F.col("x") == x) & (F.col("half") == half)).alias(f"n{x}{int(half)}")
    k1, k0 = F.count_if(F.col("x") == 1), F.count_if(F.col("x") == 0)
    odds = F.log((k1 + 0.5) / (n[1] + 1) / ((k0 + 0.5) / (n[0] + 1)))
    counted = words.groupBy("w").agg(count(0, True), count(0, False), count(1, True), count(1, False), k1.alias("k1"), odds.alias("odds"))
    found = counted.filter((F.col("k1") >= SUPPORT) & (F.col("odds") >= LEAST_ODDS)).collect()
    weights = {r["w"]: r["odds"] for r in found}
    if not weights:
        return {}, math.inf
    # Each half is scored with the weights of the other half.
    halves = {}
    for half in (0, 1):
        m = {x: sizes.get((x, bool(half)), 0) for x in (0, 1)}
        value = {r["w"]: math.log((r[f"n1{half}"] + 0.5) / (m[1] + 1) / ((r[f"n0{half}"] + 0.5) / (m[0] + 1))) for r in found}
        halves[not half] = {w: v for w, v in value.items() if v >= LEAST_ODDS}
    names = words.sparkSession.createDataFrame([(w,) for w in weights], "w string")
    hits = words.join(F.broadcast(names), "w").groupBy("i", "x", "half").agg(F.collect_list("w").alias("ws")).collect()  # of the sample only
    scores = [(r["x"], sum(halves[r["half"]].get(w, 0.0) for w in r["ws"])) for r in hits]

    def gain(t: float) -> float:
        return sum(x for x, s in scores if s >= t) / n[1] - FALSE_ALARM * sum(1 - x for x, s in scores if s >= t) / n[0]

    return weights, max(THRESHOLDS, key=lambda t: (round(gain(t), 9), -t))


# Scoring


class Scorer:
    """Finds the words of the lexicon in texts, behind disguises too."""

    def __init__(self, decoder: Decoder, weights: dict[str, float], pieces: Pieces, reach: Reach) -> None:
        self.decoder, self.weights, self.pieces, self.reach = decoder, weights, pieces, reach
        self.known, self.dull = Recent(KNOWN), Dull(KNOWN)

    def matters(self, t: str) -> bool:
        """Whether a token may be of use. It isn't where it is letters, but for what is around them, and no word of the lexicon begins as they do."""
        core = t.strip(_EDGE)
        letters = core.rstrip(_ENDS)
        if len(letters) < 2 or not letters.isalpha():
            return True
        if len(core) > len(letters) + 1 and core[len(letters) :].strip(core[-1]):
            return True  # symbols that differ can be a word behind a gap
        return self.pieces.head(letters)

    def token(self, t: str) -> tuple[tuple[str, ...], bool, str]:
        """Its words of the lexicon, whether it may be the first piece of one, and ``lone``."""
        got = self.known.get(t)
        if got is None:
            got = NOTHING
            if self.matters(t):
                got = tuple(w for w in readings(t, self.decoder, self.reach) if w in self.weights), self.pieces.begin(t), lone(t)
            if got == NOTHING:
                self.dull.add(t)
            else:
                self.known.put(t, got)
        return got

    def words(self, text: str) -> set[str]:
        words: set[str] = set()
        order = text.lower().split()
        begin, chars = set(), {}
        for t in self.dull.others(set(order)):
            found, first, c = self.token(t)
            words.update(found)
            if first:
                begin.add(t)
            if c:
                chars[t] = c
        at = [i for i, t in enumerate(order) if t in chars] if chars else []
        for t in runs_alone(order, chars) if any(c - a == 2 for a, c in zip(at, at[2:])) else ():
            words.update(w for w in LETTERS.findall(self.decoder.restore(t)) if w in self.weights)
        for t in self.pieces.spans(order, begin) if begin else ():
            run, whole = t.split(" "), t.replace(" ", "")
            reads = {*LETTERS.findall(self.decoder.restore(whole)), *(LETTERS.findall(self.decoder.restore(whole, strict=True)) if _LOOK_SYMBOL.search(t) else ())}
            words.update(w for w in reads if w in self.weights and self.pieces.likely(w, run))
        return words


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, labelled: int, toxic: str, score: str, found: str, **label_columns: str) -> DataFrame:
    spark = docs.sparkSession
    weights, threshold = fit(docs, labels, id_col, text_col, labelled, **label_columns)
    trigrams, counts, total = corpus_counts(docs, text_col, Pieces.parts(weights))
    model = spark.sparkContext.broadcast((Decoder(log_odds_table(trigrams)), weights, threshold, Pieces(weights, counts, total), Reach(weights)))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, weights, threshold, pieces, reach = model.value
        scorer = Scorer(decoder, weights, pieces, reach)
        for b in batches:
            for begins, part in slices(b.column(place), PART_BYTES):
                flags, scores, lists = [], [], []
                for text in part.to_pylist():
                    words = scorer.words(text) if text and weights else set()
                    s = sum(weights[w] for w in sorted(words))
                    scores.append(round(s, 6))
                    flags.append(bool(words) and s >= threshold)
                    lists.append(sorted(words))
                made = [pa.array(flags, pa.bool_()), pa.array(scores, pa.float64()), pa.array(lists, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.slice(begins, len(part)).columns, *made], [*b.schema.names, toxic, score, found])

    made = [StructField(toxic, BooleanType()), StructField(score, DoubleType()), StructField(found, ArrayType(StringType()))]
    return map_rows(docs, run, made)


def scan(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, **label_columns: str) -> DataFrame:
    """The toxic documents: id, ``toxic`` (true), ``score`` and the restored ``words`` that make it. label_columns: label_id and label_col, where they have other names."""
    only = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    return _scored(only, labels, "doc_id", "text", labelled, "toxic", "score", "words", **label_columns).filter("toxic").select("doc_id", "toxic", "score", "words")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, **label_columns: str) -> DataFrame:
    """``docs`` without the toxic documents. label_columns: see ``scan``."""
    toxic, score, words = free(docs, "toxic", "score", "words")
    return _scored(docs, labels, id_col, text_col, labelled, toxic, score, words, **label_columns).filter(~quoted(toxic)).select(*[quoted(c) for c in docs.columns])
