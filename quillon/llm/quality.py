"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much goes too.

All of it is column expressions over one row at a time, so the plan is scan, project, filter: no shuffle, no Python.

Defined results: a null text is kept as it is when ``keep_null`` is set and rejected otherwise (the default: there is
nothing to keep); an empty text or one of blank lines only is rejected; blank lines are neither judged nor counted and
stay where they are; repeated rows get the same decision each; ids are not looked at, so null or repeated ids are fine;
further columns pass through untouched, whatever they are called.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import free, once, quoted, with_text

#: Lines that hold one of these (in lower case) are boilerplate.
BOILERPLATE = (
    "all rights reserved", "cookie", "privacy policy", "terms of use", "terms of service", "subscribe to", "click here",
    "enable javascript", "lorem ipsum", "back to top", "share this",
)
#: Full-width ends need no space after them.
SENTENCE_END = r"""[.!?…]["'»”)]?(\s|$)|[。！？｡]"""
NOT_SYMBOL, NOT_UPPER = r"[^\p{L}\p{N}\s]+", r"[^\p{Lu}]+"
#: A line may hold this share of symbols, and this many in any case (telephone numbers, addresses).
SYMBOL_SHARE, SYMBOL_FREE = 0.12, 3
UPPER_SHARE, UPPER_FREE = 0.5, 2
#: So many bars make a line a menu or a table row.
BARS = 3
#: The least share of different words in a line.
DISTINCT_SHARE = 0.25
#: The least share of a document's characters (without blank lines) that must be left.
LEAST_LEFT = 0.5


def good_line(line: Column, suspect: Column) -> Column:
    """Whether a line passes the punctuation, navigation, case, repetition and boilerplate rules.

    suspect: whether its document holds a boilerplate phrase at all; only then lines are searched for them.
    """
    n, words = F.length(line), F.split(line, " ")
    return (
        F.rlike(line, F.lit(SENTENCE_END))
        & (n - F.length(F.regexp_replace(line, NOT_SYMBOL, "")) <= n * SYMBOL_SHARE + SYMBOL_FREE)
        & (n - F.length(F.replace(line, F.lit("|"), F.lit(""))) < BARS)
        & (F.length(F.regexp_replace(line, NOT_UPPER, "")) <= n * UPPER_SHARE + UPPER_FREE)
        & (F.size(F.array_distinct(words)) >= F.size(words) * DISTINCT_SHARE)
        & ~(suspect & F.rlike(F.lower(line), F.lit("|".join(BOILERPLATE))))
    )


def blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\v")) == ""


def chars(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.when(blank(x), 0).otherwise(F.length(x)))


def clean(docs: DataFrame, text_col: str = "text", least_left: float = LEAST_LEFT, keep_null: bool = False) -> DataFrame:
    """The documents that are left, with cleaned texts, in the columns of ``docs``."""
    lines, low, suspect, left, was, now = free(docs, "lines", "low", "suspect", "left", "was", "now")
    text = quoted(text_col)
    judged = once(docs, **{lines: F.split(text, "\n", -1), low: F.lower(text)})
    judged = once(judged, **{suspect: F.coalesce(reduce(or_, [F.contains(quoted(low), F.lit(x)) for x in BOILERPLATE]), F.lit(False))})
    judged = once(judged, **{left: F.filter(quoted(lines), lambda x: blank(x) | good_line(x, quoted(suspect))), was: chars(quoted(lines))})
    judged = once(judged, **{now: chars(quoted(left))})
    fine = (quoted(now) > 0) & (quoted(now) >= quoted(was) * least_left)
    kept = judged.filter(F.coalesce(fine, F.lit(keep_null)))
    return with_text(kept, F.array_join(quoted(left), "\n"), text_col).select(*[quoted(c) for c in docs.columns])


def sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL, over the driver's columns."""
    line = f"""regexp_matches(l, '{SENTENCE_END.replace("'", "''")}')
   and length(l) - length(regexp_replace(l, '{NOT_SYMBOL}', '', 'g')) <= length(l) * {SYMBOL_SHARE}::DOUBLE + {SYMBOL_FREE}
   and length(l) - length(replace(l, '|', '')) < {BARS}
   and length(regexp_replace(l, '{NOT_UPPER}', '', 'g')) <= length(l) * {UPPER_SHARE}::DOUBLE + {UPPER_FREE}
   and len(list_distinct(string_split(l, ' '))) >= len(string_split(l, ' ')) * {DISTINCT_SHARE}::DOUBLE
   and not regexp_matches(lower(l), '{"|".join(BOILERPLATE)}')"""
    empty = r"regexp_full_match(l, '[ \t\r\f\v]*')"
    return f"""with a as (select *, string_split(text, chr(10)) as ls from {table} where text is not null),
b as (select *, list_filter(ls, lambda l: {empty} or ({line})) as ks from a),
c as (select *, coalesce(list_sum(list_transform(ls, lambda l: case when {empty} then 0 else length(l) end)), 0) as was,
  coalesce(list_sum(list_transform(ks, lambda l: case when {empty} then 0 else length(l) end)), 0) as now from b)
select doc_id, array_to_string(ks, chr(10)) as text, lang, source, length(array_to_string(ks, chr(10)))::BIGINT as n_chars
from c where now > 0 and now >= was * {LEAST_LEFT}::DOUBLE"""
