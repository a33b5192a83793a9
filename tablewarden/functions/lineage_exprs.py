"""Reading SELECT items as text: their outermost operation, the columns they mention, their default name.

Everything is a column expression over the item text. A *mask* of equal length hides what is not at
the top level: text in quotes becomes ``·``, a bracketed group becomes ``‹¤¤›``. So one anchored
pattern on the mask decides the outermost operation, and positions in it are positions in the item.
Brackets and CASE blocks are matched by one scan of a text each, in Arrow batches; patterns repeat groups a bounded number
of times only, so an item may be of any length.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewarden.functions.fixed_values import AGGREGATE_FUNCTIONS

# Calls written with their own grammar, which lend no name to an unnamed item.
UNNAMED_CALLS = ["CAST", "TRY_CAST", "SAFE_CAST", "TRIM", "SUBSTRING", "EXTRACT", "POSITION", "OVERLAY", "CEIL", "FLOOR"]

# Words that are not columns.
STOP_WORDS = (
    "ALL AND ANY AS ASC BETWEEN BOTH BY CASE CURRENT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP DATE DESC DISTINCT ELSE "
    "END ESCAPE EXCLUDE FALSE FILTER FIRST FOLLOWING FOR FROM GROUP GROUPS ILIKE IN INTERVAL IS LAST LEADING LIKE NOT NULL "
    "NULLS OR ORDER OVER PARTITION PLACING PRECEDING RANGE ROW ROWS SOME THEN TIMESTAMP TRAILING TRUE UNBOUNDED WHEN WHERE "
    "WITHIN"
).split()

_ID = r'(?:[A-Za-z_][\w$]*|"[^"]+")'
_PATH = rf"{_ID}(?:\.{_ID}){{0,8}}"
_CALL = rf"{_PATH}\s*‹¤*›"
_TAIL = r"(?:\s*(?:FILTER|WITHIN\s+GROUP)\s*‹¤*›){0,4}"


def hide_quotes(text: Column) -> Column:
    """Text inside single quotes replaced character by character."""
    hidden = F.transform(F.split(text, "'", -1), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit("·"), F.length(p))).otherwise(p))
    return F.array_join(hidden, "'")


def _pairs(text: str) -> dict[int, int]:
    """Places of opening brackets with those of their closing ones."""
    found, waiting = {}, []
    for at in re.finditer(r"[()]", text):
        if at.group() == "(":
            waiting.append(at.start())
        elif waiting:
            found[waiting.pop()] = at.start()
    return found


def _masked(text: str) -> str:
    pairs, out, at = _pairs(text), [], 0
    for start in sorted(pairs):
        if start >= at:
            end = pairs[start]
            out += [text[at:start], "‹", "¤" * (end - start - 1), "›"]
            at = end + 1
    return "".join([*out, text[at:]])


def _bare(text: str, hidden: str) -> str:
    """``text`` without the brackets around all of it; ``hidden`` is the same with its quotes hidden."""
    pairs, start, end = _pairs(hidden), 0, len(text)
    while True:
        while start < end and text[start] == " ":
            start += 1
        while start < end and text[end - 1] == " ":
            end -= 1
        if start < end and pairs.get(start) == end - 1:
            start, end = start + 1, end - 1
        else:
            return text[start:end]


def _without_cases(masked: str) -> str:
    out, at, waiting = [], 0, []
    for word in re.finditer(r"\b(?:CASE|END)\b", masked, re.IGNORECASE):
        if word.group().upper() == "CASE":
            waiting.append(word.start())
        elif waiting:
            start = waiting.pop()
            if not waiting:
                out += [masked[at:start], "©"]
                at = word.end()
    return "".join([*out, masked[at:]])


def _each(make, *columns: Column) -> Column:
    @F.pandas_udf("string")
    def run(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else make(a, b) for a, b in zip(first, second, strict=True)], dtype=object)

    return run(columns[0], columns[-1])


def mask(text: Column) -> Column:
    """Equal-length mask of a text: quotes and outermost bracketed groups hidden."""
    return _each(lambda a, _: _masked(a), hide_quotes(text))


def unwrap(text: Column) -> Column:
    """The item without brackets around all of it."""
    return _each(_bare, text, hide_quotes(text))


def collapse_cases(masked: Column) -> Column:
    """Mask with every outermost CASE … END block as one ``©``."""
    return _each(lambda a, _: _without_cases(a), masked)


def operation(top: Column) -> Column:
    """Outermost operation of an unwrapped, masked, case-collapsed item."""
    call = F.upper(F.regexp_extract(top, rf"(?i)^({_PATH})\s*‹¤*›{_TAIL}$", 1))
    cast_chain = rf"(?i)^(?:{_PATH}|{_CALL}|‹¤*›|'·*'|[\d.]+)(?:\s*::\s*\w+(?:\s*‹¤*›)?){{1,16}}$"
    return (
        F.when(top.rlike(rf"^{_PATH}$"), "direct")
        .when(top.rlike(r"^©$"), "case")
        .when(call.isin("CAST", "TRY_CAST", "SAFE_CAST") | top.rlike(cast_chain), "cast")
        .when(top.rlike(rf"(?i)^{_CALL}{_TAIL}\s*OVER\s*(?:‹¤*›|{_ID})$"), "window")
        .when(call.isin(AGGREGATE_FUNCTIONS), "aggregate")
        .otherwise("expression")
    )


def expression_text(item: Column, masked: Column, top: Column, kind: Column) -> Column:
    """The unwrapped item; of BETWEEN and IN only the tested operand; nothing for a plain column."""
    joins = F.size(F.regexp_extract_all(top, F.lit(r"(?i)\b(AND|OR)\b"), F.lit(1)))
    positive = ~top.rlike(r"(?i)^NOT\b")
    is_in = positive & (joins == 0) & top.rlike(r"(?is)^.*\sIN\s*‹¤*›$")
    is_between = positive & (joins == 1) & top.rlike(r"(?is)^.*\sBETWEEN\s.*\sAND\s.*$")
    before_in = F.length(F.regexp_extract(masked, r"(?is)^(.*\S)\s+IN\s*‹¤*›$", 1))
    before_between = F.length(F.regexp_extract(masked, r"(?is)^(.*?\S)\s+BETWEEN\s", 1))
    operand = lambda n: F.regexp_replace(F.substring(item, F.lit(1), n), r"(?i)\s+NOT$", "")
    return (
        F.when(kind == "direct", F.lit(None).cast("string"))
        .when(is_in, operand(before_in))
        .when(is_between, operand(before_between))
        .otherwise(item)
    )


def has_subquery(text: Column) -> Column:
    return hide_quotes(text).rlike(r"(?i)\bSELECT\b")


def column_references(item: Column) -> Column:
    """All columns an item mentions, in order and with repeats, possibly qualified."""
    s = hide_quotes(item)
    for pattern, kept in [
        (r"(?is)\bINTERVAL\s*'[^']*'\s*[A-Za-z]+", " "),
        (r"(?is)'[^']*'", " "),
        (r"(?is)\bEXTRACT\s*\(\s*\w+\s+FROM\b", "EXTRACT( "),
        (r"(?is)\bAS\s+\w+(?:\s+\w+){0,4}(?:\s*\([\d\s,]*\))?\s*\)", ")"),
        (r"(?is)::\s*\w+(?:\s*\([\d\s,]*\))?", " "),
        (r"(?is)\bOVER\s+[A-Za-z_]\w*", " "),
    ]:
        s = F.regexp_replace(s, pattern, kept)
    found = F.regexp_extract_all(s, F.lit(rf'(?<![\w$."])({_PATH})(?!\s*\(|[\w$"]|\s*\.)'), F.lit(1))
    return F.filter(found, lambda w: ~F.upper(w).isin(STOP_WORDS))


def default_name(masked: Column) -> Column:
    """Name of a masked item without alias: its column, its function, else ``?column?``."""
    name = F.regexp_extract(masked, rf"(?i)^({_PATH})\s*‹¤*›{_TAIL}(?:\s*OVER\s*(?:‹¤*›|{_ID}))?$", 1)
    column = F.regexp_extract(masked, rf"^(?:{_ID}\.){{0,8}}({_ID})$", 1)
    return (
        F.when((column != "") & ~F.upper(column).isin(STOP_WORDS), F.regexp_replace(column, '"', ""))
        .when((name != "") & ~F.upper(name).isin(UNNAMED_CALLS), name)
        .otherwise("?column?")
    )
