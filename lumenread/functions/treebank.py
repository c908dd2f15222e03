"""Treebank tokenisation of sentences: quotes, marks, brackets, dashes and contractions as tokens of their own."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenread.functions.dialect import Dialect

#: The public Penn Treebank rules with their extension of 2012, in order: fixed values. Later ones read what earlier ones made.
RULES = (
    ('^"', "`` "),
    ('([ (\\[{<])"', "$1 `` "),
    ("``", " `` "),
    ("\\.\\.\\.", " ... "),
    ("([;:@#$%&])", " $1 "),
    (",([^0-9])", " , $1"),
    ("([^.])([.])([])}>\"']*)[ \t]*$", "$1 $2$3 "),
    ("([?!])", " $1 "),
    ("([\\]\\[(){}<>])", " $1 "),
    ("\\(", "-LRB-"),
    ("\\)", "-RRB-"),
    ("\\[", "-LSB-"),
    ("\\]", "-RSB-"),
    ("\\{", "-LCB-"),
    ("\\}", "-RCB-"),
    ("--", " -- "),
    ("$", " "),
    ("^", " "),
    ("([^nN])'([^('|ll|re|ve|LL|RE|VE|t|T|s|S|d|m)])", "$1' $2"),
    ("([^nN])'([tT])", "$1' $2"),
    (" '([lL])([^lL])", "' $1$2"),
    (" '([rR])([^eE])", "' $1$2"),
    (" '([vV])([^eE])", "' $1$2"),
    ('"', " '' "),
    ("([^' ])'([ '])", "$1 '$2"),
    ("'([sSmMdD]) ", " '$1 "),
    ("'ll ", " 'll "),
    ("'re ", " 're "),
    ("'ve ", " 've "),
    ("n't ", " n't "),
    ("'d ", " 'd "),
    ("'m ", " 'm "),
    ("'LL ", " 'LL "),
    ("'RE ", " 'RE "),
    ("'VE ", " 'VE "),
    ("N'T ", " N'T "),
    (" ([Cc])annot ", " $1an not "),
    (" ([Dd])'ye ", " $1' ye "),
    (" ([Gg])imme ", " $1im me "),
    (" ([Gg])onna ", " $1on na "),
    (" ([Gg])otta ", " $1ot ta "),
    (" ([Ll])emme ", " $1em me "),
    (" ([Mm])ore'n ", " $1ore 'n "),
    (" '([Tt])is ", " '$1 is "),
    (" '([Tt])was ", " '$1 was "),
    (" ([Ww])anna ", " $1an na "),
    (" +", " "),
    ("^ *", ""),
)


def tokenised(text: Column) -> Column:
    """The tokens of a one-line sentence, with a blank between each two; null stays null."""
    for pattern, new in RULES:
        text = F.regexp_replace(text, pattern.replace("[])}", "[\\])}"), new)
    return F.rtrim(text)


#: Rules from one to before another, and what a text has to hold for any of them to change it: fixed values.
#: The group of apostrophes reads quotes that the rule for " makes, so it asks for that as well.
GROUPS = (
    (0, 3, "contains({0}, '\"') or contains({0}, '``')"),
    (3, 4, None),
    (4, 5, "{0} rlike '[;:@#$%&]'"),
    (5, 7, None),
    (7, 15, "{0} rlike '[?!(){{}}<>\\\\[\\\\]]'"),
    (15, 18, None),
    (18, 36, "contains({0}, '\"') or contains({0}, '''')"),
    (36, 46, "{0} rlike '(annot|''ye|imme|onna|otta|emme|ore''n|''[Tt]is|''[Tt]was|anna) '"),
    (46, 48, None),
)


def rule_sql(text: str, pattern: str, new: str) -> str:
    """One rule in Spark's SQL; what stands for itself is replaced without a pattern."""
    quoted = lambda x: x.replace("'", "''")
    if pattern in ("$", "^", "^ *"):  # at an end there is one place to replace
        return {"$": f"concat({text}, ' ')", "^": f"concat(' ', {text})", "^ *": f"ltrim({text})"}[pattern]
    if not re.search(r"(?<!\\)[.()\[\]{}+*^$|?]", pattern):
        return f"replace({text}, '{quoted(re.sub(r'\\(.)', r'\1', pattern))}', '{quoted(new)}')"
    pattern = pattern.replace("[])}", "[\\])}").replace("\\", "\\\\")
    return f"regexp_replace({text}, '{quoted(pattern)}', '{quoted(new)}')"


def tokenised_sql(d: Dialect, text: str) -> str:
    """The same as SQL. In Spark's a group of rules is passed over by texts that none of them changes."""
    if d.spark:
        for k, (first, end, holds) in enumerate(GROUPS):
            inner = name = f"t{k}" if holds else text
            for rule in RULES[first:end]:
                inner = rule_sql(inner, *rule)
            # a name for what came before, as it is read more than once
            text = f"element_at(transform(array({text}), {name} -> case when {holds.format(name)} then {inner} else {name} end), 1)" if holds else inner
        return f"rtrim({text})"
    quoted = lambda x: x.replace("'", "''")
    for pattern, new in RULES:
        new = new.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        # at an end there is one place to replace
        text = f"concat({text}, ' ')" if pattern == "$" else f"concat(' ', {text})" if pattern == "^" else f"regexp_replace({text}, '{quoted(pattern)}', '{quoted(new)}', 'g')"
    return f"rtrim({text})"
