"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser reads expressions.

Words are those of :mod:`framestride.llm.text`. A phrase is found where its words stand consecutively, wherever the line
breaks or punctuation between them. After an identifier tag the rest of the line is parsed as a licence expression:
WITH binds tightest, then AND, then OR; every identifier becomes a label, and the expression is permissive if that
follows from its identifiers (both sides of AND, one side of OR; WITH keeps the licence's own value). An identifier is
a known licence, one of the author's own (LicenseRef-...) or what follows WITH; other words end the expression.

Score: 1 for an identifier tag with a valid expression, 0.9 for a base phrase, 0.7 for another notice, 0.3 for a tag
whose expression cannot be read, else 0.

Defined results: null and empty texts have no words, no label, score 0. Repeated rows are each scanned. Null doc_ids are
kept. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "mozilla public license 2 0": "mpl-2",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc0 1 0 universal": "cc0-1.0",
    "all rights reserved": "all-rights-reserved",
}
#: Words of an identifier tag, and licences that count as permissive.
TAG = "spdx license identifier"
PERMISSIVE = {
    "mit", "mit-0", "apache-2.0", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "0bsd", "isc", "zlib",
    "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-3.0", "cc-by", "bsl-1.0", "python-2.0", "postgresql", "wtfpl",
}

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAGGED = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff\n]+license[^0-9a-z\x80-\U0010ffff\n]+identifier[ \t]*:?[ \t]*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Forms of licence identifiers beside the permissive ones.
_IDENTIFIER = re.compile(
    r"(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|[al]?gpl-[123](?:\.[01])?(?:-only|-or-later)?|gfdl-1\.[123](?:-only|-or-later)?"
    r"|cc-by(?:-nc)?(?:-sa|-nd)?-[1-4]\.[05]|(?:mpl|epl|eupl|cddl|osl|afl|apsl|lppl|ofl|ecl|artistic|apache|cpl|zpl|bsl|php|psf|python)-[0-9](?:\.[0-9])*[a-z]?"
    r"|bsd-[1-4]-clause(?:-[a-z-]+)?|mit-[a-z0-9-]+|(?:ms-pl|ms-rl|ncsa|x11|curl|ruby|vim|openssl|sleepycat|beerware|libpng|icu|ijg|w3c|unicode-dfs-2016|unicode-3\.0|blueoak-1\.0\.0|elastic-2\.0|busl-1\.1|sspl-1\.0|hpnd|intel|naist-2003|nist-pd|odbl-1\.0|pddl-1\.0|upl-1\.0|watcom-1\.0|none|noassertion)"
)
_BINDING = {"or": 1, "and": 2, "with": 3}

ROWS = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions string, permissive boolean"
)


@cache
def automaton():
    """Phrases of whole words: each is surrounded by spaces, as is each word of the text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def parse(text: str) -> tuple[list[str], bool] | None:
    """Identifiers (lower case) of the longest valid expression at the start of a text, and whether it is permissive.

    Two stacks: operands as (identifiers, permissive), operators with their binding. None if there is no expression.
    """
    tokens = [(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    operands: list[tuple[list[str], bool]] = []
    operators: list[str] = []
    expect_name, depth, end = True, 0, 0
    best: tuple[list[str], bool] | None = None

    def apply() -> None:
        operator = operators.pop()
        right, left = operands.pop(), operands.pop()
        if operator == "with":
            operands.append((left[0] + right[0], left[1]))
        else:
            operands.append((left[0] + right[0], left[1] and right[1] if operator == "and" else left[1] or right[1]))

    for token, start, stop in tokens:
        if text[end:start].strip():
            break  # something else than white space stands between
        end = stop
        if expect_name:
            if token == "(":
                operators.append(token)
                depth += 1
            elif token == ")" or token in _BINDING:
                break
            else:
                name = token.rstrip(".")
                plain = name.removesuffix("+")
                excepted = bool(operators) and operators[-1] == "with"
                if not (excepted or plain in PERMISSIVE or _IDENTIFIER.fullmatch(plain)):
                    break
                operands.append(([name], plain in PERMISSIVE))
                expect_name = False
        elif token == ")":
            if not depth:
                break
            while operators[-1] != "(":
                apply()
            operators.pop()
            depth -= 1
        elif token in _BINDING:
            while operators and operators[-1] != "(" and _BINDING[operators[-1]] >= _BINDING[token]:
                apply()
            operators.append(token)
            expect_name = True
        else:
            break
        if not depth and not expect_name:
            best = _folded(operands, operators)
    return best


def _folded(operands: list[tuple[list[str], bool]], operators: list[str]) -> tuple[list[str], bool]:
    """The value of the stacks, left as they are."""
    values, waiting = list(operands), list(operators)
    while waiting:
        operator, right, left = waiting.pop(), values.pop(), values.pop()
        fine = left[1] if operator == "with" else left[1] and right[1] if operator == "and" else left[1] or right[1]
        values.append((left[0] + right[0], fine))
    return values[0]


def scan_text(text: str | None) -> tuple:
    """One row of the scan but for the doc_id."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base, labels, firsts, tagged, noticed = set(), set(), [], False, False
    for end, (kind, label, size) in automaton().iter(joined):
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        if kind == "base":
            base.add(label)
            firsts.append(end + 1 - size)
        else:
            noticed = True
    read = []
    if tagged:
        read = [p for m in _TAGGED.finditer(text) if (p := parse(m.group(1))) is not None]
        for names, _ in read:
            labels.update(names)
    places = [joined.count(" ", 0, p) for p in (min(firsts), max(firsts))] if firsts else [None, None]
    score = 1.0 if read else 0.9 if base else 0.7 if noticed else 0.3 if tagged else 0.0
    return (
        len(words), len(firsts), *places, ",".join(sorted(base)), ",".join(sorted(labels)), score,
        ",".join(sorted({"/".join(names) for names, _ in read})) or None, all(p for _, p in read) if read else None,
    )


def scan(docs: DataFrame) -> DataFrame:
    """Licence labels and places of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in ROWS.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
        kinds = [types[c.split(" ")[1]] for c in ROWS.split(", ")]
        for batch in batches:
            rows = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds[1:]))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)
