"""Licence statements: an Aho-Corasick automaton finds phrases and tags, a shunting-yard parser reads expressions.

The automaton runs over the text's words joined by single spaces, so phrases match wherever their words stand
consecutively, across punctuation, case and lines. After an identifier tag, the rest of its line is parsed as a licence
expression with AND, OR, WITH and parentheses; its identifiers give labels, and the score falls where it does not parse.

Null texts count as empty: no words, no labels, score 0. Rows are judged each by itself, whole texts of any length only;
repeated rows and ties are alike; empty tables give no rows. The key and columns of ours are returned, so names of other
columns do no harm.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import alnum_words, map_rows, quoted, table

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notice phrases of the method itself: words, label, weight of the evidence.
NOTICES = [
    ("lesser general public license", "lgpl", 0.8),
    ("affero general public license", "agpl", 0.8),
    ("general public license version 2", "gpl-2.0", 0.8),
    ("general public license version 3", "gpl-3.0", 0.8),
    ("apache license version 2 0", "apache-2.0", 0.8),
    ("mozilla public license", "mpl", 0.7),
    ("bsd license", "bsd", 0.6),
    ("isc license", "isc", 0.6),
    ("eclipse public license", "epl", 0.7),
    ("released under the", "notice", 0.2),
    ("licensed under the", "notice", 0.2),
    ("this work is licensed under", "notice", 0.2),
    ("permission is hereby granted free of charge", "mit", 0.9),
    ("redistribution and use in source and binary forms", "bsd", 0.9),
    ("creative commons", "cc", 0.5),
    ("cc by 4 0", "cc-by-4.0", 0.7),
    ("cc by sa 4 0", "cc-by-sa-4.0", 0.7),
    ("cc by nc 4 0", "cc-by-nc-4.0", 0.7),
    ("cc by nd 4 0", "cc-by-nd-4.0", 0.7),
    ("cc0 1 0", "cc0-1.0", 0.7),
]
BASE_WEIGHT, TAG_WEIGHT, BAD_TAG_WEIGHT = 0.6, 0.9, 0.3
TAG = "spdx license identifier"
#: The tag's words with what the automaton takes for gaps between them, then the rest of the line.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_TAG_TEXT = re.compile(rf"spdx{_GAP}+license{_GAP}+identifier(?=$|{_GAP})[^A-Za-z0-9(\n\x80-\U0010FFFF]*+([^\n]*)", re.IGNORECASE | re.ASCII)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")
_IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*")
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


def _read(tokens: list[str], prose: bool = False) -> tuple[list[str] | None, str]:
    """Shunting yard in one pass: the postfix form of the longest start that is an expression, and what ended the pass.

    Behind an operand with no parenthesis open, what is read so far is an expression; the operators that wait go behind it.
    In prose, full stops after its last identifier are not part of it.
    """
    out: list[str] = []
    operators: list[str] = []
    want_operand, depth = True, 0
    best: tuple[int, list[str], str] | None = None  # the output's length, the waiting operators, the last token
    fault = ""
    for token in tokens:
        upper = token.upper()
        if token == "(":
            if not want_operand:
                fault = "operator expected"
                break
            operators.append(token)
            depth += 1
        elif token == ")":
            if want_operand:
                fault = "identifier expected"
                break
            if not depth:
                fault = "no opening parenthesis"
                break
            while operators[-1] != "(":
                out.append(operators.pop())
            operators.pop()
            depth -= 1
        elif upper in _PRECEDENCE:
            if want_operand:
                fault = "identifier expected"
                break
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[upper]:
                out.append(operators.pop())
            operators.append(upper)
            want_operand = True
        elif _IDENTIFIER.fullmatch(token):
            if not want_operand:
                fault = "operator expected"
                break
            out.append(token)
            want_operand = False
        else:
            fault = f"unknown {token!r}"
            break
        if not want_operand and not depth and not (prose and token.rstrip(".").upper() in _PRECEDENCE):
            best = len(out), operators[::-1], token
    if not fault and (want_operand or depth):
        fault = "identifier expected" if want_operand else "no closing parenthesis"
    if best is None:
        return None, fault
    n, waiting, token = best
    postfix = out[:n]
    if prose and token != ")":
        postfix[-1] = token.rstrip(".")
    return postfix + waiting, fault


def to_postfix(expression: str) -> list[str]:
    """Identifiers and operators in postfix order; ValueError where it is no licence expression."""
    postfix, fault = _read(_TOKEN.findall(expression))
    if fault:
        raise ValueError(fault)
    return postfix


def evaluate(postfix: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    """All licences of the expression, and those that hold whatever is chosen. Exceptions stay with their licence.

    AND needs what either side needs, OR what both do; so an expression of any length takes one pass.
    """
    stack: list[tuple[frozenset[str], frozenset[str]]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            one = frozenset([token.lower()])
            stack.append((one, one))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "OR":
            stack.append((a[0] | b[0], a[1] & b[1]))
        elif token == "AND":
            stack.append((a[0] | b[0], a[1] | b[1]))
        else:
            (exception,) = list(b[0])[:1]
            stack.append((frozenset(f"{x} with {exception}" for x in a[0]), frozenset(f"{x} with {exception}" for x in a[1])))
    return stack[0]


def _line_expression(rest: str) -> tuple[frozenset[str], frozenset[str]] | None:
    """Of the longest start of the line that is an expression, in one pass; comment ends and prose may follow it."""
    postfix, _ = _read(_TOKEN.findall(rest), prose=True)
    return None if postfix is None else evaluate(postfix)


def automaton():
    import ahocorasick

    a, found = ahocorasick.Automaton(), {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label, BASE_WEIGHT))
    for phrase, label, weight in NOTICES:
        found.setdefault(phrase, []).append(("notice", label, weight))
    found.setdefault(TAG, []).append(("tag", "", 0.0))
    for phrase, what in found.items():
        a.add_word(f" {phrase} ", (len(phrase), what))
    a.make_automaton()
    return a


def scan(text: str, machine) -> dict:
    words = alnum_words(text)
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    base, base_labels, labels, doubt, tagged, notices = [], set(), set(), 1.0, False, {}
    required: set[str] = set()
    for end, (length, what) in machine.iter(joined):
        for kind, label, weight in what:
            if kind == "base":
                base.append(end - length)
                base_labels.add(label)
            elif kind == "tag":
                tagged = True
            if kind != "tag":
                notices[label] = max(weight, notices.get(label, 0.0))
    expressions = []
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            licences = _line_expression(m[1])
            expressions.append(m[1].strip())
            doubt *= 1.0 - (BAD_TAG_WEIGHT if licences is None else TAG_WEIGHT)
            if licences is not None:
                labels |= licences[0]
                required |= licences[1]
    for w in notices.values():
        doubt *= 1.0 - w
    labels |= base_labels | {x for x in notices if x != "notice"}
    first, last = (joined.count(" ", 0, min(base)), joined.count(" ", 0, max(base))) if base else (None, None)
    return {"n_words": len(words), "n_base": len(base), "first_word": None if first is None else first - 1, "last_word": None if last is None else last - 1, "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)), "score": round(1.0 - doubt, 6), "required": ",".join(sorted(required)), "expressions": expressions}


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required string, expressions array<string>"


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the counts and places of base phrases, labels, score, and the expressions after identifier tags."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def make():
        machine = automaton()

        def run(batch: pa.RecordBatch) -> dict:
            found = [scan(t or "", machine) for t in batch.column("_text").to_pylist()]
            return {"_key": batch.column("_key")} | {n: [f[n] for f in found] for n in names}

        return run

    ddl = f"_key {docs.schema[key].dataType.simpleString()}, {RESULT}"
    return map_rows(docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text")), make, ddl, sized="_text").withColumnRenamed("_key", key)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("expressions")
