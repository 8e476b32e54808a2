"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

Base kinds (email, ip, card, phone) are kept whatever their score. Added kinds (iban, ssn, secret) are kept from ``limit``
on: a number like an SSN only beside a word that names it, and a secret unless words such as "test" stand beside it.
Offsets are in code points, ends exclusive. Null texts count as empty; empty texts and tables have no spans. Every row is
judged by itself, so ties and repeated rows are alike, and no text is cut. ``pii_spans`` returns the key and spans only,
``redacted`` all columns, whatever their names. All searches take time linear in the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import ddl_of, map_rows, quoted, table

KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "secret"]
BASE = {"email", "ip", "card", "phone"}
LIMIT, REACH = 0.5, 40
#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "key", "credential", "auth"),
}
AGAINST = ("sample", "test", "dummy", "version")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Characters of an IBAN by country, as registered.
LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 "
    "MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 "
    "TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}))")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: A name of a credential, then its value.
_SECRET = re.compile(r"""(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)["']?\x20?[:=]\x20?["']?([A-Za-z0-9+/_-]{16,})""")
#: Bits a character that a secret has at least; words have fewer.
SECRET_BITS = 3.0
_WORD = re.compile(r"[a-z]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod_97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def bits(value: str) -> float:
    """Entropy of a string's characters."""
    counts = Counter(value).values()
    return -sum(n / len(value) * math.log2(n / len(value)) for n in counts)


def ibans(text: str):
    """Proposals confirmed by mod-97 on the country's own length, or else on the longest that ends at a word boundary."""
    done = 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        ends, n = [], 4
        for k in range(m.end(), m.end(1)):
            if text[k] != " ":
                n += 1
                if n >= 15 and (k + 1 == len(text) or text[k + 1] not in _ALNUM):
                    ends.append((n == LENGTHS.get(m[0][:2]), n, k + 1))
        for _, _, end in sorted(ends, reverse=True):
            if mod_97(text[m.start() : end]):
                yield m.start(), end
                done = end
                break


def emails(text: str):
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ backwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def propose(text: str):
    """(kind, start, end) of confirmed proposals."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    for a, b in ibans(text):
        yield "iban", a, b
    if "=" in text or ":" in text:
        for m in _SECRET.finditer(text):
            if _DIGIT.search(m[1]) and bits(m[1]) >= SECRET_BITS:
                yield "secret", m.start(1), m.end(1)
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()


#: Score of a proposal before its context; a checksum confirms cards and IBANs.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.4}


def score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall(text[max(0, start - REACH) : start].lower() + " " + text[end : end + REACH].lower()))
    up, down = any(w in near for w in CONTEXT[kind]), any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.3 * up - 0.2 * down)), 9)  # sums of tenths: 0.4 + 0.3 - 0.2 is the limit


def find(text: str, limit: float = LIMIT) -> list[Span]:
    """All spans, by start, then kind."""
    spans = [Span(k, a, b, score(text, k, a, b)) for k, a, b in propose(text)]
    return sorted((s for s in spans if s.kind in BASE or s.score >= limit), key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str, limit: float = LIMIT) -> str:
    """The text with each span, or overlapping spans together, replaced by its (first) kind in brackets."""
    out, done, kind = [], 0, None
    for s in find(text, limit):
        if kind is not None and s.start < done:
            done = max(done, s.end)
            continue
        out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done, kind = s.end, s.kind
    return "".join([*out, text[done:]]) if out else text


def pii_spans(docs: DataFrame, text: str = "text", key: str = "doc_id", limit: float = LIMIT) -> DataFrame:
    """key and spans (kind, start, end, score) of each document."""

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            found = [find(t or "", limit) for t in batch.column("_text").to_pylist()]
            return {"_key": batch.column("_key"), "spans": [[s._asdict() for s in spans] for spans in found]}

        return run

    kind = docs.schema[key].dataType.simpleString()
    ddl = f"_key {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>"
    return map_rows(docs.select(F.col(quoted(key)).alias("_key"), F.col(quoted(text)).alias("_text")), make, ddl, sized="_text").withColumnRenamed("_key", key)


def redacted(docs: DataFrame, text: str = "text", limit: float = LIMIT) -> DataFrame:
    """The documents with personal data replaced in their texts (and n_chars, if there, counted anew)."""
    name = text

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = [None if t is None else redact(t, limit) for t in batch.column(name).to_pylist()]
            out[name] = pa.array(texts, pa.string())
            return out

        return run

    out = map_rows(docs, make, ddl_of(docs), sized=text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(quoted(text)).isNull(), F.col("n_chars")).otherwise(F.length(F.col(quoted(text)))).cast(docs.schema["n_chars"].dataType))
    return out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(sorted(BASE)))
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 1)), ",").alias("scores"))
