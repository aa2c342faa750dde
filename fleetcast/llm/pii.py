"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it is. Then transducers rewrite the text: homoglyphs become ASCII, spelled
digits become digits, and at/dot disguises become ``@`` and ``.``. Every rewritten character remembers the span
of source characters it came from, so what is found in the rewritten text is reported as a span of the source. A rewritten
find is added if rewriting took part in it and no plain find of its kind covers it; plain finds always stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile("[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """True if the last digit is right."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses: around each ``@``, the run of local characters since the last find, then a domain. Linear time."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def ip_finds(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def card_finds(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phone_finds(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def plain_spans(text: str) -> list[Span]:
    """Identifiers of the text as it is, by kind and start."""
    finders = (("email", emails, "@"), ("ip", ip_finds, "."), ("card", card_finds, ""), ("phone", phone_finds, "+"))
    return [(kind, a, b) for kind, find, needs in finders if needs in text for a, b in find(text)]


# Letters of other scripts that look like an ASCII letter, digit or sign (Unicode confusables, the common ones).
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХаеѕіјорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ‐‑‒–—−․。＠﹫",
    "ABESIJKMHOPCTXaesijopcyxdqwhABEZHIKMNOPTYXovp------..@@"))
INVISIBLE = frozenset("​‌‍⁠﻿­")
# Words for digits and for the signs of an address, in the languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS = ("at", "arobase", "arroba"), ("dot", "punkt", "point", "punto")

NON_ASCII_ODD = re.compile("[^\x00-ɏ]|­")
SPELLED = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + r")(?![^\W_])", re.I)
NUMERAL = r"(?:[0-9]+|" + SPELLED.pattern + ")"
_BY_LETTER = {w[0]: sorted((x[1:] for x in DIGIT_WORDS if x[0] == w[0]), key=len, reverse=True) for w in DIGIT_WORDS}
_FAST = "(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in _BY_LETTER.items()) + ")"
# Any run of numerals with a spelled one has such a pair of neighbours; cheap to rule out in lower case.
PAIR = re.compile(rf"{_FAST}[\x20.()-]{{1,3}}(?:[0-9]|{_FAST})|[0-9][\x20.()-]{{1,3}}{_FAST}")
# A run of at least four numerals, at least one of them spelled, apart by at most a sign and spaces.
NUMERALS = re.compile(r"(?:\+|plus\x20)?\x20?" + NUMERAL + r"(?:[\x20.()-]{1,3}" + NUMERAL + r"){3,}", re.I)
SIGN = r"(?:\x20*[\[({{<]\x20*(?:{words})\x20*[\])}}>]\x20*|\x20+(?:{words})\x20+)"
AT_SIGN = r"(?:" + SIGN.format(words="|".join((*AT_WORDS, "@"))) + r"|@)"
DOT_SIGN = r"(?:" + SIGN.format(words="|".join((*DOT_WORDS, r"\."))) + r"|\.)"
PART, HOST = r"[A-Za-z0-9_%+-]++", r"[A-Za-z0-9-]++"
# A chain of parts and, if they follow, an at sign and a host. Chains are taken as a whole, so a text is read once.
ADDRESS = re.compile(rf"(?<![A-Za-z0-9._%+-])(?P<local>{PART}(?:{DOT_SIGN}{PART})*+)(?:(?P<at>{AT_SIGN}){HOST}(?P<dots>(?:{DOT_SIGN}{HOST})++))?", re.I)
SPELLED_IP = re.compile(rf"(?<![0-9.])[0-9]++(?:{DOT_SIGN}[0-9]++){{3}}", re.I)
DOT = re.compile(DOT_SIGN, re.I)
# What a disguised address or number holds at least; rules out most texts.
HINT = re.compile(rf"{AT_SIGN}{HOST}{DOT_SIGN}[A-Za-z0-9-]", re.I)
IP_HINT = re.compile(rf"[0-9]{SIGN.format(words='|'.join((*DOT_WORDS, r'[.]')))}[0-9]", re.I)
# Words after which "name at host" is meant as an address.
CUE = re.compile(r"(?:\b(?:e-?mail|mail|contact|write|reach|address|kontakt|adresse|schreib\w*|courriel|[eé]cri\w*|correo|contacto|escrib\w*)\b[^.!?\n]{0,24}|[:<(\"'])\x20*\Z", re.I)


class Rewritten:
    """A text and, for each character, the span of the source text it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """With ``text[a:b]`` replaced; every new character stands for the whole span."""
        out, starts, ends, last = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            out += [self.text[last:a], new]
            starts += self.starts[last:a]
            ends += self.ends[last:a]
            if new and b > a:
                s, e = self.source(a, b)
                starts += [s] * len(new)
                ends += [e] * len(new)
            last = b
        return Rewritten("".join(out), starts, ends)


def homoglyphs(t: Rewritten) -> Rewritten:
    """Lookalikes and compatibility forms as ASCII; invisible characters go."""
    edits = []
    for m in NON_ASCII_ODD.finditer(t.text):
        c = m[0]
        flat = "" if c in INVISIBLE else LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if flat != c and flat.isascii():
            edits.append((m.start(), m.end(), flat))
    return t.replaced(edits) if edits else t


def spelled_digits(t: Rewritten) -> Rewritten:
    """Digits for their words within runs of numerals; the signs between single digits go, except dots and a leading plus."""
    edits = []
    if not PAIR.search(t.text.lower()):
        return t
    for m in NUMERALS.finditer(t.text):
        run = m[0]
        numerals = [p[0].lower() in DIGIT_WORDS for p in re.finditer(NUMERAL, run, re.I)]
        few = sum(numerals) < 3  # then a word at the edge of the run is just the next word of the sentence
        if not any(numerals[1:-1] if few else numerals):
            continue
        at_edge = 0
        start = m.start()
        plus = re.match(r"(\+|plus\x20)\x20?", run, re.I)
        if plus:
            edits.append((start, start + plus.end(), "+"))
        for p in re.finditer(NUMERAL + r"|[\x20()-]+|\.", run[plus.end() if plus else 0:], re.I):
            at = start + (plus.end() if plus else 0) + p.start()
            word = p[0].lower()
            at_edge += word in DIGIT_WORDS or word.isdigit()
            if few and word in DIGIT_WORDS and at_edge in (1, len(numerals)):
                continue
            if word in DIGIT_WORDS:
                edits.append((at, at + len(word), DIGIT_WORDS[word]))
            elif not word.strip("\x20()-") and at > start:
                edits.append((at, at + len(word), ""))
    return t.replaced(edits) if edits else t


def is_address(text: str, m: re.Match) -> bool:
    """Whether a chain, an at sign and a host are meant as an address.

    A bracketed at sign, or one with spaces on both sides, always is. A word is one if the name has a letter and a dot, digit, underscore or the
    like, or if a cue stands before it: "you at noon dot com" is prose.
    """
    at, local = m["at"], m["local"]
    if at.strip() == "@" or re.search(r"[\[({<]", at):
        return True
    if not re.search(r"[A-Za-z]", local):
        return False
    return bool(re.search(r"[0-9_.%+-]", local) or DOT.search(local) or CUE.search(text, max(0, m.start() - 64), m.start()))


def signs(t: Rewritten) -> Rewritten:
    """``@`` and ``.`` for their disguises where the whole reads as an address or as four numbers."""
    edits = []
    if HINT.search(t.text):
        place = 0
        while m := ADDRESS.search(t.text, place):
            place = m.end("local")
            if m["at"] and is_address(t.text, m):
                place = m.end()
                edits += [(*m.span("at"), "@")] * (m["at"] != "@")
                for part in ("local", "dots"):
                    edits += [(m.start(part) + d.start(), m.start(part) + d.end(), ".") for d in DOT.finditer(m[part]) if d[0] != "."]
    if IP_HINT.search(t.text):
        taken = {(a, b) for a, b, _ in edits}
        edits += [e for m in SPELLED_IP.finditer(t.text) for d in DOT.finditer(m[0]) if d[0] != "."
                  for e in [(m.start() + d.start(), m.start() + d.end(), ".")] if e[:2] not in taken]
    return t.replaced(sorted(edits)) if edits else t


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """``(plain, plain and added)``, both by kind and start."""
    plain = plain_spans(text)
    t = Rewritten(text)
    rewritten = signs(spelled_digits(homoglyphs(t)))
    if rewritten.text is text or rewritten.text == text:
        return plain, plain
    added = []
    for kind, a, b in plain_spans(rewritten.text):
        s, e = rewritten.source(a, b)
        if text[s:e] != rewritten.text[a:b] and not any(k == kind and x <= s and e <= y for k, x, y in plain):
            added.append((kind, s, e))
    return plain, sorted({*plain, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans merge under the first one's kind."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find(docs: DataFrame, keep: list[str], text_col: str = "text", redact: bool = False) -> DataFrame:
    """``keep`` and ``n_<kind>`` (of all spans), ``base_sha256``, ``spans``, ``base_spans`` and, on request, ``redacted`` of every row.

    Offsets are code points, ends exclusive. NULL text counts as empty. Whole texts are read, in linear time, whatever their length. Spans of one kind
    that start together are ordered by their end; repeated rows get equal results; the result's columns replace kept ones of the same
    name. An empty table gives an empty result. Not found: a name without dot or digit beside a spelled "at" without a cue before it.
    """
    keep = [c for c in keep if c not in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "base_spans", "redacted")]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = StructType([*rows.schema.fields[:len(keep)]])
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", LongType())
    for name in ("base_sha256", "spans", "base_spans", *["redacted"] * redact):
        schema = schema.add(name, StringType())

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = []
                for text in part.column(len(keep)):
                    text = text.as_py() or ""
                    plain, spans = all_spans(text)
                    base = written(plain)
                    kinds = [x[0] for x in spans]
                    out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), written(spans), base, *[redacted(text, spans)] * redact))
                columns = [pa.array(c, f.dataType.typeName() == "long" and pa.int64() or pa.string()) for c, f in zip(zip(*out), schema.fields[len(keep):])]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *columns], schema.names)

    return rows.mapInArrow(scanned, schema)
