"""Personal data in disguise: transducers that keep source offsets."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import bound_batches, table

# The base rules.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters and signs that look like the ASCII ones beside them.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E",
    "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "。": ".", "․": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
    "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters that show nothing and are left out.
INVISIBLE = "­​‌‍⁠﻿"
#: Words for the digits 0 to 9.
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"),
    ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
AT_WORDS = ("at", "arobase", "arroba", "ät")
DOT_WORDS = ("dot", "punkt", "point", "punto")
PLUS_WORDS = ("plus", "más")
#: Loose at and dot words: others than these are too common between other words.
LOOSE_AT, LOOSE_DOT = "at", "dot"
#: What a domain with a loose dot word must end in.
LOOSE_ENDS = frozenset("com org net edu gov mil info biz io app dev de fr es uk eu ca ch nl pl jp cn br au ru".split())

_DIGIT = {word: str(d) for d, words in enumerate(DIGIT_WORDS) for word in words}


def _either(words: tuple[str, ...] | dict[str, str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
#: Signs in brackets; signs as words or alone between blanks, or between hyphens or underscores.
_SIGNS = re.compile(
    rf"{_OPEN}[ \t]*(?:(?P<at>{_either(AT_WORDS)}|@)|(?P<dot>{_either(DOT_WORDS)}|\.))[ \t]*{_CLOSE}[ \t]*"
    rf"|(?<=[^\s_-])(?:[ \t]+|[-_]+)(?:(?P<loose_at>{LOOSE_AT}|@)|(?P<loose_dot>{LOOSE_DOT}))(?:[ \t]+|[-_]+)(?=\S)", re.IGNORECASE)
_DIGITS = re.compile(rf"(?<!\w)(?:(?P<plus>{_either(PLUS_WORDS)})[ \t]+(?=(?:{_either(_DIGIT)}|[0-9])(?!\w))"
                     rf"|(?P<digit>{_either(_DIGIT)})(?!\w)(?P<gap>[ \t]+(?=(?:{_either(_DIGIT)})(?!\w)))?)", re.IGNORECASE)
#: Whether lower-cased text may spell signs or digits at all: a dot or a bracketed or lone at, or two digits in a row.
_MAYBE_SIGNS = re.compile(rf"[\[({{<][ \t]*(?:{_either(AT_WORDS)}|@)[ \t]*{_CLOSE}|[\[({{<][ \t]*(?:{_either(DOT_WORDS)}|\.)[ \t]*{_CLOSE}"
                          rf"|[ \t](?:@|{LOOSE_DOT})[ \t]|[-_](?:{LOOSE_AT}|{LOOSE_DOT})[-_]")
_MAYBE_DIGITS = re.compile(rf"(?:{_either(_DIGIT)})[\s.\])}}>[({{<-]+(?:{_either((*_DIGIT, *DOT_WORDS))})(?!\w)")


# --- transducers ----------------------------------------------------------------------------

@dataclass
class Tape:
    """A rewritten text: pieces (place in it, place in the source, taken over letter by letter or as a whole)."""
    text: str
    places: list[int]
    sources: list[int]
    stops: list[int]
    copied: list[bool]

    def source(self, start: int, stop: int) -> tuple[int, int]:
        """The source characters that text[start:stop] came from."""
        return self._begin(start), self._stop(stop)

    def _begin(self, at: int) -> int:
        piece = bisect_right(self.places, at) - 1
        return self.sources[piece] + (at - self.places[piece] if self.copied[piece] else 0)

    def _stop(self, at: int) -> int:
        piece = bisect_right(self.places, at - 1) - 1
        return self.sources[piece] + at - self.places[piece] if self.copied[piece] else self.stops[piece]

    def rewritten(self, start: int, stop: int) -> int:
        """Characters of text[start:stop] that do not stand so in the source."""
        first = bisect_right(self.places, start) - 1
        last = bisect_right(self.places, stop - 1) - 1
        ends = [*self.places[1:], len(self.text)]
        return sum(min(stop, ends[p]) - max(start, self.places[p]) for p in range(first, last + 1) if not self.copied[p])


def tape(source: str) -> Tape:
    """The source itself."""
    return Tape(source, [0], [0], [len(source)], [True])


def rewrite(of: Tape, edits: list[tuple[int, int, str]]) -> Tape:
    """`of` with text[start:stop] replaced for each (start, stop, new), in order and apart; offsets compose."""
    out, places, sources, stops, copied, size, at = [], [], [], [], [], 0, 0

    def piece(text: str, begin: int, stop: int, same: bool) -> None:
        nonlocal size
        if text:
            out.append(text)
            places.append(size)
            sources.append(begin)
            stops.append(stop)
            copied.append(same)
            size += len(text)

    def keep(start: int, stop: int) -> None:
        p = bisect_right(of.places, start) - 1
        while start < stop:
            until = min(stop, of.places[p + 1] if p + 1 < len(of.places) else len(of.text))
            begin = of.sources[p] + (start - of.places[p] if of.copied[p] else 0)
            piece(of.text[start:until], begin, begin + until - start if of.copied[p] else of.stops[p], of.copied[p])
            start, p = until, p + 1

    for start, stop, new in edits:
        keep(at, start)
        if new:
            piece(new, *of.source(start, stop), False)
        at = stop
    keep(at, len(of.text))
    return Tape("".join(out), places, sources, stops, copied)


@cache
def plain(character: str) -> str:
    """The ASCII character a character stands for; nothing for an invisible one, itself if there is none.

    Beside the look-alikes: digits of every script, and compatibility forms (wide, styled, circled) of one
    ASCII character.
    """
    if character < "\x80":
        return character
    if character in INVISIBLE:
        return ""
    if character in LOOKALIKES:
        return LOOKALIKES[character]
    digit = unicodedata.digit(character, None)
    if digit is not None:
        return str(digit)
    same = unicodedata.normalize("NFKC", character)
    return same if len(same) == 1 and same < "\x80" else character


def plain_characters(of: Tape) -> Tape:
    """Look-alikes, other digits and wide forms as ASCII; invisible characters left out."""
    if of.text.isascii():
        return of
    odd = {c for c in set(of.text) if c > "\x7f" and plain(c) != c}
    if not odd:
        return of
    found = re.finditer("[" + re.escape("".join(sorted(odd))) + "]", of.text)
    return rewrite(of, [(m.start(), m.end(), plain(m[0])) for m in found])


def plain_digits(of: Tape) -> Tape:
    """Spelled digits as digits, those in a row without the blanks between them; a spelled plus before digits as a sign."""
    if not _MAYBE_DIGITS.search(of.text.lower()):
        return of
    edits = [(m.start(), m.end(), "+" if m["plus"] else _DIGIT[m["digit"].lower()]) for m in _DIGITS.finditer(of.text)]
    return rewrite(of, edits) if edits else of


def plain_signs(of: Tape) -> tuple[Tape, list[int], list[int], set[int]]:
    """At and dot disguises as signs; places of loose at words, of rewritten dots and of the loose ones in the new text."""
    if not _MAYBE_SIGNS.search(of.text.lower()):
        return of, [], [], set()
    edits, loose_at, dots, loose_dots, shift = [], [], [], set(), 0
    for m in _SIGNS.finditer(of.text):
        at = m["at"] or m["loose_at"]
        start = m.start()
        while not (m["loose_at"] or m["loose_dot"]) and start > (edits[-1][1] if edits else 0) and of.text[start - 1] in " \t":
            start -= 1
        place = start + shift
        if m["loose_at"] and m["loose_at"] != "@":
            loose_at.append(place)
        elif not at:
            dots.append(place)
            if m["loose_dot"]:
                loose_dots.add(place)
        edits.append((start, m.end(), "@" if at else "."))
        shift += 1 - (m.end() - start)
    return (rewrite(of, edits) if edits else of), loose_at, dots, loose_dots


# --- identifiers ----------------------------------------------------------------------------

def _luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part is all that may stand there before an at sign, so each sign is tried once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Numbers in a chain of dots go four by four."""
    for chain in NUMBERS.finditer(text):
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def identifiers(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the base rules, kinds as places in KINDS, by start, then kind.

    Matches run left to right without overlap per kind, longest first; those that fail a rule are dropped
    and not tried in part.
    """
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, a, b) for a, b in _ips(text)]
    for kind, pattern, least, most in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
        if kind == 3 and "+" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least:
                digits = "".join(c for c in m[0] if "0" <= c <= "9")
                if least <= len(digits) <= most and (kind == 3 or _luhn(digits)):
                    out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _stands_alone(text: str, start: int, stop: int) -> bool:
    return not (start and text[start - 1].isalnum()) and not (stop < len(text) and text[stop].isalnum())


def disguised(source: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the source of identifiers that only show after normalisation.

    A text goes through the three transducers; identifiers of the outcome that contain something rewritten
    are mapped back. They must stand alone, emails must end in a name of letters (one of LOOSE_ENDS after a
    loose dot), a loose at word needs a disguised dot after it, and half the digits of a number, or a dot
    between numbers, must have been rewritten.
    """
    seen = plain_digits(plain_characters(tape(source)))
    seen, loose_at, dots, loose_dots = plain_signs(seen)
    if len(seen.copied) == 1 and seen.copied[0]:
        return []
    out = []
    within = lambda places, a, b: bisect_left(places, b) > bisect_right(places, a)
    for kind, start, stop in identifiers(seen.text):
        begin, end = seen.source(start, stop)
        value = seen.text[start:stop]
        if source[begin:end] == value:
            continue
        if kind == 0:
            at, name = start + value.index("@"), value.rpartition(".")[2]
            good = len(name) >= 2 and name.isalpha() and not (within(loose_at, at - 1, at + 1) and not within(dots, at, stop))
            good = good and not (stop - len(name) - 1 in loose_dots and name.lower() not in LOOSE_ENDS)
        else:
            digits = [start + i for i, c in enumerate(value) if "0" <= c <= "9"]
            good = 2 * sum(seen.rewritten(i, i + 1) for i in digits) >= len(digits) or (kind == 1 and within(dots, start, stop))
        if good and _stands_alone(source, begin, end):
            out.append((kind, begin, end))
    return out


def spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, disguised) in code points: all base ones, and disguised ones that touch no base one of their kind."""
    base = identifiers(text)
    out = [(*s, False) for s in base]
    for kind, a, b in disguised(text):
        if all(k != kind or b <= c or d <= a for k, c, d in base):
            out.append((kind, a, b, True))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans as array of struct(start, kind, stop, disguised) of every document row, whole texts, no shuffle.

    Spans are code points of the source, end exclusive, by start and kind; kinds are places in KINDS. Null
    and empty texts have none. Ties: each kind has its own matches, so kinds may overlap. Repeated rows stay,
    other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("disguised", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "kind": k, "stop": b, "disguised": d} for k, a, b, d in spans(t.as_py() or "")]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return given.mapInArrow(run, "doc_id long, spans array<struct<start: int, kind: int, stop: int, disguised: boolean>>")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every identifier of `text` replaced by its kind in brackets, overlapping ones by the first; null stays."""
    bound_batches(docs.sparkSession)

    def cut(source: str | None) -> str | None:
        if not source:
            return source
        out, at = [], 0
        for kind, a, b, _ in spans(source):
            if a >= at:
                out += [source[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, b)
        return "".join(out) + source[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            new = pa.array([cut(t.as_py()) for t in batch.column(place)], batch.column(place).type)
            yield batch.set_column(place, batch.schema.field(place), new)

    return docs.mapInArrow(run, docs.schema)


def _listed(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op12_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document; one more column: spans that were disguised."""
    found = find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: ~s["disguised"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
                        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"))
