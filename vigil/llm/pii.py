"""Personal data by offset-preserving deobfuscation.

Identifiers are first detected in the text as it stands (the base spans).  Then a chain of
transducers normalises disguises; each one keeps, for every piece it rewrites, where the
piece stood before:

1. look-alikes: full-width and mathematical letters, digits of any script, Cyrillic and
   Greek letters, dashes, blanks and signs become ASCII; invisible characters go;
2. letters that pose as digits inside numbers (O, l, I);
3. "at" and "dot" in brackets, as words, as entities or spaced out, where they make an
   address, and disguised dots between numbers;
4. spelled digits (English, German, French, Spanish), two or more in a run of three numbers, "double"
   and "triple", "plus".

The detectors run again on the normalised text, and spans in which something was rewritten
are mapped back through the chain to the characters of the source.  Base spans always stay;
a span found by the chain is added unless a base span of its kind holds it.

All detectors are linear in the text: runs are taken whole and cut, never retried.  Only
texts with a rewritten piece are searched twice.

Defined cases: null and empty texts have no spans; texts of any length are searched whole;
repeated rows and null ids come out like any other row; an empty table gives no rows; further
input columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")


# --- detectors -----------------------------------------------------------------------------------------------

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_GROUPED = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile("[0-9]+")
_DIGIT = re.compile("[0-9]")


def emails(text: str):
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def ips(text: str):
    for m in _DOTTED.finditer(text):  # a whole chain of numbers; every four of them are a match
        parts = list(_NUMBER.finditer(text, m.start(), m.end()))
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in four):
                yield four[0].start(), four[3].end()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(_NUMBER.findall(text))


def cards(text: str):
    for m in _GROUPED.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str):
    for m in _PLUS.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the text as it stands, by kind and start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, *s) for s in ips(text)]
        out += [(2, *s) for s in cards(text)]
        if "+" in text:
            out += [(3, *s) for s in phones(text)]
    return out


# --- transducers ---------------------------------------------------------------------------------------------

class Rewritten:
    """A text with pieces replaced, and the way back to the text before."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, size = [], 0, 0
        self.new, self.new_end, self.old, self.old_end = [], [], [], []
        for start, end, put in edits:
            parts += [text[at:start], put]
            size += start - at
            self.new.append(size), self.old.append(start), self.old_end.append(end)
            size, at = size + len(put), end
            self.new_end.append(size)
        self.text = "".join([*parts, text[at:]])

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source of a span, and whether a piece of it was rewritten."""
        i, j = bisect_right(self.new, start) - 1, bisect_right(self.new, end - 1) - 1
        touched = j > i or (i >= 0 and start < self.new_end[i])
        return self._place(i, start, False), self._place(j, end - 1, True), touched

    def _place(self, i: int, at: int, last: bool) -> int:
        if i < 0:
            return at + last
        if at >= self.new_end[i]:
            return self.old_end[i] + at - self.new_end[i] + last
        if self.new_end[i] - self.new[i] == self.old_end[i] - self.old[i]:  # character by character
            return self.old[i] + at - self.new[i] + last
        return self.old_end[i] if last else self.old[i]


# fixed values: letters and signs that look like ASCII ones
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "﹢": "+",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "﹣": "-", "﹘": "-",
}
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_BLANKS = "              　"


def _look_alikes() -> dict[str, str]:
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    table.update((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x1D400, 0x1D800))
    table.update((chr(c), str(unicodedata.decimal(chr(c)))) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd")
    table = {k: v for k, v in table.items() if len(v) == 1 and v.isascii()}
    return table | _LOOKS | dict.fromkeys(_INVISIBLE, "") | dict.fromkeys(_BLANKS, " ")


_LOOK_ALIKES = _look_alikes()
# characters beyond 16 bits as one range: a class of single ones would be searched one by one
_LOOK_ALIKE = re.compile("[" + "".join(re.escape(c) for c in _LOOK_ALIKES if c <= "\uffff") + "\U00010000-\U0010ffff]")


def look_alike_edits(text: str):
    if text.isascii():
        return []
    return [(m.start(), m.end(), _LOOK_ALIKES[m[0]]) for m in _LOOK_ALIKE.finditer(text) if m[0] in _LOOK_ALIKES]


_POSING = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OolI|])[0-9OolI|]{2,}+(?![A-Za-z0-9])|(?<=[0-9]\.)[OolI](?=\.[0-9OolI]|(?![\w.]))")
_POSE = str.maketrans("OolI|", "00111")


def posing_digit_edits(text: str):
    out = []
    if _DIGIT.search(text):
        for m in _POSING.finditer(text):
            n = len(_digits(m[0]))
            if n < len(m[0]) and (2 * n >= len(m[0]) or len(m[0]) == 1):
                out.append((m.start(), m.end(), m[0].translate(_POSE)))
    return out


# fixed values: ends of addresses that are plain enough to tell an address from prose
_ENDINGS = frozenset("com org net edu gov mil int info biz name io ai co dev app me tv us uk de fr es it nl be ch at eu ru pl se no dk fi cz pt br mx ca au jp cn in kr".split())
_DOT_WORD = "(?:dot|punkt|punto|point|ponto)"
_HIDDEN_DOT = rf"[ \t]*[\[({{<][ \t]*(?:{_DOT_WORD}|\.)[ \t]*[\])}}>][ \t]*|[ \t]+{_DOT_WORD}[ \t]+|_dot_|[ \t]*(?:&#46;|&period;|%2e)[ \t]*"
_AT = re.compile(r"[\[({<][ \t]*(?:at|@|a|arroba)[ \t]*[\])}>]|@|&#64;|&commat;|%40|(?<=[ \t])(?:at|arroba)(?=[ \t])|(?<=_)at(?=_)", re.I)
_ANY_DOT = re.compile(rf"(?P<hidden>{_HIDDEN_DOT})|(?P<spaced>[ \t]+\.[ \t]*|\.[ \t]+)|(?P<plain>\.)", re.I)
_DOT_BEFORE = re.compile(rf"(?:{_HIDDEN_DOT})\Z", re.I)
_IS_DOT = re.compile(_DOT_WORD, re.I)
_LABEL = re.compile("[A-Za-z0-9-]+")


# what a text in lower case must hold before it is searched for disguises; plain searches are far quicker
_DOT_MARKS = ("dot", "punkt", "punto", "point", "ponto", "&#46;", "&period;", "%2e", "[.", "(.", "{.", "<.", "[ .", "( .", "{ .", "< .")
_AT_MARKS = ("&#64;", "&commat;", "%40", "arroba", "_at_", *(f"{o}{b}{w}" for o in "[({<" for b in ("", " ") for w in ("at", "@", "a]", "a)", "a}", "a>")))
_ENDED = re.compile(r"\.(?:" + "|".join(sorted(_ENDINGS)) + r")(?!\w)")


def _may_hide_dots(low: str) -> bool:
    return any(mark in low for mark in _DOT_MARKS)


def _may_hide_address(low: str) -> bool:
    return "@" in low or _may_hide_dots(low) or any(mark in low for mark in _AT_MARKS) or " at " in low and bool(_ENDED.search(low))


def _local_part(text: str, end: int, least: int) -> tuple[int, list[tuple[int, int, str]]]:
    """Where the local part before ``end`` starts, and the disguised dots in it."""
    dots, start = [], end
    while True:
        run = start
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        if start == run:
            return (dots.pop()[1] if dots else start), dots[::-1]  # nothing stands before the last dot
        lead = max(least, start - 16)
        m = _DOT_BEFORE.search(text[lead:start])
        if not m or lead + m.start() <= least:
            return start, dots[::-1]
        dots.append((lead + m.start(), start, "."))
        start = lead + m.start()


def address_edits(text: str):
    """Rewrites of disguised addresses: the at sign and all dots that are not plain."""
    out, done = [], 0
    if not _may_hide_address(text.lower()):
        return out
    for m in _AT.finditer(text):
        a, z = m.span()
        if a < done:
            continue
        word = m[0][0] in "aA"
        if word and text[a - 1] == "_":
            a, z = a - 1, z + 1
        while a > done and text[a - 1] in " \t":
            a -= 1
        while z < len(text) and text[z] in " \t":
            z += 1
        label = _LABEL.match(text, z)
        if not label:
            continue
        plain = text[a:z] == "@"
        edits = [] if plain else [(a, z, "@")]
        hidden, dots, last = 0, 0, label
        while dot := _ANY_DOT.match(text, last.end()):
            label = _LABEL.match(text, dot.end())
            if not label or _IS_DOT.fullmatch(label[0]) or dot["spaced"] and (plain or word or last[0].lower() in _ENDINGS):
                break
            if not dot["plain"]:
                edits.append((dot.start(), dot.end(), "."))
            hidden, dots, last = hidden + bool(dot["hidden"]), dots + 1, label
        known = last[0].lower() in _ENDINGS
        if not edits:  # a plain address
            continue
        if not dots or len(last[0]) < 2 or not last[0].isalpha() or word and not hidden and not known:
            continue
        start, before = _local_part(text, a, done)
        edits = before + edits
        if start == a or word and not hidden and not re.search("[0-9._+]", text[start:a]):
            continue
        out += edits
        done = last.end()
    return out


# fixed values: digits as words
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_TOKEN = rf"(?:(?:(?:double|triple)[ -])?{_WORD}(?![^\W_])|[0-9]++)"
_SPOKEN = re.compile(rf"(?<![^\W_])(?:plus[ \t]+)?{_TOKEN}(?:[ \t]*[,.()-]?[ \t]*{_TOKEN}){{2,}}+", re.I)
_SPOKEN_PART = re.compile(rf"(?P<plus>plus[ \t]+)|(?:(?P<times>double|triple)[ -])?(?P<word>{_WORD})(?![^\W_])|(?P<digits>[0-9]+)", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9A-Za-z])(?:{_HIDDEN_DOT})(?={_TOKEN})", re.I)


def number_dot_edits(text: str):
    return [(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text)] if _may_hide_dots(text.lower()) else []


def _may_spell_digits(text: str) -> bool:
    """Whether three words in a row are digits, spelled or not, and some word is a spelled one."""
    for sign in ",.()-":
        text = text.replace(sign, " ")
    words = text.split()
    spelled = [w in _SPELLED for w in words]
    if not any(spelled):
        return False
    return b"\1\1\1" in bytes([s or w.isdigit() or w in ("double", "triple") for s, w in zip(spelled, words)])


def spelled_digit_edits(text: str):
    """Each word becomes its digit; blanks, commas and hyphens between two words go."""
    out = []
    if not _may_spell_digits(text.lower()):
        return out
    for m in _SPOKEN.finditer(text):
        before = None  # end of the spelled word before
        if sum(bool(p["word"]) for p in _SPOKEN_PART.finditer(m[0])) < 2:
            continue
        for p in _SPOKEN_PART.finditer(text, m.start(), m.end()):
            if p["word"]:
                if before is not None and before < p.start() and not text[before:p.start()].strip(" \t,-"):
                    out.append((before, p.start(), ""))
                times = {"double": 2, "triple": 3}.get((p["times"] or "").lower(), 1)
                out.append((p.start(), p.end(), _SPELLED[p["word"].lower()] * times))
                before = p.end()
            elif p["plus"]:
                out.append((p.start(), p.end(), "+"))
            else:
                before = None
    return out


TRANSDUCERS = (look_alike_edits, posing_digit_edits, address_edits, number_dot_edits, spelled_digit_edits)


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the source of identifiers that show only after rewriting."""
    chain, now = [], text
    for edits_of in TRANSDUCERS:
        if edits := edits_of(now):
            chain.append(Rewritten(now, edits))
            now = chain[-1].text
    out = []
    for kind, start, end in detect(now) if chain else []:
        if start and now[start - 1].isalnum() or end < len(now) and now[end].isalnum():
            continue
        rewritten = False
        for layer in reversed(chain):
            start, end, touched = layer.back(start, end)
            rewritten |= touched
        if rewritten:
            out.append((kind, start, end))
    return out


def find_spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, hidden) by kind and start: the base spans and those behind a disguise."""
    if not text:
        return []
    base = detect(text)
    out = [(*s, False) for s in base]
    for kind, start, end in dict.fromkeys(hidden_spans(text)):
        if not any(k == kind and a <= start and end <= z for k, a, z in base):
            out.append((kind, start, end, True))
    return sorted(out)


# --- on Spark ------------------------------------------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hidden", pa.bool_())]))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, hidden>>) of every row; offsets in code points."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):  # a few texts at a time become Python strings
                part = b.slice(at, 512)
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "hidden": h} for k, s, e, h in find_spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long, hidden: boolean>>")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_<kind> of the base spans, base_sha256, spans, n_hidden) from ``personal_data``."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind):
        return F.filter(base, lambda s: s["kind"] == F.lit(kind))

    base = F.filter("spans", lambda s: ~s["hidden"])
    return found.select(
        "doc_id", *[F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["hidden"])).cast("long").alias("n_hidden"))
