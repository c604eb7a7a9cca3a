"""Personal data with offset-preserving deobfuscation.

Base detectors read the raw text.  Transducers rewrite what is disguised while every output character keeps the source
span it came from: homoglyphs and foreign digits to ASCII, invisible characters to nothing; digit words next to other digits or
digit words to digits; at and dot to @ and . in brackets, between underscores or between blanks (at between blanks or
underscores only before a host with a dot).  The same detectors read the rewritten text and their spans are
mapped back.  An added span holds at least one rewritten place and overlaps no base span of
its kind, unless it completes one that hidden characters cut short.

All scans are linear in the text: they are anchored at @, +, a bracket, a digit, a digit word or the words at, dot
and plus, and look at the blanks next to those only.  Offsets are code points, ends exclusive.  A null text counts as empty;
repeated rows are scanned each; extra columns are ignored; a very long text is scanned whole, in one task; an empty table
gives no rows."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusweave.llm.common import per_table, small_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = done + len(text[done:at].rstrip(_LOCAL))
        if begin < at and (m := _HOST.match(text, at + 1)):
            found.append((begin, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each kind; matches that fail their test are dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if "." in text:
        for m in _IP.finditer(text):
            if all(int(x[-9:]) <= 255 and (len(x) < 10 or not x[:-9].strip("0")) for x in m[0].split(".")):
                found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


# Letters that look like ASCII letters, by ASCII letter.
_LOOKALIKE = {
    "a": "аα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κ", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "τ", "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", "@": "＠﹫", ".": "．。｡․", "+": "＋﹢", "-": "‐‑‒–−－",
}
_GLYPH = {ord(x): a for a, all_ in _LOOKALIKE.items() for x in all_}
_INVISIBLE = "​‌‍⁠﻿­"
# Digit words.
_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
_WORD = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_OPEN, _CLOSE = r"[ \t]*+[(\[{<][ \t]*+", r"[ \t]*+[)\]}>][ \t]*+"
_UNITS = rf"(?:{_WORD}|[0-9]+)\b"
_BETWEEN = rf"(?:{_OPEN}(?:dot|point|\.){_CLOSE}|[ \t]*[-,.][ \t]*|[ \t]+)(?:(?:dot|point)[ \t]+)?"
# Two or more digit words or numbers; one is rewritten if it holds a word.  What makes an identifier is left to the detectors.
_SPELLED = re.compile(rf"\b{_UNITS}(?:{_BETWEEN}{_UNITS})++", re.I)
_DIGIT_WORD = re.compile(_WORD, re.I)
_PLUS = re.compile(rf"\bplus[ \t]++(?={_WORD}\b|[0-9]++{_BETWEEN}{_UNITS})")
# Marks in lower-cased text: the word at or dot, or a bracketed sign; what stands around them is looked at in _mark.
_MARKS = (
    re.compile(r"at(?<=[ \t(\[{<_]at)(?=[ \t)\]}>_])"), re.compile(r"dot(?<=[ \t(\[{<_]dot)(?=[ \t)\]}>_])"),
    re.compile(r"[@.](?<=[ \t(\[{<][@.])(?=[ \t)\]}>])"),
)
# What must follow at between blanks or underscores: a host name and a written or disguised dot.
_HOSTLIKE = re.compile(rf"[A-Za-z0-9-]++(?:\.[a-z]{{2,}}|(?i:_dot_|[ \t]++dot[ \t]++|{_OPEN}(?:dot|\.){_CLOSE})[A-Za-z])")
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _GLYPH))) + _INVISIBLE + "！-～]|(?![0-9])\\d")
_UNIT = re.compile(rf"{_WORD}|dot|point|[0-9]|(?<=\S)\.(?=\S)|(?<=[(\[{{<])[ \t]*\.[ \t]*(?=[)\]}}>])", re.I)

Pieces = list[tuple[str, int, int, bool]]


def glyphs(text: str) -> tuple[str, list[int], list[bool]]:
    """First transducer: (output, source index of each output character and one past, rewritten)."""
    out, at, changed = [], [], []
    for i, ch in enumerate(text):
        if ch in _INVISIBLE:
            continue
        new = ch
        code = ord(ch)
        if code > 127:
            if code in _GLYPH:
                new = _GLYPH[code]
            elif 0xFF01 <= code <= 0xFF5E:
                new = chr(code - 0xFEE0)
            elif ch.isdecimal():
                new = str(unicodedata.decimal(ch))
        out.append(new)
        at.append(i)
        changed.append(new != ch or len(at) > 1 and at[-2] != i - 1)
    return "".join(out), at, changed


def _blanks(text: str, at: int, step: int) -> int:
    """The end of the blanks before (step -1) or from (step 1) a place."""
    while (0 < at if step < 0 else at < len(text)) and text[at - 1 if step < 0 else at] in " \t":
        at += step
    return at


def _mark(text: str, a: int, b: int) -> tuple[str, int, int, bool] | None:
    """The piece for a word or sign at, dot, @ or . at a..b, or None if nothing around it makes it a disguise."""
    what = "@" if text[a] in "aA@" else "."
    left, right = _blanks(text, a, -1), _blanks(text, b, 1)
    if left and text[left - 1] in "([{<" and right < len(text) and text[right] in ")]}>":
        return what, _blanks(text, left - 1, -1), _blanks(text, right + 1, 1), False
    if b - a == 1:
        return None  # a sign that is no disguise
    if a and text[a - 1] == "_" and b < len(text) and text[b] == "_":
        left, right = a - 1, b + 1
    elif left == a or right == b:
        return None
    if not left or right == len(text):
        return None
    if what == "@":
        fits = text[left - 1] in _LOCAL and _HOSTLIKE.match(text, right)
    else:
        fits = all(c.isascii() and c.isalnum() for c in (text[left - 1], text[right]))
    return (what, left, right, False) if fits else None


def _lower(text: str) -> str:
    """Lower case, place by place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def disguises(text: str) -> Pieces:
    """Second transducer: pieces (output, start, end, glued) that replace text; the rest is copied, but for
    what stands between a glued piece and the one before."""
    low = _lower(text)
    marks = [m for rule in _MARKS for x in rule.finditer(low) if (m := _mark(text, *x.span()))]
    marks += [("+", *x.span(), False) for x in _PLUS.finditer(low)]
    runs = [m for m in _SPELLED.finditer(low) if _DIGIT_WORD.search(m[0])]
    if not marks and not ("+" in low and runs) and not any(_may_identify(m[0]) for m in runs):
        return []
    groups: list[Pieces] = []
    for m in runs:
        units = [(u[0] if u[0].isdigit() else _DIGITS.get(u[0], "."), u) for u in _UNIT.finditer(m[0])]
        if sum(d == "." for d, _ in units) != 3:  # points that only part the digits
            units = [(d, u) for d, u in units if u[0] != "."]
        groups.append([(d, m.start() + u.start(), m.start() + u.end(), i > 0) for i, (d, u) in enumerate(units)])
    groups += [[m] for m in marks]
    found: Pieces = []
    done, busy = 0, sorted((g[0][1], g[-1][2]) for g in groups if len(g) > 1)
    at = 0
    for g in sorted(groups, key=lambda g: (g[0][1], -g[-1][2])):
        begin, end = g[0][1], g[-1][2]
        if begin < done < end and len(g) == 1 and text[done] in "([{<" and not text[begin:done].strip(" \t"):  # blanks that the mark before has taken
            g, begin = [(g[0][0], done, end, False)], done
        while at < len(busy) and busy[at][1] <= begin:
            at += 1
        if begin >= done and (len(g) > 1 or at == len(busy) or end <= busy[at][0]):
            found += g
            done = end
    return found


def _may_identify(run: str) -> bool:
    """Whether a run without a plus has the points of an address or the digits of a card."""
    return run.count(".") + run.count("dot") + run.count("point") >= 3 or sum(1 for _ in _UNIT.finditer(run)) >= 16


def added_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    hidden = not text.isascii() and _ODD.search(text)
    first, at, odd = glyphs(text) if hidden else (text, range(len(text)), bytes(len(text)))
    pieces = disguises(first)
    if not pieces and not hidden:
        return {}
    out, begin, end = [], [], []
    how: list[int] = []  # of each output character: 0 as it was, 1 a glyph, 2 a disguise
    i = 0

    def copy(stop: int) -> None:
        out.append(first[i:stop])
        begin.extend(at[i:stop])
        end.extend(x + 1 for x in at[i:stop])
        how.extend(map(int, odd[i:stop]))

    for new, a, b, glued in pieces:
        if not glued:
            copy(a)
        out.append(new)
        begin.append(at[a])
        end.append(at[b - 1] + 1)
        how.append(2)
        i = b
    copy(len(first))
    added: dict[str, list[tuple[int, int]]] = {}
    for kind, spans in base_spans("".join(out)).items():
        met = 0
        for a, b in spans:
            most = max(how[a:b])
            s, e = begin[a], end[b - 1]
            while met < len(base[kind]) and base[kind][met][1] <= s:
                met += 1
            until = met
            while until < len(base[kind]) and base[kind][until][0] < e:
                until += 1
            over = base[kind][met:until]
            # a base span that hidden characters cut short is completed; no other overlap is added
            if most and (not over or most == 1 and all(s <= x and y <= e for x, y in over) and (s, e) not in over):
                added.setdefault(kind, []).append((s, e))
    return added


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans.get(k, [])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for text in table["_text"].to_pylist():
            base = base_spans(text := text or "")
            more = added_spans(text, base)
            every = {k: base[k] + more.get(k, []) for k in KINDS} if more else base
            sha = hashlib.sha256(_listed(base).encode()).hexdigest()
            rows.append((*(len(base[k]) for k in KINDS), sha, _listed(every), sum(map(len, more.values()))))
        cols = list(zip(*rows))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        return pa.table([table["_id"], *map(pa.array, cols, kinds)], names=[id_col, *NAMES])

    kind = dict(docs.dtypes)[id_col]
    return small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        per_table(run),
        f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint",
    )


NAMES = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
