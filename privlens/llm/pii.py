"""Personal data, plain and disguised, with offsets into the original text.

Plain identifiers are found in the text itself. Then transducers rewrite disguises: homoglyphs to
ASCII, spelled digits to digits, ``(at)``/``[dot]``-style words to ``@`` and ``.``. A transducer keeps,
for every output character, the source span it came from, so that a hit in the rewritten text maps
back to source characters. Rewriting is local: only the neighbourhood of a trigger is rewritten, and
texts without triggers cost one scan.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from privlens.llm.common import configure, spare, with_fields

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping ``local@domain`` matches, anchored at each ``@`` so that long runs cost no rescans."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of plain identifiers: leftmost, non-overlapping within a kind; failing matches are dropped without retries."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        out += [(a, b, "ip") for a, b in _ips(text)]
        out += [(a, b, "card") for a, b in _cards(text)]
        out += [(a, b, "phone") for a, b in _phones(text)]
    return out


# --- transducers -----------------------------------------------------------------------------------

#: Characters that look like ASCII ones, by script, each string beside what it looks like.
_LOOKALIKES = {
    "аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅ": "aeopcyxijsdhlABEKMHOPCTXIJS",
    "αοεινρτυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "aoeivptukABEZHIKMNOPTYX",
}
_GLYPHS = {a: b for k, v in _LOOKALIKES.items() for a, b in zip(k, v)}
_GLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_GLYPHS |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_GLYPHS |= {"。": ".", "․": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "﹫": "@", "﹒": ".", " ": " ", " ": " "}
_GLYPHS |= dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789"))
#: Characters that a disguise inserts and that stand for nothing.
_SILENT = "​‌‍⁠­﻿"
#: Digits as words, in the four languages of the corpus.
_DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_OPEN, _CLOSE = r"[\x20\t\r\n]*[\[({<][\x20\t\r\n]*", r"[\x20\t\r\n]*[\])}>][\x20\t\r\n]*"
_AT_WORDS, _DOT_WORDS = "at|arroba|arobase", "dot|punkt|punto|point"
_AT_RE = re.compile(rf"{_OPEN}(?:{_AT_WORDS}|@){_CLOSE}|(?<![\x20])\x20+(?:{_AT_WORDS})\x20+", re.I)
_DOT_RE = re.compile(rf"{_OPEN}(?:{_DOT_WORDS}|\.){_CLOSE}|(?<![\x20])\x20+(?:{_DOT_WORDS})\x20+", re.I)
#: In every text with a disguised dot or a bracketed ``@``; a bare word for ``@`` counts only beside a disguised dot.
_SIGN_HINT = re.compile(rf"[\[({{<][\x20\t\r\n]*(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.)[\x20\t\r\n]*[\])}}>]|\x20(?:{_DOT_WORDS})\x20", re.I)
#: Any character that may be a look-alike or silent lies here.
_ODD_RE = re.compile("[\u00a0\u00ad\u00b2\u00b3\u00b7\u00b9\u0370-\U0010ffff]")
_GLYPH_RE = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + _SILENT + "]")
_WORD_DIGIT = re.compile(r"(?<!\w)(?:plus|" + "|".join(_DIGIT_WORDS) + r")(?!\w)", re.I)
#: Six digit words or numbers in a row, two of them words, make a number.
_UNIT = r"(?:(?:plus|" + "|".join(_DIGIT_WORDS) + r")(?!\w)|[0-9]++)"
_RUN = re.compile(rf"(?<!\w){_UNIT}(?:[\x20.()-]+{_UNIT}){{5,}}(?!\w)", re.I)
_BY_LETTER = "|".join(a + "(?:" + "|".join(w[1:] for w in _DIGIT_WORDS if w[0] == a) + ")" for a in sorted({w[0] for w in _DIGIT_WORDS}))
#: A run needs two digit words; the second of them shows here.
_RUN_HINT = re.compile(rf"[\x20.()-](?:{_BY_LETTER})(?!\w)")
#: Characters on either side of a trigger that are rewritten with it at least; beyond, whatever an identifier may run on over.
_AROUND = 160
_NUMERIC = frozenset("0123456789().+-")


class Mapped:
    """A rewritten text with, for each of its characters, the source span that made it."""

    def __init__(self, text: str, offset: int = 0):
        self.text = text
        self.start = list(range(offset, offset + len(text)))
        self.end = [i + 1 for i in self.start]

    def rewrite(self, pattern: re.Pattern, to) -> bool:
        """Replace each match by ``to(match)`` (None: leave it), one source span for all it writes."""
        parts, start, end, last, hit = [], [], [], 0, False
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None or m.end() == m.start():
                continue
            hit = True
            parts += [self.text[last : m.start()], new]
            start += self.start[last : m.start()] + [self.start[m.start()]] * len(new)
            end += self.end[last : m.start()] + [self.end[m.end() - 1]] * len(new)
            last = m.end()
        if hit:
            parts.append(self.text[last:])
            self.text, self.start, self.end = "".join(parts), start + self.start[last:], end + self.end[last:]
        return hit

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def _spelled(run: str) -> str:
    """A run of digit words as digits, keeping the separators between numerals but not between words."""
    out = _WORD_DIGIT.sub(lambda m: "+" if m[0].lower() == "plus" else _DIGIT_WORDS[m[0].lower()], run)
    return re.sub(r"(?<=[0-9+])[\x20]+(?=[0-9])", "", out)


def _neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Windows around triggers, whole runs included, merged."""
    hits = [] if text.isascii() or not _ODD_RE.search(text) else [m.span() for m in _GLYPH_RE.finditer(text)]
    low = text.lower()
    if _SIGN_HINT.search(text):
        hits += [m.span() for m in _AT_RE.finditer(text)]
        hits += [m.span() for m in _DOT_RE.finditer(text)]
    if _RUN_HINT.search(low):
        hits += [m.span() for m in _RUN.finditer(text) if len(_WORD_DIGIT.findall(m[0])) > 1]
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        a, b, done = max(0, a - _AROUND), min(len(text), b + _AROUND), out[-1][1] if out else 0
        # what earlier windows cover is not walked over again
        while a > done and _joined(text, a):
            a -= 1
        while done < b < len(text) and _joined(text, b):
            b += 1
        if out and a <= done:
            out[-1] = (out[-1][0], max(b, done))
        else:
            out.append((a, b))
    return out


def _joined(text: str, at: int) -> bool:
    """Whether an identifier may run on over position ``at``: no white space beside it, or white space between parts of a number."""
    left, right = text[at - 1], text[at]
    if left.isspace():
        return right in _NUMERIC and at > 1 and text[at - 2] in _NUMERIC
    return not right.isspace() or (left in _NUMERIC and at + 1 < len(text) and text[at + 1] in _NUMERIC)


def _sign_view(part: Mapped) -> Mapped:
    """``part`` with disguised dots and ``@``; a bare word for ``@`` counts only before a domain whose dot was disguised too."""
    view = Mapped(part.text)
    view.start, view.end = list(part.start), list(part.end)
    view.rewrite(_DOT_RE, lambda m: ".")
    start, end = view.start, view.end

    def sign(m):
        if m[0].strip()[0] in "[({<":
            return "@"
        d = _DOMAIN.match(m.string, m.end())
        return "@" if d and end[d.end() - 1] - start[d.start()] > len(d[0]) else None

    view.rewrite(_AT_RE, sign)
    return view


def disguised_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers that only show after rewriting and overlap no plain one, in source offsets.

    A hit must contain a rewritten character: what the plain scan rejected stays rejected.
    """
    found: dict[tuple[int, int, str], None] = {}
    for a, b in _neighbourhoods(text):
        part = Mapped(text[a:b], a)
        part.rewrite(_GLYPH_RE, lambda m: _GLYPHS.get(m[0], ""))
        part.rewrite(_RUN, lambda m: _spelled(m[0]) if len(_WORD_DIGIT.findall(m[0])) > 1 else None)
        views = [part, _sign_view(part)] if _AT_RE.search(part.text) or _DOT_RE.search(part.text) else [part]
        for view in views:
            for kind, find in _FINDERS.items():
                if view is not part and kind not in ("email", "ip"):
                    continue
                for s, e in find(view.text):
                    if kind == "email" and view is not part and not re.search(r"\.[A-Za-z]{2,}$", view.text[s:e]):
                        continue
                    src = view.span(s, e)
                    if text[src[0] : src[1]] != view.text[s:e]:
                        found[(*src, kind)] = None
    taken = sorted((s, e) for s, e, _ in base)
    out: list[tuple[int, int, str]] = []
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if all(e <= x or s >= y for x, y in taken) and all(e <= x or s >= y for x, y, _ in out):
            out.append((s, e, kind))
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def find_pii(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with ``base`` and ``added``: arrays of ``(kind, start, end)``, code points, end exclusive.

    ``base`` holds the plain identifiers, ``added`` the disguised ones; both are ordered by start, then
    kind. Null text counts as empty. Repeated rows come out once each. Input columns named ``base`` or
    ``added`` are replaced.
    """
    configure(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("base", "added")]
    span = "array<struct<kind:string,start:long,end:long>>"
    schema = with_fields(df, keep, f"base {span}, added {span}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            base, added = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                t = t or ""
                b = ordered(base_spans(t))
                base.append([{"kind": k, "start": s, "end": e} for s, e, k in b])
                added.append([{"kind": k, "start": s, "end": e} for s, e, k in ordered(disguised_spans(t, b))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, kind), pa.array(added, kind)], names=[*keep, "base", "added"])

    return df.select(*[df[c] for c in keep], df[text].alias(spare("__text", keep))).mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every identifier in ``text`` replaced by ``[KIND]``; overlapping spans are replaced as one, by the first one's kind. Null stays null."""
    configure(df.sparkSession)
    names = df.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                if t:
                    base = base_spans(t)
                    parts, last = [], 0
                    for s, e, k in ordered(base + disguised_spans(t, base)):
                        if s >= last:
                            parts += [t[last:s], f"[{k.upper()}]"]
                        last = max(last, e)
                    t = "".join(parts) + t[last:] if parts else t
                out.append(t)
            cols = list(batch.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, df.schema)
