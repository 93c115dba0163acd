"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole segments of up to ``MOST_PIECES`` pieces (words and single marks): each candidate segment has features of
the span as a whole and of the words around it, every kind weighs them, and dynamic programming over the bounded segments finds
the best boundaries and kinds together. A segment that holds neither a digit, an ``@`` nor a bracketed "at" can't be personal
data, so all else is outside with score zero and the search runs around these places only, which gives the same result as over
the whole text. Training maximises the conditional likelihood on sentences that a seeded generator makes with known spans; no
document is read for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField

from skytally.llm.common import blank_null, give_back, mapped, sliced

BASE = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans with one start are listed.
KINDS = (*BASE, "secret")
MOST_PIECES = 10

_TRIGGER = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if k % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping by kind; a match whose check fails is dropped.

    An e-mail is looked for from each ``@`` to the left, and runs of digits are entered at their first digit alone, so the time
    is linear in the text.
    """
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) < 4 and int(q or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGITS.findall(m[0])) <= 15]
    return found


_PIECE = re.compile(r"[^\W_][\w@%+/:-]*(?:\.[\w@%+/:-]+)*|\+[0-9]+(?:[.-][0-9]+)*|[^\s]")
_CUES = {
    "mail": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "cell"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "key", "apikey", "api_key", "credential"),
    "number": ("version", "page", "section", "chapter", "order", "no", "isbn", "invoice", "year", "id", "part"),
}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws}
_WHOLE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "local_email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+"),
    "veiled_email": re.compile(r"[\w.%+-]+ ?[\[({] ?at ?[\])}] ?[\w-]+( ?([\[({] ?dot ?[\])}]|\.) ?[\w-]+)+", re.I),
    "ip": re.compile(r"([0-9]{1,3}\.){3}[0-9]{1,3}"),
    "ip6": re.compile(r"([0-9a-fA-F]{1,4}:){4,7}[0-9a-fA-F]{1,4}"),
    "date": re.compile(r"[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}"),
    "time": re.compile(r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?"),
    "version": re.compile(r"v?[0-9]{1,3}(\.[0-9]{1,3}){1,2}"),
    "groups": re.compile(r"\(? ?[0-9]{2,4} ?\)?([ .-]?[0-9]{2,4}){2,4}"),
    "plus": re.compile(r"\+[0-9].*"),
    "aws": re.compile(r"(AKIA|ASIA)[A-Z0-9]{12,}"),
    "prefixed": re.compile(r"(sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{12,}"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
    "long_mixed": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{16,}"),
    "number": re.compile(r"[0-9]+"),
    "decimal": re.compile(r"[0-9]+\.[0-9]+"),
    "word_digits": re.compile(r"[A-Za-z]+-?[0-9]{1,4}"),
}


def pieces_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _PIECE.finditer(text, start, end)]


@cache
def _bucket(name: str, n: int) -> str:
    return f"{name}={n}"


def features(text: str, pieces: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the segment of pieces i to j (exclusive) as a whole, and of the pieces beside it."""
    span = text[pieces[i][0] : pieces[j - 1][1]]
    digits = "".join(_DIGITS.findall(span))
    n = len(digits)
    f = ["bias", _bucket("pieces", j - i)]
    f += ["whole " + k for k, e in _WHOLE.items() if e.fullmatch(span)]
    f.append(_bucket("digits", 0 if not n else 1 if n < 7 else 2 if n < 10 else 3 if n < 14 else 4 if n < 20 else 5))
    if 13 <= n <= 19 and n >= len(span) - 4:
        f.append("luhn" if luhn(digits) else "no luhn")
    letters = sum(c.isalpha() for c in span)
    f.append("letters" if letters else "no letters")
    if letters and " " in span:
        f.append("letters and spaces")
    if not span[-1].isalnum():
        f.append("ends in a mark")
    if not (span[0].isalnum() or span[0] in "+("):
        f.append("starts with a mark")
    if span.count("(") != span.count(")"):
        f.append("bracket is open")
    for name, k in (("left", i - 1), ("right", j)):
        if 0 <= k < len(pieces):
            beside = text[slice(*pieces[k])]
            if _DIGITS.search(beside):
                f.append(f"{name} has digits")
            if beside in "=\"':([{":
                f.append(f"{name} {beside}")
            if beside == "+":
                f.append(f"{name} plus")
    for k in range(max(0, i - 3), i):
        if cue := _CUE_OF.get(text[slice(*pieces[k])].lower()):
            f.append("cue " + cue)
    return f


def segments(text: str, pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Candidate segments: bounded, on one line, starting with a word, a plus or a bracket and ending in a word."""
    for i, (start, end) in enumerate(pieces):
        if not (text[start].isalnum() or text[start] in "+("):
            continue
        for j in range(i + 1, min(len(pieces), i + MOST_PIECES) + 1):
            last = pieces[j - 1]
            if "\n" in text[end : last[1]] or last[1] - start > 200 and j > i + 1:
                break
            if text[last[1] - 1].isalnum() and _TRIGGER.search(text, start, last[1]):
                yield i, j


class Field:
    """Weights by kind and feature, and by the kinds that follow each other; kind 0 is outside, one piece at a time."""

    def __init__(self, names: list[str]):
        self.index = {f: k for k, f in enumerate(names)}
        self.w = np.zeros((len(names), len(KINDS)))
        self.step = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scored(self, text: str, pieces: list[tuple[int, int]]) -> list[list[tuple[int, list[int], np.ndarray]]]:
        """By end: (start, features, scores by kind) of the candidates."""
        ends: list[list] = [[] for _ in range(len(pieces) + 1)]
        for i, j in segments(text, pieces):
            own = [k for f in features(text, pieces, i, j) if (k := self.index.get(f)) is not None]
            ends[j].append((i, own, self.w[own].sum(0)))
        return ends

    def best(self, text: str, pieces: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(first piece, end, kind) of the segments of the best labelling."""
        ends, n = self.scored(text, pieces), len(pieces)
        top = np.full((n + 1, len(KINDS) + 1), -np.inf)
        top[0, 0] = 0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            came = top[j - 1] + self.step[:, 0]
            top[j, 0], back[j, 0] = came.max(), (j - 1, int(came.argmax()))
            for i, _, score in ends[j]:
                came = top[i][:, None] + self.step[:, 1:]
                total = came.max(0) + score
                for y in np.flatnonzero(total > top[j, 1:]):
                    top[j, y + 1], back[j, y + 1] = total[y], (i, int(came[:, y].argmax()))
        j, y, out = n, int(top[n].argmax()), []
        while j:
            i, before = back[j, y]
            if y:
                out.append((i, j, y - 1))
            j, y = i, before
        return out[::-1]

    def gradient(self, ends: list, gold: dict[tuple[int, int], int], n: int, gw: np.ndarray, gs: np.ndarray) -> float:
        """Adds the log-likelihood's gradient for one labelled sentence; returns the log-likelihood."""
        kinds = len(KINDS) + 1
        ends = [[(i, own, self.w[own].sum(0)) for i, own, _ in x] for x in ends]
        fore, aft = np.full((n + 1, kinds), -np.inf), np.full((n + 1, kinds), -np.inf)
        fore[0, 0], aft[n] = 0, 0
        starts: list[list] = [[] for _ in range(n + 1)]
        for j, x in enumerate(ends):
            for i, own, score in x:
                starts[i].append((j, own, score))
        with np.errstate(divide="ignore"):
            for j in range(1, n + 1):
                fore[j, 0] = np.logaddexp.reduce(fore[j - 1] + self.step[:, 0])
                for i, _, score in ends[j]:
                    fore[j, 1:] = np.logaddexp(fore[j, 1:], np.logaddexp.reduce(fore[i][:, None] + self.step[:, 1:], 0) + score)
            for i in range(n - 1, -1, -1):
                aft[i] = self.step[:, 0] + aft[i + 1, 0]
                for j, _, score in starts[i]:
                    aft[i] = np.logaddexp(aft[i], np.logaddexp.reduce(self.step[:, 1:] + score + aft[j, 1:], 1))
        z, like = np.logaddexp.reduce(fore[n]), 0.0
        for j in range(1, n + 1):
            gs[:, 0] -= np.exp(fore[j - 1] + self.step[:, 0] + aft[j, 0] - z)
            for i, own, score in ends[j]:
                p = np.exp(fore[i][:, None] + self.step[:, 1:] + score + aft[j, 1:] - z)
                gs[:, 1:] -= p
                gw[own] -= p.sum(0)
        j, before = 0, 0
        own_of = {(i, j): own for j, x in enumerate(ends) for i, own, _ in x}
        while j < n:
            nxt = next(((k, y) for (i, k), y in gold.items() if i == j), None)
            if nxt:
                gs[before, nxt[1] + 1] += 1
                gw[own_of[j, nxt[0]], nxt[1]] += 1
                like += self.step[before, nxt[1] + 1] + self.w[own_of[j, nxt[0]], nxt[1]].sum()
                j, before = nxt[0], nxt[1] + 1
            else:
                gs[before, 0] += 1
                like += self.step[before, 0]
                j, before = j + 1, 0
        return float(like - z)


def sentence(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """An invented sentence with its spans."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(pick("an", "the", "ra", "to", "mi", "er", "ou", "sch", "que", "lo", "in", "st") for _ in range(rng.integers(1, 4)))
    mixed = lambda n, letters: "".join(letters[k] for k in rng.integers(0, len(letters), n - 1)) + digits(1)

    def card() -> str:
        body = pick("4", "5", "37") + digits(int(rng.integers(12, 15)))
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = pick("", "", " ", "-", ".")
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4))

    def item() -> tuple[str, str, str | None]:
        kind = pick(*KINDS, None, None, None)
        if kind == "email":
            plain = f"{word()}.{digits(2)}@{word()}{digits(1)}.{pick('com', 'org', 'example.com')}"
            veiled = f"{word()} {pick('[at]', '(at)', '[ at ]')} {word()} {pick('[dot]', '(dot)')} {pick('com', 'org')}"
            return pick("", "", "mail ", "email: ", "contact "), pick(plain, plain, veiled, f"{word()}@{word()}"), kind
        if kind == "ip":
            v4 = ".".join(str(rng.integers(1, 256)) for _ in range(4))
            v6 = ":".join(f"{rng.integers(1, 65536):x}" for _ in range(8))
            return pick("", "ip ", "host ", "server "), pick(v4, v4, v6), kind
        if kind == "card":
            return pick("", "", "card ", "visa "), card(), kind
        if kind == "phone":
            local = f"({digits(3)}) {digits(3)}-{digits(4)}"
            return pick("", "tel ", "call ", "phone: "), pick(f"+1 {local}", local, f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"), kind
        if kind == "secret":
            name = pick("password=", "password: ", 'token = "', "secret=", "api_key: ", "key ", "pwd=")
            value = pick(mixed(18, "0123456789abcdef"), mixed(40, "0123456789abcdef"), mixed(12, "abcdefghijkmnopqrstuvwxyz23456789"))
            aws = "AKIA" + mixed(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
            known = pick(aws, "ghp_" + mixed(24, "abcdefghijklmnopqrstuvwxyzABCDEF0123456789"))
            return ("", known, kind) if rng.random() < 0.5 else (name, value, kind)
        false_card = digits(16)
        if luhn(false_card):
            false_card = false_card[:-1] + str((int(false_card[-1]) + 1) % 10)
        plain = (
            false_card, false_card, f"{false_card[:4]} {false_card[4:8]} {false_card[8:12]} {false_card[12:]}",
            f"{pick(1999, 2004, 2021)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}", f"{digits(2)}.{digits(2)}%",
            f"${digits(3)}.{digits(2)}", f"page {digits(3)}", f"order {digits(8)}", f"{digits(4)}", f"{digits(1)}.", f"{rng.integers(0, 24)}:{rng.integers(10, 60)}", f"no {digits(6)}",
            f"isbn 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{word()}{digits(2)}", f"{digits(1)} {digits(2)} {digits(1)}", f"{word().upper()}-{digits(3)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"id {digits(12)}", f"@{word()}", f"part {digits(3)}-{digits(2)}",
        )
        return "", plain[rng.integers(len(plain))], None

    text, spans = "", []
    for _ in range(rng.integers(1, 4)):
        text += "".join(word() + pick(" ", " ", ", ") for _ in range(rng.integers(1, 6)))
        lead, value, kind = item()
        text += lead
        if kind:
            spans.append((len(text), len(text) + len(value), kind))
        text += value + pick(" ", " ", ". ", ", ") if not lead.endswith('"') else value + '" '
    return text + word() + ".", spans


@cache
def trained(sentences: int = 400, rounds: int = 10, seed: int = 11, ridge: float = 1e-3) -> Field:
    """Weights fitted by adaptive gradient ascent on generated sentences; the same on every run."""
    rng, data, names = np.random.default_rng(seed), [], {}
    while len(data) < sentences:
        text, spans = sentence(rng)
        pieces = pieces_of(text, 0, len(text))
        first, last = {p[0]: k for k, p in enumerate(pieces)}, {p[1]: k + 1 for k, p in enumerate(pieces)}
        if not all(a in first and b in last for a, b, _ in spans):
            continue
        gold = {(first[a], last[b]): KINDS.index(k) for a, b, k in spans}
        have = set(segments(text, pieces))
        if not set(gold) <= have:
            continue
        ends: list[list] = [[] for _ in range(len(pieces) + 1)]
        for i, j in have:
            own = [names.setdefault(f, len(names)) for f in features(text, pieces, i, j)]
            ends[j].append((i, own, None))
        data.append((ends, gold, len(pieces)))
    field = Field(list(names))
    sw, ss = np.full(field.w.shape, 1e-6), np.full(field.step.shape, 1e-6)
    for r in range(rounds):
        for part in np.array_split(rng.permutation(len(data)), max(1, len(data) // 25)):
            gw, gs = -ridge * field.w * len(part), -ridge * field.step * len(part)
            for k in part:
                ends, gold, n = data[k]
                field.gradient(ends, gold, n, gw, gs)
            sw, ss = sw + gw**2, ss + gs**2
            field.w += 0.7 * gw / np.sqrt(sw)
            field.step += 0.7 * gs / np.sqrt(ss)
    return field


def regions(text: str, around: int = 60) -> Iterator[tuple[int, int]]:
    """Stretches of text around what a segment must hold, cut at white space; those that touch are one."""
    start = end = None
    for m in _TRIGGER.finditer(text):
        if end is not None and m.end() <= end:
            continue
        lo, hi = max(0, m.start() - around), min(len(text), m.end() + around)
        while lo and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if end is not None and lo <= end:
            end = hi
        else:
            if end is not None:
                yield start, end
            start, end = lo, hi
    if end is not None:
        yield start, end


def all_spans(text: str, field: Field) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, is of the fixed patterns) in order; what the field finds is added where no fixed one overlaps."""
    if not _TRIGGER.search(text):
        return []
    base = base_spans(text)
    out = [(a, b, k, True) for a, b, k in base]
    covered = sorted((a, b) for a, b, _ in base)
    starts, reach = [a for a, _ in covered], []
    for _, b in covered:
        reach.append(max(b, reach[-1] if reach else 0))
    for lo, hi in regions(text):
        pieces = pieces_of(text, lo, hi)
        for i, j, y in field.best(text, pieces):
            a, b = pieces[i][0], pieces[j - 1][1]
            k = int(np.searchsorted(starts, b)) if starts else 0
            if not k or reach[k - 1] <= a:
                out.append((a, b, KINDS[y], False))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_spans(docs: DataFrame, *, text_col: str = "text", into: str = "pii_spans", field: Field | None = None) -> DataFrame:
    """``docs`` with a column of all spans (kind, start, end in code points, base), in order of start and kind.

    A null or empty text has none. Long texts take time in proportion; rows (repeated ones too), nulls and other columns stay as
    they are; an empty table stays empty. ``into`` must be a new name.
    """
    if into in docs.columns:
        raise ValueError(f"there is a column {into} already")
    field = field or trained()
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in sliced(batches):
            rows = [[{"kind": k, "start": a, "end": b, "base": own} for a, b, k, own in all_spans(t or "", field)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, into])
        give_back()

    return mapped(docs, work, [*docs.schema.fields, StructField(into, DataType.fromDDL(SPANS))])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed patterns by kind, base_sha256, all spans as text and their number, for every row.

    Null and empty texts have no spans; null ids and repeated rows keep their rows; other columns are ignored.
    """
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank_null(F.col("text")).alias("text"))).drop("text")
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def redact_text(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """Overlapping spans become one mark of the first one's kind."""
    out, at, end = [], 0, -1
    for start, stop, kind, _ in spans:
        if start >= end:
            out += [text[at:start], f"[{kind.upper()}]"]
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets, and the length column, if there is one, brought up to date.

    Null and empty texts, rows without personal data, repeated rows, null ids and all other columns, whatever their names, stay as
    they are; an empty table stays empty. Texts of any length are read whole.
    """
    field = field or trained()
    columns, at = docs.columns, docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t if not t or not (s := all_spans(t, field)) else redact_text(t, s) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)
        give_back()

    out = mapped(docs, work, docs.schema.fields)
    if length_col in columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)))
    return out
