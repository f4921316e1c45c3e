"""Personal data by a semi-Markov conditional random field over candidate segments.

A text is looked at in zones: runs of white-space-separated tokens with a digit or an at sign, and
one token on either side. A zone is cut into pieces (digit runs, letter runs, single other signs).
Segments of up to MAX_PIECES pieces are scored by features of the whole span (digit count, check
sum, octets, separators, group lengths, letters, what stands before and after), and a dynamic
program over the zone chooses boundaries and types jointly. Weights are learned by conditional
likelihood from a bounded sample of distinct zones: spans of the checked patterns are the labels,
zones without any teach what to leave alone, and variants of the spans (other separators, no plus
sign, spelled at signs) teach what the patterns miss.

The checked patterns (BASE) always stay; the field adds spans that overlap none of them.

Rows: null and empty texts have no spans. Repeated rows are each searched; null ids pass through.
`redact` carries all columns. A sample without any span gives a field that adds nothing. Texts are
searched whole; a zone as long as the text is allowed, and costs time in proportion to its length.

Scale: learning uses at most `sample` distinct zones, those of least hash; its weights are a few thousand
numbers. Searching is one pass without a shuffle.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as t

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]*"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
AROUND_AT = re.compile(r"[A-Za-z0-9._%+@-]+")
PIECE = re.compile(r"[0-9]+|[^\W\d_]+|\S")
AT_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+@-")
BESIDE = 40
MARK, SPACE = re.compile(r"[0-9@]|[\[(][Aa][Tt][\])]"), re.compile(r"\s")
BEFORE, AFTER = re.compile(rf"(?<!\S)\S{{1,{BESIDE}}}[ \t]\Z"), re.compile(rf"[ \t]\S{{1,{BESIDE}}}(?!\S)")
SPELLED_AT = re.compile(r"\[at\]|\(at\)", re.I)
MAX_PIECES, SAMPLE, ZONES = 24, 4000, 700


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(run: str) -> list[tuple[int, int]]:
    """What EMAIL finds, in time that grows with the length: a local part that no domain follows is read once."""
    out, at = [], 0
    while at < len(run):
        local = LOCAL.match(run, at).end()
        domain = DOMAIN.match(run, local) if local > at else None
        if domain:
            out.append((at, domain.end()))
        at = domain.end() if domain else local + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the checked patterns, by kind, then start."""
    out = []
    at = text.find("@")
    while at >= 0:
        left = at
        while left and text[left - 1] in AT_SIGNS:
            left -= 1
        run = AROUND_AT.match(text, left)
        out += [("email", left + a, left + b) for a, b in _emails(run.group())]
        at = text.find("@", run.end())
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Ranges of the text that can hold a segment: marked tokens with one token on either side, if that
    is at most BESIDE long and on the same line."""
    out: list[tuple[int, int]] = []
    end = 0
    for m in MARK.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        stop = SPACE.search(text, m.end())
        end = stop.start() if stop else len(text)
        if prior := BEFORE.search(text, max(0, a - BESIDE), a):
            a = prior.start()
        after = AFTER.match(text, end)
        b = after.end() if after else end
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _kind_of(c: str) -> str:
    return "^" if not c else "d" if "0" <= c <= "9" else "a" if c.isalpha() else "s" if c.isspace() else c if c in "+@().-" else "o"


def span_features(s: str, before: str, after: str) -> list[str]:
    digits = _digits(s)
    n, letters = len(digits), sum(c.isalpha() for c in s)
    at = "@" in s
    out = [f"n{min(n, 20)}", f"b{_kind_of(before)}", f"e{_kind_of(after)}", f"f{_kind_of(s[:1])}", f"l{_kind_of(s[-1:])}"]
    odd = "".join(sorted({c for c in s if not c.isalnum()}))
    out.append(f"s{odd[:6]}")
    out.append("letters" if letters else "plain")
    if letters and n and not at:
        out.append("mixed")
    if not letters:
        groups = "-".join(str(len(g)) for g in re.findall(r"[0-9]+", s))
        out.append(f"g{groups[:24]}")
        out.append(f"many{min(groups.count('-'), 6)}")
        if 13 <= n <= 19:
            out.append(f"check{luhn(digits)}")
        if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s):
            out.append(f"octets{all(int(p) <= 255 for p in s.split('.'))}")
        if 9 <= n <= 15:
            out.append(f"dial{'+' if s[0] == '+' else '('  if '(' in s else 'x'}{groups.count('-') > 0}")
    if at:
        out.append(f"mail{bool(EMAIL.fullmatch(s))}")
        out.append(f"ats{min(s.count('@'), 2)}")
    elif SPELLED_AT.search(s):
        out.append(f"spelled{bool(re.fullmatch(r'[A-Za-z0-9._%+-]+ ?[(]at[)] ?[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', s.replace('[', '(').replace(']', ')')))}")
    if s.count("(") != s.count(")"):
        out.append("open")
    if " " in s or "\n" in s:
        out.append("gap" if "\n" not in s else "line")
    return out


def segments(zone: str) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The number of pieces, and (first piece, piece after the last, start, end) of the candidates: with
    an at sign, or with four digits and three dots, or with seven digits, and no line break."""
    pieces = [m.span() for m in PIECE.finditer(zone)]
    n = len(pieces)
    digits, ats, dots = [0], [0], [0]
    for a, b in pieces:
        s = zone[a:b]
        digits.append(digits[-1] + (b - a if "0" <= s[0] <= "9" else 0))
        ats.append(ats[-1] + (s == "@" or (s.lower() == "at" and 0 < a and zone[a - 1] in "[(")))
        dots.append(dots[-1] + (s == "."))
    out = []
    for i in range(n):
        for j in range(i + 1, min(n, i + MAX_PIECES) + 1):
            if j - i > 1 and "\n" in zone[pieces[j - 2][1] : pieces[j - 1][0]]:
                break
            d = digits[j] - digits[i]
            if ats[j] > ats[i] or d >= 7 or (d >= 4 and dots[j] - dots[i] >= 3):
                out.append((i, j, pieces[i][0], pieces[j - 1][1]))
    return n, out


class Field:
    """Weights of each feature for each kind."""

    def __init__(self):
        self.weights: dict[str, list[float]] = {}
        self.bias = [-4.0] * len(KINDS)

    def scores(self, features: list[str]) -> list[float]:
        total = list(self.bias)
        get = self.weights.get
        for f in features:
            w = get(f)
            if w:
                for k in range(len(KINDS)):
                    total[k] += w[k]
        return total

    def decode(self, text: str, a: int, b: int) -> list[tuple[str, int, int]]:
        """The best segmentation of one zone."""
        zone = text[a:b]
        n, found = segments(zone)
        if not found:
            return []
        by_end: dict[int, list[tuple[int, float, int, int, int]]] = {}
        for i, j, x, y in found:
            s = self.scores(span_features(zone[x:y], text[a + x - 1 : a + x] if a + x else "", text[a + y : a + y + 1]))
            k = max(range(len(KINDS)), key=s.__getitem__)
            if s[k] > 0:
                by_end.setdefault(j, []).append((i, s[k], k, x, y))
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, s, k, x, y in by_end.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k, x, y)
        out, j = [], n
        while j:
            if back[j]:
                i, k, x, y = back[j]
                out.append((KINDS[k], a + x, a + y))
                j = i
            else:
                j -= 1
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 6, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """Conditional log-likelihood by stochastic gradient; an example is a zone with a space on either side, and its spans."""
        built = []
        for zone, spans in examples:
            n, found = segments(zone)
            gold = {(x, y): KINDS.index(k) for k, x, y in spans}
            if found and sum((x, y) in gold for _, _, x, y in found) == len(gold):
                built.append((n, [(i, j, span_features(zone[x:y], zone[x - 1 : x] if x else "", zone[y : y + 1]), gold.get((x, y))) for i, j, x, y in found]))
        if not any(g is not None for _, segs in built for *_, g in segs):
            self.bias = [-1e9] * len(KINDS)
            return
        square: dict[str, list[float]] = {}
        rng = random.Random(11)
        for _ in range(epochs):
            rng.shuffle(built)
            for n, segs in built:
                scored = [(i, j, self.scores(f), f, g) for i, j, f, g in segs]
                starts, ends = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
                for x in scored:
                    m = max(x[2])
                    x = (*x, m + math.log(sum(math.exp(v - m) for v in x[2])))
                    starts[x[0]].append(x)
                    ends[x[1]].append(x)
                ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
                for j in range(1, n + 1):
                    terms = [ahead[j - 1]] + [ahead[x[0]] + x[5] for x in ends[j]]
                    m = max(terms)
                    ahead[j] = m + math.log(sum(math.exp(v - m) for v in terms))
                for i in range(n - 1, -1, -1):
                    terms = [behind[i + 1]] + [behind[x[1]] + x[5] for x in starts[i]]
                    m = max(terms)
                    behind[i] = m + math.log(sum(math.exp(v - m) for v in terms))
                for i, j, s, f, g in scored:
                    for k in range(len(KINDS)):
                        slope = (g == k) - math.exp(min(0.0, ahead[i] + s[k] + behind[j] - ahead[n]))
                        if abs(slope) < 1e-4:
                            continue
                        for name in f:
                            w = self.weights.setdefault(name, [0.0] * len(KINDS))
                            q = square.setdefault(name, [1e-6] * len(KINDS))
                            step = slope - ridge * w[k]
                            q[k] += step * step
                            w[k] += rate * step / math.sqrt(q[k])


def _variants(kind: str, s: str, rng: random.Random) -> str:
    """Another way to write the span."""
    if kind == "email":
        return s.replace("@", rng.choice([" [at] ", "(at)", " (at) ", "[at]"]))
    d = _digits(s)
    if kind == "card":
        return rng.choice([" ", "-", "."]).join(d[k : k + 4] for k in range(0, len(d), 4))
    if kind == "phone" and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])
    return s


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE, most: int = ZONES) -> Field:
    """A field learned from at most `sample` zones of all texts, and of these at most `most` without a span."""
    field, rng = Field(), random.Random(5)
    marked = docs.where(F.col(text).rlike("[0-9@]"))

    def cut(batches):
        for batch in t.sliced(batches, "_text"):
            found = []
            for s in batch.column(batch.schema.get_field_index("_text")).to_pylist():
                # every zone of the text, with the sign before and after it; long ones teach nothing
                found += [s[max(a - 1, 0) : b + 1] for a, b in zones(s) if b - a <= 400]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["zone"])

    cuts = t.map_arrow(marked.select(F.col(text).alias("_text")), cut, "zone string").distinct().orderBy(F.xxhash64("zone"), "zone").limit(sample)
    rows = sorted(r.zone for r in cuts.collect())
    rng.shuffle(rows)
    with_spans = [(z, s) for z in rows if (s := base_spans(z))]
    without = [(z, []) for z in rows if not base_spans(z)]
    examples = []
    counts = dict.fromkeys(KINDS, 0)
    for zone, spans in with_spans:
        spans = sorted(spans, key=lambda x: x[1])
        if any(a[2] > b[1] for a, b in zip(spans, spans[1:])) or all(counts[k] >= most // 4 for k, _, _ in spans):
            continue
        for k, _, _ in spans:
            counts[k] += 1
        examples.append((zone, spans))
        if rng.random() < 0.5:
            out, last, moved = "", 0, []
            for k, a, b in spans:
                out += zone[last:a]
                new = _variants(k, zone[a:b], rng)
                moved.append((k, len(out), len(out) + len(new)))
                out, last = out + new, b
            examples.append((out + zone[last:], moved))
    field.learn(examples + without[:most])
    return field


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The spans of the checked patterns, and those that the field adds."""
    base = base_spans(text)
    added = []
    for a, b in zones(text):
        for k, x, y in field.decode(text, a, b):
            if not any(x < d and c < y for _, c, d in base):
                added.append((k, x, y))
    return base, added


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def _maybe(texts: pa.Array) -> np.ndarray:
    """Rows with a digit, an at sign or a bracketed at."""
    offsets, data = t.buffers(texts)
    marks = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57) | (data == 64) | (data == 40) | (data == 91))))
    return np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])


def search(docs: DataFrame, field: Field, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs with the counts of base spans, `base`, `spans` and `n_added`."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    source = docs.select(*carry, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches):
        for batch in t.sliced(batches, "_text"):
            texts = batch.column(batch.schema.get_field_index("_text"))
            n = batch.num_rows
            counts, base, spans, added = np.zeros((n, len(KINDS)), np.int64), [""] * n, [""] * n, np.zeros(n, np.int64)
            for r in _maybe(texts).tolist():
                old, new = find(texts[r].as_py(), held.value)
                for k, _, _ in old:
                    counts[r, KINDS.index(k)] += 1
                base[r], spans[r], added[r] = _joined(old), _joined(old + new), len(new)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(carry))], *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(base), pa.array(spans), pa.array(added)], [*carry, *[f"n_{k}" for k in KINDS], "base", "spans", "n_added"])

    return t.map_arrow(source, run, f"{kinds}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, n_added long")


def redact(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with all columns; each span of the text is replaced by its kind in angle brackets."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in t.sliced(batches, text):
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            for r in _maybe(batch.column(at)).tolist():
                base, added = find(texts[r], held.value)
                out, last = [], 0
                for k, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                    if a >= last:
                        out += [texts[r][last:a], f"<{k}>"]
                    last = max(last, b)
                texts[r] = "".join(out) + texts[r][last:] if out else texts[r]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

    return t.map_arrow(docs, run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: counts and digest of the checked patterns, and all spans."""
    docs = t.table(spark, sf_dir, "documents")
    found = search(docs, fit(docs))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
