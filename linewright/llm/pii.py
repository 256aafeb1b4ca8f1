"""Personal data by a semi-Markov conditional random field.

Around every trigger (an at sign, a digit group) the text is cut into tokens. Segments of up to
``LONGEST`` tokens whose characters suit a kind are candidates; features of the whole segment
(checksums, digit counts, grouping, borders, cue words before it) score it, and a dynamic program
over token positions and the kind of the segment before chooses borders and kinds jointly.
The weights are fitted by maximum likelihood (forward and backward sums over the same lattice) on
sentences that :func:`examples` makes.

Base spans, which fixed patterns define, always stay: they are found in the whole text, and a
chosen segment that overlaps one gives way to it.

Defined results: null and empty texts hold nothing; a text of any length is searched whole; repeated
rows each get their answer; of segmentations that tie the one with the earlier kind in ``STATES`` is
taken; an empty table gives no row. Input
columns named like an output column give way to it.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from linewright.llm.common import add_columns, field, take_turn

KINDS = ("email", "ip", "card", "phone")
#: Most tokens of a segment; characters around a trigger that are looked at; borders that one lattice covers.
LONGEST, AROUND, STEP = 24, 64, 2048

# The base patterns. Look-behinds and possessive repeats only save retries that cannot match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """From at sign to at sign: the local part is the run before it, as far as no earlier match holds it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if any(c in text for c in "0123456789"):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 if len(p) < 9 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_TRIGGER = re.compile(r"@|[(\[]at[)\]]|[0-9][\x20().-]{0,2}[0-9][\x20().-]{0,2}[0-9]", re.I)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_AT, _DOT = re.compile(r"@|\x20?[(\[]at[)\]]\x20?", re.I), re.compile(r"\.|\x20?[(\[]dot[)\]]\x20?", re.I)
_MAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*)(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]+)+", re.I)
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
_TAIL = re.compile(r"\x20?[A-Za-z0-9-]*+(?:(?:\.|\x20?[(\[][Dd][Oo][Tt][)\]]\x20?)[A-Za-z0-9-]++)*+")
_GROUPS = re.compile(r"[0-9]+")
#: Cue words, by kind; the last row speaks against all.
CUES = {
    "email": ("email", "mail", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "dirección", "adresse"),
    "card": ("card", "visa", "credit", "cc", "mastercard", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "teléfono", "telefon", "téléphone"),
    "none": ("version", "isbn", "order", "invoice", "no", "id", "ref", "page", "section", "v", "token", "password"),
}
_CUE_OF = {w: k for k, words in CUES.items() for w in words}


def features(kind: str, text: str, a: int, b: int) -> list[str]:
    """Names of the features of the whole segment text[a:b] as ``kind``."""
    s = text[a:b]
    before, after = text[a - 1 : a], text[b : b + 1]
    cue = next((_CUE_OF[w] for w in reversed(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, a - 24) : a].lower())[-2:]) if w in _CUE_OF), "")
    out = ["any"]
    if cue:
        out.append("cue own" if cue == kind else "cue none" if cue == "none" else "cue other")
    if before.isalnum() or before in ("@", "+", "%", "_") or (before in (".", "-") and text[a - 2 : a - 1].isalnum() and a >= 2):
        out.append("cut left")
    if after.isalnum() or after in ("@", "_") or (after in (".", "-") and text[b + 1 : b + 2].isalnum()):
        out.append("cut right")
    if kind == "email":
        out.append("plain" if "@" in s else "spelt")
        out.append("ends in letters" if s[-1].isalpha() else "ends in digits")
    else:
        d, groups = _digits(s), [len(g) for g in _GROUPS.findall(s)]
        if kind == "ip":
            out.append("parts fit" if all(len(g) <= 3 and int(g) <= 255 for g in s.split(".")) else "parts too large")
        elif kind == "card":
            out += ["luhn" if luhn(d) else "no luhn", "16" if len(d) == 16 else f"{len(d)} digits" if len(d) in (13, 14, 15) else "other length", "even groups" if len(groups) == 1 or groups[:-1] == [4] * (len(groups) - 1) else "uneven groups"]
        else:
            out += ["plus" if s[0] == "+" else "bracket" if s[0] == "(" else "bare", "one group" if len(groups) == 1 else "3-3-4" if groups[-3:] == [3, 3, 4] and len(groups) <= 4 else "groups", "many" if 9 <= len(d) <= 12 else "few" if len(d) < 9 else "most"]
            if s.count(".") >= 3:
                out.append("dots")
    return [f"{kind} {x}" for x in out]


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches around the triggers, joined where they meet; none ends inside a candidate.

    Every three digits of a number are a trigger; around an at sign the whole address is taken in, however long.
    """
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = m.start() - AROUND, m.end() + AROUND
        if not text[m.start()].isdigit():
            left = m.start() - (text[m.start() - 1 : m.start()] == " ")
            while left > 0 and text[left - 1] in _LOCAL:
                left -= 1
            a, b = min(a, left), max(b, _TAIL.match(text, m.end()).end())
        a, b = max(0, a), min(len(text), b)
        while out and a <= out[-1][1]:
            before = out.pop()
            a, b = min(a, before[0]), max(b, before[1])
        out.append((a, b))
    return out


def lattice(text: str, start: int, end: int) -> tuple[list[int], dict[int, list[tuple[int, str, list[str]]]]]:
    """Token borders, and by end border the candidates (start border, kind, features)."""
    borders = [start] + [m.end() for m in _TOKEN.finditer(text, start, end)]
    place = {p: k for k, p in enumerate(borders)}
    arcs: dict[int, list] = defaultdict(list)

    def add(kind: str, a: int, b: int) -> None:
        if a in place and b in place and 0 < place[b] - place[a] <= LONGEST:
            arcs[place[b]].append((place[a], kind, features(kind, text, a, b)))

    for m in _AT.finditer(text, start, end):
        left, a = [], m.start()
        while a > start and text[a - 1] in _LOCAL and len(left) < LONGEST:
            a -= 1
            if a in place and text[a].isalnum():
                left.append(a)
        right, b = [], m.end()
        while (part := re.compile(r"[A-Za-z0-9-]+").match(text, b, end)) and len(right) < LONGEST:
            right.append(part.end())
            dot = _DOT.match(text, part.end(), end)
            if not dot:
                break
            b = dot.end()
        for a in left:
            for b in right[1:]:
                if _MAIL.fullmatch(text, a, b):
                    add("email", a, b)
    for k, a in enumerate(borders[:-1]):
        if not (text[a].isdigit() and text[a].isascii() or text[a] in "+("):
            continue
        n = 0
        for b in borders[k + 1 : k + 1 + LONGEST]:
            piece = text[borders[place[b] - 1] : b]
            if not (piece.isdigit() and piece.isascii()):
                if len(piece) > 1 or piece not in " ().-+" or (piece == "+" and b > a + 1):
                    break
                continue
            n += len(piece)
            if n > 19:
                break
            s = text[a:b]
            if s.count(".") == 3 and re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", s):
                add("ip", a, b)
            if 13 <= n and re.fullmatch(r"[0-9](?:[\x20-]?[0-9])+", s):
                add("card", a, b)
            if 7 <= n <= 15 and _NUMBER.fullmatch(s):
                add("phone", a, b)
    return borders, arcs


def _score(w: dict[str, float], kind: str, names: list[str], before: str, touching: bool) -> float:
    return sum(w.get(x, 0.0) for x in names) + (w.get(f"{before}>{kind}", 0.0) if touching else 0.0)


STATES = ("none", *KINDS)


def decode(text: str, start: int, end: int, w: dict[str, float], step: int = STEP) -> list[tuple[str, int, int]]:
    """The best segmentation: V[j][y], the best score of a segmentation up to border j whose last segment has kind y.

    The lattice is made for ``step`` borders at a time, with the ``LONGEST`` before them that their candidates may
    begin at; states go on from one to the next. A state holds its segments as a chain (chain before, segment).
    """
    borders = [start] + [m.end() for m in _TOKEN.finditer(text, start, end)]
    n = len(borders)
    best: dict[int, dict[str, tuple]] = {0: {"none": (0.0, None)}}
    for first in range(1, n, step):
        low, stop = max(0, first - LONGEST), min(first + step, n)
        # One border more than is asked for: an address may look complete where its text is cut.
        _, arcs = lattice(text, borders[low], borders[min(stop, n - 1)])
        if not arcs:
            top = max((best[first - 1][s] for s in STATES if s in best[first - 1]), key=lambda x: x[0])
            best = {j: states for j, states in best.items() if j >= stop - LONGEST} | {j: {"none": top} for j in range(max(first, stop - LONGEST), stop)}
            continue
        for j in range(first, stop):
            before = best[j - 1]
            here = best[j] = {"none": max((before[s] for s in STATES if s in before), key=lambda x: x[0])}
            for i, kind, names in arcs.get(j - low, ()):
                own, states = _score(w, kind, names, "", False), best[low + i]
                for y in STATES:
                    if y in states:
                        s = states[y][0] + own + (w.get(f"{y}>{kind}", 0.0) if y != "none" else 0.0)
                        if kind not in here or s > here[kind][0]:
                            here[kind] = (s, (states[y][1], (kind, borders[low + i], borders[j])))
            best.pop(j - LONGEST, None)
    chain, out = max((best[n - 1][s] for s in STATES if s in best[n - 1]), key=lambda x: x[0])[1], []
    while chain:
        chain, segment = chain
        out.append(segment)
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _expected(borders: list[int], arcs: dict, w: dict) -> dict[str, float]:
    """Expected feature counts under the model: forward and backward sums over the lattice."""
    n = len(borders)
    alpha, beta = [dict.fromkeys(STATES, -math.inf) for _ in range(n)], [dict.fromkeys(STATES, -math.inf) for _ in range(n)]
    alpha[0]["none"] = 0.0
    steps = []
    for j in range(1, n):
        for y in STATES:
            if alpha[j - 1][y] > -math.inf:
                alpha[j]["none"] = _add(alpha[j]["none"], alpha[j - 1][y])
                steps.append((j - 1, y, j, "none", 0.0, ()))
        for i, kind, names in arcs.get(j, ()):
            own = _score(w, kind, names, "", False)
            for y in STATES:
                if alpha[i][y] > -math.inf:
                    extra = (f"{y}>{kind}",) if y != "none" else ()
                    s = own + sum(w.get(x, 0.0) for x in extra)
                    alpha[j][kind] = _add(alpha[j][kind], alpha[i][y] + s)
                    steps.append((i, y, j, kind, s, (*names, *extra)))
    for y in STATES:
        beta[-1][y] = 0.0 if alpha[-1][y] > -math.inf else -math.inf
    for i, y, j, z, s, _ in reversed(steps):
        if beta[j][z] > -math.inf:
            beta[i][y] = _add(beta[i][y], s + beta[j][z])
    out: dict[str, float] = defaultdict(float)
    for i, y, j, z, s, names in steps:
        if names and beta[j][z] > -math.inf:
            p = math.exp(min(0.0, alpha[i][y] + s + beta[j][z] - beta[0]["none"]))
            for x in names:
                out[x] += p
    return out


def examples(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences made by rule, with their true spans; decoys look alike and are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("en", "ta", "lo", "ri", "sh", "ou", "me", "st")) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(good: bool) -> str:
        body = rng.choice("345") + num(14)
        check = next(c for c in "0123456789" if luhn(body + c) is True)
        d = body + (check if good else str((int(check) + rng.randint(1, 9)) % 10))
        return rng.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))))

    makers = {
        "email": lambda: rng.choice((f"{word()}.{num(2)}@{word()}.com", f"{word()}@{word()}.{word()}.org", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}[dot]net")),
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: card(True),
        "phone": lambda: rng.choice((f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{rng.randint(1, 99)}{num(9)}")),
    }
    decoys = (lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}", lambda: card(False), lambda: num(rng.randint(3, 8)), lambda: f"{rng.randint(256, 999)}.{num(3)}.{num(2)}.{num(2)}", lambda: f"order {num(10)}", lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", lambda: f"isbn {num(3)}-{num(1)}-{num(5)}-{num(3)}-{num(1)}", lambda: f"{word()}@{word()}", lambda: f'token = "{num(4)}ab{num(9)}cd{num(8)}"', lambda: num(13))
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 4))) + " "
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                if rng.random() < 0.4:
                    text += rng.choice(CUES[kind][:3]) + rng.choice((" ", ": "))
                made = makers[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made + rng.choice((" ", ". ", ", ", "\n"))
            else:
                text += rng.choice(decoys)() + " "
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=4)
def train(n: int = 240, epochs: int = 8, seed: int = 7) -> tuple[tuple[str, float], ...]:
    """Weights by stochastic gradient steps on the log-likelihood of the made sentences."""
    w: dict[str, float] = defaultdict(float)
    power: dict[str, float] = defaultdict(float)
    cases = []
    for text, spans in examples(n, seed):
        borders, arcs = lattice(text, 0, len(text))
        gold: dict[str, float] = defaultdict(float)
        true = {(k, a, b) for k, a, b in spans}
        seen = set()
        for j, found in arcs.items():
            for i, kind, names in found:
                if (kind, borders[i], borders[j]) in true:
                    seen.add((kind, borders[i], borders[j]))
                    for x in names:
                        gold[x] += 1
        if seen == true:
            cases.append((borders, arcs, gold))
    for _ in range(epochs):
        for borders, arcs, gold in cases:
            expected = _expected(borders, arcs, w)
            for x in {*gold, *expected}:
                g = gold.get(x, 0.0) - expected.get(x, 0.0) - 0.002 * w[x]
                power[x] += g * g
                w[x] += 0.5 * g / math.sqrt(power[x] + 1e-3)
    return tuple(sorted(w.items()))


def find(text: str, w: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    if not text or not _TRIGGER.search(text):
        base = base_spans(text) if text else []
        return base, base
    base = base_spans(text)
    chosen = [x for a, b in windows(text) for x in decode(text, a, b, w)]
    taken = sorted((a, b) for _, a, b in base)
    ends = []
    top = 0
    for _, b in taken:
        top = max(top, b)
        ends.append(top)
    extra, last = [], -1
    for kind, a, b in sorted(chosen, key=lambda x: (x[1], x[2])):
        k = bisect_left(taken, (b, 0)) - 1
        if (k < 0 or ends[k] <= a) and a >= last:
            extra.append((kind, a, b))
            last = b
    return base, sorted([*base, *extra], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_pii(docs: DataFrame, *, text: str = "text", columns: list[str] | None = None, redact: bool = False) -> DataFrame:
    """``docs`` (or its ``columns``) with base_spans and pii_spans: arrays of (kind, start, end) in code points.

    With ``redact`` the column ``text`` comes back with every span replaced by <KIND>.
    """
    weights = train()

    def fn(batches):
        take_turn("pii")
        w = dict(weights)
        for batch in batches:
            base, spans, texts = [], [], []
            for raw in batch.column(text).to_pylist():
                few, every = find(raw or "", w)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in few])
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in every])
                if redact:
                    texts.append(redacted(raw, every))
            yield batch, [pa.array(base, _SPAN), pa.array(spans, _SPAN)] + ([pa.array(texts, pa.string())] if redact else [])

    keep = columns if columns is not None else docs.columns
    narrow = docs.select(*dict.fromkeys([*keep, text]))
    fields = [field("base_spans", "array<struct<kind:string,start:int,end:int>>"), field("pii_spans", "array<struct<kind:string,start:int,end:int>>")] + ([field(text, "string")] if redact else [])
    return add_columns(narrow, fn, fields, keep)


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """``text`` with each stretch that spans cover replaced by the kind of its first span."""
    if not spans:
        return text
    parts, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda x: (x[1], x[2])):
        if a >= end:
            parts += [text[at:a], f"<{kind.upper()}>"]
        end = max(end, b)
        at = end
    return "".join([*parts, text[at:]])
