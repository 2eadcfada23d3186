"""Personal data: fixed patterns, and a semi-Markov random field for the forms they miss.

The patterns' spans always stay. Around what they leave, tokens near digits,
``@`` and spelled-out addresses are cut into candidate segments of bounded
length; whole-span features score each segment for each type, and dynamic
programming picks boundaries and types together.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import columns_only, whole

#: Kinds in the order of the results; the last two have no base pattern.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Tokens of the longest entity, and tokens of context beside a trigger.
LONGEST = 14
CONTEXT = 4

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and without overlap for each kind, in order of kinds."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append(("email", start, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# -- the random field ------------------------------------------------------------------
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9@]|\bdot\b|\[at\]|\(at\)", re.IGNORECASE)
#: Words that announce an entity.
CUES = {
    "phone": {"tel", "phone", "call", "mobile", "fax", "telefon", "rufen", "cell"},
    "email": {"mail", "email", "contact", "write", "reach", "e"},
    "card": {"card", "visa", "mastercard", "credit", "karte"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "konto", "bank"},
    "number": {"order", "invoice", "version", "page", "id", "token", "key", "no", "number", "ref", "part"},
}
TYPES = ("email", "card", "phone", "ssn", "iban")


def _cue(word: str) -> str:
    for name, words in CUES.items():
        if word.lower() in words:
            return name
    return "digits" if word.isdigit() else "word" if word.isalpha() else word or "edge"


@lru_cache(maxsize=50_000)
def span_features(text: str, before: str, after: str) -> tuple[str, ...]:
    """Features of a whole candidate segment and the cues on either side."""
    digits = [c for c in text if c.isdigit()]
    groups = re.findall(r"[0-9]+", text)
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 12)}", re.sub(r"[A-Za-z]{2,}", "A", re.sub(r"\b[A-Za-z]\b", "a", text)))
    low = text.lower()
    letters = sum(c.isalpha() for c in text)
    n = len(digits)
    found = [
        "shape=" + re.sub(r"\s+", "_", shape)[:40],
        f"digits={min(n, 24)}",
        f"groups={min(len(groups), 7)}",
        "sizes=" + ",".join(str(min(len(g), 9)) for g in groups[:5]),
        f"before={before}", f"after={after}",
        f"before={before},digits={min(n, 24) // 2}",
        "letters" if letters else "no letters",
        "seps=" + "".join(sorted({c for c in text if not c.isalnum()})),
        "start=" + ("+" if text[0] == "+" else "(" if text[0] == "(" else "0" if text[0].isdigit() else "A"),
    ]
    if n >= 12:
        found.append(f"luhn={luhn(''.join(digits))},{16 <= n <= 19}")
    if re.search(r"(?:\bat\b|[\[(]at[\])]|@)", low):
        dots = len(re.findall(r"\bdot\b|\.", low))
        found.append(f"at,dots={min(dots, 3)}")
        tail = low.rsplit("dot" if "dot" in low else ".", 1)[-1].strip(" ])")
        found.append(f"top={tail in {'com', 'org', 'net', 'de', 'fr', 'es', 'edu', 'io'}}")
        found.append("bracketed at" if re.search(r"[\[(]at[\])]", low) else "bare at")
        found.append(f"words={min(len(re.findall('[a-z0-9]+', low)), 12)}")
    if re.match(r"[a-z]{2}[0-9]{2}\b|[a-z]{2}[0-9]{2}[ 0-9]", low):
        size = len(re.sub("[^a-z0-9]", "", low))
        found.append(f"country,{15 <= size <= 34},{min(max(len(g) for g in groups), 9) // 3}")
    return tuple(found)


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Token ranges that may be an entity: within the bound, with edges that entities have."""
    kind = [text[s] for s, _ in tokens]
    out = []
    for i, c in enumerate(kind):
        if not (c.isalnum() or c in "+("):
            continue
        digits = words = 0
        for j in range(i, min(i + LONGEST, len(tokens))):
            s, e = tokens[j]
            if j > i and (s - tokens[j - 1][1] > 1 or "\n" in text[tokens[j - 1][1] : s]):
                break
            if kind[j].isdigit():
                digits += e - s
            w = text[s:e].lower()
            words += w in ("at", "dot") or kind[j] == "@"
            words += w == "at" and j > 0 and kind[j - 1] in "[("
            if kind[j].isalnum() and (digits >= 7 or words >= 2):
                # no entity ends or begins inside a run without a space
                inner = (s == e) or (e < len(text) and text[e].isalnum()) or (tokens[i][0] > 0 and text[tokens[i][0] - 1].isalnum())
                if not inner:
                    out.append((i, j + 1))
    return out


class Field:
    """Weights of features by type, and the dynamic programme over segments."""

    def __init__(self) -> None:
        self.weights: dict[str, np.ndarray] = {}

    def segments(self, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, tuple[str, ...]]]]:
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        segs = []
        for i, j in candidates(text, tokens):
            s, e = tokens[i][0], tokens[j - 1][1]
            words = [text[a:b] for a, b in tokens[max(0, i - 3) : i] if text[a].isalnum()]
            before = _cue(words[-1]) if words else "edge"
            if before == "word" and len(words) > 1 and _cue(words[-2]) not in ("word", "digits"):
                before = _cue(words[-2])
            after = _cue(text[slice(*tokens[j])]) if j < len(tokens) else "edge"
            segs.append((i, j, span_features(text[s:e], before, after)))
        return tokens, segs

    def scores(self, segs: list) -> np.ndarray:
        zero = np.zeros(len(TYPES))
        return np.array([sum((self.weights.get(f, zero) for f in feats), zero) - 1.0 for _, _, feats in segs]).reshape(-1, len(TYPES))

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best cut of the text into entities and single tokens outside."""
        tokens, segs = self.segments(text)
        if not segs:
            return []
        s = self.scores(segs)
        ending: dict[int, list[int]] = {}
        for k, (_, j, _) in enumerate(segs):
            ending.setdefault(j, []).append(k)
        best = [0.0] * (len(tokens) + 1)
        back: list[tuple[int, int] | None] = [None] * (len(tokens) + 1)
        for at in range(1, len(tokens) + 1):
            best[at] = best[at - 1]
            for k in ending.get(at, ()):
                y = int(s[k].argmax())
                value = best[segs[k][0]] + float(s[k][y])
                if value > best[at]:
                    best[at], back[at] = value, (k, y)
        out, at = [], len(tokens)
        while at > 0:
            if back[at] is None:
                at -= 1
            else:
                k, y = back[at]
                i, j, _ = segs[k]
                out.append((TYPES[y], tokens[i][0], tokens[j - 1][1]))
                at = i
        return out[::-1]

    def learn(self, sentences: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 7, rate: float = 0.3, ridge: float = 1e-4) -> None:
        """Gradient ascent on the likelihood of the labelled cuts, sentence by sentence."""
        prepared = []
        for text, truth in sentences:
            tokens, segs = self.segments(text)
            named = {(s, e): TYPES.index(t) for t, s, e in truth}
            gold = np.zeros((len(segs), len(TYPES)))
            for k, (i, j, _) in enumerate(segs):
                y = named.get((tokens[i][0], tokens[j - 1][1]))
                if y is not None:
                    gold[k, y] = 1
            if segs:
                prepared.append((len(tokens), segs, gold))
            for _, _, feats in segs:
                for f in feats:
                    self.weights.setdefault(f, np.zeros(len(TYPES)))
        scale = {f: np.full(len(TYPES), 1e-3) for f in self.weights}
        for _ in range(rounds):
            for n, segs, gold in prepared:
                s = self.scores(segs)
                flat = np.logaddexp.reduce(s, axis=1)
                ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
                by_end: dict[int, list[int]] = {}
                by_start: dict[int, list[int]] = {}
                for k, (i, j, _) in enumerate(segs):
                    by_end.setdefault(j, []).append(k)
                    by_start.setdefault(i, []).append(k)
                for at in range(1, n + 1):
                    ahead[at] = np.logaddexp.reduce([ahead[at - 1], *[ahead[segs[k][0]] + flat[k] for k in by_end.get(at, ())]])
                for at in range(n - 1, -1, -1):
                    behind[at] = np.logaddexp.reduce([behind[at + 1], *[behind[segs[k][1]] + flat[k] for k in by_start.get(at, ())]])
                for k, (i, j, feats) in enumerate(segs):
                    p = np.exp(ahead[i] + behind[j] - ahead[n] + s[k])
                    g = gold[k] - p
                    if np.abs(g).max() > 1e-4:
                        for f in feats:
                            scale[f] += g * g
                            self.weights[f] += rate * g / np.sqrt(scale[f] + 0.1) - ridge * self.weights[f]


def labelled_sentences(n: int = 800, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Training sentences: invented prose around entities in uncommon forms, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    number = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("an", "er", "th", "re", "in", "on", "ca", "lo", "mi", "tu") for _ in range(int(rng.integers(1, 4))))

    def card(ok: bool) -> str:
        while True:
            d = pick("4", "5") + number(15)
            if luhn(d) == ok:
                return d

    def entity() -> tuple[str | None, str, str]:
        kind = int(rng.integers(12))
        if kind == 0:
            at, dot = pick((" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" (at) ", "."), (" [at] ", "."))
            return "email", pick("mail ", "contact ", "write to ", "", "reach ", "send it to ", "to "), f"{word()}{pick('', '.' + word(), number(2))}{at}{word()}{dot}{pick('com', 'org', 'de', 'net')}"
        if kind == 1:
            a, b, c = number(3), number(3), number(4)
            return "phone", pick("", "tel ", "call ", "phone: ", "Tel. "), pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {a} {b} {c}")
        if kind == 2:
            return "phone", pick("tel ", "call ", "phone: ", "mobile "), pick(f"{number(3)} {number(3)} {number(4)}", f"0{number(3)} {number(7)}", f"00{number(2)} {number(2)} {number(7)}", f"00 {number(2)} {number(2)} {number(7)}", f"00 {number(2)} {number(3)} {number(3)} {number(4)}")
        if kind == 3:
            return "ssn", pick("", "ssn ", "SSN: "), f"{number(3)}-{number(2)}-{number(4)}"
        if kind == 4:
            size = int(rng.integers(12, 26))
            b = number(size) if rng.integers(3) else pick("ABCD", "WXYZ", "MIDL", "BANK") + number(size - 4)
            tight = f"{pick('DE', 'FR', 'ES', 'GB', 'IT', 'NL', 'AT')}{number(2)}"
            return "iban", pick("", "iban ", "account ", "IBAN: "), tight + (b if rng.integers(2) else "".join(" " + b[i : i + 4] for i in range(0, size, 4)))
        if kind == 5:
            d = card(True)
            return "card", pick("", "card ", "visa "), pick(".", "/").join(d[i : i + 4] for i in range(0, 16, 4))
        if kind == 6:
            return None, pick("", "card ", "order ", "id "), card(False)
        if kind == 7:
            return None, pick("", "order ", "invoice ", "ref "), pick(number(8), number(10), number(12), f"{number(4)}-{number(6)}")
        if kind == 8:
            return None, pick("", "on "), pick(f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{number(4)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}")
        if kind == 9:
            return None, 'token = "', "".join(pick(*"0123456789abcdef") for _ in range(40)) + '"'
        if kind == 10:
            return None, pick("version ", "page ", ""), pick(f"{number(1)}.{number(1)}.{number(2)}", f"{number(3)}-{number(3)}", f"{number(3)}.{number(3)}.{number(3)}", f"{number(6)} {number(6)}")
        return None, "", pick("look at the dot", "at noon a dot and a dot", f"{number(2)} {number(2)} {number(2)} {number(2)} {number(2)}")

    out = []
    for _ in range(n):
        text, truth = " ".join(word() for _ in range(int(rng.integers(1, 5)))) + " ", []
        for _ in range(int(rng.integers(1, 3))):
            kind, lead, value = entity()
            text += lead
            if kind:
                truth.append((kind, len(text), len(text) + len(value)))
            text += value + pick(" ", ", ", ". ", " and ") + " ".join(word() for _ in range(int(rng.integers(1, 4)))) + " "
        out.append((text, truth))
    return out


def islands(text: str, triggers: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of text around triggers, wide enough for any entity there."""
    reach = 80
    start = end = None
    for t in triggers:
        if end is not None and t - reach <= end:
            end = t + reach
            continue
        if end is not None:
            yield max(start, 0), min(end, len(text))
        start, end = t - reach, t + reach
    if end is not None:
        yield max(start, 0), min(end, len(text))


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Entities of the field that touch no base span."""
    triggers = [m.start() for m in _TRIGGER.finditer(text)]
    if not triggers:
        return []
    taken = sorted((s, e) for _, s, e in base)
    starts, upto = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out = []
    for s, e in islands(text, triggers):
        while s > 0 and not text[s - 1].isspace() and text[s].isalnum():
            s -= 1
        while e < len(text) and not text[e].isspace() and text[e - 1].isalnum():
            e += 1
        part = list(text[s:e])
        for a, b in taken[bisect_right(upto, s) : bisect_left(starts, e)]:  # base spans are borders that no entity crosses
            if b > s:
                part[max(a, s) - s : min(b, e) - s] = "\n" * (min(b, e) - max(a, s))
        out += [(k, a + s, b + s) for k, a, b in field.decode("".join(part))]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


@lru_cache(maxsize=1)
def trained_field() -> Field:
    """The field of the built-in sentences, trained once in a driver."""
    field = Field()
    field.learn(labelled_sentences())
    return field


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per input row: id, counts of base kinds, ``base_sha256``, ``spans``.

    ``spans`` lists kind:start:end of all spans by kind (email, ip, card,
    phone, ssn, iban), then start, comma-joined; offsets are code points, ends
    exclusive. Base spans come from fixed patterns; the field adds spans that
    overlap none of them. Whole texts are read; work beyond the patterns is
    bounded by the number of triggers (digits, ``@``, spelled-out addresses).
    Null and empty texts have no spans. Repeated rows give repeated results,
    an empty table an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((field or trained_field()).weights)
    rows = columns_only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    base_kinds = KINDS[:4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field()
        model.weights = shared.value
        for b in batches:
            counts: list[list[int]] = [[] for _ in base_kinds]
            shas, spans = [], []
            for x in b.column(1):
                text = x.as_py()
                base = base_spans(text)
                for n, k in zip(counts, base_kinds):
                    n.append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + added_spans(text, base, model)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(n, pa.int64()) for n in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["id", *[f"n_{k}" for k in base_kinds], "base_sha256", "spans"],
            )

    schema = f"id {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
