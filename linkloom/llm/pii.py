"""Personal data by a semi-Markov conditional random field (operator 9).

Base kinds (email, ip, card, phone) are found by fixed patterns and always
stay. In the rest of each stretch around digits and at signs (also [at], [dot]), units
(letter-digit runs and single marks) form a lattice: every run of up to
``SPAN_UNITS`` units is a candidate segment of every kind, features of the
whole span score it, and dynamic programming picks boundaries and kinds
together; a unit outside every entity scores zero, so the lattice of a text
falls apart into its stretches exactly. Weights come from maximising the
conditional likelihood (forward-backward) over labelled sentences that
``training_sentences`` generates.

A candidate segment lies in a stretch, so what has neither a digit nor an at
sign (nor a bracketed at or dot) near it is none by definition; of all others
the model decides.

Defined cases: a null text is empty and has no spans; a null doc_id is kept; spans are code points,
end exclusive; repeated rows get equal spans; very long texts are read whole
in linear time; extra columns stay in ``redact`` and are not carried by
``digests``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import giving_back, kept, small_batches, table

KINDS = ["email", "ip", "card", "phone", "secret"]
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: Units of the longest candidate segment.
SPAN_UNITS = 12
#: Least probability of an added span, given its stretch.
LEAST_MARGINAL = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]")
_TOKEN = re.compile(r"\S+")
_SPACE = re.compile(r"\s")
_UNIT = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start, then kind."""
    out: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        if "." in text:
            # a match takes whole digit runs, so it never begins inside one
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            d = _only_digits(m.group()) if m.end() - m.start() >= 12 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m.group())) <= 15]
        out.sort(key=lambda s: (s[0], _ORDER[s[2]]))
    return out


# --- features of whole spans ------------------------------------------------

_CUES = {
    "secret": {"token", "key", "secret", "password", "passwd", "pwd", "api", "apikey", "auth", "bearer"},
    "phone": {"phone", "tel", "call", "fax", "mobile"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "credit", "iban"},
    "email": {"mail", "email", "contact", "write"},
}
_FEATURES = [
    "bias", "len<6", "len<12", "len<20", "len<33", "len<65", "len>64", "hex", "mixed", "turns4", "digits", "nd9-15", "nd12-19", "luhn", "plus", "at", "at_domain", "octets", "octet_range",
    "space", "quoted", "left_open", "right_open", "words", "marks", "phone_shape", "card_shape", "dots", "upper", "edge_mark", "unbalanced", *(f"cue_{k}" for k in KINDS),
]
_ID = {f: i for i, f in enumerate(_FEATURES)}
_HEX = re.compile(r"[0-9a-f]+\Z|[0-9A-F]+\Z")
_TURN = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_FOUR = re.compile(r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}\Z")
_MAIL = re.compile(r"[\w.%+-]+ ?(?:@|[\[(]at[\])]) ?[\w-]+(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]+)+\Z")
_CALL = re.compile(r"\(?[0-9]{2,4}\)?(?: - |[ .-])?[0-9]{3,4}(?: - |[ .-])[0-9]{3,4}\Z")
_FOURS = re.compile(r"[0-9]{4}(?:[ .-][0-9]{4}){2,3}\Z")


def span_features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that hold for text[start:end] as one entity."""
    s, on = text[start:end], [0]
    n = end - start
    on.append(_ID["len<6" if n < 6 else "len<12" if n < 12 else "len<20" if n < 20 else "len<33" if n < 33 else "len<65" if n < 65 else "len>64"])
    add = lambda f: on.append(_ID[f])
    digits = _only_digits(s)
    nd = len(digits)
    alnum = s.isalnum()
    if alnum and nd and _HEX.match(s) and nd < n:
        add("hex")
    if alnum and 0 < nd < n:
        add("mixed")
    if len(_TURN.findall(s)) >= 4:
        add("turns4")
    if nd == n:
        add("digits")
    if 9 <= nd <= 15:
        add("nd9-15")
    if 12 <= nd <= 19:
        add("nd12-19")
        if luhn(digits):
            add("luhn")
    if s[0] == "+":
        add("plus")
    if "@" in s or "at]" in s or "at)" in s:
        add("at")
        if _MAIL.match(s):
            add("at_domain")
    if _FOUR.match(s):
        add("octets")
        if all(int(p) <= 255 for p in s.split(".")):
            add("octet_range")
    if " " in s or "\n" in s:
        add("space")
    left, right = text[start - 1 : start], text[end : end + 1]
    if left in ("'", '"', "`") and left and left == right:
        add("quoted")
    if left and (left.isalnum() or left in "._-@+/"):
        add("left_open")
    if right and (right.isalnum() or right in "_-@/" or right == "." and text[end + 1 : end + 2].isalnum()):
        add("right_open")
    if not nd:
        add("words")
    if not alnum:
        add("marks")
    if _CALL.match(s):
        add("phone_shape")
    if _FOURS.match(s):
        add("card_shape")
    if "." in s:
        add("dots")
    if s.isupper():
        add("upper")
    if not s[-1].isalnum() or not (s[0].isalnum() or s[0] in "+("):
        add("edge_mark")
    if s.count("(") != s.count(")"):
        add("unbalanced")
    before = re.findall(r"[a-z]+", text[max(0, start - 24) : start].lower())[-2:]
    for kind, words in _CUES.items():
        if any(w in words for w in before):
            add(f"cue_{kind}")
    return on


def lattice(text: str, units: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Candidate segments (first unit, unit after the last) and their 0/1 feature rows."""
    segs, rows = [], []
    for i in range(len(units)):
        for j in range(i + 1, min(len(units), i + SPAN_UNITS) + 1):
            segs.append((i, j))
            rows.append(span_features(text, units[i][0], units[j - 1][1]))
    x = np.zeros((len(segs), len(_FEATURES)))
    for k, on in enumerate(rows):
        x[k, on] = 1
    return segs, x


def _log_sums(n: int, segs: list[tuple[int, int]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log sums; scores: segments x kinds."""
    total = np.logaddexp.reduce(scores, axis=1).tolist()
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    begins: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for (i, j), t in zip(segs, total):
        ends[j].append((i, t))
        begins[i].append((j, t))

    def add(terms: list[float]) -> float:
        m = max(terms)
        return m + math.log(sum(math.exp(t - m) for t in terms))

    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        a[j] = add([a[j - 1], *(a[i] + t for i, t in ends[j])])
    for i in range(n - 1, -1, -1):
        b[i] = add([b[i + 1], *(b[j] + t for j, t in begins[i])])
    return np.array(a), np.array(b)


def marginals(n: int, segs: list[tuple[int, int]], scores: np.ndarray) -> np.ndarray:
    """Probability of every segment with every kind."""
    a, b = _log_sums(n, segs, scores)
    ends = np.array(segs).reshape(-1, 2)
    return np.exp(a[ends[:, 0], None] + scores + b[ends[:, 1], None] - a[n])


def best_path(n: int, segs: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(segment number, kind number) of the best set of segments that do not overlap."""
    kind, top = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j) in enumerate(segs):
        ends[j].append(k)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ends[j]:
            s = best[segs[k][0]] + top[k]
            if s > best[j]:
                best[j], back[j] = s, k
    out, j = [], n
    while j:
        k = back[j]
        if k < 0:
            j -= 1
        else:
            out.append((k, kind[k]))
            j = segs[k][0]
    return out[::-1]


# --- training ----------------------------------------------------------------


def training_sentences(n: int = 260, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with the spans of their entities, and ones with look-alikes that are none."""
    r = random.Random(seed)
    words = "the of and in to report from was on page call about order line time with then data part note".split()
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = number(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def secret() -> tuple[str, str, str, str]:
        body = hexes(r.choice([24, 32, 40, 40, 64])) if r.random() < 0.7 else mixed(r.randint(20, 44))
        q = r.choice(['"', '"', "'", ""])
        return r.choice(["token", "key", "secret", "password", "api key"]) + r.choice([" = ", "=", ": "]) + q, body, q, "secret"

    def entity() -> tuple[str, str, str, str]:
        k = r.choice(["secret", "secret", "email", "ip", "card", "phone"])
        if k == "secret":
            return secret()
        if k == "email":
            return r.choice(["mail ", "", "contact "]), f"{r.choice(words)}{number(r.choice([0, 2]))}{r.choice(['@', ' [at] ', ' (at) '])}{r.choice(words)}{r.choice(['.', ' [dot] '])}{r.choice(['org', 'com'])}", "", k
        if k == "ip":
            return r.choice(["", "host "]), ".".join(str(r.randint(1, 255)) for _ in range(4)), "", k
        if k == "card":
            c = card()
            return r.choice(["", "card "]), c if r.random() < 0.5 else r.choice(" .-").join(c[i : i + 4] for i in range(0, 16, 4)), "", k
        return r.choice(["tel ", "phone ", "call "]), r.choice([f"+1 ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}{(dash := r.choice(['-', ' - ']))}{number(3)}{dash}{number(4)}"]), "", k

    def decoy() -> str:
        return r.choice([
            f"version {r.randint(1, 9)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", number(r.randint(1, 8)), f"{r.choice(words)}{r.randint(1, 99)}",
            f"CC BY {r.randint(1, 4)}.0", f"{number(3)},{number(3)}", f"https://{r.choice(words)}.com/{number(5)}", hexes(r.randint(4, 9)) + "1", f"{r.randint(300, 999)}.{number(3)}.{number(3)}.{number(3)}", f"@{r.choice(words)}", f"{r.choice(words)} (at) {r.choice(words)}", f"{number(2)}:{number(2)}", f"{number(16)}0", mixed(6) + "7", f"{number(4)}-{number(2)}-{number(2)}",
        ])

    out = []
    for _ in range(n):
        text, spans = r.choice(words), []
        for _ in range(r.randint(1, 3)):
            text += " " + r.choice(words) + r.choice([" ", " ", ", ", ". "])
            if r.random() < 0.55:
                pre, body, post, kind = entity()
                text += pre
                spans.append((len(text), len(text) + len(body), kind))
                text += body + post + r.choice(["", "", ".", ",", "!!", "%%%"])
            else:
                text += decoy() + r.choice(["", "", ".", ",", "###"])
        out.append((text + " " + r.choice(words), spans))
    return out


@lru_cache(maxsize=2)
def train(epochs: int = 30, rate: float = 0.3, l2: float = 0.02) -> np.ndarray:
    """Weights (features x kinds) by adaptive gradient ascent on the conditional log-likelihood."""
    data = []
    for text, spans in training_sentences():
        missed = set(spans)
        for units in stretches(text, []):
            segs, x = lattice(text, units)
            gold = np.zeros((len(segs), len(KINDS)))
            place = {(units[i][0], units[j - 1][1]): k for k, (i, j) in enumerate(segs)}
            for a, b, kind in spans:
                if (k := place.get((a, b))) is not None:
                    gold[k, _ORDER[kind]] = 1
                    missed.discard((a, b, kind))
            data.append((len(units), segs, x, x.T @ gold))
        if missed:
            raise ValueError(f"no candidate segment for {sorted(missed)} in {text!r}")
    w = np.zeros((len(_FEATURES), len(KINDS)))
    w[0] = -3
    seen = np.full_like(w, 1e-6)
    for _ in range(epochs):
        for n, segs, x, want in data:
            g = want - x.T @ marginals(n, segs, x @ w) - l2 * w / 10
            seen += g * g
            w += rate * g / np.sqrt(seen)
    return w


# --- decoding ----------------------------------------------------------------


def stretches(text: str, taken: list[tuple[int, int, str]]) -> list[list[tuple[int, int]]]:
    """Units of each stretch of white-space separated tokens that have a digit, an at sign or a bracketed at or dot.

    Neighbouring such tokens are one stretch, with the token that follows and
    the one before it, and so are stretches that then meet; the parts that
    ``taken`` covers are cut out.
    """
    edges: list[list[int]] = []
    pos, n = 0, len(text)
    while m := _SIGN.search(text, pos):
        start = m.start()
        low = edges[-1][1] if edges else 0
        while start > low and not text[start - 1].isspace():
            start -= 1
        e = _SPACE.search(text, m.start())
        end = e.start() if e else n
        if edges and start - edges[-1][1] <= 1:
            edges[-1][1] = end
        else:
            edges.append([start, end])
        pos = end
    tokens = edges
    edges = []
    for start, end in tokens:
        low = edges[-1][1] if edges else 0
        while start > low and text[start - 1].isspace():
            start -= 1
        while start > low and not text[start - 1].isspace():
            start -= 1
        if m := _TOKEN.search(text, end):
            end = m.end()
        if edges and start <= edges[-1][1]:
            edges[-1][1] = end
        else:
            edges.append([start, end])
    out, k = [], 0
    for start, end in edges:
        pieces, at = [], start
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        q = k
        while q < len(taken) and taken[q][0] < end:
            if taken[q][0] > at:
                pieces.append((at, taken[q][0]))
            at = max(at, taken[q][1])
            q += 1
        if at < end:
            pieces.append((at, end))
        for a, b in pieces:
            if _SIGN.search(text, a, b):
                out.append([m.span() for m in _UNIT.finditer(text, a, b)])
    return out


def added_spans(text: str, base: list[tuple[int, int, str]], w: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans that the model adds; none overlaps a base span."""
    out = []
    flat: list[tuple[int, int, str]] = []
    for s in base:  # base kinds may overlap one another
        if flat and s[0] < flat[-1][1]:
            flat[-1] = (flat[-1][0], max(flat[-1][1], s[1]), "")
        else:
            flat.append(s)
    for units in stretches(text, flat):
        n = len(units)
        segs, x = lattice(text, units)
        scores = x @ w
        path = best_path(n, segs, scores)
        if path:
            p = marginals(n, segs, scores)
            out += [(units[segs[k][0]][0], units[segs[k][1] - 1][1], KINDS[t]) for k, t in path if p[k, t] >= LEAST_MARGINAL]
    return out


def find_spans(text: str | None, w: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans, each by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    if not base and not _SIGN.search(text):
        return base, base
    more = added_spans(text, base, w)
    return base, sorted(base + more, key=lambda s: (s[0], _ORDER[s[2]])) if more else base


def _line(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


def digests(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    w = train()
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts: list[list[int]] = [[], [], [], []]
            shas, lines = [], []
            for t in b.column("text").to_pylist():
                base, spans = find_spans(t, w)
                kinds = [k for _, _, k in base]
                for i in range(4):
                    counts[i].append(kinds.count(KINDS[i]))
                shas.append(hashlib.sha256(_line(base).encode()).hexdigest())
                lines.append(_line(spans))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(lines, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Each stretch of spans replaced by the first span's kind in angle brackets."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all columns and rows stay. A null text stays null."""
    w = train()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("pii", "", dict)  # what another stage remembers goes
        for b in it:
            k = b.schema.get_field_index("text")
            texts = pa.array([mask(t, find_spans(t, w)[1]) for t in b.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == k else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return docs.mapInArrow(giving_back(run), docs.schema)


def op9_semi_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
