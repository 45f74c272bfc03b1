"""Personal data and secrets by a skip-chain conditional random field over tokens.

Base rules (see ``base_spans``) find emails, addresses, cards and phones. Regions are the base spans and looser
candidates: runs of digits with separators that no rule accepts, written-out emails, long keys of letters and
digits. The field's sites are the tokens (runs of anything but white space) of all regions and ``AROUND`` tokens
on either side; every other token is no personal data. A site's label is none or one of the kinds, ``secret``
among them. Neighbouring tokens share a chain potential. Tokens that repeat, and tokens of regions that resemble
each other (equal digits, equal last digits, equal mailbox, equal key), share a hub variable wherever they stand
in the document, to which each has a skip potential: any two are two hops apart, in work linear in them. A hub
with tokens of base spans takes one of their kinds, by their shares, so a candidate hears of them wherever it
stands. Loopy sum-product messages run until they settle and make labels agree. Base tokens keep their labels; a
run of a region's tokens whose marginals for a kind reach ``THRESHOLD`` is added as a span of that kind.

Weights are trained by pseudo-likelihood on the tokens of at most about ``max_docs`` documents, those of the least
hashes of their id. The teacher is the base rules and two rules for secrets (a key assigned to a name that says so,
and keys of well-known forms), of which the field doesn't see all: a part of the documents is read with the words
around hidden, and each case comes again with what no rule would find, labelled all the same: loose copies of its
spans, spans run together, of which the rules make one and drop it, and made-up decoys of these forms, labelled
none. So shape and context teach the kinds, and agreement with a distant like token is all that tells a loose copy
from a decoy.

Null and empty texts have no spans. Very long texts are scanned whole, in time linear in their length; a
document's field is as large as its regions. Repeated rows and clashing column names don't matter.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborsim.llm import common

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
MAX_DOCS, THRESHOLD, SETTLED, AROUND = 3000, 0.9, 1e-4, 2

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[+(]?[0-9](?:[0-9]|[ ().\-/](?=[ ().\-/]{0,2}[0-9(]))*")
_AT = re.compile(r"\(at\)|\[at\]| at ")
_HOST = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]+)+")
#: A key: 12 characters or more, letters and digits among them.
_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+")
_ASSIGNED = re.compile(r"(?i:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key)[\"']? ?[=:] ?[\"']?$")
#: How well-known services' keys begin.
_KNOWN = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,}|sk_live_[0-9A-Za-z]{16,}")
_HEX = re.compile(r"[0-9a-fA-F]+")
_TOKEN = re.compile(r"\S+")
_WORDS = re.compile(r"\w[\w-]*")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start and kind; leftmost and non-overlapping within a kind."""
    out, until, at = [], 0, text.find("@")
    while at >= 0:
        left = text[until:at]
        m = _DOMAIN.match(text, at) if left else None
        start = at - (len(left) - len(left.rstrip(_LOCAL)))
        if m and start < at:
            out.append((start, 0, m.end()))
            until = m.end()
        else:
            until = at + 1
        at = text.find("@", until)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _is_key(piece: str) -> bool:
    return any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece)


def regions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind or -1): base spans and the candidates that overlap none of them, by start."""
    out, taken = [(a, b, k) for a, k, b in base], sorted((a, b) for a, _, b in base)
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    free = lambda a, b: not ((i := bisect_left(starts, b)) and ends[i - 1] > a)
    found: list[tuple[int, int]] = []
    if _DIGIT.search(text):
        found += [m.span() for m in _DIGITS.finditer(text) if m.end() - m.start() >= 7 and len(_DIGIT.findall(m[0])) >= 7]
        found += [m.span() for m in _KEY.finditer(text) if _is_key(m[0])]
    for m in _AT.finditer(text):
        host, left = _HOST.match(text, m.end()), m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = left
        while start and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < left:
            found.append((start, host.end()))
    until = -1
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= until and free(a, b):
            out.append((a, b, -1))
            until = b
    return sorted(out)


def keys(piece: str) -> list[str]:
    """What makes two regions alike: equal digits, equal last nine digits, equal mailbox and host, equal key.

    Regions that have any of these in common have the last in common.
    """
    low = re.sub(r" ?[\[(]at[\])] ?| at ", "@", piece.lower())
    if "@" in low:
        return ["m:" + re.sub(r" ?[\[(]dot[\])] ?| dot ", ".", low)]
    if _is_key(piece) and " " not in piece:
        return ["k:" + low]
    digits = "".join(_DIGIT.findall(piece))
    dots = ["i:" + piece] if piece.count(".") == 3 else []
    return dots + (["d:" + digits] if len(digits) >= 7 else []) + (["e:" + digits[-9:]] if len(digits) > 9 else [])


def tokens(text: str, areas: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, region or -1) of the tokens of the regions and around them, by start.

    A token that lies in several regions belongs to the first base region of them, else to the first.
    """
    out: dict[int, tuple[int, int, int]] = {}
    for r in sorted(range(len(areas)), key=lambda r: areas[r][2] < 0):
        a, b, _ = areas[r]
        first = a
        for _ in range(AROUND + 1):  # back over this token and those before it
            while first and not text[first - 1].isspace():
                first -= 1
            begin = first
            while first and text[first - 1].isspace():
                first -= 1
            if first == 0:
                break
        after = 0
        for m in _TOKEN.finditer(text, begin):
            after += m.start() >= b
            if after > AROUND:
                break
            mine = m.start() < b and m.end() > a
            if m.start() not in out or mine and out[m.start()][2] < 0:
                out[m.start()] = (m.start(), m.end(), r if mine else -1)
    return sorted(out.values())


CUES = (
    {"email", "mail", "e-mail", "contact", "courriel", "correo"}, {"ip", "host", "server", "address", "adresse"}, {"card", "visa", "credit", "karte", "carte", "tarjeta"},
    {"phone", "tel", "call", "fax", "mobile", "telefon", "teléfono", "téléphone"}, {"token", "secret", "password", "passwd", "key", "api_key", "apikey"},
)


def observe(text: str, a: int, b: int, area: tuple[int, int, int] | None = None) -> np.ndarray:
    """Binary features of a token, of its region's form and of the words before that, without the rules' own verdicts."""
    own, piece = text[a:b], text[area[0] : area[1]] if area else ""
    inner = text[max(a, area[0]) : min(b, area[1])] if area else ""
    digits = _DIGIT.findall(piece)
    mine = _DIGIT.findall(inner)
    n, m = len(digits), len(mine)
    start = area[0] if area else a
    before = text[max(0, start - 40) : start].lower()
    words = set(_WORDS.findall(before)[-3:])
    key = _is_key(piece) and " " not in piece and "@" not in piece and len(piece) >= 12
    run = bool(area) and not key and n > 0
    return np.array([
        1, not area, not area and any(c.isdigit() for c in own), run, bool(area) and n == 0, run and n <= 9, run and 10 <= n <= 11, run and 12 <= n <= 15, run and 16 <= n <= 19, run and n > 19,
        piece.count(".") == 3, "." in piece, " " in piece, "-" in piece, "(" in piece, piece[:1] == "+", "@" in piece, any(c.isalpha() for c in piece) and not key, run and 12 <= n <= 19 and luhn("".join(digits)),
        run and inner[:1] == "+", run and inner[:1] == "(", run and m <= 3, run and 4 <= m <= 8, run and 9 <= m <= 11, run and 12 <= m <= 19, run and 12 <= m <= 19 and luhn("".join(mine)), run and inner.count(".") == 3, run and "-" in inner,
        key, key and len(piece) >= 18, key and len(piece) >= 32, key and bool(_HEX.fullmatch(piece)), key and piece.upper() == piece, key and bool(_KNOWN.fullmatch(piece)), before.rstrip("\"' ")[-1:] in ("=", ":"), *(bool(words & c) for c in CUES),
    ], float)


#: Features that tell of the tokens around; some cases are read without them.
AROUND_FEATURES = 1 + len(CUES)


def links(text: str, areas: list[tuple[int, int, int]], at: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): pairs of neighbouring tokens; (token, hub) of tokens that others repeat or resemble."""
    by: dict[str, list[int]] = defaultdict(list)
    for i, (a, b, r) in enumerate(at):
        if r >= 0:
            for k in keys(text[areas[r][0] : areas[r][1]])[-1:]:
                by[k].append(i)
            own = text[a:b].strip(".,:;()\"'").lower()
            if len(own) >= 7 and any(c.isdigit() for c in own):
                by["t:" + own].append(i)
    hubs = list({tuple(own): None for own in by.values() if len({at[i][2] for i in own}) > 1})
    skip = sorted((i, h) for h, own in enumerate(hubs) for i in own)
    chain = [(i, i + 1) for i in range(len(at) - 1) if text[at[i][1] : at[i + 1][0]].isspace()]
    return chain, skip


class SkipChainCRF:
    """Labels 0 (none) and 1 to 5 (kinds). Trained state: three small arrays."""

    def __init__(self):
        k = len(KINDS) + 1
        self.unary, self.chain, self.skip = np.zeros((k, len(observe("", 0, 0)))), np.zeros((k, k)), np.eye(k) * 2.0

    def train(self, docs: list[tuple[list[list[float]], list[int], list[tuple[int, int]], list[tuple[int, int]]]], steps: int = 250, rate: float = 0.06) -> SkipChainCRF:
        """Pseudo-likelihood: each labelled token given its features and its neighbours' labels (-1: unlabelled).

        Of a hub, a token sees the shares of the labels of the hub's other tokens.
        """
        k, x, y, chain, skip = len(KINDS) + 1, [], [], [], []
        for feats, labels, pairs, alike in docs:
            around, hubs = np.zeros((2, len(labels), k)), np.zeros((len(labels), k))  # there are fewer hubs than sites
            for i, j in pairs:
                if labels[j] >= 0:
                    around[0, i, labels[j]] += 1
                if labels[i] >= 0:
                    around[0, j, labels[i]] += 1
            for i, h in alike:
                if labels[i] >= 0:
                    hubs[h, labels[i]] += 1
            for i, h in alike:
                others = hubs[h].copy()
                if labels[i] >= 0:
                    others[labels[i]] -= 1
                around[1, i] += others / max(others.sum(), 1)
            for i, label in enumerate(labels):
                if label >= 0:
                    x.append(feats[i])
                    y.append(label)
                    chain.append(around[0, i])
                    skip.append(around[1, i])
        if not y:
            return self
        x, y = np.concatenate([np.array(x), np.array(chain), np.array(skip)], 1), np.eye(k)[y]
        f = x.shape[1] - 2 * k
        w = np.concatenate([self.unary.T, self.chain, self.skip])
        rest, decay = w.copy(), np.concatenate([np.full(f, 2e-5), np.full(2 * k, 2e-4)])[:, None]
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            up = x.T @ (y - p / p.sum(1, keepdims=True)) / len(y) - decay * (w - rest)
            for m in (up[f : f + k], up[f + k :]):  # both potentials are symmetric
                m[:] = (m + m.T) / 2
            first, second = 0.9 * first + 0.1 * up, 0.99 * second + 0.01 * up * up
            w = w + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.unary, self.chain, self.skip = w[:f].T.copy(), w[f : f + k].copy(), w[f + k :].copy()
        return self

    def marginals(self, feats: np.ndarray, known: list[int], chain: list[tuple[int, int]], skip: list[tuple[int, int]]) -> np.ndarray:
        """Loopy sum-product in the log domain, damped; known labels (>= 0) are clamped. One row for each site."""
        n = len(feats)
        local = np.concatenate([feats @ self.unary.T, np.zeros((1 + max((h for _, h in skip), default=-1), len(self.unary)))])
        for i, label in enumerate(known):
            if label >= 0:
                local[i] = -50.0
                local[i, label] = 0.0
        told_by = np.zeros_like(local)
        for i, h in skip:
            if known[i] >= 0:
                told_by[n + h, known[i]] += 1
        sure = told_by.any(1)
        local[sure] = np.where(told_by[sure] > 0, np.log(np.maximum(told_by[sure], 1) / told_by[sure].sum(1, keepdims=True)), -1e9)  # however many candidates lean elsewhere
        edges = [(i, j, self.chain) for i, j in chain] + [(i, n + h, self.skip) for i, h in skip if known[i] < 0]
        if not edges:
            return _soft(local[:n])
        src = np.array([e[0] for e in edges] + [e[1] for e in edges])
        dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
        back = np.r_[len(edges) : 2 * len(edges), : len(edges)]
        pot = np.array([e[2] for e in edges] * 2)
        message = np.zeros((len(src), local.shape[1]))
        # news crosses an edge in a round, so it gets everywhere; the bound ends only a field that never settles
        for _ in range(100 + 2 * len(local)):
            belief = local.copy()
            np.add.at(belief, dst, message)
            out = belief[src] - message[back]
            new = pot + out[:, :, None]
            top = new.max(1, keepdims=True)
            new = np.log(np.exp(new - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            moved = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if moved < SETTLED:
                break
        belief = local.copy()
        np.add.at(belief, dst, message)
        return _soft(belief[:n])

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base, all): spans as (start, kind, end), sorted."""
        base = base_spans(text)
        areas = regions(text, base)
        if all(k >= 0 for _, _, k in areas):
            return base, base
        at = tokens(text, areas)
        chain, skip = links(text, areas, at)
        known = [areas[r][2] + 1 if r >= 0 and areas[r][2] >= 0 else -1 for _, _, r in at]
        p = self.marginals(_features(text, areas, at), known, chain, skip)
        more, last = [], (-1, -1)
        for (a, b, r), q in zip(at, p):
            k = int(q.argmax()) - 1
            if r < 0 or areas[r][2] >= 0 or k < 0 or q[k + 1] < THRESHOLD:
                last = (-1, -1)
                continue
            a, b = max(a, areas[r][0]), min(b, areas[r][1])
            if last == (r, k):
                more[-1] = (more[-1][0], k, b)
            else:
                more.append((a, k, b))
            last = (r, k)
        # a part of a region is a span of its own only if it holds a digit
        more = [(a, k, b) for a, k, b in more if _DIGIT.search(text[a:b]) or any(x == a and y == b for x, y, _ in areas)]
        return base, sorted(base + more)


def _soft(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _features(text: str, areas: list[tuple[int, int, int]], at: list[tuple[int, int, int]]) -> np.ndarray:
    return np.array([observe(text, a, b, areas[r] if r >= 0 else None) for a, b, r in at])


def _secrets(text: str, areas: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The regions with the teacher's verdict on keys: a secret where a name that says so has it, or by its form."""
    secret = lambda a, b: _is_key(text[a:b]) and (_ASSIGNED.search(text[max(0, a - 40) : a]) or _KNOWN.fullmatch(text[a:b]))
    return [(a, b, 4 if k < 0 and secret(a, b) else k) for a, b, k in areas]


def _loose(kind: int, piece: str, pick) -> str:
    """The span as no rule would find it."""
    digits = "".join(_DIGIT.findall(piece))
    if kind == 0:
        user, host = piece.split("@", 1)
        return f"{user} (at) {host}" if pick.random() < 0.5 else f"{user} at {host.replace('.', ' dot ')}"
    if kind == 1:
        return piece.replace(".", " . " if pick.random() < 0.5 else "-")
    if kind == 2:
        return (". " if pick.random() < 0.5 else "/").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        return f"{digits[:1]} {digits[1:4]} {digits[4:7]} {digits[7:]}" if pick.random() < 0.5 else f"{digits[:4]}.{digits[4:7]}.{digits[7:]}"
    return piece


def _decoy(kind: int, piece: str, pick) -> str:
    """Something of the same form that nothing resembles; of a key, one without a name and of no known form."""
    if kind == 4:
        letters = "0123456789abcdef" if _HEX.fullmatch(piece) else "abcdefghijklmnopqrstuvwxyz0123456789"
        return "".join(pick.choice(letters) for _ in piece[:-2]) + "a1"
    other = "".join(str(pick.randint(0, 9)) if c.isdigit() else c for c in piece)
    return _loose(kind, other if kind else "nobody" + other, pick)


def example(text: str, seed: int = 0):
    """Training cases of a text: (features, labels, chain, skip) each; labels are -1 for tokens that are left out.

    The text as it is, and with loose copies, spans run together and decoys at its end. Every third is read
    without its context.
    """
    import random

    pick, out = random.Random(seed), []
    judged = _secrets(text, regions(text, base_spans(text)))
    whole = [(k, text[a:b]) for a, b, k in judged if k >= 0 and not any(j != k and x < b and y > a for x, y, j in judged)]
    longer, made = text, []  # where each made-up span begins and ends, and its label

    def put(*parts: tuple[int, str]) -> None:
        nonlocal longer
        longer += " und so weiter,"
        for label, piece in parts:
            made.append((len(longer) + 1, len(longer) + 1 + len(piece), label))
            longer += " " + piece
        longer += " ."

    for k, piece in whole[:20]:
        put((k + 1, _loose(k, piece, pick)))
        put((0, _decoy(k, piece, pick)))
        if 1 <= k <= 3:
            j, other = pick.choice([(j, p) for j, p in whole if 1 <= j <= 3])
            new = lambda x: "".join(str(pick.randint(0, 9)) if c.isdigit() else c for c in x)
            # of the same shape but not alike, so that shape must tell; a card's digits make it one
            put((k + 1, piece if k in (1, 2) else new(piece)), (j + 1, other if j in (1, 2) else new(other)))
            put((k + 1, piece if k in (1, 2) else new(piece)), (0, "".join(str(pick.randint(0, 9)) for _ in range(pick.randint(3, 9)))))
    for body in (text, longer) if made else (text,):
        areas = regions(body, base_spans(body))
        if not areas:
            continue
        judged = _secrets(body, areas)
        at = tokens(body, areas)
        sure = {k for a, b, kind in judged if kind >= 0 for k in keys(body[a:b])}
        starts, labels = [a for a, _, _ in made], []
        for a, b, r in at:
            i = bisect_right(starts, a) - 1
            told = [label for x, y, label in made[max(0, i) : i + 2] if x < b and y > a]
            if body is longer and r >= 0 and told:
                labels.append(told[0])
            elif r < 0:
                labels.append(0)
            elif judged[r][2] >= 0:
                labels.append(judged[r][2] + 1)
            else:  # the rules know little of what resembles their spans, and of long runs, which may hold several
                piece = body[areas[r][0] : areas[r][1]]
                labels.append(-1 if sure & set(keys(piece)) or len(_DIGIT.findall(piece)) >= 12 and not _is_key(piece) else 0)
        x = _features(body, areas, at)
        if pick.random() < 1 / 3:
            x[:, -AROUND_FEATURES:] = 0
        out.append((x.astype(int).tolist(), labels, *links(body, areas, at)))
    return out


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, seed: int = 5) -> SkipChainCRF:
    """Only the sampled documents' features and links reach the driver, of at most ``max_docs`` rows.

    The sample is the rows with the least hashes of id and text among those with a digit or an at sign, drawn from
    a share of all rows that holds about 1.3 times as many.
    """
    import json

    total = docs.count()
    u = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    share = min(1.0, 1.3 * max_docs / max(total, 1))
    sample = docs.where((F.pmod(u, F.lit(1_000_000)) < int(share * 1_000_000) + 1) & F.col("text").rlike("[0-9@]")).select(u.alias("u"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(*(c.to_pylist() for c in batch.columns)):
                got = [json.dumps(e) for e in example(t or "", d)]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array(got, pa.string())], names=["u", "k", "case"])

    rows = sample.mapInArrow(run, "u long, k int, case string").orderBy("u", "k", "case").limit(2 * max_docs).collect()
    return SkipChainCRF().train([json.loads(r["case"]) for r in rows])


def find(docs: DataFrame, model: SkipChainCRF) -> DataFrame:
    """doc_id, base and all: spans as array<struct<start, kind, end>> (code points, end exclusive)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<start: int, kind: string, end: int>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [held.value.spans(t or "") for t in batch.column(1).to_pylist()]
            cols = [pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "all"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, base {span}, all {span}")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_secret and n_spans: how many of all spans are secrets, and all of them."""
    docs = common.table(spark, sf_dir, "documents")
    found = find(docs, fit(docs))
    say = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count("base", k) for k in BASE), F.sha2(say("base").cast("binary"), 256).alias("base_sha256"), say("all").alias("spans"), count("all", "secret"), F.size("all").cast("long").alias("n_spans"))
