"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from four fixed patterns with their checks. The field adds spans that the
patterns miss (numbers grouped by other signs, written-out addresses). A text is cut into
chunks between white space; a stretch is a run of chunks that hold a digit, an at sign or a
written-out sign. Candidate segments are 1 to ``MAX_CHUNKS`` chunks of a stretch, scored
by features of the whole span (digit count, grouping, signs, checks, left neighbour);
dynamic programming over segments of bounded length chooses boundaries and types jointly,
chunks of a base span being closed to it. A segment of the best path is kept where its
marginal odds (its probability under the field, by forward and backward sums, against all
else) pass ``ODDS``, so that plain numbers stay.

Training is on generated stretches: personal data in many spellings, and look-alikes
(dates, amounts, versions, identifiers) as background; seeded, thus the same everywhere.

Scale: a map over the scan, no shuffle; the model is a few hundred numbers. The work is linear
in a text's length: patterns can't backtrack beyond a span, and a stretch costs its chunks
times ``MAX_CHUNKS``.

Cases: a null or empty text has no spans; repeated rows are searched each; an empty table
gives no rows; further columns are not carried along.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmith.llm import common

KINDS = ("email", "ip", "card", "phone")
MAX_CHUNKS = 5
ODDS = 4.0
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]|\b(?:at|dot)\b")
CHUNK = re.compile(r"\S+")
ANCHOR = re.compile(r"[0-9@]|[\[({<](?:at|dot|AT|DOT)[\])}>]|^(?:at|dot|AT|DOT)$")
TELLING = re.compile(r"[0-9@]|\S[\[({<](?:at|dot|AT|DOT)[\])}>]")
ANY_DIGIT = str.maketrans("012345678", "999999999")
MAX_KEY, MAX_KEYS = 200, 50_000
EDGE = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:  # the local part is the run that ends here; no other start can match
        start = at
        while start > last and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


CUES = {"email": 0, "mail": 0, "e-mail": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "credit": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3}


#: Written-out or bracketed signs, in text whose white space is collapsed.
AT_SIGN = re.compile(r" ?[\[({<] ?at ?[\])}>] ?| at | ?@ ?")
DOT_SIGN = re.compile(r" ?[\[({<] ?dot ?[\])}>] ?| dot ")
ADDRESS = re.compile(r"[\w.%+-]++@[\w-]++(?:\.[\w-]++)+")


def is_address(low: str) -> bool:
    """Whether a lower-case span with collapsed white space is an address once its signs are put in."""
    return bool(ADDRESS.fullmatch(DOT_SIGN.sub(".", AT_SIGN.sub("@", low))))


def span_features(s: str, left: str) -> list[str]:
    """Features of a whole candidate span; left is the chunk before it."""
    s = " ".join(s.split())
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    lens = tuple(map(len, groups))
    seps = "".join(sorted(set(re.sub(r"[0-9A-Za-z]", "", s)) & set(" .-/()+_,:@%=#$€")))
    letters = sum(c.isalpha() for c in s)
    low = s.lower()
    f = ["bias", f"digits:{min(len(d), 20)}", f"groups:{min(len(groups), 7)}", f"seps:{seps}", f"letters:{min(letters, 1) if letters < 3 else 3}"]
    f.append("shape:" + re.sub(r"[A-Za-zÀ-ÿ]+", "a", re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 6)), s))[:24])
    if 12 <= len(d) <= 19:
        f.append(f"luhn:{luhn(d)}:{letters == 0}")
    if lens and letters == 0:
        f.append(f"even4:{len(lens) >= 3 and set(lens[:-1]) == {4} and lens[-1] <= 4}")
    if len(groups) == 4 and letters == 0:
        f.append(f"octets:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}:{seps}")
    if s[:1] in "+(" or d[:2] == "00":
        f.append(f"intl:{s[:1] if s[:1] in '+(' else '00'}:{9 <= len(d) <= 15}")
    if is_address(low):
        f.append(f"address:{'@' in s}:{bool(re.search(r'[\[({<]', s))}:{low.endswith(('com', 'org', 'net', 'edu', 'de', 'fr', 'es'))}")
    cue = CUES.get(left.lower().strip(EDGE + "()"))
    f.append(f"cue:{cue}")
    return f


def span_key(s: str, left: str) -> tuple:
    """All that span_features reads of a span: its form, digits' values aside, and what these are asked for."""
    s = " ".join(s.split())
    form = s.translate(ANY_DIGIT)
    n, values = form.count("9"), ()
    if n >= 4:
        groups = re.findall(r"[0-9]+", s)
        values = luhn("".join(groups)) if 12 <= n <= 19 else None, len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return form, values, n > 1 and _digits(s[:80])[:2] == "00", CUES.get(left.lower().strip(EDGE + "()"))


class SemiMarkovCRF:
    """Weights by (feature, kind); background chunks score 0."""

    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.seen: dict[tuple, tuple] = {}  # scores by span_key, once trained

    def scores(self, feats: list[str]) -> np.ndarray:
        out = np.zeros(len(KINDS))
        for f in feats:
            if f in self.w:
                out += self.w[f]
        return out

    def lattice(self, chunks: list[str], left: str, joined, closed: list[bool] | None = None) -> dict[tuple[int, int], tuple[list[str], np.ndarray]]:
        """Features and scores by kind of each segment that holds no closed chunk."""
        out = {}
        for i in range(len(chunks)):
            for j in range(i + 1, min(len(chunks), i + MAX_CHUNKS) + 1):
                if closed and closed[j - 1]:
                    break
                feats = span_features(joined(i, j), chunks[i - 1] if i else left)
                out[i, j] = feats, self.scores(feats)
        return out

    def scored(self, chunks: list[str], left: str, joined, closed: list[bool]) -> dict[tuple[int, int], tuple]:
        """The same with the best kind and its score; spans of one key are scored once."""
        out = {}
        for i in range(len(chunks)):
            before = chunks[i - 1] if i else left
            for j in range(i + 1, min(len(chunks), i + MAX_CHUNKS) + 1):
                if closed[j - 1]:
                    break
                s = joined(i, j)
                key = span_key(s, before) if len(s) <= MAX_KEY else None
                item = self.seen.get(key)
                if item is None:
                    scores = self.scores(span_features(s, before))
                    best = int(np.argmax(scores))
                    item = None, scores, best, float(scores[best])
                    if key:
                        if len(self.seen) >= MAX_KEYS:
                            self.seen.clear()
                        self.seen[key] = item
                out[i, j] = item
        return out

    def marginals(self, n: int, lat: dict) -> dict[tuple[int, int], np.ndarray]:
        """Probability of each segment and kind, by forward and backward sums."""
        a, b = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        a[0], b[n] = 0.0, 0.0
        for j in range(1, n + 1):
            a[j] = np.logaddexp.reduce([a[j - 1], *(a[i] + x for i in range(max(0, j - MAX_CHUNKS), j) if (i, j) in lat for x in lat[i, j][1])])
        for i in range(n - 1, -1, -1):
            b[i] = np.logaddexp.reduce([b[i + 1], *(b[j] + x for j in range(i + 1, min(n, i + MAX_CHUNKS) + 1) if (i, j) in lat for x in lat[i, j][1])])
        return {(i, j): np.exp(a[i] + s + b[j] - a[n]) for (i, j), (_, s, *_) in lat.items()}

    def fit(self, data: list, rounds: int = 5, rate: float = 0.3, l2: float = 1e-3) -> SemiMarkovCRF:
        """data: (chunks, left, {(i, j): kind}). Stochastic ascent of the likelihood, AdaGrad steps."""
        square: dict[str, np.ndarray] = {}
        for _ in range(rounds):
            for chunks, left, truth in data:
                lat = self.lattice(chunks, left, lambda i, j, c=chunks: " ".join(c[i:j]).strip(EDGE))
                grad: dict[str, np.ndarray] = {}
                for seg, p in self.marginals(len(chunks), lat).items():
                    g = -p
                    if seg in truth:
                        g[truth[seg]] += 1
                    if np.abs(g).max() > 1e-3:
                        for f in lat[seg][0]:
                            grad[f] = grad.get(f, 0) + g
                for f, g in grad.items():
                    w = self.w.setdefault(f, np.zeros(len(KINDS)))
                    g = g - l2 * w
                    s = square.setdefault(f, np.zeros(len(KINDS)))
                    s += g * g
                    w += rate * g / np.sqrt(s + 1e-8)
        return self

    def decode(self, chunks: list[str], left: str, joined, closed: list[bool]) -> list[tuple[int, int, int]]:
        """Segments (i, j, kind) of the best path whose marginal odds pass; none holds a closed chunk."""
        lat = self.scored(chunks, left, joined, closed)
        found = best_path(len(chunks), lat)
        if not found:
            return []
        p = self.marginals(len(chunks), lat)
        return [(i, j, k) for i, j, k in found if p[i, j][k] > ODDS * (1 - p[i, j][k])]


def best_path(n: int, lat: dict) -> list[tuple[int, int, int]]:
    """Segments (i, j, kind) of the greatest total score, by dynamic programming; chunks outside of them score 0."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i in range(max(0, j - MAX_CHUNKS), j):
            if (i, j) in lat:
                _, scores, *known = lat[i, j]
                k, top = known or (int(np.argmax(scores)), scores.max())
                total = best[i] + top
                if total > best[j]:
                    best[j], back[j] = total, (i, k)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((i, j, k))
            j = i
    return out[::-1]


def _luhn_number(r: random.Random, n: int) -> str:
    d = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def generated(n: int = 900, seed: int = 7) -> list:
    """Stretches in many spellings, with their segments."""
    r = random.Random(seed)
    num = lambda a, b: str(r.randint(a, b))
    some = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))

    def email() -> str:
        at = r.choice(["@", " at ", " [at] ", " (at) ", "[at]", "(at)"])
        dot = r.choice([" dot ", " [dot] ", "[dot]", "(dot)"]) if at != "@" or r.random() < 0.3 else "."
        return word() + r.choice(["", "." + word(), num(1, 99)]) + at + word() + dot + r.choice(["com", "org", "net", "de", "fr", "es"])

    def ip() -> str:
        return r.choice([".", ".", "[.]", "-", "(.)"]).join(num(0, 255) for _ in range(4))

    def card() -> str:
        d = _luhn_number(r, 16)
        return r.choice(["", " ", "-", ".", "_", "/"]).join(d[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(200, 999), num(200, 999), some(4)
        return r.choice([f"+{num(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"00{num(10, 99)} {a} {b}{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(1, 99)}/{a}/{b}{c}"])

    def other() -> str:
        return r.choice(
            [
                f"{num(1900, 2030)}-{num(1, 12):0>2}-{num(1, 28):0>2}", f"{num(1, 28)}/{num(1, 12)}/{num(1950, 2030)}", f"{num(1, 28)}.{num(1, 12)}.{num(1950, 2030)}",
                f"{num(0, 23)}:{num(10, 59)}", f"{num(1, 9999)}.{some(2)}", f"${num(1, 999)},{some(3)}.{some(2)}", f"v{num(0, 9)}.{num(0, 20)}.{num(0, 9)}", f"{num(0, 9)}.{num(0, 30)}.{num(0, 99)}",
                num(0, 9), num(10, 99), num(100, 999), num(1000, 99999), some(7), some(10), some(16), f"{num(1, 100)}%", f"#{num(1, 99999)}", f"{word()}{num(1, 99)}", f"{num(1, 9)},{some(3)},{some(3)}",
                f"{word()}={some(6)}{word()}{some(4)}", f"{some(3)}-{some(4)}", f"978-{num(0, 9)}-{some(4)}-{some(4)}-{num(0, 9)}", f"at {num(1, 30)}", f"{some(4)} {some(3)} {some(2)}", f"@{word()}", "at", "dot", f"{some(8)}{word()}{some(8)}",
            ]
        )

    makers, data = (email, ip, card, phone), []
    for _ in range(n):
        chunks, truth = [], {}
        left = r.choice([word(), word(), "the", ""])
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                k = r.randrange(4)
                parts = makers[k]().split(" ")
                if len(parts) > MAX_CHUNKS:
                    continue
                if not chunks and r.random() < 0.2:
                    left = r.choice([c for c, v in CUES.items() if v == k])
                truth[len(chunks), len(chunks) + len(parts)] = k
                chunks += parts
            else:
                chunks += other().split(" ")
            chunks += [word() for _ in range(r.randint(0, 2))]
        if chunks:
            data.append((chunks, left, truth))
    return data


@lru_cache(1)
def model() -> SemiMarkovCRF:
    """Trained once a process on generated stretches."""
    return SemiMarkovCRF().fit(generated())


def find_spans(text: str, crf: SemiMarkovCRF) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, (start, end, kind) by start, then kind."""
    if not HINT.search(text):
        return [], []
    base = base_spans(text)
    chunks = [m.span() for m in CHUNK.finditer(text)] if ANCHORS.search(text) else []
    hot = [bool(ANCHOR.search(text[a:b])) for a, b in chunks]
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))

    def in_base(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and reach[k - 1] > a

    added, k, n = [], 0, len(chunks)
    while k < n:
        if not hot[k]:
            k += 1
            continue
        end = k + 1
        while end < n and (hot[end] or (end + 1 < n and hot[end + 1] and _written(text, chunks[end + 1])) or _written(text, chunks[end - 1])):
            end += 1
        begin = k - 1 if k and _written(text, chunks[k]) else k
        # A written-out sign alone is an everyday word.
        stretch = chunks[begin:end]
        if any(TELLING.search(text[a:b]) for a, b in stretch) or sum(_written(text, c) for c in stretch) > 1:
            closed = [in_base(a, b) for a, b in stretch]
            if not all(closed):
                cut = lambda i, j, s=stretch: _trim(text, s[i][0], s[j - 1][1])
                words = [text[a:b] for a, b in stretch]
                left = text[slice(*chunks[begin - 1])] if begin else ""
                for i, j, kind in crf.decode(words, left, lambda i, j, f=cut: text[slice(*f(i, j))], closed):
                    added.append((*cut(i, j), kind))
        k = end
    return base, sorted(base + added, key=lambda s: (s[0], s[2], s[1]))


ANCHORS = re.compile(r"[0-9@]|[\[({<](?:at|dot|AT|DOT)[\])}>]|(?:^|\s)[\[({<]?(?:at|AT)[\])}>]?\s+\S+\s+[\[({<]?(?:dot|DOT)[\])}>]?(?:\s|$)")


def _written(text: str, span: tuple[int, int]) -> bool:
    return text[slice(*span)].lower().strip("[](){}<>") in ("at", "dot")


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in EDGE:
        a += 1
    while b > a and text[b - 1] in EDGE:
        b -= 1
    return a, b


def joined_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _find(crf: SemiMarkovCRF):
    def run(batches):
        for batch in common.slices(batches, 1024):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = find_spans(text, crf)
                n = [sum(k == x for _, _, k in base) for x in range(4)]
                out.append((doc, *n, joined_spans(base), joined_spans(spans), len(spans) - len(base)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_added"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base and all spans as text, number of added spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(_find(model()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")


def _masked(text: str | None, crf: SemiMarkovCRF) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in find_spans(text, crf)[1]:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{KINDS[k].upper()}]" if a >= at else ""]
        at = b
    return "".join(out) + text[at:] if out else text


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span of ``text`` replaced by its kind in brackets; all columns stay."""
    crf, where, schema = model(), docs.columns.index("text"), docs.schema
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in common.slices(batches, 1024):
            texts = [_masked(x, crf) for x in batch.column(where).to_pylist()]
            batch = batch.set_column(where, batch.schema.field(where), pa.array(texts, batch.schema.field(where).type))
            if size is not None:
                f = batch.schema.field(size)
                batch = batch.set_column(size, f, pa.array([None if x is None else len(x) for x in texts], f.type))
            yield batch

    return docs.mapInArrow(common.tidied(run), schema)


def base_digest(c: str = "base"):
    return F.sha2(F.col(c), 256)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", base_digest().alias("base_sha256"), "spans", "n_added"
    )
