"""Personal data with a semi-Markov conditional random field.

Base spans come from fixed patterns and always stay. The field adds spans: in
every zone of neighbouring tokens with a digit or an at sign it scores whole
candidate segments (shape, digits, checks, context), and a dynamic programme
over segments of at most ``LONGEST`` tokens chooses boundaries and kinds
jointly. It is fitted by likelihood on a bounded sample of zones whose labels
are the base spans, with varied forms of them (a phone without its plus sign, a
card in dotted groups) and made-up numbers that are no personal data.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.sample import hashed_sample

# The kinds in order, and the base patterns (possessive where that
# changes no match; the part before an at sign is found from the sign).
KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

LABELS = ["", *KINDS]  # "" is text outside any segment, one token long
LONGEST = 6  # tokens in a segment
SLOTS = 1 << 12  # hashed features
SAMPLE_DOCS = 1500  # texts for fitting
SAMPLE_BYTES = 4096
EPOCHS, RATE = 6, 0.5
SCHEMA = "spans array<struct<kind:string,start:int,stop:int,base:boolean>>, redacted string"

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]")
_LEAD, _TAIL = "\"'<[{,;:!?*#&$%|", "\"'>]},;:!?.*#&$%|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base spans, sorted."""
    out = []
    at, end = t.find("@"), 0
    while at >= 0:
        s = at
        while s > end and t[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(t, at + 1) if s < at else None
        if m:
            end = m.end()
            out.append((s, 0, end))
        at = t.find("@", max(at + 1, end))
    for m in IP.finditer(t):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:] if len(x.lstrip("0")) <= 3 else "999") <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(t):
        d = _digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(t):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def zones(t: str):
    """Runs of neighbouring tokens with a digit or an at sign: lists of (start,
    end) of tokens without surrounding punctuation."""
    run, last = [], -2
    for i, m in enumerate(_TOKEN.finditer(t)):
        if not _SIGN.search(m[0]):
            continue
        s, e = m.span()
        while s < e and t[s] in _LEAD:
            s += 1
        while e > s and t[e - 1] in _TAIL:
            e -= 1
        if i != last + 1 and run:
            yield run
            run = []
        run.append((s, e))
        last = i
    if run:
        yield run


_RUNS = [(re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a")]


def features(t: str, s: int, e: int, tokens: int) -> list[int]:
    """Hashed features of a whole candidate segment."""
    x = t[s:e]
    if len(x) > 80:
        return [_slot("long"), _slot(f"tokens{tokens}")]
    d = _digits(x)
    shape = x
    for r, c in _RUNS:
        shape = r.sub(c, shape)
    parts = x.split(".")
    octets = len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)
    before = t[max(0, s - 12):s].split()
    f = [f"shape={shape}", f"digits={len(d)}", f"tokens={tokens}", f"at={x.count('@')}", f"letters={shape.count('a') > 0}",
         f"octets={octets}", f"luhn={12 <= len(d) <= 19 and luhn(d)}", f"plus={x[:1] == '+'}",
         f"phonelike={shape.strip('+') in ('9 (9) 9-9', '(9) 9-9', '9-9-9', '9.9.9', '9 9 9', '9-9')}&{len(d)}",
         f"runs={','.join(str(len(r)) for r in re.findall('[0-9]+', x)[:6])}", f"before={(before[-1] if before else '').lower()[-6:]}"]
    return [_slot(v) for v in f]


def _slot(v: str) -> int:
    return zlib.crc32(v.encode()) % SLOTS


class Field:
    """Weights of a segment's label given its features, and of label pairs."""

    def __init__(self):
        self.w = np.zeros((len(LABELS), SLOTS))
        self.pair = np.zeros((len(LABELS), len(LABELS)))

    def _scores(self, t, zone):
        """scores[i][n] of the labels of the segment of n + 1 tokens from token i."""
        out, feats = [], []
        for i in range(len(zone)):
            row, fr = [], []
            for n in range(min(LONGEST, len(zone) - i)):
                f = features(t, zone[i][0], zone[i + n][1], n + 1)
                v = self.w[:, f].sum(1)
                if n:
                    v[0] = -np.inf  # outside segments have one token
                row.append(v)
                fr.append(f)
            out.append(row)
            feats.append(fr)
        return out, feats

    def best(self, t: str, zone) -> list[tuple[int, int, int]]:
        """(start, kind number, end) of the segments of the best labelling."""
        n, k = len(zone), len(LABELS)
        scores, _ = self._scores(t, zone)
        v = np.full((n + 1, k), -np.inf)
        v[0, 0] = 0
        back = {}
        for i in range(n):
            come = v[i][:, None] + self.pair
            top, arg = come.max(0), come.argmax(0)
            for m, s in enumerate(scores[i]):
                x = top + s
                better = x > v[i + m + 1]
                for y in np.flatnonzero(better):
                    back[i + m + 1, y] = (i, int(arg[y]))
                v[i + m + 1] = np.maximum(v[i + m + 1], x)
        out, j, y = [], n, int(v[n].argmax())
        while j > 0:
            i, before = back[j, y]
            if y:
                out.append((zone[i][0], y - 1, zone[j - 1][1]))
            j, y = i, before
        return out[::-1]

    def step(self, t: str, zone, gold: dict[tuple[int, int], int], rate: float) -> None:
        """One gradient step on the log-likelihood of a zone's gold segments."""
        n, k = len(zone), len(LABELS)
        scores, feats = self._scores(t, zone)
        fwd, bwd = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        fwd[0, 0], bwd[n] = 0, 0
        for i in range(n):
            come = np.logaddexp.reduce(fwd[i][:, None] + self.pair, 0)
            for m, s in enumerate(scores[i]):
                fwd[i + m + 1] = np.logaddexp(fwd[i + m + 1], come + s)
        for i in range(n - 1, -1, -1):
            for m, s in enumerate(scores[i]):
                bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(self.pair + (s + bwd[i + m + 1])[None], 1))
        z = np.logaddexp.reduce(fwd[n])
        true, before, i = {}, 0, 0
        gold_pair = np.zeros_like(self.pair)
        while i < n:
            m, y = next(((b - i, y) for (a, b), y in gold.items() if a == i), (1, 0))
            true[i, m - 1] = y
            gold_pair[before, y] += 1
            before, i = y, i + m
        d_pair = gold_pair
        for i in range(n):
            for m, s in enumerate(scores[i]):
                joint = np.exp(fwd[i][:, None] + self.pair + (s + bwd[i + m + 1])[None] - z)
                d_pair = d_pair - joint
                g = -joint.sum(0)
                if (i, m) in true:
                    g[true[i, m]] += 1
                np.add.at(self.w, (slice(None), feats[i][m]), rate * g[:, None])
        self.pair += rate * d_pair


def _gold(zone, spans):
    """Base spans that begin and end with tokens of the zone, as token ranges."""
    starts, ends = {s: i for i, (s, _) in enumerate(zone)}, {e: i + 1 for i, (_, e) in enumerate(zone)}
    out, last = {}, 0
    for s, kind, e in spans:
        if s in starts and e in ends and last <= starts[s] < ends[e] <= starts[s] + LONGEST:
            out[starts[s], ends[e]] = kind + 1
            last = ends[e]
    return out


def _examples(texts: list[str], rng):
    """(text, zone, gold) of all zones of the texts, and varied and made-up ones."""
    def whole(lead, x, kind):
        t = lead + x + " and"
        zone = next(iter(zones(t)), None)
        if zone:
            s, e = zone[0][0], zone[-1][1]
            yield t, zone, {(0, len(zone)): kind} if kind and e - s == len(x) else {}

    for t in texts:
        spans = base_spans(t)
        for zone in zones(t):
            if len(zone) > 40:
                continue
            yield t, zone, _gold(zone, spans)
            s, e = zone[0][0], zone[-1][1]
            lead = t[max(0, s - 12):s]
            for a, kind, b in spans:
                if (a, b) != (s, e):
                    continue
                d = _digits(t[a:b])
                if kind == 3 and len(d) >= 10:
                    for form in ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"):
                        yield from whole(lead, form.format(d[-10:-7], d[-7:-4], d[-4:]), 4)
                elif kind == 2 and len(d) == 16:
                    yield from whole(lead, ".".join(d[i:i + 4] for i in range(0, 16, 4)), 3)
    for _ in range(200):
        n = lambda a, b: int(rng.integers(a, b))
        for x in (f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", str(n(0, 100000)), f"{n(1, 1000)}.{n(0, 100)}",
                  f"{n(1, 24)}:{n(0, 60):02}", f"{n(1, 1000)}-{n(1, 1000)}", "".join(str(n(0, 10)) for _ in range(n(8, 22))), f"a{n(0, 10**6)}b{n(0, 99)}"):
            if not base_spans(x):
                yield from whole("the ", x, 0)


def fit_field(docs: DataFrame, rows: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, epochs: int = EPOCHS) -> Field:
    """Fits on at most ``rows`` texts of at most ``most_bytes`` bytes with a digit
    or an at sign, those with the smallest hashes of their ids."""
    some = hashed_sample(docs, rows, "pii", (F.octet_length("text") <= most_bytes) & F.col("text").rlike("[0-9@]"))
    rng, field = np.random.default_rng(0), Field()
    every = list(_examples([t for _, t in some], rng))
    for k in range(epochs):
        for i in rng.permutation(len(every)):
            field.step(*every[i], RATE / (1 + k))
    return field


def all_spans(t: str, field: Field) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) sorted: base spans, and the field's that
    touch none of them."""
    base = base_spans(t)
    out = [(*x, True) for x in base]
    taken = np.array(sorted((s, e) for s, _, e in base), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    for zone in zones(t):
        i = np.searchsorted(taken[:, 0], zone[-1][1])
        inside = [(s, e) for s, e in zone if not (i and reach[i - 1] > s and _touched(taken, reach, s, e))]
        if not inside:
            continue
        for s, kind, e in field.best(t, zone):
            if not _touched(taken, reach, s, e):
                out.append((s, kind, e, False))
    return sorted(out)


def _touched(taken, reach, s, e) -> bool:
    i = np.searchsorted(taken[:, 0], e)
    return bool(i and reach[i - 1] > s)


def find_personal_data(docs: DataFrame, field: Field, redact: bool = True) -> DataFrame:
    """Every row of ``docs`` (all columns stay; columns named spans and redacted
    are replaced) with spans in code points, end exclusive, sorted by start and
    kind, and, with ``redact``, the text with every span replaced by its kind in
    brackets (overlapping spans become one). Null texts have no spans and stay
    null; texts of any length are read whole."""
    cols = [c for c in docs.columns if c not in ("spans", "redacted")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols] + [SCHEMA])
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        for b in batches:
            col = b.column("text")
            signed = pc.fill_null(pc.match_substring_regex(col, "[0-9@]"), False).to_numpy(zero_copy_only=False)
            spans, changed = [[] for _ in range(b.num_rows)], {}
            for i in np.flatnonzero(signed):
                t = col[int(i)].as_py()
                found = all_spans(t, field)
                spans[i] = [{"kind": KINDS[k], "start": s, "stop": e, "base": base} for s, k, e, base in found]
                if found and redact:
                    changed[int(i)] = redacted(t, found)
            if changed:
                at = np.array(sorted(changed))
                mask = np.zeros(b.num_rows, bool)
                mask[at] = True
                new = pc.replace_with_mask(col, pa.array(mask), pa.array([changed[i] for i in at], col.type))
            else:
                new = col if redact else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in cols] + [pa.array(spans, pa.list_(kind_of)), new], cols + ["spans", "redacted"])

    out = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)
    return out if redact else out.drop("redacted")


def redacted(t: str, spans) -> str:
    out, at = [], 0
    for s, kind, e, _ in spans:
        if s >= at:
            out += [t[at:s], f"[{KINDS[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + t[at:]


def digest(spans: list[tuple[int, int, int]]) -> str:
    """SHA-256 of kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
