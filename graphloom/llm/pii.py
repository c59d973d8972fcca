"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions that adds to them.

Base spans come from the rules alone (e-mail addresses, IP addresses, payment cards that pass Luhn, phone numbers).
The tagger is trained in numpy on labelled spans: rule matches of a bounded sample of documents, and the same matches
rewritten in forms that the rules miss (spaces around @, "(at)", other separators, no plus sign), among digits that are
none of these. A span of any kind holds a digit, an @ or an at-sign in brackets, so exactly the overlapping windows
around these marks, anywhere in the whole text, are read: every span of up to WINDOW - STRIDE characters lies whole in
one. Every window is decoded by Viterbi; all windows of a text then vote, and the votes are reconciled over the whole
text: base spans stand, further spans need a majority of the windows that hold them whole, must pass the check of
their kind and may not overlap; among rivals the one with more votes, then the longer, then the earlier stays.

Defined cases. Null and empty texts have no spans, an empty table gives an empty result. Ties, repeated rows and very long
texts need no special case: rows are treated one by one and windows in batches. Columns in keep with the name of a
result are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import blocks, per_batch

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, kind

# --- rules -----------------------------------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card_ok(s: str) -> bool:
    return 12 <= len(n := digits(s)) <= 19 and luhn(n)


def ip_ok(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ backwards, so that long runs of letters cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """Sorted by start, then kind."""
    found = [(a, b, 0) for a, b in emails(text)]
    if re.search("[0-9]", text):
        found += [(*m.span(), 1) for m in _IP.finditer(text) if ip_ok(m[0].split("."))]
        found += [(*m.span(), 2) for m in _CARD.finditer(text) if card_ok(m[0])]
        found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def plausible(text: str, kind: int) -> bool:
    """The check of an added span."""
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?(@|\(at\)|\[at\]) ?[A-Za-z0-9-]+( ?\. ?[A-Za-z0-9-]+)+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}( ?[.,] ?[0-9]{1,3}){3}", text)) and ip_ok(re.findall("[0-9]+", text))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9]{3,}([ ./-]{0,2}[0-9]{2,})+|[0-9]+", text)) and card_ok(text)
    n = len(digits(text))
    return bool(re.fullmatch(r"(\+ ?|00)?\(?[0-9]{1,4}\)?([ ./()-]{1,2}[0-9]{2,}){2,}", text)) and 9 <= n <= 15 and not card_ok(text)


# --- the tagger ------------------------------------------------------------------------------------------------------

WINDOW, STRIDE = 96, 32
_SYMBOLS = np.full(256, 99, np.int64)
_SYMBOLS[32:127] = np.arange(95)
_SYMBOLS[[9, 10, 11, 12, 13]] = 0
_SYMBOLS[128:] = 97
PAD = 98
N_SYMBOLS, N_TAGS = 100, 9  # tag 0: outside; 1 + 2 k and 2 + 2 k: first and further characters of kind k


@dataclass
class Tagger:
    """Embedding, the two LSTMs (input and recurrent weights together, with bias), output layer, transitions."""

    embed: np.ndarray
    lstm: list[np.ndarray]
    out: np.ndarray
    step: np.ndarray

    @classmethod
    def fresh(cls, rng: np.random.Generator, width: int = 12, hidden: int = 16) -> Tagger:
        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        return cls(normal(N_SYMBOLS, width), [normal(width + hidden + 1, 4 * hidden) for _ in range(2)], normal(2 * hidden + 1, N_TAGS), np.zeros((N_TAGS + 1, N_TAGS), np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.lstm, self.out, self.step]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list]:
    """x: (time, batch, width). Hidden states of every step, and what the gradient needs."""
    steps, n, _ = x.shape
    size = w.shape[1] // 4
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    one = np.ones((n, 1), np.float32)
    out, tape = np.empty((steps, n, size), np.float32), []
    for t in range(steps):
        z = np.concatenate([x[t], h, one], 1)
        g = z @ w
        gates, cand = _sigmoid(g[:, : 3 * size]), np.tanh(g[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        before = c
        c = f * c + i * cand
        tc = np.tanh(c)
        h = o * tc
        out[t] = h
        tape.append((z, i, f, o, cand, before, tc))
    return out, tape


def _lstm_back(d_out: np.ndarray, w: np.ndarray, tape: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    steps, n, size = d_out.shape
    dw, dx = np.zeros_like(w), np.empty((steps, n, width), np.float32)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in range(steps - 1, -1, -1):
        z, i, f, o, cand, before, tc = tape[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate([dc * cand * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - cand * cand)], 1)
        dw += z.T @ dg
        dz = dg @ w.T
        dx[t], dh, dc = dz[:, :width], dz[:, width:-1], dc * f
    return dw, dx


def _scores(m: Tagger, symbols: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Emission scores (time, batch, tag) of windows (batch, time)."""
    x = m.embed[symbols.T]
    fore, tape_f = _lstm(x, m.lstm[0])
    back, tape_b = _lstm(x[::-1], m.lstm[1])
    z = np.concatenate([fore, back[::-1], np.ones((*x.shape[:2], 1), np.float32)], 2)
    return z @ m.out, (z, tape_f, tape_b)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _loss(m: Tagger, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """CRF negative log likelihood per window, and its gradients."""
    score, (z, tape_f, tape_b) = _scores(m, symbols)
    steps, n, _ = score.shape
    start, step = m.step[-1], m.step[:-1]
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = start + score[0]
    for t in range(1, steps):
        alpha[t] = score[t] + _logsum(alpha[t - 1][:, :, None] + step[None], 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _logsum((beta[t + 1] + score[t + 1])[:, None, :] + step[None], 2)
    total = _logsum(alpha[-1], 1)
    gold = tags.T
    rows = np.arange(n)
    d = np.exp(alpha + beta - total[None, :, None])
    path = start[gold[0]] + score[0, rows, gold[0]]
    d_step = np.zeros_like(m.step)
    d_step[-1] = d[0].sum(0)
    np.subtract.at(d_step[-1], gold[0], 1)
    for t in range(1, steps):
        path = path + step[gold[t - 1], gold[t]] + score[t, rows, gold[t]]
        joint = np.exp(alpha[t - 1][:, :, None] + step[None] + (score[t] + beta[t] - total[:, None])[:, None, :])
        d_step[:-1] += joint.sum(0)
        np.subtract.at(d_step, (gold[t - 1], gold[t]), 1)
    np.subtract.at(d, (np.arange(steps)[:, None], rows[None], gold), 1)
    d /= n
    size = m.lstm[0].shape[1] // 4
    d_out = np.tensordot(z, d, ([0, 1], [0, 1]))
    dz = d @ m.out.T
    width = m.embed.shape[1]
    wf, xf = _lstm_back(dz[:, :, :size], m.lstm[0], tape_f, width)
    wb, xb = _lstm_back(dz[::-1, :, size : 2 * size], m.lstm[1], tape_b, width)
    d_embed = np.zeros_like(m.embed)
    np.add.at(d_embed, symbols.T, xf + xb[::-1])
    return float((total - path).mean()), [d_embed, wf, wb, d_out.astype(np.float32), d_step / n]


def fit(windows: np.ndarray, tags: np.ndarray, steps: int = 400, batch: int = 64, seed: int = 7) -> Tagger:
    """Adam on windows drawn at random."""
    rng = np.random.default_rng(seed)
    m = Tagger.fresh(rng)
    first, second = ([np.zeros_like(p) for p in m.parts()] for _ in range(2))
    for k in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        _, grads = _loss(m, windows[pick], tags[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - 0.9 * k / steps)
        for p, g, a, b in zip(m.parts(), grads, first, second, strict=True):
            g = g * min(1, 5 / (norm + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return m


def decode(m: Tagger, symbols: np.ndarray) -> np.ndarray:
    """The best tags (batch, time) of windows."""
    score, _ = _scores(m, symbols)
    steps, n, _ = score.shape
    best, back = m.step[-1] + score[0], np.empty((steps, n, N_TAGS), np.int8)
    for t in range(1, steps):
        way = best[:, :, None] + m.step[:-1][None]
        back[t] = way.argmax(1)
        best = way.max(1) + score[t]
    tags = np.empty((n, steps), np.int8)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t, rows, tags[:, t]]
    return tags


def symbols_of(text: str) -> np.ndarray:
    """One symbol per code point."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _SYMBOLS[np.minimum(code, 128)]


# --- training data ---------------------------------------------------------------------------------------------------


def _variants(s: str, kind: int, rng: np.random.Generator) -> str:
    """The span itself, or a form that the rules miss."""
    way = int(rng.integers(0, 4))
    if way == 0:
        return s
    if kind == 0:
        return [s.replace("@", " @ "), s.replace("@", " (at) "), s.replace("@", " [at] ")][way - 1]
    if kind == 1:
        return [s.replace(".", " . "), s.replace(".", ". "), s.replace(".", ",")][way - 1]
    n = digits(s)
    if kind == 2:
        return [".", "/", " - "][way - 1].join(n[i : i + 4] for i in range(0, len(n), 4))
    n = n[-10:]
    return [f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}.{n[3:6]}.{n[6:]}"][way - 1]


def _made_up(kind: int, rng: np.random.Generator) -> str:
    """A span of the kind, for what the sample lacks; kind 4: digits that are no personal data."""
    num = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    word = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, k))
    if kind == 0:
        a, b = word(int(rng.integers(2, 9))), word(int(rng.integers(2, 9)))
        host = word(int(rng.integers(3, 10))) + (f".{word(int(rng.integers(3, 8)))}" if rng.random() < 0.3 else "")
        return f"{[a, f'{a}.{b}', f'{a}.{num(2)}', f'{a}{num(2)}', f'{a}_{b}'][int(rng.integers(0, 5))]}@{host}.{['com', 'org', 'net', 'de'][int(rng.integers(0, 4))]}"
    if kind == 1:
        return ".".join(str(int(x)) for x in rng.integers(0, 1 + rng.choice([9, 99, 255], 4)))
    if kind == 2:
        body = "4" + num(14)
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))
    if kind == 3:
        return f"+{int(rng.integers(1, 99))} ({num(3)}) {num(3)}-{num(4)}"
    return [num(int(rng.integers(1, 9))), f"{num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", hashlib.md5(num(9).encode()).hexdigest(), "AK" + num(3).join([word(3).upper()] * 4), f"{num(2)},{num(3)}", f"#{num(5)}"][int(rng.integers(0, 9))]


def training_windows(contexts: list[tuple[str, str, str, int]], n: int = 4000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from (text before, span, text after, kind or 4)."""
    rng = np.random.default_rng(seed)
    around = [(a, b) for a, _, b, _ in contexts] or [("the word ", " and more")]
    known = {k: [s for _, s, _, kind in contexts if kind == k] for k in range(5)}
    x, y = np.full((n, WINDOW), PAD, np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        kind = int(rng.integers(0, 5))
        pool = known[kind]
        s = pool[int(rng.integers(0, len(pool)))] if pool and rng.random() < 0.6 else _made_up(kind, rng)
        s = _variants(s, kind, rng) if kind < 4 else s
        a, b = around[int(rng.integers(0, len(around)))]
        if rng.random() < 0.4:  # other words around it
            a, b = ("".join(["".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(1, 9)))) + " " for _ in range(int(rng.integers(0, 8)))]) for _ in range(2))
            b = " " + b
        a = a[len(a) - int(rng.integers(0, len(a) + 1)) :] if a else a
        tags = [0] * len(a) + ([1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1) if kind < 4 else [0] * len(s)) + [0] * len(b)
        sym = symbols_of(a + s + b)[:WINDOW]
        x[row, : len(sym)] = sym
        y[row, : len(sym)] = tags[:WINDOW]
    return x, y


def _contexts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out = []
    for text in batch.column(0).to_pylist():
        spans = base_spans(text)
        other = [(*m.span(), 4) for m in re.finditer(r"\S*[0-9]\S*", text) if not any(a < m.end() and m.start() < b for a, b, _ in spans)]
        out += [{"a": text[max(0, a - 40) : a], "s": text[a:b], "b": text[b : b + 40], "k": k} for a, b, k in [*spans, *other] if b - a <= 60]
    yield pa.RecordBatch.from_pylist(out, pa.schema([("a", pa.string()), ("s", pa.string()), ("b", pa.string()), ("k", pa.int32())]))


def train(docs: DataFrame, text_col: str = "text", max_rows: int = 3000) -> Tagger:
    """Train on rule matches of about max_rows documents that hold a digit or an @ (chosen by a hash of the text)."""
    rows = docs.select(F.col(text_col).alias("text")).where("text rlike '[0-9@]'")
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, max_rows / max(1, n))))
    found = picked.mapInArrow(per_batch(_contexts), "a string, s string, b string, k int")
    sample = found.orderBy(F.xxhash64("a", "s", "b"), "a", "s", "b", "k").limit(max_rows).collect()
    return fit(*training_windows([tuple(r) for r in sample]))


# --- detection -------------------------------------------------------------------------------------------------------

_MARK = re.compile(r"[0-9@]|\(at\)|\[at\]")


def _starts(text: str) -> list[int]:
    """Starts of the windows around every mark."""
    return sorted({max(0, (k - back) * STRIDE) for m in _MARK.finditer(text) for k in [m.start() // STRIDE] for back in range(WINDOW // STRIDE)})


def _has_mark(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts of a block have a mark (also one that is cut by a text's end, which finds nothing)."""
    mark = ((buf >= 48) & (buf <= 57)) | (buf == 64)
    if len(buf) >= 4:
        at = (buf[1:-2] == 97) & (buf[2:-1] == 116)
        mark[:-3] |= at & (((buf[:-3] == 40) & (buf[3:] == 41)) | ((buf[:-3] == 91) & (buf[3:] == 93)))
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[offs[1:]] > total[offs[:-1]]


def _spans_of(tags: np.ndarray) -> list[Span]:
    found, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and not (t == 2 + 2 * kind):
            found.append((start, i, kind))
            start = -1
        if t % 2 == 1:
            start, kind = i, t // 2
    return found


def _snapped(text: str, a: int, b: int, k: int) -> Span:
    """The span with the rest of a word or number that it cuts."""
    while a and text[a - 1] in _LOCAL and text[a - 1].isalnum():
        a -= 1
    while b < len(text) and text[b] in _LOCAL and text[b].isalnum():
        b += 1
    return a, b, k


def reconcile(text: str, base: list[Span], windows: list[tuple[int, np.ndarray]]) -> list[Span]:
    """Base spans and those that the windows (start, tags) add."""
    votes: Counter[Span] = Counter(
        _snapped(text, s + a, s + b, k) for s, tags in windows for a, b, k in _spans_of(tags) if (a > 0 or s == 0) and (b < WINDOW or s + b == len(text)) and s + b <= len(text)
    )
    kept, starts = list(base), [s for s, _ in windows]
    for (a, b, k), n in sorted(votes.items(), key=lambda v: (-v[1], v[0][0] - v[0][1], v[0])):
        holding = sum(s < a or s == a == 0 for s in starts if s + WINDOW > b and s <= a)
        if 2 * n > holding and not any(a < y and x < b for x, y, _ in kept) and plausible(text[a:b], k):
            kept.append((a, b, k))
    return sorted(kept, key=lambda s: (s[0], s[2]))


def find_spans(texts: list[str], m: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) if _MARK.search(t) else [] for t in texts]
    where = [(d, s) for d, t in enumerate(texts) for s in _starts(t)]
    windows: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
    sym: dict[int, np.ndarray] = {}
    for lo in range(0, len(where), 2048):
        part = where[lo : lo + 2048]
        x = np.full((len(part), WINDOW), PAD, np.int64)
        for row, (d, s) in enumerate(part):
            if d not in sym:
                sym = {d: symbols_of(texts[d])}
            own = sym[d][s : s + WINDOW]
            x[row, : len(own)] = own
        for (d, s), tags in zip(part, decode(m, x), strict=True):
            windows[d].append((s, tags))
    return [(b, reconcile(t, b, w) if w else b) for t, b, w in zip(texts, base, windows, strict=True)]


def held_out_quality(m: Tagger, n: int = 1500, seed: int = 4242) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind's spans on made-up windows of another seed (spans that a window cuts do not count)."""
    x, y = training_windows([], n, seed)
    hit, told_n, true_n = Counter(), Counter(), Counter()
    for row, tags, gold in zip(x, decode(m, x), y, strict=True):
        end = int((row != PAD).sum())
        a, b = ({s for s in _spans_of(t) if 0 < s[0] and s[1] < end} for t in (tags, gold))
        for s in a | b:
            hit[s[2]] += s in a and s in b
            told_n[s[2]] += s in a
            true_n[s[2]] += s in b
    return {k: (hit[i] / max(1, told_n[i]), hit[i] / max(1, true_n[i])) for i, k in enumerate(KINDS)}


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, m: Tagger, keep: list[str], text_col: str = "text", redact: bool = False) -> DataFrame:
    """The columns in keep, n_email, n_ip, n_card and n_phone (base spans), base_sha256, spans and, if asked for, redacted (null for null)."""
    held = docs.sparkSession.sparkContext.broadcast(m)
    names = [f"n_{k}" for k in KINDS]
    taken = {*names, "base_sha256", "spans", *["redacted"] * redact}
    keep = [c for c in keep if c not in taken]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        text = batch.column(len(keep))
        for lo, hi, buf, offs in blocks(text):
            some = np.flatnonzero(_has_mark(buf, offs))
            texts = [buf[offs[d] : offs[d + 1]].tobytes().decode("utf-8", "surrogatepass") for d in some]
            base, every, clean = [""] * (hi - lo), [""] * (hi - lo), {}
            counts = np.zeros((len(KINDS), hi - lo), np.int64)
            for d, t, (b, e) in zip(some, texts, find_spans(texts, held.value), strict=True):
                base[d], every[d] = told(b), told(e)
                for _, _, k in b:
                    counts[k, d] += 1
                if e and redact:
                    clean[int(d)] = redacted(t, e)
            columns = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
            columns += [pa.array(c) for c in counts]
            columns += [pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(every, pa.string())]
            if redact:
                own = text.slice(lo, hi - lo)
                columns.append(pa.array([clean.get(d, x) for d, x in enumerate(own.to_pylist())], pa.string()) if clean else own)
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names, "base_sha256", "spans", *["redacted"] * redact])

    fields = [*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in names), *(T.StructField(c, T.StringType()) for c in ("base_sha256", "spans", *["redacted"] * redact))]
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(per_batch(run), T.StructType(fields))
