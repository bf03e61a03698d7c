"""Operator 9, personal data: a character-level bidirectional LSTM with CRF transitions.

Fixed patterns give the base spans (email, ip, card, phone). A tagger trained in numpy on
windows of labelled spans adds what the patterns miss. Its windows hold the base spans as they
are and the same ones disguised: blanks around signs, other signs between digits, ``00``
for ``+``; a disguised span keeps its label, so the tagger learns what no pattern says. It reads characters by class (lower,
upper and other letters, digits, every ASCII sign by itself) in windows of ``WINDOW``
characters that overlap by ``OVERLAP``. Each character's tag comes from the window in which it lies
farthest from the border, so spans run on over windows, however long. A
span is added if each of its characters is surely (``SURE``) tagged, it is possible (a card's digits pass
the Luhn test, an address has four numbers up to 255) and it meets no base span; of overlapping ones the surer stays.

All four kinds hold a digit or an ``@``. A span without either is never added, so windows
without either need no decoding; nothing else is skipped.

Labelled spans are those of at most ``ROWS`` documents with a digit or ``@``, the ones with the
smallest hashes of their id; training takes fixed seeds and steps.

Edge cases: a null text counts as empty and has no span; a very long text is tagged whole, window by window;
without labelled spans nothing
is added; of equally sure spans the first one stays; repeated rows get equal spans; rows without doc_id
are kept; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglake.llm.common import saved

KINDS = ("email", "ip", "card", "phone")
ROWS, WINDOW, OVERLAP, SURE, SHORTEST = 1_500, 128, 48, 0.9, 7
TRAIN_WINDOW, STEPS, BATCH, EMBEDDED, HIDDEN = 56, 480, 24, 10, 16
#: Windows of a learning document: around its spans, and around other digits or ``@``.
SPANS_EACH, OTHERS_EACH = 4, 3
#: Windows decoded at a time.
DECODED = 512

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@`` so that long words cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by the fixed patterns, ordered by kind and start."""
    spans = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _TRIGGER.search(text):
        return spans
    spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            spans.append((2, *m.span()))
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


# --- characters and tags ----------------------------------------------------------------

CLASSES = 40
TAGS = 1 + 2 * len(KINDS)
_LATIN = np.zeros(128, np.int64)
for _i in range(128):
    _c = chr(_i)
    _LATIN[_i] = 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c == " " else 5 if _c.isspace() or not _c.isprintable() else 0
_LATIN[_LATIN == 0] = np.arange(8, 8 + (_LATIN == 0).sum())


def encoded(text: str) -> np.ndarray:
    """The class of each character: 1-3 letters and digits, 4-5 blanks, 6 beyond ASCII, 8 on the signs; 0 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _LATIN[codes.clip(0, 127)], 6)


def tagged(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
    return tags


# --- the model --------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, one LSTM each way, a linear layer, and CRF transitions between the tags."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"embed": (CLASSES, EMBEDDED), "out": (2 * HIDDEN, TAGS), "bias": (TAGS,), "step": (TAGS, TAGS), "first": (TAGS,)}
        for way in ("f", "b"):
            shapes |= {f"x{way}": (EMBEDDED, 4 * HIDDEN), f"h{way}": (HIDDEN, 4 * HIDDEN), f"g{way}": (4 * HIDDEN,)}
        self.p = {k: rng.normal(0, 0.25 if len(s) > 1 else 0.01, s).astype(np.float32) for k, s in shapes.items()}
        for way in ("f", "b"):
            self.p[f"g{way}"][HIDDEN:2 * HIDDEN] = 1

    def _lstm(self, x: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        p, h, c = self.p, np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
        inner, out, kept = x @ p[f"x{way}"] + p[f"g{way}"], np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = inner[t] + h @ p[f"h{way}"]
            gates = _sigmoid(z[:, :3 * HIDDEN])
            i, f, o = np.split(gates, 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, last = c, h
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            kept.append((t, i, f, o, g, before, s, last))
        return out, kept

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (time, row, tag) of classes (time, row)."""
        e = self.p["embed"][x]
        (hf, kf), (hb, kb) = self._lstm(e, "f"), self._lstm(e, "b")
        both = np.concatenate((hf, hb), axis=2)
        return both @ self.p["out"] + self.p["bias"], (e, both, kf, kb)

    def _alphas(self, s: np.ndarray) -> np.ndarray:
        a = np.empty_like(s)
        a[0] = s[0] + self.p["first"]
        for t in range(1, len(s)):
            a[t] = s[t] + _logsum(a[t - 1][:, :, None] + self.p["step"], 1)
        return a

    def _betas(self, s: np.ndarray) -> np.ndarray:
        b = np.zeros_like(s)
        for t in range(len(s) - 2, -1, -1):
            b[t] = _logsum(self.p["step"] + (s[t + 1] + b[t + 1])[:, None, :], 2)
        return b

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y (time, row), and its gradient."""
        s, (e, both, kf, kb) = self.scores(x)
        rows, length = x.shape[1], len(x)
        a, b = self._alphas(s), self._betas(s)
        total = _logsum(a[-1], 1)
        marginal = np.exp(a + b - total[None, :, None])
        grid = np.arange(rows)
        gold = s[np.arange(length)[:, None], grid, y].sum(0) + self.p["first"][y[0]] + self.p["step"][y[:-1], y[1:]].sum(0)
        ds = marginal.copy()
        ds[np.arange(length)[:, None], grid, y] -= 1
        ds /= rows
        g = {"first": ds[0].sum(0), "step": np.zeros((TAGS, TAGS), np.float32)}
        for t in range(length - 1):
            pair = a[t][:, :, None] + self.p["step"] + (s[t + 1] + b[t + 1])[:, None, :] - total[:, None, None]
            g["step"] += np.exp(pair).sum(0) / rows
        np.subtract.at(g["step"], (y[:-1].ravel(), y[1:].ravel()), 1 / rows)
        g["out"], g["bias"] = np.tensordot(both, ds, ((0, 1), (0, 1))), ds.sum((0, 1))
        db = ds @ self.p["out"].T
        de = np.zeros_like(e)
        for way, kept, part in (("f", kf, db[:, :, :HIDDEN]), ("b", kb, db[:, :, HIDDEN:])):
            de += self._back(way, kept, part, e, g)
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], x.ravel(), de.reshape(-1, EMBEDDED))
        return float((total - gold).mean()), g

    def _back(self, way: str, kept: list, part: np.ndarray, e: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
        dz_all, h_all = np.empty((*part.shape[:2], 4 * HIDDEN), np.float32), np.empty(part.shape, np.float32)
        dh, dc = np.zeros(part.shape[1:], np.float32), np.zeros(part.shape[1:], np.float32)
        for t, i, f, o, c_in, before, s, last in reversed(kept):
            dh = dh + part[t]
            dc = dc + dh * o * (1 - s * s)
            dz = np.concatenate((dc * c_in * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - c_in * c_in)), axis=1)
            dz_all[t], h_all[t] = dz, last
            dc, dh = dc * f, dz @ self.p[f"h{way}"].T
        g[f"h{way}"] = np.tensordot(h_all, dz_all, ((0, 1), (0, 1)))
        g[f"x{way}"] = np.tensordot(e, dz_all, ((0, 1), (0, 1)))
        g[f"g{way}"] = dz_all.sum((0, 1))
        return dz_all @ self.p[f"x{way}"].T

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> list[float]:
        """Adam on windows x with tags y (row, time)."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for n in range(1, steps + 1):
            rows = rng.integers(0, len(x), BATCH)
            loss, g = self.gradient(x[rows].T, y[rows].T)
            rate = 0.03 * min(1, n / 10) * (1 - 0.9 * n / steps)
            norm = max(1.0, float(np.sqrt(sum((w * w).sum() for w in g.values()))) / 5)
            for k, w in g.items():
                m[k] = 0.9 * m[k] + 0.1 * w / norm
                v[k] = 0.99 * v[k] + 0.01 * (w / norm) ** 2
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
            losses.append(loss)
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags (row, time) of windows x, and how sure each is."""
        s, _ = self.scores(x.T)
        best, back = s[0] + self.p["first"], np.empty(s.shape, np.int64)
        for t in range(1, len(s)):
            step = best[:, :, None] + self.p["step"]
            back[t] = step.argmax(1)
            best = s[t] + step.max(1)
        tags = np.empty(x.T.shape, np.int64)
        tags[-1] = best.argmax(1)
        rows = np.arange(x.shape[0])
        for t in range(len(s) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        a, b = self._alphas(s), self._betas(s)
        sure = np.exp(np.take_along_axis(a + b, tags[:, :, None], 2)[:, :, 0] - _logsum(a[-1], 1))
        return tags.T, sure.T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


# --- windows ----------------------------------------------------------------------------


def window_starts(length: int) -> list[int]:
    step = WINDOW - OVERLAP
    return list(range(0, max(1, length - OVERLAP), step))


def joined_tags(length: int, windows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One tag and how sure it is for each character, from decoded windows (start, tags, sure)."""
    tags, sure = np.zeros(length, np.int8), np.zeros(length, np.float32)
    for edge in (0, OVERLAP // 2):  # all that a window covers first, then what it is the best one for
        for start, t, s in windows:
            a = start + (edge if start else 0)
            b = min(length, start + WINDOW - (edge if start + WINDOW < length else 0))
            tags[a:b], sure[a:b] = t[a - start:b - start], s[a - start:b - start]
    return tags, sure


def found_spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[float, Span]]:
    """(sureness, span) of each run of tags of one kind; a run begins at a first tag or where another one ends."""
    out, t, marked = [], 0, np.flatnonzero(tags)
    for i in marked.tolist():
        if i < t:
            continue
        kind, t = (int(tags[i]) - 1) // 2, i + 1
        while t < len(tags) and tags[t] == 2 + 2 * kind:
            t += 1
        out.append((float(sure[i:t].min()), (kind, i, t)))
    return out


def possible(kind: int, piece: str) -> bool:
    """Whether a span can be what it is tagged as."""
    digits = _digits(piece)
    if kind == 0:
        return "@" in piece and "." in piece[piece.index("@"):]
    if kind == 1:
        numbers = re.findall("[0-9]+", piece)
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15 and piece.startswith(("+", "00"))


def reconciled(text: str, found: list[tuple[float, Span]], base: list[Span], sure: float = SURE) -> list[Span]:
    """The spans to add to the base ones, without overlaps."""
    taken = sorted((a, b) for _, a, b in base)
    added: list[Span] = []
    for surety, (kind, a, b) in sorted(found, key=lambda x: (-x[0], x[1])):
        if surety < sure or b - a < SHORTEST or not possible(kind, text[a:b]):
            continue
        if all(b <= c or d <= a for c, d in taken):
            taken.append((a, b))
            added.append((kind, a, b))
    return added


# Ways to write each kind that the patterns don't know, as (what, instead).
DISGUISES = (
    ((r"@", " @ "), (r"\.(?=[^@]*$)", " . "), (r"(@)|\.(?=[^@]*$)", lambda m: " @ " if m[1] else " . ")),
    ((r"\.", " . "), (r"\.", ","), (r"\.", " ")),
    ((r"[ -]?([0-9]{4})(?=[0-9 -])", r"\1."), (r"[ -]?([0-9]{4})(?=[0-9 -])", r"\1/"), (r"[ -]?([0-9]{4})(?=[0-9 -])", r"\1  ")),
    ((r"^\+", "00"), (r"[ .-]", "/"), (r"^\+", "00 ")),
)


def disguised(text: str, span: Span, way: int) -> tuple[str, Span]:
    """The text with one of its spans written another way, and the span there."""
    kind, a, b = span
    what, instead = DISGUISES[kind][way % len(DISGUISES[kind])]
    piece = re.sub(what, instead, text[a:b])
    return text[:a] + piece + text[b:], (kind, a, a + len(piece))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def learn(docs: DataFrame, rows: int = ROWS) -> Tagger | None:
    """A tagger trained on ``docs`` (doc_id, text), or None if there is no labelled span."""
    usable = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    ids = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = usable.join(F.broadcast(ids), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = TRAIN_WINDOW // 2
        for batch in batches:
            out = []

            def add(doc_id: int, k: int, x: np.ndarray, y: np.ndarray, middle: int, out: list = out) -> None:
                start = max(0, min(middle - half + (k * 11) % 23 - 11, len(x) - TRAIN_WINDOW))
                if not start or y[start] % 2 or y[start] == 0:  # no span is cut at the left
                    pad = (0, max(0, TRAIN_WINDOW - len(x)))
                    out.append((doc_id, k, np.pad(x, pad)[start:start + TRAIN_WINDOW].tolist(), np.pad(y, pad)[start:start + TRAIN_WINDOW].tolist()))

            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                x, spans = encoded(text), base_spans(text)
                y = tagged(len(x), spans)
                middles = [(a + b) // 2 for _, a, b in spans][:SPANS_EACH]
                middles += [m.start() for m in _TRIGGER.finditer(text)][:: max(1, len(text) // 200)][:OTHERS_EACH]
                for k, middle in enumerate(middles):
                    add(doc_id, k, x, y, middle)
                for k, span in enumerate(spans[:SPANS_EACH], len(middles)):
                    # only the neighbourhood is needed
                    low = max(0, span[1] - WINDOW)
                    near, own = disguised(text[low:span[2] + WINDOW], (span[0], span[1] - low, span[2] - low), k + doc_id)
                    others = [(kind, a, b) for kind, a, b in base_spans(near) if b <= own[1] or a >= own[2]]
                    add(doc_id, k, encoded(near), tagged(len(near), [own, *others]), (own[1] + own[2]) // 2)
            yield pd.DataFrame(out, columns=["doc_id", "k", "x", "y"])

    found = saved(sample.mapInPandas(cut, "doc_id long, k int, x array<int>, y array<int>"), "pii-windows").orderBy(F.xxhash64("doc_id"), "doc_id", "k").toPandas()
    if not len(found):
        return None
    x, y = np.stack(found["x"].to_numpy()).astype(np.int64), np.stack(found["y"].to_numpy()).astype(np.int64)
    if not y.any():
        return None
    tagger = Tagger()
    tagger.fit(x, y)
    return tagger


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """The counts of base spans, their digest and all spans of ``docs`` (doc_id, text)."""

    def added_spans(texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        added: list[list[Span]] = [[] for _ in texts]
        decoded: dict[int, list] = {}
        places: list[tuple[int, int]] = []
        codes: list[np.ndarray] = []

        def settle(up_to: int) -> None:
            """Decode what waits; rows before ``up_to`` have all their windows then."""
            if codes:
                tags, sure = tagger.decode(np.stack(codes))
                for (row, start), t, s in zip(places, tags.astype(np.int8), sure.astype(np.float32), strict=True):
                    decoded.setdefault(row, []).append((start, t, s))
                places.clear()
                codes.clear()
            for row in [r for r in decoded if r < up_to]:
                added[row] = reconciled(texts[row], found_spans(*joined_tags(len(texts[row]), decoded.pop(row))), base[row])

        for row, text in enumerate(texts):
            if not _TRIGGER.search(text):
                continue
            x = encoded(text).astype(np.uint8)
            marks = np.unique([m.start() for m in _TRIGGER.finditer(text)])
            for start in window_starts(len(x)):
                at = np.searchsorted(marks, start)
                if at < len(marks) and marks[at] < start + WINDOW:
                    places.append((row, start))
                    codes.append(np.pad(x[start:start + WINDOW], (0, max(0, start + WINDOW - len(x)))))
                    if len(codes) == DECODED:
                        settle(row)
        settle(len(texts))
        return added

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base) if tagger else [[] for _ in texts]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], **{f"n_{k}": [sum(s[0] == i for s in b) for b in base] for i, k in enumerate(KINDS)},
                "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
                "spans": [_joined(b + a) for b, a in zip(base, added, strict=True)],
            })

    # ids go as text, which has room for a missing one
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text)
    return rows.mapInPandas(run, SPANS.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
