"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The model tags characters (outside, or first or later character of an e-mail
address, IP address, card or phone number). It is trained in numpy, by Adam on
the CRF likelihood, from labelled spans: what the patterns find in at most
``TRAIN_DOCS`` documents with a digit or an @, chosen by a hash: a fifth of that
with a span of each kind, and a fifth without any. A document of any length gives at
most ``DOC_WINDOWS`` windows, the first with a span if it has one, so a table with a
labelled span has it in the sample. Windows of ``WINDOW`` characters start
every ``STEP``; every span of the four kinds holds a digit or an @, so windows
without either are outside as a whole and are not run. Scores of a character
from overlapping windows are averaged, those near a window's middle counting
more, and one Viterbi pass decodes each covered stretch of the text, so windows
cannot disagree. A decoded span is added if its characters' probability is at
least ``SURE``, it touches no span of the patterns, and it is plausible: check
digit, parts and number of digits as the patterns have them.

Rules: null text is empty; rows repeat as they come, with null or repeated ids;
texts of any length are read whole; an empty table gives an empty result, a table
without labelled spans adds none; other columns are ignored. Model spans have
kinds of their own, ``model_email`` and so on, listed after the patterns'.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import discard, slices, stage, texts

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training table: documents, and windows of them.
TRAIN_DOCS, TRAIN_WINDOWS, DOC_WINDOWS = 600, 1200, 8
WINDOW, STEP, SURE = 64, 32, 0.9
EMBED, HIDDEN, TAGS, CHARS = 12, 16, 1 + 2 * len(KINDS), 130

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match never begins within a run of digits
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def plausible(kind: int, span: str) -> bool:
    """Whether what the model found can be data of its kind: check digit, part sizes, number of digits."""
    digits = re.sub("[^0-9]", "", span)
    if KINDS[kind] == "email":
        return "@" in span
    if KINDS[kind] == "ip":
        return span.count(".") == 3 and all(0 < len(x) <= 3 and int(x) <= 255 for x in re.findall("[0-9]+", span))
    if KINDS[kind] == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of what the patterns find, by kind and start."""
    if not _CUE.search(text):
        return []
    out, at, end = [], text.find("@"), 0
    while at >= 0:  # the local part is the run before the @, from the last match's end at most
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, end := found.end()))
        at = text.find("@", found.end() if found else at + 1)
    for m in _IP.finditer(text):
        places = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in places):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


# ---- model ---------------------------------------------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """0 stands for what lies beyond the text, 129 for characters that are not ASCII."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(points < 128, points + 1, 129).astype(np.int16)


def windows(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an @."""
    cues = np.fromiter((m.start() for m in _CUE.finditer(text)), np.int64)
    last = np.unique(cues // STEP)
    starts = np.unique(np.concatenate([last - i for i in range(WINDOW // STEP)])) if len(last) else last
    return (starts[starts >= 0] * STEP).tolist()


def cut(text_codes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.append(text_codes, np.zeros(WINDOW, np.int16))
    return padded[np.array(starts, np.int64)[:, None] + np.arange(WINDOW)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_model(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    model = {"embed": draw(CHARS, EMBED) * 3, "out": draw(2 * HIDDEN, TAGS), "out_bias": np.zeros(TAGS, np.float32),
             "next": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
    for side in "fb":
        model |= {f"{side}_in": draw(EMBED, 4 * HIDDEN), f"{side}_rec": draw(HIDDEN, 4 * HIDDEN), f"{side}_bias": np.zeros(4 * HIDDEN, np.float32)}
    return model


def lstm(model: dict, side: str, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states of one direction; x is (time, batch, EMBED)."""
    pre = x @ model[f"{side}_in"] + model[f"{side}_bias"]
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((len(x), x.shape[1], HIDDEN), np.float32)
    for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
        z = pre[t] + h @ model[f"{side}_rec"]
        gates, g = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, h_before = c, h
        c = f * c + i * g
        tanh = np.tanh(c)
        h = out[t] = o * tanh
        if trace is not None:
            trace.append((t, i, f, o, g, before, tanh, h_before))
    return out


def lstm_back(model: dict, side: str, x: np.ndarray, trace: list, d_out: np.ndarray, grad: dict) -> np.ndarray:
    d_h = d_c = np.zeros((x.shape[1], HIDDEN), np.float32)
    d_pre = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
    for t, i, f, o, g, before, tanh, h_before in reversed(trace):
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - tanh * tanh)
        z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tanh * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        grad[f"{side}_rec"] += h_before.T @ z
        d_pre[t] = z
        d_h, d_c = z @ model[f"{side}_rec"].T, d_c * f
    flat = d_pre.reshape(-1, 4 * HIDDEN)
    grad[f"{side}_in"] += x.reshape(-1, EMBED).T @ flat
    grad[f"{side}_bias"] += flat.sum(0)
    return d_pre @ model[f"{side}_in"].T


def emissions(model: dict, batch: np.ndarray) -> np.ndarray:
    """Scores (time, batch, tag) of windows (batch, time)."""
    x = model["embed"][batch.T]
    return np.concatenate([lstm(model, "f", x), lstm(model, "b", x)], axis=2) @ model["out"] + model["out_bias"]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf(model: dict, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums, and the log of the total; score is (time, batch, tag)."""
    ahead, behind = np.empty_like(score), np.zeros_like(score)
    ahead[0] = model["first"] + score[0]
    for t in range(1, len(score)):
        ahead[t] = log_sum(ahead[t - 1][:, :, None] + model["next"], 1) + score[t]
    for t in range(len(score) - 2, -1, -1):
        behind[t] = log_sum(model["next"] + (score[t + 1] + behind[t + 1])[:, None, :], 2)
    return ahead, behind, log_sum(ahead[-1], 1)


def train(batches: np.ndarray, tags: np.ndarray, epochs: int = 12, size: int = 16, rate: float = 0.03, seed: int = 11) -> dict[str, np.ndarray]:
    """Model fitted to windows (rows, WINDOW) and their tags."""
    model, rng = start_model(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    step, steps = 0, max(1, epochs * -(-len(batches) // size))
    for _ in range(epochs):
        order = rng.permutation(len(batches))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            x, y = model["embed"][batches[pick].T], tags[pick].T
            traces: dict[str, list] = {"f": [], "b": []}
            hidden = np.concatenate([lstm(model, s, x, traces[s]) for s in "fb"], axis=2)
            score = hidden @ model["out"] + model["out_bias"]
            ahead, behind, total = crf(model, score)
            d_score = np.exp(ahead + behind - total[:, None])
            grad = {k: np.zeros_like(v) for k, v in model.items()}
            pair = np.exp(ahead[:-1, :, :, None] + model["next"] + (score[1:] + behind[1:])[:, :, None, :] - total[:, None, None])
            grad["next"] += pair.sum((0, 1))
            np.subtract.at(grad["next"], (y[:-1].ravel(), y[1:].ravel()), 1)
            grad["first"] += d_score[0].sum(0)
            np.subtract.at(grad["first"], y[0], 1)
            np.subtract.at(d_score, (np.arange(len(y))[:, None], np.arange(y.shape[1]), y), 1)
            grad["out"] += hidden.reshape(-1, 2 * HIDDEN).T @ d_score.reshape(-1, TAGS)
            grad["out_bias"] += d_score.sum((0, 1))
            d_hidden = d_score @ model["out"].T
            d_x = sum(lstm_back(model, s, x, traces[s], d_hidden[:, :, i * HIDDEN : (i + 1) * HIDDEN], grad) for i, s in enumerate("fb"))
            np.add.at(grad["embed"], batches[pick].T, d_x)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values())) / len(pick)
            scale = min(1.0, 5 / max(norm, 1e-9)) / len(pick)
            for k, g in grad.items():
                g *= scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = (model[k] - rate * (1 - step / (steps + 1)) * (first[k] / (1 - 0.9**step))
                            / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def decode(model: dict, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags of one stretch (time, tag), and the probability of each."""
    back = np.zeros(score.shape, np.int64)
    best = model["first"] + score[0]
    for t in range(1, len(score)):
        step = best[:, None] + model["next"]
        back[t] = step.argmax(0)
        best = step.max(0) + score[t]
    path = np.empty(len(score), np.int64)
    path[-1] = best.argmax()
    for t in range(len(score) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    ahead, behind, total = crf(model, score[:, None, :])
    return path, np.exp(ahead + behind - total[:, None])[np.arange(len(path)), 0, path]


def model_spans(text: str, starts: list[int], score: np.ndarray, model: dict) -> list[tuple[int, int, int]]:
    """Spans of a text from the scores (window, time, tag) of its windows."""
    weight = (1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])).astype(np.float32)
    out, i = [], 0
    while i < len(starts):
        j = i
        while j + 1 < len(starts) and starts[j + 1] <= starts[j] + WINDOW:
            j += 1
        low, high = starts[i], min(starts[j] + WINDOW, len(text))
        total, mass = np.zeros((starts[j] + WINDOW - low, TAGS), np.float32), np.zeros((starts[j] + WINDOW - low, 1), np.float32)
        for k in range(i, j + 1):
            at = slice(starts[k] - low, starts[k] - low + WINDOW)
            total[at] += score[k] * weight[:, None]
            mass[at] += weight[:, None]
        path, sure = decode(model, (total / mass)[: high - low])
        t = 0
        while t < len(path):
            end = t + 1
            if path[t]:
                kind = (path[t] - 1) // 2
                while end < len(path) and path[end] == 2 * kind + 2:
                    end += 1
                if sure[t:end].min() >= SURE and plausible(int(kind), text[low + t : low + end]):
                    out.append((len(KINDS) + int(kind), low + t, low + end))
            t = end
        i = j + 1
    return out


def training_windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """At most ``DOC_WINDOWS`` windows of a text and their tags: those with a span, of each kind in turn, between others."""
    tags = np.zeros(len(text) + WINDOW, np.int8)
    for kind, start, end in sorted(base_spans(text), key=lambda s: -s[0]):
        tags[start:end] = 2 * kind + 2
        tags[start] = 2 * kind + 1
    starts = np.array(windows(text), np.int64)
    own = tags[starts[:, None] + np.arange(WINDOW)] if len(starts) else np.zeros((0, WINDOW), np.int8)
    turn = np.full(len(starts), len(starts))  # a window's place among those of a kind, the least over its kinds
    for kind in range(len(KINDS)):
        held = np.flatnonzero((own == 2 * kind + 1).any(1))
        turn[held] = np.minimum(turn[held], np.arange(len(held)))
    labelled = np.argsort(turn, kind="stable")[: min(DOC_WINDOWS - DOC_WINDOWS // 4, int((turn < len(starts)).sum()))]
    rest = np.setdiff1d(np.arange(len(starts)), labelled)[: DOC_WINDOWS - len(labelled)]
    turns = np.concatenate([2 * np.arange(len(labelled)), 2 * np.arange(len(rest)) + 1])  # with a span and without in turn
    pick = np.concatenate([labelled, rest])[np.argsort(turns)].astype(np.int64)
    return cut(codes(text), starts[pick].tolist()), own[pick].astype(np.int64)


def training_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from at most ``TRAIN_DOCS`` documents with a digit or an @, by hash: an equal share with a span of each kind, and without."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kinds = [sorted({k for k, _, _ in base_spans(t)}) or [len(KINDS)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("at"), pa.array(kinds, pa.list_(pa.int32()))], ["at", "kinds"])

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [training_windows(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("at"), *(pa.array([r[k].astype(np.int16).tobytes() for r in rows], pa.binary()) for k in range(2))], ["at", "x", "y"])

    cued = texts(docs).where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text", F.lit(3)).alias("at"))
    found = stage(cued.mapInArrow(label, "at long, kinds array<int>"), "labelled")
    picked: set[int] = set()
    for kind in range(len(KINDS) + 1):  # the last: texts without a span
        own = found.where(F.array_contains("kinds", F.lit(kind))).select("at").distinct()
        picked |= {r["at"] for r in own.orderBy("at").limit(TRAIN_DOCS // (len(KINDS) + 1)).collect()}
    discard(found)
    if not picked:
        return np.zeros((0, WINDOW), np.int16), np.zeros((0, WINDOW), np.int64)
    drawn = {r["at"]: (r["x"], r["y"]) for r in cued.where(F.col("at").isin(sorted(picked))).mapInArrow(
        windowed, "at long, x binary, y binary").dropDuplicates(["at"]).collect()}
    both = [tuple(np.frombuffer(v, np.int16).reshape(-1, WINDOW) for v in drawn[at]) for at in sorted(drawn)]
    order = [(k, i) for k in range(DOC_WINDOWS) for i in range(len(both)) if k < len(both[i][0])][:TRAIN_WINDOWS]
    return np.stack([both[i][0][k] for k, i in order]), np.stack([both[i][1][k] for k, i in order]).astype(np.int64)


def names_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k] if k < len(KINDS) else 'model_' + KINDS[k - len(KINDS)]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    if model is None:
        x, y = training_table(docs)
        model = train(x, y) if y.any() else {}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = part.column("text").to_pylist()
            base = [base_spans(t) for t in rows]
            more: list[list] = [[] for _ in rows]
            starts = [windows(t) if model else [] for t in rows]
            own = np.concatenate([cut(codes(t), s) for t, s in zip(rows, starts) if s]) if any(starts) else np.zeros((0, WINDOW), np.int16)
            score = np.concatenate([emissions(model, own[i : i + 256]).transpose(1, 0, 2) for i in range(0, len(own), 256)]) if len(own) else own
            at = 0
            for i, (text, s) in enumerate(zip(rows, starts)):
                if s:
                    taken = np.zeros(len(text) + 1, bool)
                    for _, a, b in base[i]:
                        taken[a:b] = True
                    more[i] = [x for x in model_spans(text, s, score[at : at + len(s)], model) if not taken[x[1] : x[2]].any()]
                    at += len(s)
            counts = [[sum(k == x[0] for x in spans) for spans in base] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(names_of(s).encode()).hexdigest() for s in base], pa.string()),
                 pa.array([names_of(s + m) for s, m in zip(base, more)], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    own = texts(docs)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(find, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
