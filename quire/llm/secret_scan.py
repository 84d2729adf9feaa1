"""Secret scans: base rules, and a character convolutional network over every wider candidate with its context.

The base rules give their findings as they are. Candidates of the network are their values, which it scores alone, and
other long runs of key characters, letters alone and digits alone included, unless they hold few different characters.
A convolutional network in numpy reads LEFT characters before, the candidate's head and tail, and RIGHT after,
each with its own max pooling. Of a candidate longer than head and tail it reads pieces all along as well, each with
what is around it, and the highest score counts: any 32 characters in a row are in one piece. It is trained on labelled
findings (by default made from a seeded generator), its scores are calibrated on a fold it hasn't seen, and each
candidate class gets the highest threshold that keeps the wanted recall there, that of all classes together if the fold
has no secret of the class.

Defined cases: a null text is empty and has no finding; findings of one kind never overlap, those of different kinds
may; of a run that base findings overlap, what they leave over is a candidate if it is one by itself; a text of any
length is read whole; repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "other")
#: The base rules, each with the group and length a finding needs.
RULES = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: The same findings of hex, sooner: a run that long is met at its first character.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = 16
#: Different characters that make a run a candidate, whatever they are; with fewer it needs a letter and a digit.
VARIED = 8
WIDE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
LEFT, HEAD, TAIL, RIGHT, WIDTH, FILTERS, DENSE = 20, 32, 12, 12, 5, 20, 16
#: Longer candidates are read in pieces of SPAN characters too, one every STEP.
SPAN, STEP = HEAD + TAIL, 12
SEGMENTS = ((0, LEFT), (LEFT, LEFT + HEAD + TAIL), (LEFT + HEAD + TAIL, LEFT + HEAD + TAIL + RIGHT))


def base_findings(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base rules."""
    found = []
    low = text.lower()
    for kind in KINDS[:3]:
        rule, group, least = RULES[kind]
        if kind == "assign" and not any(n in low for n in NAMES) or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), kind, m.end()) for m in (LONG_HEX if kind == "hex" else rule).finditer(text) if m.end(group) - m.start(group) >= least]
    return found


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """Runs of key characters that are varied or have a letter and a digit, without what of them is in base findings."""
    out, taken, i = [], [], 0
    for a, _, b in sorted(base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for m in WIDE.finditer(text):
        at, end = m.span()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        k = i
        while at < end:
            a, b = taken[k] if k < len(taken) and taken[k][0] < end else (end, end)
            run = text[at:a]
            if len(run) >= LEAST and (len(set(run)) >= VARIED or any(c.isdigit() for c in run) and any(c.isalpha() for c in run)):
                out.append((at, a))
            at, k = b, k + 1
    return out


@functools.cache
def _classes() -> dict[str, int]:
    """The class of a character: its own for the commoner ones, else one for each kind."""
    own = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-.:@\"' \n#&?,;()<>{}[]$%*!|~\\"
    return {c: i + 2 for i, c in enumerate(own)}


N_CLASSES = len(_classes()) + 3


def window(text: str, a: int, b: int) -> np.ndarray:
    """Classes of the characters around and in text[a:b]; 0 where there is none, 1 for others below 128, last above."""
    head, tail = text[a : min(b, a + HEAD)], text[max(a + HEAD, b - TAIL) : b]
    parts = text[max(0, a - LEFT) : a].rjust(LEFT, "\0"), head.ljust(HEAD, "\0"), tail.ljust(TAIL, "\0"), text[b : b + RIGHT].ljust(RIGHT, "\0")
    return _codes("".join(parts))


def _codes(text: str) -> np.ndarray:
    known = _classes()
    return np.array([0 if c == "\0" else known.get(c, 1 if c < "\x80" else N_CLASSES - 1) for c in text], np.int16)


def windows(text: str, a: int, b: int) -> np.ndarray:
    """The window of text[a:b] and, where that leaves out its middle, those of pieces all along it."""
    ends = window(text, a, b)[None]
    if b - a <= SPAN:
        return ends
    around = _codes(text[max(0, a - LEFT) : a].rjust(LEFT, "\0") + text[a : b + RIGHT].ljust(b - a + RIGHT, "\0"))
    at = np.append(np.arange(0, b - a - SPAN, STEP), b - a - SPAN)
    return np.concatenate([ends, np.lib.stride_tricks.sliding_window_view(around, LEFT + SPAN + RIGHT)[at]])


def findings(n: int = 2600, seed: int = 5, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled findings from a seeded generator: (windows, labels, candidate classes); within: pieces of longer candidates."""
    r = random.Random(seed)
    hexa, upper, alnum, base64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    of = lambda chars, k: "".join(r.choices(chars, k=k))
    word = lambda: of("aeiounrstlhdc", 2 + int(r.random() * 7))
    spoken = lambda: "".join(pick("", of("bcdfghjklmnpqrstvwxyz", 1), pick("st", "pr", "br", "cl", "tr", "ch", "sh", "th")) + of("aeiou", 1) + pick("", of("bcdgklmnprstvx", 1), pick("rt", "ck", "st", "nd", "ng", "ss")) for _ in range(k(1, 4)))
    pick = lambda *x: x[int(r.random() * len(x))]
    k = lambda a, b: a + int(r.random() * (b - a))
    secret = (
        lambda: of(alnum, k(18, 48)),
        lambda: of(base64, k(22, 60)) + pick("", "=", "=="),
        lambda: pick("ghp_", "sk-", "sk_live_", "xoxb-", "glpat-", "AIza") + of(alnum, k(20, 40)),
        lambda: of(hexa, k(20, 32)),
        lambda: of(upper, k(18, 32)),
        lambda: "eyJ" + of(base64, k(20, 40)),
        lambda: of(pick(alnum[:26], alnum[26:52], alnum[:52]), k(18, 40)),
        lambda: pick("npm_", "pypi-", "dop_v1_", "EAAC", "SG.", "ya29", "key-", "hf_", "whsec_") + of(pick(alnum, base64, hexa), k(22, 50)),
        lambda: of(alnum[:26], k(2, 7)) + pick("-", "_") + pick("", "", "live_", "test_", "v1-", "prod-") + of(pick(alnum, alnum + "-_"), k(18, 42)),
        lambda: of(alnum[:26], k(3, 5)) + "-" + "".join(of("0123456789", k(9, 14)) + "-" for _ in range(k(1, 3))) + of(alnum, k(18, 34)),
        lambda: of(hexa, k(18, 32)),
    )
    stem = lambda: "".join(spoken() for _ in range(k(4, 9)))
    other = (
        lambda: "-".join(word() for _ in range(k(3, 6))) + f"-{k(1, 3000)}",
        lambda: "/".join(word() for _ in range(k(3, 6))) + f"/{k(1, 3000)}",
        lambda: "_".join(word() for _ in range(k(3, 6))) + f"_{k(1, 99)}",
        lambda: f"{k(1990, 2035)}-{k(10, 13)}-{k(10, 29)}T{k(10, 24)}-{k(10, 60)}-{k(10, 60)}Z",
        lambda: "".join(word().capitalize() for _ in range(k(3, 6))) + str(k(1, 100)),
        lambda: "x" * k(8, 20) + str(k(0, 10)) * k(8, 20),
        lambda: (word() * 8)[: k(16, 24)] + str(k(0, 100)),
        lambda: "=" * k(10, 20) + f"part{k(1, 20)}" + "=" * k(10, 20),
        lambda: f"{of(hexa, 8)}-{of(hexa, 4)}-4{of(hexa, 3)}-a{of(hexa, 3)}-{of(hexa, 12)}",
        lambda: f"build-{k(1, 20)}-{k(0, 20)}-{k(0, 999)}-{word()}-{word()}",
        lambda: pick(str.lower, str.capitalize, str.upper)((stem() + stem() + stem())[: k(16, 26)]),
        lambda: pick(str.lower, str.capitalize)("".join(pick("th", "er", "on", "an", "en", "in", "he", "re", "es", "sch", "tion", "keit", "ou", "al", "ment", "ung", "ado", "que", "ein", "ich") for _ in range(k(7, 11)))),
        lambda: of("0123456789", k(16, 21)),
        lambda: pick("4", "5", "3", "6") + of("0123456789", 15),
        lambda: str(k(1, 10)) + of("0123456789", k(15, 25)),
        lambda: f"{k(1990, 2035)}{k(10, 13)}{k(10, 29)}{k(10, 24)}{k(10, 60)}{k(10, 60)}" + of("0123456789", k(2, 7)),
        lambda: "0" * k(8, 20) + of("0123456789", k(3, 9)) if r.random() < 0.5 else pick("deadbeef", "cafebabe", "feedface", "abcdef", "0123456789abcdef") * k(3, 4),
        lambda: "-".join(of("0123456789", 4) for _ in range(k(4, 6))),
    )
    rows, labels, classes = [], [], []
    for i in range(n):
        label = int(r.random() < 0.5)
        token = pick(*(secret if label else other))()
        before = pick("", *(["key ", "auth: ", "bearer ", "credential=", "private ", "pass "] if label else ["see ", "file ", "at ", "page ", "id "]), "")
        left = " ".join(word() for _ in range(k(0, 5))) + pick(" ", "\n", ' "', " (") + before
        right = pick(" ", "\n", '" ', ". ", ") ") + " ".join(word() for _ in range(k(0, 4)))
        if within:
            # ordinary parts before and after; the piece holds most of the token that the label is of
            glue, part = pick("/", "/", "_", "-", "="), lambda: pick(spoken, spoken, spoken, word, pick(*other))()  # noqa: B023
            head, tail = (glue.join(part() for _ in range(k(2, 7))) for _ in range(2))
            a = len(left) + len(head) + 1
            token, b = head + glue + token + glue + tail, a + len(token)
            text = left + token + right
            least, most = len(left), max(len(left), len(left) + len(token) - SPAN)
            room = min(SPAN, b - a, 32)
            at = min(max(k(b - SPAN, a + 1) if b - a <= room else k(a, b - room + 1), least), most)
            rows.append(window(text, at, min(at + SPAN, len(left) + len(token))))
        else:
            text = left + token + right
            rows.append(window(text, len(left), len(left) + len(token)))
        labels.append(label)
        classes.append(candidate_class(token))
    return np.stack(rows), np.array(labels, np.float32), np.array(classes)


def candidate_class(token: str) -> int:
    """0: hex digits only, 1: one case of letters, 2: mixed."""
    return 0 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token) else 1 if token in (token.lower(), token.upper()) else 2


class CharNetwork:
    """Convolution over one-hot characters, ReLU, max pooling by segment, a dense layer and a calibrated output."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        g = lambda *s, fan: (r.standard_normal(s) * np.sqrt(2 / fan)).astype(np.float32)
        self.p = {"K": g(WIDTH, N_CLASSES, FILTERS, fan=WIDTH), "k": np.zeros(FILTERS, np.float32), "D": g(3 * FILTERS, DENSE, fan=3 * FILTERS), "d": np.zeros(DENSE, np.float32), "o": g(DENSE, fan=DENSE), "c": np.zeros(1, np.float32)}
        self.slope, self.shift, self.thresholds = 1.0, 0.0, np.full(3, 0.5)

    def forward(self, x: np.ndarray) -> dict:
        p = self.p
        t = x.shape[1] - WIDTH + 1
        c = p["k"] + sum(p["K"][j][x[:, j : j + t]] for j in range(WIDTH))
        pooled, where = [], []
        for a, b in SEGMENTS:
            part = c[:, a : min(b, t)]
            i = part.argmax(axis=1)
            where.append(i + a)
            pooled.append(np.take_along_axis(part, i[:, None], axis=1)[:, 0])
        m = np.concatenate(pooled, axis=1)
        m = np.maximum(m, 0)
        h = np.maximum(m @ p["D"] + p["d"], 0)
        return {"m": m, "h": h, "where": where, "z": h @ p["o"] + p["c"]}

    def fit(self, x: np.ndarray, y: np.ndarray, classes: np.ndarray, recall: float, epochs: int = 16, batch: int = 128, rate: float = 0.006) -> CharNetwork:
        """The last quarter of the rows is the calibration fold."""
        cut = len(x) * 3 // 4
        r, m, s, t = np.random.default_rng(1), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(cut)
            for i in range(0, cut, batch):
                rows = order[i : i + batch]
                t += 1
                for k, v in self._gradients(x[rows], y[rows]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * v
                    s[k] = 0.999 * s.get(k, 0) + 0.001 * v * v
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        z, labels = self.forward(x[cut:])["z"].astype(np.float64), y[cut:]
        for _ in range(500):  # Platt's scaling, by gradient steps on slope and shift
            e = 1 / (1 + np.exp(-(self.slope * z + self.shift))) - labels
            self.slope -= 0.05 * (float((e * z).mean()) + 0.01 * (self.slope - 1))
            self.shift -= 0.05 * float(e.mean())
        score = self.scores(x[cut:])
        every = np.sort(score[labels == 1])
        for c in range(3):
            positive = np.sort(score[(classes[cut:] == c) & (labels == 1)])
            if len(positive := positive if len(positive) else every):
                self.thresholds[c] = positive[int((1 - recall) * len(positive) + 1e-9)]
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        f, p = self.forward(x), self.p
        dz = (1 / (1 + np.exp(-np.clip(f["z"], -30, 30))) - y) / len(y)
        dh = dz[:, None] * p["o"] * (f["h"] > 0)
        dm = (dh @ p["D"].T) * (f["m"] > 0)
        dk = np.zeros_like(p["K"])
        for i, at in enumerate(f["where"]):
            d = dm[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(WIDTH):
                cell = np.take_along_axis(x, at + j, axis=1).astype(np.int64) * FILTERS + np.arange(FILTERS)
                dk[j] += np.bincount(cell.reshape(-1), d.reshape(-1), N_CLASSES * FILTERS).reshape(N_CLASSES, FILTERS)
        return {"K": dk, "k": sum(dm[:, i * FILTERS : (i + 1) * FILTERS].sum(axis=0) for i in range(3)), "D": f["m"].T @ dh, "d": dh.sum(axis=0), "o": f["h"].T @ dz, "c": dz.sum(keepdims=True)}

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.forward(x)["z"].astype(np.float64) + self.shift)))


def examples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Generated findings in a mixed order, whole ones and pieces of longer ones."""
    whole, pieces = findings(5600), findings(4800, seed=6, within=True)
    order = np.random.default_rng(2).permutation(len(whole[0]) + len(pieces[0]))
    return tuple(np.concatenate(x)[order] for x in zip(whole, pieces, strict=True))


def trained(recall: float = 0.95, labelled=None) -> CharNetwork:
    """A network fitted to labelled findings (windows, labels, classes), or to generated ones, once per process."""
    return CharNetwork().fit(*labelled, recall) if labelled else _generated(recall)


@functools.cache
def _generated(recall: float) -> CharNetwork:
    return CharNetwork().fit(*examples(), recall)


def value(text: str, start: int, kind: str, end: int) -> tuple[int, int]:
    """Where the value of a base finding lies, without what assigns it."""
    return RULES[kind][0].match(text, start, end).span(RULES[kind][1]) if kind == "assign" else (start, end)


def scored(texts: list[str], network: CharNetwork) -> list[list[tuple[int, str, int, float]]]:
    """All findings (start, kind, end, score) of each text, in the order of start and kind."""
    base = [base_findings(t) for t in texts]
    where = [(i, *value(t, *f), f) for i, t in enumerate(texts) for f in base[i]]
    where += [(i, a, b, None) for i, t in enumerate(texts) for a, b in candidates(t, base[i])]
    best, rows, owner, held = np.zeros(len(where)), [], [], 0
    for k, (i, a, b, _) in enumerate(where):
        rows.append(windows(texts[i], a, b))
        owner.append(np.full(len(rows[-1]), k))
        held += len(rows[-1])
        if held >= 2048 or k == len(where) - 1:
            x, of = np.concatenate(rows), np.concatenate(owner)
            for first in range(0, held, 2048):
                np.maximum.at(best, of[first : first + 2048], network.scores(x[first : first + 2048]))
            rows, owner, held = [], [], 0
    out = [[] for _ in texts]
    for p, (i, a, b, finding) in zip(best.tolist(), where, strict=True):
        if finding:
            out[i].append((*finding, p))
        elif p >= network.thresholds[candidate_class(texts[i][a:b])]:
            out[i].append((a, "other", b, p))
    return [sorted(f, key=lambda x: (x[0], KINDS.index(x[1]))) for f in out]


def scan_text(texts: list[str], network: CharNetwork) -> list[list[tuple[int, str, int]]]:
    """All findings (start, kind, end) of each text, in the order of start and kind."""
    return [[f[:3] for f in found] for found in scored(texts, network)]


def _joined(found) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b, *_ in found)


def secret_findings(docs: DataFrame, network: CharNetwork | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_other, scores) of every document; a score for each span."""
    network = network or trained()

    def scan(batches):
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                found = scored([t or "" for t in part.column(1).to_pylist()], network)
                counts = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in KINDS]
                digest = [hashlib.sha256(_joined(x for x in f if x[1] != "other").encode()).hexdigest() for f in found]
                scores = pa.array([[x[3] for x in f] for f in found], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *counts[:3], pa.array(digest, pa.string()), pa.array([_joined(f) for f in found], pa.string()), counts[3], scores], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_other", "scores"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_other long, scores array<double>")


def redacted(docs: DataFrame, network: CharNetwork | None = None, mask: str = "[secret]") -> DataFrame:
    """docs with each finding in `text` replaced by the mask (overlapping ones by one), and n_chars, if there, as it then is."""
    network = network or trained()

    def hide(text: str, found) -> str:
        out, at = [], 0
        for a, _, b in found:
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def scan(batches):
        for batch in batches:
            place = batch.schema.get_field_index("text")
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                texts = part.column(place).to_pylist()
                found = scan_text([t or "" for t in texts], network)
                new = pa.array([hide(t, f) if f else t for t, f in zip(texts, found, strict=True)], part.schema.field(place).type)
                yield part.set_column(place, part.schema.field(place), new)

    out = docs.mapInArrow(scan, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
