"""Operator 2: personal data, by fixed patterns and a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import held, lean

KINDS = ("email", "ip", "card", "phone")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # from the first digit of a run: where that fails, the others do
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' matches that pass their tests, by kind and then start; leftmost, not overlapping within a kind."""
    out = []
    # An address is found from its @: the name before it, as far as the last address, and the domain after it.
    at, done = text.find("@"), 0
    while at >= 0:
        m = _MAIL_DOMAIN.match(text, at)
        if m:
            a = at
            while a > done and text[a - 1] in _NAME_CHARS:
                a -= 1
            if a < at:
                out.append(("email", a, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _DIGITS.sub("", m.group())
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return out


# The conditional random field. Labels: O, then the kinds.
LABELS = ("O", *KINDS)
_TOKEN = re.compile(r"[^\s]+")
_HOT = re.compile(r"[0-9@+]")

#: Places of the chains that are decoded together; a longer chain is decoded alone.
CELLS = 1 << 18

#: The labelled table: a text, with {kind:...} around what is personal.
LABELLED = """
write to {email:ann.lee@mail.example.org} today
mail {email:j_roe+news@corp-site.co.uk}, please
{email:bob (at) example (dot) com} answers soon
contact {email:sales [at] shop [dot] example} or call
reach me: {email:kim at example dot org}
the server {ip:10.20.30.40} was down
from {ip:192.168.0.17} to {ip:8.8.4.4} again
host {ip:172.16.254.1}:8080 refused
card {card:4111 1111 1111 1111} expires soon
paid with {card:5500-0000-0000-0004} yesterday
number {card:4012888888881881}, thanks
call {phone:+1 (212) 555-0147} now
tel. {phone:+49 30 901820} or {phone:+44 20 7946 0958}
ring {phone:(415) 555-0132} after six
phone {phone:555-867-5309} at home
fax {phone:020 7946 0018}
telephone {phone:+33 1 99 00 12 34}, thanks
mobile {phone:0171 2345678} bitte
in 1998 there were 12 houses
chapter 3, page 214
version 2.10.1 of the tool
the price is 1,299.50 now
it took 45 minutes and 30 seconds
on 2021-05-17 at 10:30 they met
order 000123456789 was sent
token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e" here
key 9f86d081884c7d659a2feaa0c55ad015 ends
see section 4.2.1 and table 7
about 3.14 or 2.718
a + b = c and 5 + 6 = 11
follow @someone on the site
room 12B, floor 3
the 1st, 2nd and 3rd time
the and of a word in that with plain text only
es war einmal ein kleines haus im wald
il y avait une fois dans la ville
License, Version 2.0.
License, version 3.
under CC BY-NC 4.0.
isbn 978-3-16-148410-0 printed
price 4500000000000000000000 units
meet at example street at noon
a dot on the page
my number {phone:555 867 5309} at work
or ring {phone:020 7946 0018} today
number {phone:555 010 4477} again
iban DE44 5001 0517 5407 3249 31 given
account GB29 NWBK 6016 1331 9268 19 there
iban FR14 2004 1010 0505 0001 3M02 606 here
""".strip().split("\n")


def _shape(word: str) -> str:
    """Letters to a or A, digits to 9, runs cut to the length classes 1, 2, 3, 4 and more (9: up to 4, then +)."""
    out, last, run = [], "", 0
    for c in word:
        s = "9" if "0" <= c <= "9" else ("A" if c.isupper() else "a") if c.isalpha() else c
        run = run + 1 if s == last else 1
        if s == "9" and run <= 4 or s != "9" and run <= 1:
            out.append(s)
        elif s == "9" and run == 5:
            out.append("+")
        last = s
    return "".join(out)


_CUES = {"at": "at", "(at)": "at", "[at]": "at", "{at}": "at", "dot": "dot", "(dot)": "dot", "[dot]": "dot", "{dot}": "dot"}
_AROUND = ".,;:!?\"'"
_CALLS = {"call", "phone", "tel", "telephone", "tel.", "fax", "mobile", "ring", "cell"}


def _cue(word: str) -> str:
    return _CUES.get(word.strip(_AROUND).lower(), "")


def _features(word: str) -> list[str]:
    """The word-shape features of one word."""
    core = word.strip(_AROUND)
    s = _shape(core)
    digits = sum("0" <= c <= "9" for c in core)
    f = ["bias", f"digits={min(digits, 20) if digits < 4 else min(digits // 2 * 2, 20)}", f"dots={min(core.count('.'), 4)}", f"hyphens={min(core.count('-'), 3)}"]
    if _HOT.search(core):
        f += [f"shape={s}", f"head={s[:2]}", f"tail={s[-2:]}", f"mark={'@' in core}{core[:1] == '+'}{'(' in core}", f"letters={any(c.isalpha() for c in core)}"]
    else:
        f.append("plain")
        if _cue(word):
            f.append("cue=" + _cue(word))
        if core.lower() in _CALLS:
            f.append("call")
    return f


class _Ids(dict):
    """A word's class, that of its features; long words are not kept."""

    def __init__(self, crf: Crf):
        self.crf = crf

    def __missing__(self, word: str) -> int:
        core = word.strip(_AROUND)
        plain = core.isalpha() and core.lower() not in _CUES and core.lower() not in _CALLS
        k = Crf.PLAIN if plain else self.crf.of(_features(word))
        if len(word) <= 64:
            self[word] = k
        return k


class Crf:
    """Linear chain: a score for each label by the features of a word and of its neighbours, and for label pairs.

    Words with the same features are one class; PLAIN is that of most words, EDGE stands before the first and after the last.
    """

    PLAIN, EDGE = 0, 1

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.clear()
        self.margin = self._margin()

    def clear(self) -> None:
        self.ids, self.classes = _Ids(self), {}
        #: What a word adds to the labels of its own place, of the next one and of the one before, by class.
        self.adds = np.zeros((3, 64, len(LABELS)))
        #: Whether a span that counts has a word of the class: one with a digit, @ or +, or an at.
        self.telling = np.zeros(64, bool)
        self.of(_features("word"))
        self.of(["edge"])

    def of(self, features: list[str]) -> int:
        telling = "plain" not in features or "cue=at" in features
        known = [f for f in features if any(side + f in self.names for side in ("", "-", "+"))]
        new = len(self.classes)
        k = self.classes.setdefault((telling, *known), new)
        if k == new:
            if k == self.adds.shape[1]:
                self.adds = np.concatenate([self.adds, np.zeros_like(self.adds)], 1)
                self.telling = np.concatenate([self.telling, np.zeros_like(self.telling)])
            self.telling[k] = telling
            for i, side in enumerate(("", "-", "+")):
                self.adds[i, k] = self.weights[[self.names[side + f] for f in known if side + f in self.names]].sum(0)
        return k

    def read(self, words: list[str]) -> np.ndarray:
        """The words' classes, with an edge on both sides."""
        if len(self.ids) > 50_000 or len(self.classes) > 50_000:
            self.clear()
        return np.array([self.EDGE, *map(self.ids.__getitem__, words), self.EDGE], np.int64)

    def _margin(self) -> int | None:
        """So many words at each end of a run of plain words between plain words may have labels; in the best path the others are O.

        In m such words of which none is O, writing O for all scores more whatever the labels around, so one of any m is O; and between
        two that are O, writing O for fewer words scores more as well. None if no m up to 64 has this.
        """
        e, moves = self.adds[:, self.PLAIN].sum(0), self.moves
        path = moves[:, 1:] + e[1:]
        for m in range(1, 65):
            other = (path[:, :, None] + moves[None, 1:]).max(1)
            plain = moves[:, :1] + moves[None, 0] + m * e[0] + (m - 1) * moves[0, 0]
            if (plain > other).all():
                return m
            if plain[0, 0] <= other[0, 0]:
                return None
            path = (path[:, :, None] + moves[None, 1:, 1:]).max(1) + e[1:]
        return None

    @staticmethod
    def parts(words: list[str]) -> list[list[str]]:
        own = [_features(w) for w in words]
        return [
            [*own[i], *(("-" + f for f in own[i - 1]) if i else ["-edge"]), *(("+" + f for f in own[i + 1]) if i + 1 < len(words) else ["+edge"])]
            for i in range(len(words))
        ]

    def emissions(self, ids: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """The scores of words lo to hi of those that were read; their neighbours count."""
        return self.adds[0, ids[lo + 1 : hi + 1]] + self.adds[1, ids[lo:hi]] + self.adds[2, ids[lo + 2 : hi + 2]]

    def chains(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """The parts of a text between words that are O in its best path; such a word is the first and last of a part, unless the text's own end is."""
        n = len(ids) - 2
        plain = ids == self.PLAIN
        odd = np.flatnonzero(~(plain[:-2] & plain[1:-1] & plain[2:]))
        if not n:
            return []
        if self.margin is None:
            return [(0, n)]
        gap = np.flatnonzero(np.diff(odd) > 2 * self.margin + 1)
        starts, ends = odd[gap + 1] - self.margin - 1, odd[gap] + self.margin + 2
        return list(zip([0, *starts.tolist()], [*ends.tolist(), n], strict=True))

    def viterbi(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each chain; chains go step by step together, the longest first, as many as have CELLS places."""
        order = np.argsort([-len(c) for c in chains], kind="stable")
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
        lo = 0
        while lo < len(order):
            hi = lo + max(CELLS // len(chains[order[lo]]), 1)
            self._together(chains, order[lo:hi], out)
            lo = hi
        return out

    def _together(self, chains: list[np.ndarray], order: np.ndarray, out: list[np.ndarray]) -> None:
        lengths = np.array([len(chains[i]) for i in order])
        t_most, k = lengths[0], len(LABELS)
        e = np.zeros((len(order), t_most, k))
        for row, i in enumerate(order):
            e[row, : lengths[row]] = chains[i]
        best, back = e[:, 0].copy(), np.zeros((len(order), t_most, k), np.int8)
        for t in range(1, t_most):
            m = int((lengths > t).sum())
            step = best[:m, :, None] + self.moves[None]
            back[:m, t] = step.argmax(1)
            best[:m] = step.max(1) + e[:m, t]
        for row, i in enumerate(order):
            y = np.zeros(lengths[row], np.int8)
            y[-1] = best[row].argmax()
            for t in range(lengths[row] - 1, 0, -1):
                y[t - 1] = back[row, t, y[t]]
            out[i] = y


def _read_labelled(lines: list[str]) -> list[tuple[list[str], list[int]]]:
    out = []
    for line in lines:
        words, labels = [], []
        for m in re.finditer(r"\{(\w+):([^}]*)\}(\S*)|(\S+)", line):
            if m[1]:
                own = m[2].split(" ")
                own[-1] += m[3]
                words += own
                labels += [LABELS.index(m[1])] * len(own)
            else:
                words.append(m[4])
                labels.append(0)
        out.append((words, labels))
    return out


def train(lines: list[str] = LABELLED, rounds: int = 250, rate: float = 0.25, ridge: float = 0.01) -> Crf:
    """Fit by gradient ascent on the log-likelihood (forward-backward), with a ridge penalty. Deterministic."""
    data = _read_labelled(lines)
    names: dict[str, int] = {}
    parts = [[[names.setdefault(f, len(names)) for f in p] for p in Crf.parts(w)] for w, _ in data]
    k = len(LABELS)
    weights, moves = np.zeros((len(names), k)), np.zeros((k, k))
    sums = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(rounds):
        g, gm = -ridge * weights, -ridge * moves
        for at, (_, labels) in zip(parts, data, strict=True):
            e = np.array([weights[p].sum(0) for p in at])
            n = len(e)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = e[0]
            for t in range(1, n):
                a[t] = e[t] + np.logaddexp.reduce(a[t - 1][:, None] + moves, 0)
            for t in range(n - 2, -1, -1):
                b[t] = np.logaddexp.reduce(moves + (e[t + 1] + b[t + 1])[None], 1)
            z = np.logaddexp.reduce(a[-1])
            p = np.exp(a + b - z)
            for t in range(n):
                d = -p[t]
                d[labels[t]] += 1
                np.add.at(g, at[t], d)
                if t:
                    gm -= np.exp(a[t - 1][:, None] + moves + (e[t] + b[t])[None] - z)
                    gm[labels[t - 1], labels[t]] += 1
        for v, d, s in ((weights, g, sums[0]), (moves, gm, sums[1])):
            s += d * d
            v += rate * d / np.sqrt(s + 1e-8)
    return Crf(names, weights, moves)


def _address(words: list[str]) -> bool:
    """Whether words have an at, a word on each side of it, and then a dot between words or within one."""
    cues = [_cue(w) for w in words]
    return any(c == "at" and ("dot" in cues[i + 2 : -1] or "." in "".join(words[i + 1 : i + 2]).strip(_AROUND)) for i, c in enumerate(cues) if i)


def crf_spans(crf: Crf, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """For each text the spans that the model finds, whatever the patterns say: those of the best path over all its words.

    A text is decoded in parts that give this path. Parts without a digit, an @ or an at can have none of the spans that count.
    """
    where, chains, words = [], [], []
    for d, text in enumerate(texts):
        words.append(text.split())
        ids = crf.read(words[d])
        for lo, hi in crf.chains(ids):
            if crf.telling[ids[lo + 1 : hi + 1]].any():
                e = crf.emissions(ids, lo, hi)
                if lo:
                    e[0, 1:] = -np.inf
                if hi < len(words[d]):
                    e[-1, 1:] = -np.inf
                where.append((d, lo))
                chains.append(e)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    at: dict[int, list[tuple[int, int]]] = {}
    for (d, lo), labels in zip(where, crf.viterbi(chains), strict=True):
        if not labels.any():
            continue
        if d not in at:
            at[d] = [w.span() for w in _TOKEN.finditer(texts[d])]
        spans = at[d][lo : lo + len(labels)]
        t, n = 0, len(spans)
        while t < n:
            y = labels[t]
            u = t + 1
            while u < n and labels[u] == y:
                u += 1
            if y:
                a, b = spans[t][0], spans[u - 1][1]
                while a < b and texts[d][a] in "\"'<[{,;:":
                    a += 1
                while b > a and texts[d][b - 1] in "\"'>]},;:.!?&%*#$|":
                    b -= 1
                if b > a and (sum("0" <= c <= "9" for c in texts[d][a:b]) >= 6 or LABELS[y] == "email" and _address(words[d][lo + t : lo + u]) or "@" in texts[d][a:b]):
                    out[d].append((LABELS[y], a, b))
            t = u
    return out


def all_spans(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The base spans, and those of the model that overlap none of them; by kind, then start."""
    taken = sorted((a, b) for _, a, b in base)
    added = [x for x in more if not any(a < x[2] and x[1] < b for a, b in taken)]
    return sorted({*base, *added}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def write(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or overlapping spans together, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


_FOUND = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted")
_trained: list[Crf] = []


def scan(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The rows and columns of ``docs``, and after them the struct _pii: counts, digest, spans and, if asked for, the redacted text.

    Counts and base_sha256 are of the patterns' matches, which the model only adds to. Null text counts as empty; its
    redacted text is null. Positions are code points. Columns of ``docs`` may have any names but _pii. An empty table
    gives an empty one. The model is trained on the driver from LABELLED and sent with the tasks, some 50 KB.
    """
    if not _trained:
        _trained.append(train())
    crf = _trained[0]
    names, weights, moves = crf.names, crf.weights, crf.moves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("", dict)
        own = Crf(names, weights, moves)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            rows: list[dict] = []
            for lo in range(0, len(column), 256):
                values = column.slice(lo, 256).to_pylist()
                texts = [v or "" for v in values]
                for value, text, more in zip(values, texts, crf_spans(own, texts), strict=True):
                    base = base_spans(text)
                    spans = all_spans(base, more)
                    n = [sum(k == x for k, _, _ in base) for x in KINDS]
                    redacted = redact(text, spans) if with_text and value is not None else None
                    rows.append(dict(zip(("n_email", "n_ip", "n_card", "n_phone"), n, strict=True)) | {"base_sha256": hashlib.sha256(write(base).encode()).hexdigest(), "spans": write(spans), "redacted": redacted})
            kind = pa.struct([(k, pa.int64()) for k in ("n_email", "n_ip", "n_card", "n_phone")] + [(k, pa.string()) for k in ("base_sha256", "spans", "redacted")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "_pii"])
        own.clear()

    found = T.StructType([T.StructField(k, T.LongType() if k.startswith("n_") else T.StringType()) for k in _FOUND])
    return lean(docs).select("*").mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_pii", found)]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return scan(slim, "text", with_text=False).select("doc_id", *[f"_pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])
