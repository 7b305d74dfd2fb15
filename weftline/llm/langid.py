"""Operator 5: language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import held, lean

#: Languages that are learned at most (the most frequent), documents of each, about, and pieces of each document, of so many bytes.
LANGS, PER_LANG, PIECES, PIECE = 200, 400, 3, 64
HIDDEN, STEPS, BATCH, RATE = 12, 300, 96, 1.5e-2
#: A text is read in spans of so many bytes; each direction has read so many bytes before a span when it comes to it.
SPAN, LEAD = 224, 32
#: Spans that go through the network together.
TOGETHER = 512
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def _bounded(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): as the hyperbolic tangent, between -1 and 1, for a fraction of its cost; its slope is (1 - |y|)^2 at the value y."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


class Gru:
    """Two gated recurrent layers, one from each end, and a softmax over languages at every byte. Gates are (1 + _bounded) / 2."""

    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.langs = langs
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(h), shape).astype(np.float32)
        #: The input's part of the three gates by byte (rows 256 on: of the direction from the end), the state's part for each direction; then the output layer.
        self.p = {"x": draw(512, 3 * h) * 0.5, "u": draw(2, h, 3 * h), "w": draw(2 * h, len(langs)), "b": np.zeros(len(langs), np.float32)}

    def states(self, s: np.ndarray, kept: list | None = None) -> np.ndarray:
        """(steps, 2, rows, hidden): states after each byte of ``s`` (steps, 2, rows), what either direction reads in its order; kept gets what the way back needs.

        A zero byte stands for what lies beside a text: the state there is 0.
        """
        x, u, m = self.p["x"], self.p["u"], HIDDEN
        live = s != 0
        gaps = ~live.all((1, 2))
        s = s + np.array([0, 256])[None, :, None]
        h = np.zeros((2, s.shape[2], m), x.dtype)
        out = np.empty((len(s), *h.shape), x.dtype)
        for t in range(len(s)):
            a, g = x.take(s[t], axis=0), h @ u
            zr = _bounded(a[..., : 2 * m] + g[..., : 2 * m])
            zr *= 0.5
            zr += 0.5
            z, r = zr[..., :m], zr[..., m:]
            c = _bounded(a[..., 2 * m :] + r * g[..., 2 * m :])
            if kept is not None:
                kept.append((h, z, r, c, g[..., 2 * m :]))
            h = c + z * (h - c)
            if gaps[t]:
                h *= live[t, :, :, None]
            out[t] = h
        return out

    def log_probabilities(self, both: np.ndarray) -> np.ndarray:
        """Of each language, from the states of both directions at a byte, side by side."""
        y = np.ascontiguousarray((both.reshape(-1, both.shape[-1]) @ self.p["w"] + self.p["b"]).T)  # languages first: their few sums go over long rows
        y -= y.max(0)
        y -= np.log(np.exp(y).sum(0))
        return y.T.reshape(*both.shape[:-1], -1)

    def gradient(self, s: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """The mean loss over the bytes of equally long rows, and its gradient by backpropagation through time."""
        kept: list = []
        order = np.stack((s.T, s[:, ::-1].T), 1)
        states = self.states(order, kept)
        both = np.concatenate((states[:, 0], states[::-1, 1]), 2)
        logp = self.log_probabilities(both)
        t_all, n, _ = logp.shape
        d = np.exp(logp)
        d[:, np.arange(n), label] -= 1
        d /= n * t_all
        grad = {"w": np.einsum("tnh,tnl->hl", both, d), "b": d.sum((0, 1))}
        d_both, m, u = d @ self.p["w"].T, HIDDEN, self.p["u"]
        d_out = np.stack((d_both[:, :, :m], d_both[::-1, :, m:]), 1)
        du, dh = np.zeros_like(u), np.zeros((2, n, m), u.dtype)
        da = np.empty((t_all, 2, n, 3 * m), u.dtype)
        for t in range(t_all - 1, -1, -1):
            h, z, r, c, gc = kept[t]
            dh = (dh + d_out[t]) * (order[t] != 0)[..., None]
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * gc * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            da[t] = np.concatenate((dz, dr, dc), 2)
            dg = np.concatenate((dz, dr, dc * r), 2)
            du += h.transpose(0, 2, 1) @ dg
            dh = dh * z + dg @ u.transpose(0, 2, 1)
        at = (order + np.array([0, 256])[None, :, None]).ravel()
        by = np.argsort(at, kind="stable")
        rows, first = np.unique(at[by], return_index=True)
        grad["x"] = np.zeros_like(self.p["x"])
        grad["x"][rows] = np.add.reduceat(da.reshape(-1, 3 * m)[by], first)
        grad["u"] = du
        return float(-logp[:, np.arange(n), label].mean()), grad

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean over its bytes of the log-probabilities of each language; 0 for an empty one."""
        size = np.array([len(t) for t in texts], np.int64)
        spans = -(-size // SPAN)
        # Each text stands between LEAD zero bytes and filled spans.
        flat = np.frombuffer(b"".join(bytes(LEAD) + t + bytes(int(n) * SPAN - len(t) + LEAD) for t, n in zip(texts, spans, strict=True)), np.uint8)
        begin = np.concatenate(([0], np.cumsum(spans * SPAN + 2 * LEAD)[:-1])) if len(texts) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(texts)), spans)
        place = (np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
        out = np.zeros((len(texts), len(self.langs)))
        step = np.arange(LEAD + SPAN)
        for lo in range(0, len(doc), TOGETHER):
            d, p = doc[lo : lo + TOGETHER], place[lo : lo + TOGETHER]
            base = begin[d] + p
            s = np.stack((flat[base[None] + step[:, None]], flat[base[None] + 2 * LEAD + SPAN - 1 - step[:, None]]), 1)
            h = self.states(s)[LEAD:]
            logp = self.log_probabilities(np.concatenate((h[:, 0], h[::-1, 1]), 2))
            logp *= (p[None] + step[:SPAN, None] < size[d])[:, :, None]
            np.add.at(out, d, logp.sum(0, dtype=np.float64))
        return out / np.maximum(size, 1)[:, None]


def train(pieces: list[tuple[bytes, int]], langs: list[str], steps: int = STEPS, seed: int = 5) -> Gru:
    """Fit by Adam on batches of pieces, as many of each language; every byte is labelled with its document's language. Shorter pieces are filled with zero bytes."""
    net, rng = Gru(langs, seed), np.random.default_rng(seed)
    if not pieces:
        return net
    s = np.frombuffer(b"".join(p.ljust(PIECE, b"\0") for p, _ in pieces), np.uint8).reshape(-1, PIECE)
    label = np.array([y for _, y in pieces])
    rows = [np.flatnonzero(label == k) for k in range(len(langs)) if (label == k).any()]
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = np.concatenate([r[rng.integers(0, len(r), -(-BATCH // len(rows)))] for r in rows])
        _, grad = net.gradient(s[at], label[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k, g in grad.items():
            g = g / max(norm, 1.0)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def bytes_of(text: str) -> bytes:
    """The text's bytes as the network reads them: in lower case, white space kept."""
    return text.lower().encode("utf-8", "surrogatepass")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECES pieces of each text, from places that the draw decides."""
    for b in batches:
        draw, lang, piece = [], [], []
        for text, k, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            raw, rng = bytes_of(text), np.random.default_rng(int(x * (1 << 40)))
            for at in rng.integers(0, max(len(raw) - PIECE, 0) + 1, PIECES).tolist() if _LETTER.search(text) else []:
                draw.append(x)
                lang.append(k)
                piece.append(raw[at : at + PIECE])
        yield pa.RecordBatch.from_arrays([pa.array(draw, pa.float64()), pa.array(lang, pa.string()), pa.array(piece, pa.binary())], names=["draw", "lang", "piece"])


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Gru | None:
    """A network from ``docs`` (doc_id, text, lang): those not held out whose language and text aren't null.

    It learns the LANGS most frequent languages (ties: by name), from about ``per_lang`` documents of each, those of the
    smallest hashes. PIECES pieces of PIECE bytes of each are cut out where the texts are; the driver sees no more. None if there are none.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return None
    share = docs.sparkSession.createDataFrame([(r["lang"], float(per_lang) / r["n"]) for r in counts], "lang string, share double")
    draw = (F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 40)) / F.lit(1 << 40)).alias("draw")
    sample = lean(rows).select("text", "lang", draw).join(F.broadcast(share), "lang").where((F.col("draw") < F.col("share")) & F.col("text").isNotNull())
    got = sample.select("text", "lang", "draw").mapInArrow(_sampled, "draw double, lang string, piece binary")
    got = got.orderBy("draw", "lang", "piece").limit(2 * PIECES * per_lang * len(langs)).collect()
    return train([(bytes(r["piece"]), langs.index(r["lang"])) for r in got], langs) if got else None


def identify(docs: DataFrame, net: Gru | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row: the language of the largest pooled probability, and that.

    Each byte of the whole text, white space too, gets log-probabilities from the states of both directions, which run on from
    word to word: over the LEAD bytes beside a span and the span. The document's are their mean, made to sum to 1; ties go to the
    first language by name. Null texts, texts without a letter, and all texts if there is no network, are ``und`` with score 0.
    Null or repeated doc_ids are rows like others (a null is not held out). Extra columns are ignored. An empty table gives an empty one.
    """
    langs, params = (net.langs, net.p) if net else ([], {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("", dict)
        own = Gru.__new__(Gru)
        own.langs, own.p = langs, params
        for b in batches:
            preds: list[str] = []
            scores: list[float] = []
            for lo in range(0, b.num_rows, 256):
                texts = b.column(1).slice(lo, 256).to_pylist()
                some = [i for i, t in enumerate(texts) if t is not None and langs and _LETTER.search(t)]
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                for i, mean in zip(some, own.pooled([bytes_of(texts[i]) for i in some]) if some else (), strict=True):
                    p = np.exp(mean - mean.max())
                    pred[i], score[i] = langs[int(p.argmax())], float(p.max() / p.sum())
                preds += pred
                scores += score
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
