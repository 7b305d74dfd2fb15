"""Operator 3: learned decision lists over text statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import held, lean
from .textvec import Words, mix, slices, utf8

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_pipes", "n_open"]
#: Rows that the list is learned from at most, taken by hash of the doc_id.
SAMPLE = 20_000
WINDOW = 5


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_SYMBOLS, _MARKS, _PIPES, _OPEN = _table("#*$%&|<>"), _table("!?"), _table("|"), _table("{}[]()=;/\\")
_UPPER, _DIGITS = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_LATER = (np.arange(256) & 0xC0) == 0x80


def text_stats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each of STATS."""
    w = Words(data, offsets)
    b, n = w.bytes, w.n_docs
    out = np.zeros((n, len(STATS)), np.int64)
    out[:, 0] = np.diff(w.first_word)
    out[:, 1] = w.count(w.inside & ~_LATER[b])
    out[:, 2] = w.count(_SYMBOLS[b])
    # Lines: a span between line feeds; those with a word that equal an earlier one of the text.
    feed = np.flatnonzero(b == 10)
    start = np.union1d(w.offsets[:-1], feed + 1)
    start = start[start < len(b)] if len(b) else start[:0]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    end = np.append(start[1:], len(b)).astype(np.int64)
    end = np.where(np.isin(end - 1, feed) & (end > start), end - 1, end)
    end = np.minimum(end, w.offsets[doc + 1])
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[has], end[has], doc[has]
    key = mix(w.span_hash(start, end) + doc.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    first, inverse = np.unique(key, return_index=True, return_inverse=True)[1:]
    lines = np.bincount(doc, minlength=n)
    again = np.flatnonzero(first[inverse] != np.arange(len(key)))
    earlier = first[inverse[again]]
    again = again[(end[again] - start[again] == end[earlier] - start[earlier])]
    earlier = first[inverse[again]]
    again = again[w.same_bytes(start[again], start[earlier], end[again] - start[again])]
    out[:, 3] = np.bincount(doc[again], minlength=n)
    # Words in windows that the text has twice or more.
    h, at = w.windows(WINDOW)
    key = mix(h + w.doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    out[:, 4] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    out[:, 5] = w.count(~_LATER[b])
    out[:, 6] = lines
    for k, t in enumerate((_UPPER, _DIGITS, _MARKS, _PIPES, _OPEN), 7):
        out[:, k] = w.count(t[b])
    return out


def _with_stats(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("", dict)
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index(text_col)))
            parts = [text_stats(data, offsets[lo : hi + 1]) for lo, hi in slices(offsets)]
            stats = np.concatenate(parts) if parts else np.zeros((0, len(STATS)), np.int64)
            fields = pa.StructArray.from_arrays([pa.array(stats[:, k]) for k in range(len(STATS))], names=STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, fields], names=[*batch.schema.names, "_stats"])

    return run


def base_failed(stats: str = "_stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


#: Ratios that rules are made of: name, numerator, denominator among STATS (None: 1).
RATIOS = [
    ("words", "n_words", None), ("word_length", "word_chars", "n_words"), ("symbols_per_word", "n_symbols", "n_words"), ("dup_line_part", "n_dup_lines", "n_lines"),
    ("repeat_part", "n_repeat_words", "n_words"), ("upper_part", "n_upper", "n_chars"), ("digit_part", "n_digits", "n_chars"), ("marks_per_word", "n_marks", "n_words"),
    ("pipes_per_word", "n_pipes", "n_words"), ("code_part", "n_open", "n_chars"), ("words_per_line", "n_words", "n_lines"),
]


def features(stats: np.ndarray) -> np.ndarray:
    col = {k: stats[:, i].astype(float) for i, k in enumerate(STATS)}
    return np.stack([col[a] / np.maximum(col[b], 1.0) if b else col[a] for _, a, b in RATIOS], 1)


def ratio_column(name: str, stats: str = "_stats") -> Column:
    a, b = next((a, b) for n, a, b in RATIOS if n == name)
    top = F.col(stats)[a].cast("double")
    return top / F.greatest(F.col(stats)[b], F.lit(1)).cast("double") if b else top


Rule = list[tuple[str, str, float]]


def learn(stats: np.ndarray, good: np.ndarray, seed: int = 7, least: int = 8, precision: float = 0.9) -> list[Rule]:
    """Rules that reject, in order, by sequential covering.

    Each is grown on two thirds of the rows not covered yet, a threshold condition at a time, by information gain; its
    last conditions are pruned while the other third is not served worse; the first rule that is no better than
    ``precision`` there, or covers fewer than ``least`` rows, ends the list.
    """
    x, bad = features(stats), ~good
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    open_rows = np.ones(len(x), bool)

    def holds(rule: Rule, rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for name, op, t in rule:
            v = x[rows, [n for n, _, _ in RATIOS].index(name)]
            out &= v > t if op == ">" else v <= t
        return out

    while bad[open_rows].any():
        rows = rng.permutation(np.flatnonzero(open_rows))
        grow, prune = rows[: 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]
        rule: Rule = []
        inside = grow
        while len(inside) and bad[inside].mean() < 1 and len(rule) < 4:
            p0 = bad[inside].sum()
            if not p0:
                break
            info, best = np.log2(p0 / len(inside)), (0.0, None)
            for k, (name, _, _) in enumerate(RATIOS):
                v = x[inside, k]
                order = np.argsort(v, kind="stable")
                v, y = v[order], bad[inside][order]
                cut = np.flatnonzero(v[1:] > v[:-1])
                p, n = np.cumsum(y)[cut], cut + 1
                for op, pos, tot in (("<=", p, n), (">", p0 - p, len(v) - n)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(pos >= least, pos * (np.log2(pos / tot) - info), 0.0)
                    if len(gain) and gain.max() > best[0]:
                        i = int(gain.argmax())
                        best = (float(gain[i]), (name, op, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
            if best[1] is None:
                break
            rule = [*rule, best[1]]
            inside = inside[holds([best[1]], inside)]

        def worth(r: Rule, rows: np.ndarray = prune) -> float:
            got = holds(r, rows)
            p, n = (bad[rows] & got).sum(), (good[rows] & got).sum()
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = holds(rule, rows)
        if not rule or covered.sum() < least or bad[rows][covered].mean() < precision or worth(rule) < 2 * precision - 1:
            break
        rules.append(rule)
        open_rows[rows[covered]] = False
    return rules


def decide(rules: list[Rule], stats: str = "_stats") -> Column:
    """The list as one conditional expression: the number of the first rule that holds, 0 if none does."""
    out = F
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for name, op, t in rule:
            v = ratio_column(name, stats)
            test = test & (v > t if op == ">" else v <= t)
        out = out.when(test, F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def learn_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """Rules from the rows of ``docs`` that ``labels`` (doc_id, quality 0 or 1) covers.

    At most ``sample`` labels, the smallest by hash of doc_id, are used, and at most twice as many rows of ``docs``; only
    their statistics reach the driver. Null labels or ids are left out; with no labelled row, or labels of one kind
    only, there are no rules.
    """
    y = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(y), "doc_id")
    rows = rows.select("text", "quality").mapInArrow(_with_stats("text"), _schema(rows.select("text", "quality")))
    got = rows.select("_stats.*", "quality").orderBy(F.xxhash64(*STATS), *STATS).limit(2 * sample).toPandas()
    if not len(got):
        return []
    return learn(got[STATS].to_numpy(), got["quality"].to_numpy() == 1)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows and columns of ``docs``, and after them _stats, _base_failed, _rule (0: none) and _kept.

    Null and empty texts have no words, so they fail the base test, as do all of fewer than 10 words. Statistics are of
    whole texts. Repeated rows get equal verdicts; a null doc_id only has no label. Columns of ``docs`` may have any
    names but those four. An empty table gives an empty one.
    """
    rules = learn_rules(docs, labels, id_col, text_col, sample)
    own = lean(docs).select("*").mapInArrow(_with_stats(text_col), _schema(docs))
    own = own.withColumn("_base_failed", base_failed()).withColumn("_rule", decide(rules))
    return own.withColumn("_kept", ~F.col("_base_failed") & (F.col("_rule") == 0))


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, T.StructField("_stats", T.StructType([T.StructField(k, T.LongType()) for k in STATS]))])
