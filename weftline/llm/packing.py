"""Operator 6: packing documents into token sequences by swap-based local search."""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import whole_groups
from .store import held, lean, stash
from .textvec import Words, slices, utf8

#: The tokenizer's file, for public_tokenizers.path().
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Pieces that are packed together, about.
GROUP = 8192
#: Words, and parts of words, whose ids a worker keeps; when there are more, it starts anew.
WORDS, PARTS = 1_000_000, 600_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10]] = True
_LETTERS_FIRST = re.compile(r"([^\W\d_]+)([^\s\w']*)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of whole texts, word by word.

    Words between spaces, tabs and line feeds are encoded on their own, which gives the ids of the whole text: the
    tokenizer's pattern never joins across white space, its normalisation does not compose across it, and it drops it.
    Letters, in lower case, and the signs after them are encoded apart where a word has no other parts: the pattern ends
    a token between them (not at an apostrophe), and a word in composed form is composed in its parts. Words are looked up by
    a hash, and their bytes compared with those that the ids are of; texts with a word of which they differ are encoded whole.
    """

    def __init__(self, path: str | None):
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.parts: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        """No words: their sorted hashes with their rows, and each row's place in the ids of all rows, end to end."""
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.length, self.ids = (np.zeros(0, k) for k in (np.int64, np.int64, np.uint32))
        self.words: list[bytes] = []

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        parts, split, whole = self.parts, [], []
        match, normal = _LETTERS_FIRST.fullmatch, unicodedata.is_normalized
        for w in words:
            if (m := match(w)) and (w.isascii() or "\u03a3" not in w and "\u0130" not in w and normal("NFC", w)):
                split.append((m[1].lower(), m[2]))
            else:
                split.append((w, ""))
                whole.append(w)
        if len(parts) > PARTS:
            parts.clear()
        fresh = list({x for own in split for x in own if x not in parts})
        parts.update(zip(fresh, self._encode(fresh), strict=True))
        new = [parts[a] + parts[b] if b else parts[a] for a, b in split]
        for w in whole:  # may be long
            parts.pop(w, None)
        length = np.array([len(x) // 4 for x in new], np.int64)
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(new), np.uint32)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, end to end, and where each text's begin and end."""
        w = Words(data, offsets, _GAP)
        if len(self.keys) > WORDS:
            self._clear()
        unique, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != unique) if len(self.keys) else np.arange(len(unique))
        raw = w.bytes.tobytes()
        if len(new):
            own, rows = first[new], len(self.start)
            fresh = [raw[a:b] for a, b in zip(w.start[own].tolist(), w.end[own].tolist(), strict=True)]
            self._learn([x.decode() for x in fresh])
            self.words += fresh
            self.keys = np.insert(self.keys, at[new], unique[new])
            self.rows = np.insert(self.rows, at[new], np.arange(rows, rows + len(new)))
            at = np.searchsorted(self.keys, unique)
        same = w.same_words(first, inverse)
        known = np.ones(len(unique), bool)
        known[new] = False
        old = np.flatnonzero(known)
        known[old] = [self.words[r] == raw[a:b] for r, a, b in zip(self.rows[at[old]].tolist(), w.start[first[old]].tolist(), w.end[first[old]].tolist(), strict=True)]
        known[new] = True
        wrong = np.unique(w.doc[~(same & known[inverse])])
        rows = self.rows[at][inverse]
        length = self.length[rows]
        ends = np.concatenate(([0], np.cumsum(length)))
        flat = self.ids[np.repeat(self.start[rows] - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[w.first_word]
        if len(wrong):  # two words of one hash
            lists = np.split(flat, bounds[1:-1])
            for d in wrong.tolist():
                text = raw[w.offsets[d] : w.offsets[d + 1]].decode()
                lists[d] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            flat, bounds = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        return flat, bounds


def pieces(path: str | None, capacity: int):
    """A mapInArrow function from (doc_id, text) to the pieces of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held(f"encoder {path}", lambda: Encoder(path))
        end = array("I", [END_ID]).tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in slices(offsets):
                c = b.slice(lo, hi - lo)
                out: list[tuple] = []
                flat, bounds = encode(data, offsets[lo : hi + 1])
                for doc, a, z in zip(c.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = flat[a:z].tobytes() + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of at most ``capacity``, as lists of indexes into ``lengths``.

    It starts from best fit by falling length, then searches locally among the sequences that are not full.
    """
    room_of: list[int] = []
    bins: list[list[int]] = []
    by_room: list[tuple[int, int]] = []  # (room, bin), sorted; full bins leave it
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect.bisect_left(by_room, (n, -1))
        if at < len(by_room):
            room, b = by_room.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
            room_of.append(0)
        room_of[b] = room - n
        if room > n:
            bisect.insort(by_room, (room - n, b))
    return search(bins, lengths, capacity)


def search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: a document moves, or is exchanged for one or for two of another bin, so that squared fill grows most.

    All bins that aren't full take part: each gives, the emptiest first, to any that is as full as it, as long as
    squared fill grows. Every step raises the sum of squared fills, which is bounded, so it ends: after a pass over all bins in which
    nothing changes, or when there are no more bins than the sum of the lengths needs. A bin that has become empty is dropped.
    """
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    least = -(-int(fill.sum()) // capacity)
    changed = True
    while changed and np.count_nonzero(fill) > least:
        changed = False
        takers = _Takers(bins, lengths, fill, capacity)
        for a in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[a] < capacity and (step := takers.best(a)) is not None:
                out, b, back = step
                gain = sum(lengths[i] for i in out) - sum(lengths[i] for i in back)
                bins[a] = [x for x in bins[a] if x not in out] + back
                bins[b] = [x for x in bins[b] if x not in back] + out
                fill[a] -= gain
                fill[b] += gain
                takers.put(a)
                takers.put(b)
                changed = True
            if np.count_nonzero(fill) <= least:
                break
    return [b for b in bins if b]


class _Takers:
    """What the open bins can give back: nothing, one document or two, a row each, as arrays; rows of a bin that has changed are replaced."""

    def __init__(self, bins: list[list[int]], lengths: list[int], fill: np.ndarray, capacity: int):
        self.bins, self.lengths, self.fill, self.capacity = bins, lengths, fill, capacity
        self.rows: list[tuple[int, int, int, int]] = []
        self.pending: list[int] = []
        self._take(b for b in range(len(bins)) if 0 < fill[b] < capacity)
        self._freeze()

    def _take(self, which) -> None:  # noqa: ANN001
        for b in which:
            own, seen = self.bins[b], set()
            options = [(0, -1, -1), *((self.lengths[i], i, -1) for i in own), *((self.lengths[i] + self.lengths[j], i, j) for k, i in enumerate(own) for j in own[:k])]
            for option in options:
                if option[0] not in seen:  # of equal lengths one will do
                    seen.add(option[0])
                    self.rows.append((b, *option))

    def _freeze(self) -> None:
        self.owner, self.size, self.first, self.second = np.array(self.rows, np.int64).reshape(-1, 4).T.copy()
        self.pending = []

    def put(self, b: int) -> None:
        self.pending.append(b)
        if len(self.pending) >= 64:
            self._renew()

    def _renew(self) -> None:
        stale = set(self.pending)
        self.rows = [r for r in self.rows if r[0] not in stale]
        self._take(b for b in sorted(stale) if 0 < self.fill[b] < self.capacity)
        self._freeze()

    def best(self, a: int) -> tuple[list[int], int, list[int]] | None:
        """What bin a gives, to which, and what for: the exchange by which squared fill grows most."""
        own = sorted(self.bins[a], key=lambda i: self.lengths[i])
        ones = np.array([self.lengths[i] for i in own], np.int64)
        i, j = np.triu_indices(len(own), 1)
        twos = ones[i] + ones[j]
        order = np.argsort(twos, kind="stable")
        fresh = ~np.isin(self.owner, self.pending) if self.pending else np.ones(len(self.owner), bool)
        ok = np.flatnonzero(fresh & (self.owner != a) & (self.fill[self.owner] >= self.fill[a]) & (self.fill[self.owner] < self.capacity))
        top, found = 0, None
        room = self.capacity - self.fill[self.owner[ok]] + self.size[ok]
        ahead = self.fill[self.owner[ok]] - self.fill[a]
        for sizes, two in ((ones, False), (twos[order], True)):
            if not len(sizes) or not len(ok):
                continue
            at = np.searchsorted(sizes, room, "right") - 1
            gain = np.where(at >= 0, sizes[at] - self.size[ok], 0)
            if two:  # two for one; not two for none or for two
                gain = np.where((self.first[ok] >= 0) & (self.second[ok] < 0), gain, 0)
            grows = np.where(gain > 0, gain * (ahead + gain), 0)
            k = int(grows.argmax())
            if grows[k] > top:
                top, r = int(grows[k]), ok[k]
                given = [own[i[order[at[k]]]], own[j[order[at[k]]]]] if two else [own[at[k]]]
                found = given, int(self.owner[r]), [int(x) for x in (self.first[r], self.second[r]) if x >= 0]
        if found is None and self.pending:
            self._renew()
            return self.best(a)
        return found


def _packed(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["grp"]):
            length, grp = t.column("length").to_numpy(), t.column("grp").to_numpy()
            sequence, offset, room = (np.zeros(len(length), np.int64) for _ in range(3))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = length[lo:hi]
                for k, members in enumerate(pack(own.tolist(), capacity)):
                    at = np.array(members) + lo
                    sequence[at] = (turn << 56) + (grp[lo] << 24) + k
                    offset[at] = np.cumsum(length[at]) - length[at]
                    room[at] = capacity - length[at].sum()
            out = t.drop_columns(["grp", "tie"])
            for name, column in (("sequence_id", sequence), ("offset", offset), ("room", room)):
                out = out.append_column(name, pa.array(column))
            yield from out.combine_chunks().to_batches()

    return run


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): each piece of each document, once, in a sequence.

    A document is its token ids and id 1; null texts count as empty, so they are id 1 alone. A document longer than the
    capacity is cut into pieces of it, the last may be shorter; whole pieces fill a sequence each. Null or repeated
    doc_ids are documents like others. Extra columns are ignored. An empty table gives an empty one.

    Pieces are dealt by a hash of their place in the written table into groups of about GROUP, so that repeated rows
    spread and a group is bounded; each group is packed by itself. What then lies in underfull sequences of all groups is
    dealt and packed again, as long as that halves it and there was more than one group, so that groups leave no sequence each.
    """
    p = lean(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces(tokenizer, capacity), PIECES)
    p, done, left, turn = stash(p, "pieces"), [], None, 0
    while True:
        n = p.count()
        if left is not None and 2 * n > left:
            break
        groups = max(1, -(-n // GROUP))
        dealt = p.select(*[c.split()[0] for c in PIECES.split(", ")]).withColumn("tie", F.monotonically_increasing_id())
        dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("tie"), F.lit(groups)).cast("long")).repartition(max(1, min(groups, 4096)), "grp").sortWithinPartitions("grp", "length", "tie")
        packed = stash(dealt.mapInArrow(_packed(capacity, turn), f"{PIECES}, sequence_id long, offset long, room long"), "packed")
        if left is not None:  # these were open before
            done[-1] = done[-1].where("room = 0")
        done.append(packed)
        if groups == 1:
            break
        p, left, turn = packed.where("room > 0"), n, turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("room")
