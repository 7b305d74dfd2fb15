"""Plain versions of the operators' contracts, a text or a pair at a time."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib

import numpy as np

sys.set_int_max_str_digits(0)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_base(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(repeated)}
    return out | {"base_failed": len(words) < 10 or 100 * len(repeated) > 20 * len(words)}


def pii_base(text: str | None) -> tuple[list[int], str]:
    text = text or ""
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]

    def luhn(d: str) -> bool:
        x = [int(c) for c in d[::-1]]
        return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    spans = [(k, a, b) for k, x in zip(("email", "ip", "card", "phone"), (email, ip, card, phone), strict=True) for a, b in x]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return [len(email), len(ip), len(card), len(phone)], hashlib.sha256(joined.encode()).hexdigest()


def shingle_set(text: str | None, width: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def components(pairs: list[tuple[int, int]], n: int) -> list[int]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def near_duplicates(texts: list[str | None], width: int, percent: int = 80) -> list[int]:
    """For each text the first text of its component."""
    sets = [shingle_set(t, width) for t in texts]
    index: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = []
    for i, s in enumerate(sets):
        common: dict[int, int] = {}
        for x in s:
            for j in index[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        pairs += [(i, j) for j, c in common.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
    return components(pairs, len(texts))


def targets(sizes: dict, total: int) -> dict:
    """By rounds: share what is left by weight, stop those above three times their size, share the excess again."""
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    fixed: dict = {}
    while True:
        left = total - sum(fixed.values())
        open_ = [k for k in order if k not in fixed]
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > 3 * sizes[k]]
        if not over:
            return {k: float(v) for k, v in (fixed | share).items()}
        fixed |= {k: 3 * sizes[k] for k in over}


def token_ids(text: str | None) -> np.ndarray:
    import public_tokenizers
    from tokenizers import Tokenizer

    global _tokenizer
    if "_tokenizer" not in globals():
        _tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array([*_tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def crc(x: np.ndarray) -> int:
    return zlib.crc32(x.tobytes())
