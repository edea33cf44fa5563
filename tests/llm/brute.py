"""Plain, slow definitions that the operators are held against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def rule_counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    found = words(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(found[i : i + 8]) for i in range(len(found) - 7)]
    often = Counter(windows)
    covered = set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    n = len(found)
    return n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = words(lower)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: dict[int, int], radius: int = 2) -> dict[int, int]:
    """Row number -> number of its component's first row, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    values = np.array([fps[i] for i in ids], dtype=np.uint64)
    for k, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius) + k + 1
        for j in near:
            a, b = find(i), find(ids[j])
            if a != b:
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def repeats(texts: list[str | None], window: int = 35) -> list[tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 of each text."""
    all_words = [words(t) for t in texts]
    often: Counter = Counter()
    for w in all_words:
        often.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if often[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = " ".join(v for v, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def components_of_rows(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """doc_id, fingerprint, least doc_id of the component."""
    fps = {k: fingerprint(text) for k, (_, text) in enumerate(rows)}
    least: dict[int, int] = {}
    found = components(fps)
    for k, (doc_id, _) in enumerate(rows):
        least[found[k]] = min(least.get(found[k], doc_id), doc_id)
    return [(doc_id, f"{fps[k]:016x}", least[found[k]]) for k, (doc_id, _) in enumerate(rows)]


def chat_digest(turns: list[tuple[str, str]]) -> tuple:
    """n_turns, turns_sha256, loss_chars, loss_sha256."""
    said = [t for r, t in turns if r == "assistant"]
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns).encode()), sum(map(len, said)), sha("".join(said).encode())


def nearest(ids: np.ndarray, vectors: np.ndarray, every: int = 50, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    lengths = np.linalg.norm(vectors, axis=1)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        cosines = vectors @ vectors[q] / (lengths * lengths[q])
        order = [j for j in np.lexsort((ids, -cosines)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(cosines[j])) for j in order]
    return out
