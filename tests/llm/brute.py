"""Plain, slow versions of the operators' contracts, written independently of them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

ASCII_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def quality(text):
    text = text or ""
    words = ASCII_SPACE.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if ASCII_SPACE.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def contamination(docs, items):
    """docs: (doc_id, text); items: (item_id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").translate(UPPER))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def fingerprint(text):
    words = ASCII_SPACE.findall((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs):
    prints = [(d, fingerprint(t)) for d, t in docs]
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(prints):
        r = root(i)
        least[r] = d if least.get(r) is None else min(least[r], d) if d is not None else least[r]
    return [(d, f"{p:016x}", least[root(i)]) for i, (d, p) in enumerate(prints)]


def suffix_dedup(docs, length=100):
    """docs in order of doc_id."""
    seen, out = set(), []
    for doc, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def line_dedup(docs):
    """docs in order of doc_id; the kept text of each."""
    seen, out = set(), []
    for doc, text in docs:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if not any(re.search(r"[^ \t\n\x0b\f\r]", x) for x in w):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out.append((doc, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out
