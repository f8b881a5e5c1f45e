"""Plain Python versions of what the operators must return."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter([(w,) for w in words] + list(zip(words, words[1:], strict=False)))


def op2_base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def op3(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone, strict=True) if not g))))
    return out


def op4_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))


def op4(texts, items):
    windows: dict[tuple, set] = {}
    for item, t in items:
        w = op4_words(t)
        if w:
            k = min(10, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for t in texts:
        w = op4_words(t)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[g]
        names = sorted(str(x) for x in found)
        out.append((len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def op5(text):
    t = text or ""
    spans = []
    for m in re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, "assign", m.end()))
    for k, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        spans += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    spans.sort()
    n = Counter(s[2] for s in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans))


def op7(rows, k=4, percent=85):
    """(id, text) -> {id: (size, component)}"""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index: dict[tuple, list] = {}
    done = set()
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    for ids in index.values():
        for x in range(len(ids)):
            for y in range(x + 1, len(ids)):
                p = ids[x], ids[y]
                if p not in done:
                    done.add(p)
                    a, b = sets[p[0]], sets[p[1]]
                    if 100 * len(a & b) >= percent * len(a | b):
                        ra, rb = find(p[0]), find(p[1])
                        root[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def op1_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def crc_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def op11(rows, items, percent=25, least=20, seed=7, buckets=10000):
    """(id, text) and item texts -> {id: (n_features, weight, score, rank)}"""

    def features(t):
        w = op4_words(t)
        return [zlib.crc32(x.encode()) % buckets for x in (*w, *map(" ".join, zip(w, w[1:], strict=False)))], len(w)

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, f, _ in docs for b in f), Counter(b for x in items for b in features(x)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = {}
    for i, f, n in docs:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha(f"{seed}:{i}")[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n]
    fit = sorted((-v[2], i) for i, v in out.items() if v[4] >= least)
    for k, (_, i) in enumerate(fit[: percent * len(fit) // 100]):
        out[i][3] = k + 1
    return {i: tuple(v[:4]) for i, v in out.items()}


def op12(i, text):
    """n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"""
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = [int(sha(f"42:{i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, sha(t), sha(t)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return len(units), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(t)
