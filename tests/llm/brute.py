"""Plain Python versions of the operators, to compare with on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def quality_rules(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def _bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(texts: dict, items: list[tuple]) -> dict:
    windows: dict = {}
    for item, text in items:
        words = _bench_words(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in texts.items():
        words, hit, got = _bench_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    got |= found
                    hit.update(range(i, i + n))
        out[doc] = (len(words), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def shingles(text: str | None) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def components(texts: dict) -> dict:
    """(size of the set, smallest linked id) of each text."""
    sets = {k: shingles(v) for k, v in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    shared: Counter = Counter()
    for ids in by.values():
        shared.update((a, b) for i, a in enumerate(ids) for b in ids[i + 1 :])
    for (a, b), both in shared.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


_BASE = {
    "assign": re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def secrets(text: str | None) -> list[tuple]:
    found = []
    for rank, (kind, pattern) in enumerate(_BASE.items()):
        for m in pattern.finditer(text or ""):
            if (kind == "assign" and len(m[2]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                found.append((m.start(), rank, kind, m.end()))
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def licences(text: str | None, model, cues: str, confirm: float, window: int) -> tuple[int, int, set]:
    """Notices, unknown ones and family numbers of one text, paragraph by paragraph; nothing is ruled out beforehand."""

    def words(x):
        return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", re.sub(r"\bcc-by\b", "cc by", x))

    def judged(ws):
        grams = {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}
        z = [b + sum(model.weights[g][k] for g in grams if g in model.weights) for k, b in enumerate(model.bias)]
        best = max(range(1, len(z)), key=lambda k: (z[k], -k))
        p = 1 / sum(math.exp(x - z[best]) for x in z)
        held = {k: max(len(pairs & grams) / len(pairs) for pairs, f in zip(model.pairs, model.family, strict=True) if f == k) for k in range(1, len(z))}
        return best, p >= model.least, held

    notices, unknown, families = 0, 0, set()
    for block in re.split(r"\n(?:[^\S\n]*\n)+", (text or "").lower()):
        lines, at = [], 0
        for line in block.split("\n"):
            ws = words(line)
            lines.append((at, at + len(ws), bool(re.search(cues, line)), *judged(ws)))
            at += len(ws)
        every = words(block)
        half = window // 2
        found = []
        for k in range(max(-(-len(every) // half) - 1, 1)):
            best, named, held = judged(every[half * k : half * k + window])
            if named and held[best] >= confirm:
                found.append((half * k, min(half * k + window, len(every)), best))
        sure = [(a, b, f) for a, b, _, f, named, held in lines if named and held[f] >= confirm]
        apart = [(a, b, f) for a, b, f in found if not any(f == g and x < b and y > a for x, y, g in sure)]
        until: dict = {}
        for a, b, f in apart:
            notices += a >= until.get(f, 0)
            until[f] = b
        notices += len(sure)
        families |= {f for _, _, f in sure + apart}
        for a, b, cue, f, named, held in lines:
            if (cue or named) and not (named and held[f] >= confirm):
                unknown += not any(x < b and y > a and held[g] > 0 for x, y, g in apart)
    return notices, unknown, families


def random_spans(texts: dict, battery, weights, lengths, shortest: int, fdr: float, bins: int) -> dict:
    """The spans that weighted Benjamini-Hochberg control over every candidate of ``texts`` adds, candidate by candidate."""
    family = []
    for doc, text in texts.items():
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text or ""):
            if m.end() - m.start() < shortest:
                continue
            whole = None
            for start, end, p in battery.judged(m[0]):
                b = min(bins, int(-10 * math.log10(p))) if p < 1 else 0
                family.append((doc, m.start() + start, m.start() + end, b, weights[sum(end - start > x for x in lengths)], whole))
                whole = whole or len(family)
    mean = sum(f[4] for f in family) / len(family) if family else 1
    q = [10 ** (-b / 10) * mean / w if b else math.inf for _, _, _, b, w, _ in family]
    best = 0.0
    for rank, x in enumerate(sorted(q), 1):
        if x * len(family) <= fdr * rank:
            best = x
    out: dict = {doc: [] for doc in texts}
    for (doc, start, end, b, _, whole), x in zip(family, q, strict=True):
        if b and x <= best and not (whole and q[whole - 1] <= best):
            out[doc].append(f"random:{start}:{end}")
    return out
