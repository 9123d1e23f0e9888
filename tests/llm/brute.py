"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def secrets(text):
    """Base spans (start, kind number, kind, end)."""
    name = "".join
    any_case = lambda w: name(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
    assign = rf"""(?:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text or "") if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def personal(text):
    """Base spans (kind number, start, end, kind)."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15)]
    return [(n, m.start(), m.end(), kind) for n, (kind, pattern, ok) in enumerate(kinds)
            for m in re.finditer(pattern, text or "") if ok(m[0])]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def line_dedup(texts, min_docs, min_chars=1):
    """n_lines, n_dropped, kept text of each."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and found[key(x)] >= min_docs)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def components(n, links):
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(i) for i in range(n)]


def near_dups(texts, width, percent=80):
    """(set size, component number) of each; components by the first member's place."""
    sets = []
    for t in texts:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(len(s), c) for s, c in zip(sets, components(len(sets), links))]


def agreement(text, item, window):
    """The best share of equal words in an aligned window of the item."""
    d, x = words((text or "").translate(LOWER)), words((item or "").translate(LOWER))
    size = min(window, len(x))
    best = 0
    for shift in range(-len(x), len(d)):
        same = [0 <= shift + i < len(d) and d[shift + i] == w for i, w in enumerate(x)]
        for s in range(len(x) - size + 1):
            best = max(best, sum(same[s:s + size]))
    return best / size if size else 0


def substring_dedup(texts, window):
    """(words, removed, kept text) of each."""
    docs = [words(t) for t in texts]
    seen = Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {j for i in range(len(d) - window + 1) if seen[tuple(d[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(d), len(gone), " ".join(w for j, w in enumerate(d) if j not in gone)))
    return out


def lm(rows, mix, prior):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base, score without quantisation)}."""
    toks = {i: [*words((t or "").translate(LOWER)), "\n"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    one = Counter(w for i, t in toks.items() if not held[i] for w in t)
    two = Counter(p for i, t in toks.items() if not held[i] for p in zip(["\n", *t[:-1]], t))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    out = {}
    for i, t in toks.items():
        full = sum(math.log10((1 - mix) * two[a, b] / (one[a] + prior) + p(b) * (mix + (1 - mix) * prior / (one[a] + prior)))
                   for a, b in zip(["\n", *t[:-1]], t))
        out[i] = (held[i], len(t), sum(one[w] > 0 for w in t), n, sum(math.log10(p(w)) for w in t), full)
    return out


def check_packing(rows, texts, encode, size=2048):
    """Assert the contract of a packing; the number of sequences."""
    cut = defaultdict(list)
    for r in rows:
        cut[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        ids = [*encode(text or ""), 0]
        parts = sorted(cut.pop(doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        at = 0
        for r in parts:
            assert r["start"] == at
            piece = ids[at:at + r["length"]]
            assert len(piece) == r["length"] and (r["length"] == size or r["piece"] == 0)
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
            at += r["length"]
        assert at == len(ids)
    assert not cut
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)
