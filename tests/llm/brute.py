"""Plain versions of the operators for small inputs, written from their contracts."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LEAST = -(1 << 63)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key(doc_id):
    return LEAST if doc_id is None else doc_id


def edited(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_chars, edited_sha256), of (doc_id, text)."""
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (key(r[0]), zlib.crc32(r[1].encode()), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        n = len(t) // 2
        out.append((d, len(t), sha(t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n])))
    return out


def repeats(docs: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256)"""
    words = [(d, WORD.findall(t or "")) for d, t in docs]
    first: dict[tuple, int] = {}
    for d, ws in words:
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i : i + window])
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, ws in words:
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < key(d):
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(ws, gone, strict=True) if not g]
        out.append((d, len(ws), sum(gone), sha(" ".join(kept))))
    return out


def contaminated(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)"""
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        ws = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(ws) - window + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + window]), set()).add(str(name))
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, text in docs:
        ws = ALNUM.findall((text or "").translate(LOWER))
        hit, names = [False] * len(ws), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if found := windows.get(tuple(ws[i : i + n])):
                    hit[i : i + n] = [True] * n
                    names |= found
        out.append((d, len(ws), sum(hit), len(names), sha(",".join(sorted(names))), sum(hit) > 0 and 20 * sum(hit) >= len(ws)))
    return out


def shingle_set(text: str | None, k: int = 5) -> frozenset:
    ws = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def alike(docs: list[tuple], percent: int = 75) -> list[tuple]:
    """(doc_id, n_shingles, component_id)"""
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), key(d)), key(d))
    back = lambda x: None if x == LEAST else x
    return [(d, len(s), back(least[find(i)]) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def luhn(digits: str) -> bool:
    every = [int(c) for c in digits][::-1]
    return (sum(every[0::2]) + sum(sum(divmod(2 * d, 10)) for d in every[1::2])) % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, place of the kind, kind, end), ascending."""
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


TERM = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")


def terms_apart(text: str) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms that no base span touches."""
    spans = [(a, b) for a, _, _, b in personal(text)]
    out = [(m.start(), m.end(), m[0].translate(LOWER)) for m in TERM.finditer(text) if len(m[0].encode()) >= 3]
    return [(a, b, t) for a, b, t in out if not any(x < b and a < y for x, y in spans)]


def entity_keys(found: str, kind: str) -> list[str]:
    """An identifier and what it has in common with others."""
    if kind == "email":
        domain = found.lower().split("@")[1].split(".")
        return ["email:" + found.lower(), "domain:" + ".".join(domain), "domain:" + ".".join(domain[-2:])]
    digits = re.sub(r"[^0-9]", "", found)
    if kind == "ip":
        parts = found.split(".")
        return ["ip:" + found, "network:" + ".".join(parts[:3]), "network:" + ".".join(parts[:2])]
    return [f"{kind}:{digits}", f"issuer:{digits[:6]}" if kind == "card" else f"area:{digits[:-7]}"]


def disclosures(texts: list[str], window: int, support: int) -> dict[str, float]:
    """Largest share of any entity's information that a term gives, of terms with a pair seen often enough."""
    from collections import Counter, defaultdict
    from math import log

    n_t, n_e, n_et = Counter(), Counter(), Counter()
    windows, sets = defaultdict(set), defaultdict(set)
    for text in texts:
        terms = terms_apart(text)
        n_t.update({t for _, _, t in [(m.start(), m.end(), m[0].translate(LOWER)) for m in TERM.finditer(text) if len(m[0].encode()) >= 3]})
        near = defaultdict(set)
        for a, _, kind, b in personal(text):
            before = [t for s, _, t in terms if s < a][-window:]
            after = [t for s, _, t in terms if s >= b][:window]
            for e in set(entity_keys(text[a:b], kind)):
                near[e].update(before + after)
        for e, some in near.items():
            n_e[e] += 1
            sets[e].add(frozenset(some))
            for t in some:
                n_et[e, t] += 1
                windows[e, t].add(frozenset(some))
    looked_at = sum(len(some) for each in sets.values() for some in each)
    share: dict[str, float] = {}
    for (e, t), n in n_et.items():
        if len(windows[e, t]) >= support and n_e[e] < len(texts):
            pmi = log(n * len(texts) / (n_e[e] * n_t[t]))
            if n * pmi >= log(looked_at):
                share[t] = max(share.get(t, 0), pmi / log(len(texts) / n_e[e]))
    return share
