"""Plain single-machine versions of the contracts, to hold the operators against."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(marked),
        "base_failed": len(words) < 50 or 100 * len(marked) > 50 * len(words),
    }


def line_dedup(docs: dict[int, str | None]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: ascii_lower(line.strip(SPACE))
    holders = defaultdict(set)
    for d, text in docs.items():
        for line in (text or "").split("\n"):
            holders[key(line)].add(d)
    out = {}
    for d, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(k := key(x)) >= 10 and len(holders[k]) > 1 and min(holders[k]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def substring_dedup(docs: dict[int, str | None], size: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen: set[bytes] = set()
    out = {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                mark[i : i + size] = b"\x01" * size
            else:
                seen.add(w)
        spans = len(re.findall(b"\x01+", bytes(mark)))
        out[d] = (len(b), sum(mark), spans, sha(bytes(x for x, m in zip(b, mark) if not m)))
    return out


def shingles(text: str | None, size: int = 4) -> set[tuple[str, ...]]:
    words = WORD.findall(ascii_lower(text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_components(docs: dict[int, str | None], size: int = 4, percent: int = 80) -> dict[int, tuple[int, int, bool]]:
    sets = {d: shingles(t, size) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by_shingle = defaultdict(list)
    for d in sorted(docs):
        shared = Counter(e for s in sets[d] for e in by_shingle[s])
        for e, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
        for s in sets[d]:
            by_shingle[s].append(d)
    return {d: (len(sets[d]), root(d), root(d) == d) for d in docs}


SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def secrets(text: str | None) -> tuple[int, int, int, str]:
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, pattern, holds) in enumerate(SECRETS) for m in pattern.finditer(text or "") if holds(m)]
    n = Counter(k for _, k, _ in found)
    return n[0], n[1], n[2], sha(",".join(x for *_, x in sorted(found)))


URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url(address: str | None) -> tuple[str, str, str | None, str | None]:
    if address is None or "://" not in address:
        return "", "", None, None
    m = re.match(r"([^/?#]*)([^?#]*)", address.split("://", 1)[1], re.S)
    host, path = ascii_lower(m[1]), m[2]
    fits = [(len(h) + len(p), h + p, verdict) for verdict, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def mix(docs: dict[int, tuple[str, str, str, str | None]], weights: dict, *, percent: int, max_epochs: int, seed: int) -> dict[int, int]:
    """Copies taken of each document (domain, lang, source, text): shares by weight, those that can't use theirs capped first."""
    tokens = {d: len(WORD.findall(v[3] or "")) for d, v in docs.items()}
    leaves = defaultdict(list)
    for d, v in docs.items():
        leaves[v[:3]].append(d)
    own = {leaf: sum(tokens[d] for d in held) for leaf, held in leaves.items()}

    def shared(budget: int, prefix: tuple) -> dict[tuple, int]:
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        names = sorted({leaf[depth] for leaf in leaves if leaf[:depth] == prefix})
        room = {n: max_epochs * sum(t for leaf, t in own.items() if leaf[: depth + 1] == (*prefix, n)) for n in names}
        w = {n: weights.get(("domain", "lang", "source")[depth], {}).get(n, 1) for n in names}
        given: dict[str, int] = {}
        while True:
            left, open_ = budget - sum(given.values()), [n for n in names if n not in given]
            total = sum(w[n] for n in open_)
            full = [n for n in open_ if room[n] * total <= left * w[n]]
            if not full:
                given |= {n: left * w[n] // total for n in open_}
                break
            least = min(full, key=lambda n: (room[n] / w[n], n))
            given[least] = room[least]
            if len(given) == len(names):
                break
        return {leaf: b for n in names for leaf, b in shared(given[n], (*prefix, n)).items()}

    total = sum(tokens.values())
    budgets = shared(min(total * percent // 100, total * max_epochs), ())
    out = {}
    for leaf, held in leaves.items():
        epochs = min(budgets[leaf] // own[leaf], max_epochs) if own[leaf] else 1
        rest = budgets[leaf] - epochs * own[leaf] if epochs < max_epochs else -1
        upto = 0
        for d in sorted(held, key=lambda d: (hashlib.md5(f"{seed}:{epochs}:{d}".encode()).hexdigest(), d)):
            upto += tokens[d]
            out[d] = epochs + (rest >= 0 and upto <= rest)
    return {d: n for d, n in out.items() if n}
