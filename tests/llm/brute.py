"""Slow versions that the operators have to agree with."""

import re
from collections import Counter

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def valid(kind, match):
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        digits = re.sub("[ -]", "", match)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(re.sub("[^0-9]", "", match)) <= 15
    return True


def personal_data(text):
    return sorted(
        (m.start(), i, m.end()) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())
    )


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def reachable(ids, near):
    """{id: smallest id that links lead to}, over all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def duplicates(texts, size, percent=80):
    """{id: (set size, smallest id reachable)} of {id: text}."""
    sets = {i: shingle_set(t, size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def leaks(docs, items, least=0.8):
    """{(doc, item): (similarity, start)} of the best item-sized windows."""
    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []

    found = {}
    for doc, text in docs:
        have = shingles(text)
        for item, want_text in items:
            want = shingles(want_text)
            if not set(have) & set(want):
                continue
            for start in range(max(1, len(have) - len(want) + 1)):
                window = Counter(have[start:start + len(want)])
                both = sum((window & Counter(want)).values())
                alike = both / (sum(window.values()) + len(want) - both)
                if alike >= least and alike > found.get((doc, item), (0, 0))[0]:
                    found[doc, item] = (alike, start)
    return found
