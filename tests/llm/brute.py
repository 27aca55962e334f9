"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(zip(ws, ws[1:], ws[2:]))
    again = {i + j for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if seen[g] > 1 for j in range(3)}
    n, chars = len(ws), sum(map(len, ws))
    symbols, dup = len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(again) > 50 * n
    kept = not (base or 10 * symbols > n or chars < 3 * n or chars > 10 * n
                or 100 * dup > 50 * len(lines))
    return n, chars, symbols, dup, len(again), base, kept


def shingles(text, n):
    ws = words(lower(text))
    if not ws:
        return set()
    n = min(n, len(ws))
    return {tuple(ws[i: i + n]) for i in range(len(ws) - n + 1)}


def groups(rows, n, num, den):
    """doc_id -> (set size, smallest reachable doc_id); ids are not null."""
    sets = {i: shingles(t, n) for i, t in rows}
    group = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return {i: (len(sets[i]), group[i]) for i in sets}


def removed(rows, width):
    """doc_id -> flags of removed bytes; ids are not null and distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        flags = [False] * len(data)
        for s in range(len(data) - width + 1):
            window = data[s: s + width]
            if window in seen:
                flags[s: s + width] = [True] * width
            seen.add(window)
        out[i] = flags
    return out


def digest(text, flags):
    data = (text or "").encode()
    spans = sum(1 for i, f in enumerate(flags) if f and (i == 0 or not flags[i - 1]))
    kept = bytes(b for b, f in zip(data, flags) if not f)
    return len(data), sum(flags), spans, hashlib.sha256(kept).hexdigest()
