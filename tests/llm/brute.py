"""Plain Python versions of the operators' contracts."""

import hashlib
import re

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
    counts = [sum(k == x for _, k, _ in found) for x in range(3)]
    return (*counts, hashlib.sha256(listed.encode()).hexdigest(), listed)


def exact(rows):
    """rows: (doc_id, text). {doc_id: (keep_id, group_size, kept, sha)} for distinct ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near(rows, percent=85):
    """rows: (doc_id, text) of distinct ids. {doc_id: (n_shingles, component_id, kept)}"""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        both = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""\b(?:https?|ftp|amqp|redis|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z0-9]+)://[^\x00-\x20"'<>]{4,}""", re.I | re.A)


def weak_secrets(text, scope=400):
    """Every span that a scan lists: the base ones, and weak parts whose complement starts within the scope."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    cover = text
    if found:
        for pattern in (ASSIGN, re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]{24,}")):
            cover = pattern.sub(lambda m: "\0" * len(m[0]), cover)
    weak = [(m.start(), 3, m.end()) for m in ACCOUNT.finditer(cover)]
    weak += [(m.start(), 4, m.end()) for m in BARE_KEY.finditer(cover) if all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(cover)]
    near = lambda s, kinds: any(k in kinds and abs(x - s) <= scope for x, k, _ in found + weak)
    out = found + [(s, k, e) for s, k, e in weak if (k == 4 or near(s, (0, 2, 4))) and (k == 3 or near(s, (1, 3)))]
    return ",".join(f"{('assign', 'access', 'hex', 'account', 'bare_key', 'endpoint')[k]}:{s}:{e}" for s, k, e in sorted(out))
