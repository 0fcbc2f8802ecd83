"""Plain single-machine versions of the operators, to test against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path, rules):
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def base_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def spans(found):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)


def dedup(docs, span=50):
    """docs: {id: text} -> {id: (n_words, n_removed, sha of kept)}"""
    split = {i: words(t) for i, t in docs.items()}
    first = {}
    for i in sorted(split):
        for p in range(len(split[i]) - span + 1):
            first.setdefault(tuple(split[i][p : p + span]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for p in range(len(w) - span + 1):
            if first[tuple(w[p : p + span])] < i:
                gone.update(range(p, p + span))
        out[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def shingles(text, n=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def jaccard(docs, least=85, n=4):
    """{id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    common = Counter()
    for ids in at.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] += 1
    for (a, b), both in common.items():
        if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in docs}


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def crc(text):
    return zlib.crc32((text or "").encode())


def components(edges):
    """{node: class} of undirected edges."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def verdicts(urls, edges, rules):
    """{url: verdict}: the longest rule's, else block where the class has a blocked address and no allowed one."""
    own = lambda u: rule(*url(u), rules)[1]
    comp = components(edges)
    said = defaultdict(set)
    for node, c in comp.items():
        said[c].add(own(node))
    return {u: own(u) or ("block" if u in comp and "block" in said[comp[u]] and "allow" not in said[comp[u]] else "allow") for u in urls}


def entropy(text):
    """Places covered by entropy spans, each window judged from scratch."""
    from math import log2

    from sultry.llm import secrets as s

    taken = {p for a, _, b in base_secrets(text) for p in range(a, b)}
    out = set()
    bits = lambda w: -sum(c / len(w) * log2(c / len(w)) for c in Counter(w).values())
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        allowed = {m.start() + p for a in s.ALLOWED.finditer(m[0]) for p in range(a.start(), a.end())}
        kind = s.char_class(m[0])
        whole = kind if kind in ("hex", "mixhex", "mixed") and not allowed else None
        free = [p for p in range(m.start(), m.end()) if p not in taken and p not in allowed]
        runs, run = [], []
        for p in free:
            if run and p != run[-1] + 1:
                runs.append(run)
                run = []
            run.append(p)
        for run in [*runs, run]:
            for i in range(len(run) - 19):
                w = "".join(text[p] for p in run[i : i + 20])
                own = s.char_class(w)
                if whole and bits(w) >= s.LEAST[whole] - 1e-9:
                    out.update(run[i : i + 20])
                elif own and bits(w) >= s.LEAST[own] - 1e-9:
                    a, b = i, i + 20
                    if own in ("lower", "upper", "letters"):
                        while a and text[run[a - 1]].isalnum():
                            a -= 1
                        while b < len(run) and text[run[b]].isalnum():
                            b += 1
                    out.update(run[a:b])
    return out


BOILER = re.compile(r"\b(?:all rights reserved|cookie policy|accept (?:all )?cookies|privacy policy|terms of (?:use|service)|sign in|log in|click here|read more|skip to content|javascript is disabled|share this (?:page|article)|subscribe to our newsletter|previous page|next page)\b", re.I)


def line_fails(line):
    w = words(line)
    n = len(w)
    if not n:
        return False
    marked = sum(re.search(r"(?:[#*$%&<>]{2}|!!)[.,;:]?$", x) is not None for x in w)
    bars = sum(x in ("|", ">", ">>", "»", "·", "•") for x in w)
    different = len(set(w))
    return marked > 0.3 * n or (n >= 4 and bars > 0.25 * n) or (n >= 4 and line.upper() == line and line.lower() != line) or (n <= 25 and BOILER.search(line) is not None) or (n >= 12 and different < 0.5 * n and different < 40)


def kept(text):
    """(kept, words in failing lines, text without them)"""
    lines = (text or "").split("\n")
    lost = sum(len(words(x)) for x in lines if line_fails(x))
    clean = "\n".join(x for x in lines if not line_fails(x)) if lost else text
    return not quality(text)[-1] and lost <= 0.3 * len(words(text)), lost, clean
