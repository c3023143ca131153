"""Plain versions of the contracts, written apart from the operators."""

import hashlib
import html
import re
from collections import Counter
from itertools import combinations

SPACE = "[ \t\n\x0b\x0c\r]+"


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    w = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def components(sets, percent):
    """Smallest key reachable by links, for sets by key."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in sets}


def shingles(text, size):
    w = split(low(text))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def contamination(text, items):
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    w = re.findall(word, low(text))
    hit, found = set(), set()
    for item_id, item in items:
        v = re.findall(word, low(item))
        size = min(13, len(v))
        for i in range(len(v) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == v[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


def secrets(text):
    spans = []
    for k, (kind, pattern, least) in enumerate((
        ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 12),
        ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]+)", 16),
    )):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[1]) >= least]
    return spans, hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest()


def article(page):
    m = re.search("<article>(.*)</article>", page, re.S)
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", re.sub("</?b>", "", m[1]))).split())


def block_distribution(lines):
    """Kept lines of (text, characters in links, boilerplate, article or 0) by the sums of all windows, each computed anew."""
    on_page = any(m and not b for _, _, b, m in lines)
    w = [0 if b else 4 * len(t) if m else max(0, len(t) - 2 * min(k, len(t))) for t, k, b, m in lines]
    groups, parts = [], []
    for i, x in enumerate(lines):
        if not groups or (on_page and x[3]) != (on_page and lines[groups[-1][-1]][3]):
            groups.append([])
        groups[-1].append(i)
    for g in groups:
        sums = {i: sum(w[j] for j in range(i, i + 3) if j in g) for i in g}
        runs, open_ = [], False
        for i in g:
            if not open_ and w[i] and sums[i] >= 60:
                runs.append([])
                open_ = True
            elif open_ and not sums[i]:
                open_ = False
            if open_:
                runs[-1].append(i)
        some = [i for i in g if w[i]]
        runs = runs or ([list(range(some[0], some[-1] + 1))] if some else [])
        parts += [(r, g, lines[g[0]][3] if on_page else 0) for r in runs]
    weight = [sum(w[i] for r2, _, m2 in parts if (m2 == m if m else r2 is r) for i in r2) for r, _, m in parts]
    out = {}
    for (r, g, m), x in zip(parts, weight, strict=True):
        while r and not w[r[-1]]:
            r = r[:-1]
        if 5 * x >= max(weight):
            out |= {i: lines[i][0] for i in (g if m else r) if not lines[i][2] and (m or w[i] or lines[i][1] < len(lines[i][0]))}
    return " ".join(out[i] for i in sorted(out))


def edit_within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def line_dedup(docs, least, shortest):
    """(kept lines, exact, near) of each row, in the given order."""
    lines = [(i, k, split(low(line))) for i, text in docs if i is not None for k, line in enumerate((text or "").split("\n"))]
    first = {}
    for i, k, w in lines:
        if len(w) >= shortest:
            first[tuple(w)] = min((i, k), first.get(tuple(w), (i, k)))
    near = {w for w, at in first.items() if len(w) >= least and any(len(v) >= least and v != w and x < at and edit_within_one(list(w), list(v)) for v, x in first.items())}
    out = []
    for i, text in docs:
        kept, exact, n_near = [], 0, 0
        for k, line in enumerate((text or "").split("\n")):
            w = tuple(split(low(line)))
            if i is None or w not in first or (w not in near and first[w] == (i, k)):
                kept.append(line)
            elif w in near:
                n_near += 1
            else:
                exact += 1
        out.append((i, "\n".join(kept), exact, n_near))
    return out
