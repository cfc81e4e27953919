"""Plain versions of the operators' contracts, one text or pair at a time."""

import hashlib
import re
from collections import Counter

SPACES = " \t\n\x0b\f\r"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    return PLAIN.findall(text or "")


def folded(text):
    return FOLDED.findall(low(text))


def statistics(text):
    text = text or ""
    w = plain(text)
    wins = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if plain(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
    }


def shingles(text, k=5):
    w = plain(low(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def without_repeats(rows, depth=13):
    first = {}
    words = {i: plain(t) for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - depth + 1):
            first.setdefault(tuple(words[i][j : j + depth]), i)
    out = {}
    for i, w in words.items():
        gone = {p for j in range(len(w) - depth + 1) if first[tuple(w[j : j + depth])] < i for p in range(j, j + depth)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def contamination(rows, items, span=13):
    wins = {}
    for i, t in items:
        w = folded(t)
        n = min(span, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    lengths = {len(x) for x in wins}
    out = {}
    for d, t in rows:
        w, hit, ids = folded(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                if found := wins.get(tuple(w[j : j + n])):
                    ids |= found
                    hit |= set(range(j, j + n))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def phrases(text, given):
    w = folded(text)
    places = [(i, label) for label, p in given for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def licenses(text, m):
    """(labels, score) of a text, from the phrases, templates and limits of a module m."""
    words = folded(text)
    grams = [" ".join(words[i : i + m.K]) for i in range(len(words) - m.K + 1)]
    labels, score = set(), 0.0
    for phrase, given in ((True, m.PHRASES), (False, m.TEMPLATES)):
        for label, own in given:
            own = own.split()
            known = [" ".join(own[i : i + m.K]) for i in range(len(own) - m.K + 1)]
            need = {i for i, g in enumerate(known) if not phrase and g in m.REQUIRED.get(label, ())}
            votes = [(i - j, j, False, i) for i, g in enumerate(grams) for j, k in enumerate(known) if g == k]
            if not phrase:
                for veto in m.VETOES.get(label, ()):
                    pair = veto.split()[:2]
                    at = next((i for i in range(len(own)) if own[i : i + 2] == pair), own.index(pair[0]) if pair[0] in own else None)
                    votes += [(i - at, None, True, i) for i, g in enumerate(grams) if g == veto and at is not None]
            spans, last = [], None
            for d in sorted({v[0] for v in votes}):
                if last is None or phrase or d - last > m.STEP:
                    spans.append([])
                spans[-1] += [v for v in votes if v[0] == d]
                last = d
            for span in spans:
                places = {v[1] for v in span if not v[2]}
                cover = len(places) / len(known)
                starts = [v[3] for v in span]
                long = max(starts) - min(starts) + m.K > m.STRETCH * (len(known) + m.K - 1)
                good = cover >= 1 if phrase else need <= places and not any(v[2] for v in span) and cover >= m.COVER and not long
                if good:
                    labels.add(label)
                    score = max(score, cover)
    return ",".join(sorted(labels)), score
