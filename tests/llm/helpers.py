"""Brute-force versions that the operators are held to."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width):
    w = WORD.findall(lower(text or ""))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def jaccard_links(sets, num, den):
    """All linked pairs, by an inverted index over whole sets."""
    seen, links = {}, []
    for k in sorted(sets):
        met = {}
        for g in sets[k]:
            for j in seen.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            seen[g].append(k)
        links += [(j, k) for j, n in met.items() if den * n >= num * (len(sets[k]) + len(sets[j]) - n)]
    return links


def line_form(line):
    return " ".join(x for x in re.split(r"[\x20\x09-\x0d]+", lower(line)) if x)
