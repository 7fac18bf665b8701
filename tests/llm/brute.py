"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re

SPACE = "\x20\t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def substring_dedup(rows, width=13):
    """rows: (doc_id, text)."""
    smallest = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k : k + width])
            smallest[key] = min(smallest.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and smallest[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def line_dedup(rows, least_chars=40, least_docs=5):
    key = lambda line: lower(line.strip(SPACE))
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars and i is not None:
                docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(docs.get(key(x), ())) < least_docs or i == max(docs[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text):
    w = words(lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, least=75):
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= least * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}
