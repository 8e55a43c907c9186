"""Plain Python versions of what the operators compute."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def statistics(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    count, covered = collections.Counter(windows), set()
    for k, window in enumerate(windows):
        if count[window] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def grams(text, n=5):
    words = WORD.findall(text or "")
    return frozenset(zip(*(words[k:] for k in range(n)))) or frozenset([tuple(words)] if words else [])


def links(texts, threshold=0.8):
    """id -> (smallest id of the group, number of links) for a dict of texts."""
    sets = {i: grams(t) for i, t in texts.items()}
    root, n = {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= threshold * len(x | y) - 1e-9:
                n[a] += 1
                n[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (find(i), n[i]) for i in ids}


def scores(texts, factor=0.4):
    """Held-out bigram scores of a list of texts."""
    docs = [WORD.findall(t or "") for t in texts]
    one = collections.Counter(w for d in docs for w in d)
    two = collections.Counter(p for d in docs for p in zip(d, d[1:]))
    total, out = sum(one.values()), []
    for d in docs:
        own1, own2, n = collections.Counter(d), collections.Counter(zip(d, d[1:])), max(total - len(d), 1)
        s = 0.0
        for k, w in enumerate(d):
            alone = (one[w] - own1[w] or 0.5) / n
            if not k:
                s += math.log10(alone)
                continue
            pair = (d[k - 1], w)
            c = two[pair] - own2[pair]
            s += math.log10(c / (one[d[k - 1]] - own1[d[k - 1]])) if c > 0 else math.log10(factor * alone)
        out.append(s)
    return out


def secret_spans(text):
    """Base spans (start, number, kind, end)."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def spelled(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def spelling_counts(texts, shortest=6, least=5):
    """Words and counts of a dict of texts."""
    count = collections.Counter()
    for i, text in texts.items():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= least}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1:] == x for k in range(len(y)))


def spelling_forms(count, factor=5):
    """word -> (form, root, n, n_near, form_n)."""
    near = {w: [v for v in count if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in count}
    best = {w: min(vs, key=lambda v: (-count[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if count[v] >= factor * count[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, len(near[w]), count.get(form.get(w))) for w, n in count.items()}


def rebuilt(rows):
    """conv_id -> turns (role, text) after the rebuild, from (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def trie(conversations):
    """(conv_id, depth) -> the columns of a node."""
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, turns in conversations.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    out = {}
    leaves, saved = collections.Counter(), collections.Counter()
    for node, own in members.items():
        words = len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * words
    for node, own in members.items():
        digest = sha(",".join(map(str, sorted(ends[node]))))
        out[min(own), len(node)] = (min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], digest)
    return out
