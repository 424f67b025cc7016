"""Plain Python statements of what the corpus operators return."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = " \t\n\v\f\r"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs):
    sets = {k: shingles(t) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared, holders = Counter(), defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                shared[min(a, b), max(a, b)] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in docs}


def passages(docs, items):
    spell = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for i, t in items.items():
        w = spell(t)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t in docs.items():
        w, hit, ids = spell(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit |= set(range(k, k + size))
                    ids |= found
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, r in KINDS.items() for m in re.finditer(r, text or "") if valid(k, m.group())]


def unigram(docs):
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    tokens = {k: [*words(lower(t)), None] for k, t in docs.items()}
    c = Counter(w for k, v in tokens.items() if not held[k] for w in v)
    n, kinds = sum(c.values()), len(c)
    return {k: (held[k], len(v), sum(c[w] > 0 for w in v), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (kinds + 1))) for w in v)) for k, v in tokens.items()}


def repeated_lines(docs, least=50):
    """The texts left when lines of runs of ``least`` words or more that stand earlier too are gone.

    Stated from the contract: places of equal lines are compared along every shift, and each
    run of neighbouring equal ones counts as it is. In one text a run must not overlap the
    earlier one, so that a run longer than its shift is looked at piece by piece.
    """
    held = {i: [(p, x.strip(SPACE)) for p, x in enumerate((docs[i] or "").split("\n")) if x.strip(SPACE)] for i in docs}
    size = {i: [len(words(x)) for _, x in held[i]] for i in docs}
    places = defaultdict(list)
    gone = defaultdict(set)
    for i in sorted(held):
        for k, (_, x) in enumerate(held[i]):
            places[x].append((i, k))
        shifts = defaultdict(list)
        for k, (_, x) in enumerate(held[i]):
            for j, k0 in places[x]:
                if j != i or k0 < k:
                    shifts[j, k - k0].append(k)
        for (j, d), ks in shifts.items():
            while ks:
                n = next((n for n in range(1, len(ks)) if ks[n] != ks[0] + n), len(ks))
                run, ks = ks[:n], ks[n:]
                for s in run if j == i else run[:1]:
                    piece = [k for k in run if s <= k < s + d] if j == i else run
                    if sum(size[i][k] for k in piece) >= least:
                        gone[i] |= {held[i][k][0] for k in piece}
    return {i: None if docs[i] is None else "\n".join(t for p, t in enumerate(docs[i].split("\n")) if p not in gone[i]) for i in docs}


def trie_bits(train, text, order):
    """Code length of one text by partial matching with method C and exclusion, all contexts kept."""
    def framed(t):
        return [0xFE] * order + list(lower(t).encode()) + [0xFF]

    counts = defaultdict(Counter)
    for t in train:
        s = framed(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    s, total = framed(text), 0.0
    for i in range(order, len(s)):
        k = order
        while tuple(s[i - k : i]) not in counts:
            k -= 1
        out = set()
        while True:
            c = {x: n for x, n in counts[tuple(s[i - k : i])].items() if x not in out} if k >= 0 else None
            if c is None:
                total += math.log2(256 - len(out))
                break
            size = sum(c.values()) + len(c)
            if s[i] in c:
                total -= math.log2(c[s[i]] / size)
                break
            if c:
                total -= math.log2(len(c) / size)
            out |= set(c)
            k -= 1
    return total


def letters(text):
    """Lower-case letters, everything else as single spaces, two of them ahead."""
    kept = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    return "  " + re.sub(" +", " ", kept).lstrip(" ")


def kneser_ney(texts):
    """Per language a function from text to nats a symbol; interpolated over three symbols."""
    grams = {lang: Counter(s[i - 2 : i + 1] for s in map(letters, own) for i in range(2, len(s))) for lang, own in texts.items()}
    alphabet = {g[-1] for c in grams.values() for g in c}

    def model(three):
        two, one = Counter(g[1:] for g in three), None
        one = Counter(g[1:] for g in two)
        tables = []
        for counts in (three, two, one):
            n = Counter(counts.values())
            d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            total, kinds = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            tables.append((counts, d, total, kinds))

        def p(gram, level=0):
            counts, d, total, kinds = tables[level]
            lower = (1 / (len(alphabet) + 1)) if level == 2 else None
            context = gram[:-1]
            if not total[context]:
                return p(gram[1:], level + 1)
            lower = p(gram[1:], level + 1) if lower is None else lower
            return max(counts[gram] - d, 0) / total[context] + d * kinds[context] / total[context] * lower

        def entropy(text):
            s = letters(text)
            return -sum(math.log(p(s[i - 2 : i + 1])) for i in range(2, len(s))) / (len(s) - 2)

        return entropy

    return {lang: model(c) for lang, c in grams.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def merkle(levels, fanout=2):
    """Root of a list of digests, and of each the (before, after) texts of its siblings from below."""
    at, paths, row = list(range(len(levels))), [[] for _ in levels], list(levels)
    while len(row) > 1:
        for i, p in enumerate(at):
            own = p - p % fanout
            paths[i].append(("".join(row[own:p]), "".join(row[p + 1 : own + fanout])))
            at[i] = p // fanout
        row = [sha("".join(row[i : i + fanout])) for i in range(0, len(row), fanout)]
    return row[0], paths


def manifest(rows, fanout=2):
    """Digests of rows (doc_id, text, lang, source, n_chars), one tuple each, sorted."""
    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, more):
        i, text, lang, source, n = r
        return sha("".join(map(framed, (i, source, lang, None if n is None else n + more, text))))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    trees, langs = {}, sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for k in langs:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, 0)))
        trees[k] = merkle([leaf(r, 0) for r in groups[k]], fanout)
    root, tops = merkle([trees[k][0] for k in langs], fanout)
    out = []
    for k, top in zip(langs, tops, strict=True):
        for r, path in zip(groups[k], trees[k][1], strict=True):
            own = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for before, after in path + top:
                own = sha(before + own + after)
            out.append((r[0], leaf(r, 0), trees[k][0], root, sha("".join(a + b for a, b in path + top)), own, own == root))
    return sorted(out, key=str)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(b) - len(a) == 1 and a[i:] == b[i + 1 :])


def vocabulary(rows, length=6, least=5):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = 1 if i is None else zlib.crc32(f"{i}:{run}".encode())
            found[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= length and n >= least}


def variants(vocab, times=5):
    """word, form, root, n, n_near, form_n by comparing all words of like lengths."""
    near = defaultdict(list)
    sized = defaultdict(list)
    for w in vocab:
        sized[len(w)].append(w)
    for size, ws in sized.items():
        for a in ws:
            for b in itertools.chain(ws, sized.get(size + 1, [])):
                if one_edit(a, b):
                    near[a].append(b)
                    if len(b) > size:
                        near[b].append(a)
    best = {w: min(near[w], key=lambda x: (-vocab[x], x)) for w in vocab if near[w]}
    form = {w: b for w, b in best.items() if vocab[b] >= times * vocab[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), vocab.get(form.get(w))) for w, n in vocab.items()}
