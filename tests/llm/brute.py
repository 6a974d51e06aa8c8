"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width=5):
    w = words(text)
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


def components(texts):
    """Component of each place of the list by links of at least 0.8."""
    sets = [set(shingles(t)) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return sets, label


def matches(texts, items):
    """{(place of the text, item): best weighted similarity} of item-sized windows."""
    found = {}
    for i, text in enumerate(texts):
        for item, item_text in items:
            w = words(item_text)
            if not w:
                continue
            width = min(5, len(w))
            own = Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
            n, t = sum(own.values()), words(text)
            grams = [tuple(t[k : k + width]) for k in range(len(t) - width + 1)]
            best = 0.0
            for k in range(max(1, len(grams) - n + 1)) if grams else ():
                part = grams[k : k + n]
                shared = sum((Counter(part) & own).values())
                best = max(best, shared / (len(part) + n - shared))
            if best >= 0.8:
                found[i, item] = round(best, 9)
    return found


BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def base_spans(text):
    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans)]


def without_repeats(texts, length=400):
    """(bytes, removed, runs, what is kept) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def without_repeated_lines(docs, least=3, length=20):
    """(id, lines, dropped, digest of what is kept) of each (id, text); rows of an id are one document."""
    name = lambda i, t: (i is not None, i or 0, "" if i is not None else t or "")
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[line_key(line)].add(name(i, t))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = lambda k: len(k) >= length and len(held[k]) >= least and max(held[k]) != name(i, t)  # noqa: B023, E731
        kept = [line for line in lines if not gone(line_key(line))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def word_counts(docs):
    """{word: n} of letter runs, some of them damaged."""
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    """(word, form, root, n, n_near, form_n) by comparing all words."""
    form, out = {}, []
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        best = min(near, default=(0, None))
        form[w] = best[1] if -best[0] >= 2 * n else None
        out.append([w, form[w], w, n, len(near), -best[0] if form[w] else None])
    for row in out:
        while form[row[2]]:
            row[2] = form[row[2]]
    return [tuple(row) for row in out]


def weak_spans(text, patterns, scope):
    """All spans of a text by comparing all parts with each other; ``patterns`` are those of the weak kinds."""
    text = text or ""
    spans = {tuple(x.split(":")) for x in base_spans(text)}
    strong = {(k, int(a), int(b)) for k, a, b in spans}
    weak = {(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text, re.A)}
    mixed = lambda t: re.search("[a-z]", t) and re.search("[A-Z]", t) and re.search("[0-9]", t)
    weak = {s for s in weak if s[0] != "mixed" or mixed(text[s[1] : s[2]])}
    of = lambda *kinds: [s for s in strong | weak if s[0] in kinds]
    near = lambda s, others: any(o[1] <= s[2] + scope and o[2] >= s[1] - scope for o in others)
    ids, secret = of("access", "login"), of("assign", "hex", "passcode", "mixed")
    hubs = [s for s in of("endpoint") if near(s, ids) and near(s, secret)]
    found = strong | set(hubs)
    found |= {s for s in of("login") if near(s, secret) or near(s, hubs)}
    found |= {s for s in of("passcode", "mixed") if near(s, ids) or near(s, hubs)}
    return found


def order_minhash(text, k, bins, tuple_size, mix, factors):
    """Entries of the fingerprint from all k-mers of a text, one at a time."""
    import numpy as np

    raw = (text or "").encode()
    if not raw:
        return [0] * bins
    raw = raw.ljust(k, b"\0")
    one = lambda x: int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
    seen, held = Counter(), defaultdict(list)
    for at in range(len(raw) - k + 1):
        value = one(int.from_bytes(raw[at : at + k], "little"))
        numbered = value
        if raw[at : at + k] in repeated_kmers(raw, k):
            numbered = one(value + seen[value] * int(factors[0]))
        seen[value] += 1
        held[numbered * bins >> 64].append((numbered, at, value))
    out, full = [0] * bins, sorted(held)
    for n, b in enumerate(full):
        best = sorted(held[b])[:tuple_size]
        if len(best) < tuple_size and len(full) > 1:
            best.append(min(held[full[(n + 1) % len(full)]]))
        total = int(factors[0])
        for j, (_, _, value) in enumerate(sorted(best, key=lambda x: x[1])):
            total += value * int(factors[j + 1])
        out[b] = max(one(total) & 0xFFFF, 1)
    return out


def repeated_kmers(raw, k, cache={}):  # noqa: B006
    if (raw, k) not in cache:
        cache.clear()
        counts = Counter(raw[i : i + k] for i in range(len(raw) - k + 1))
        cache[raw, k] = {x for x, n in counts.items() if n > 1}
    return cache[raw, k]
