"""Plain versions of the operators, for small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import public_tokenizers
import xxhash

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@cache
def _sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def op1(docs):
    out = []
    for doc_id, text in docs:
        ids = _sp().encode(text or "", add_bos=True, add_eos=True)
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(_sp().decode(ids).encode()).hexdigest()))
    return out


def fingerprint(text):
    words = [w for w in SPACES.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op2(docs, bits=4):
    prints = [(d, fingerprint(t)) for d, t in docs]
    distinct = sorted({f for _, f in prints})
    near = {f: {g for g in distinct if (f ^ g).bit_count() <= bits} for f in distinct}
    ids, group = defaultdict(list), {}
    for d, f in prints:
        ids[f].append(d)
    for f in distinct:
        if f in group:
            continue
        reach, edge = {f}, {f}
        while edge:
            edge = set().union(*(near[x] for x in edge)) - reach
            reach |= edge
        known = [d for x in reach for d in ids[x] if d is not None]
        for x in reach:
            group[x] = min(known) if known else None
    return [(d, f"{f:016x}", group[f]) for d, f in prints]


def shingles(text, size=5):
    w = [x for x in SPACES.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_kept(docs, bits=4, similarity=0.8):
    """The smallest doc_id of each group that few differing bits or a high similarity of five-word shingles join."""
    docs = [(d, fingerprint(t), shingles(t)) for d, t in docs if shingles(t)]
    root = {d: d for d, _, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, f, s) in enumerate(docs):
        for b, g, t in docs[:k]:
            if (f ^ g).bit_count() <= bits or 5 * len(s & t) >= 4 * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [d for d in root if root[d] == d]


def near_rows(docs, bits=4):
    """Which rows with words stay: of each group that near copies join, the smallest doc_id (of equal ids the first row)
    and, where rows have none, the first of those."""
    own = [(fingerprint(t), shingles(t)) for _, t in docs]
    group = list(range(len(docs)))
    for k, (f, s) in enumerate(own):
        for j, (g, t) in enumerate(own[:k]):
            if s and t and ((f ^ g).bit_count() <= bits or 5 * len(s & t) >= 4 * len(s | t)):
                old, new = sorted((group[k], group[j]))[::-1]
                group = [new if x == old else x for x in group]
    stays = {}
    for k, (doc_id, _) in enumerate(docs):
        if own[k][1]:
            key = (group[k], doc_id is None)
            if key not in stays or (doc_id is not None and doc_id < docs[stays[key]][0]):
                stays[key] = k
    return [k in stays.values() for k in range(len(docs))]


def op3(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    # rows of one doc_id come by XXH64 as a signed number
    signed = lambda t: (xxhash.xxh64_intdigest((t or "").encode(), 42) + 2**63) % 2**64
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def op5(pages):
    largest = {}
    for page_id, html in pages:
        largest[html or ""] = max((x for x in (largest.get(html or ""), page_id) if x is not None), default=None)
    out = []
    for page_id, html in pages:
        raw, to = (html or "").encode(), largest[html or ""]
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to == page_id else "revisit", None if to == page_id else to))
    return out


def op7(docs):
    norm = [(d, SPACES.sub(" ", t or "")) for d, t in docs]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    kept, out = set(), []
    for d, t in norm:
        first = min((x for x in groups[t] if x is not None), default=None)
        stays = d == first and t not in kept
        if stays:
            kept.add(t)
        out.append((d, first, len(groups[t]), stays, hashlib.sha256(t.encode()).hexdigest()))
    return out


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def op8(docs, items, size=13):
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(str(item_id))
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("password|passwd|secret|token|api_?key", "(?:" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"))


def op9(docs):
    out = []
    for doc_id, text in docs:
        text = text or ""
        found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        found.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        n = [sum(k == x for k, _, _ in found) for x in ("assign", "access", "hex")]
        out.append((doc_id, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
    return out


def grams(text):
    s = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip()
    s = f" {s} " if s else ""
    return [s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1) if s[i : i + n].strip()]


def top_grams(counts, top):
    key = lambda g: [ord(c) for c in g]
    return sorted(counts, key=lambda g: (-counts[g], len(g) > 1, sum(k << 21 * (len(g) - 1 - i) for i, k in enumerate(key(g)))))[:top]


def op10(docs, labelled, top=400):
    counts = defaultdict(Counter)
    for text, lang in labelled:
        if lang is not None:
            counts[lang].update(grams(text))
    profiles = {k: {g: i for i, g in enumerate(top_grams(c, top))} for k, c in sorted(counts.items()) if c}
    out = []
    for doc_id, text in docs:
        own = top_grams(Counter(grams(text)), top)
        if not own:
            out.append((doc_id, "und", 0.0))
            continue
        off = {k: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) for k, p in profiles.items()}
        near = {k: 1 - v / (top * len(own)) for k, v in off.items()}
        best = min(off, key=lambda k: (off[k], k))
        out.append((doc_id, best, round(min(1.0, max(0.0, near[best] / max(sum(near.values()), 1e-9))), 9)))
    return out


def toxic_score(text, entries, beta):
    """The linear score of a text's lexicon entries, written out."""
    runs, out = re.findall("[a-z\x80-\U0010ffff]+", (text or "").lower()), []
    unspaced = lambda c: any(a <= ord(c) <= b for a, b in ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)))
    for w in runs:
        out += [w[k : k + 2] for k in range(max(1, len(w) - 1))] if any(map(unspaced, w)) else [w]
    hits = [any(w == e[1:] if e[0] == "=" else len(w) > len(e) - 1 and w.startswith(e[1:]) for w in out) for e in entries]
    n = sum(hits)
    x = [*map(float, hits), 1.0, float(n > 0), math.log1p(n), min(5.0, 100 * n / max(1, len(out)))]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(x, beta))))))


def label_model(rows, share, rounds=30):
    n, m = len(rows), len(rows[0])
    post = [0.9 if 1 in r else 0.05 if -1 in r else share for r in rows]
    for k in range(rounds):
        if k % 10 == 0:
            cov = [[0.0] * m for _ in range(m)]
            for w in (post, [1 - p for p in post]):
                total = max(sum(w), 1e-9)
                mean = [sum(w[i] * rows[i][a] for i in range(n)) / total for a in range(m)]
                for a in range(m):
                    for b in range(a, m):
                        c = sum(w[i] * (rows[i][a] - mean[a]) * (rows[i][b] - mean[b]) for i in range(n))
                        cov[a][b] += c
                        cov[b][a] = cov[a][b]
            sd = [math.sqrt(max(cov[a][a], 1e-9)) for a in range(m)]
            corr = [[min(1.0, max(0.0, cov[a][b] / (sd[a] * sd[b]))) if a != b else 0.0 for b in range(m)] for a in range(m)]
            alike = [[c if c > 0.1 else 0.0 for c in row] for row in corr]
        told = {}
        for y in (1, -1):
            for a in range(m):
                toxic = (sum(post[i] for i in range(n) if rows[i][a] == y) + 0.5) / (sum(post) + 1)
                other = (sum(1 - post[i] for i in range(n) if rows[i][a] == y) + 0.5) / (n - sum(post) + 1)
                told[y, a] = y * max(0.0, y * math.log(toxic / other))
        if k % 10 == 0:
            weight = [{a: 1 / (1 + sum(alike[b][a] for b in range(m) if r[b] == r[a])) for a in range(m) if r[a]} for r in rows]
        odds = [math.log(share / (1 - share)) + sum(w * told[r[a], a] for a, w in own.items()) for r, own in zip(rows, weight)]
        post = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    return post


def op13(docs, size=3, part=85, whole=100):
    own = [shingles(t, size) for _, t in docs]
    group = list(range(len(docs)))
    for k, s in enumerate(own):
        for j, t in enumerate(own[:k]):
            if s and t and whole * len(s & t) >= part * len(s | t):
                old, new = max(group[k], group[j]), min(group[k], group[j])
                group = [new if x == old else x for x in group]
    out = []
    for k, (doc_id, _) in enumerate(docs):
        ids = [d for j, (d, _) in enumerate(docs) if group[j] == group[k] and d is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(own[k]), least, doc_id == least))
    return out


def op12(rows):
    """rows: doc_id, source, lang, n_chars, text."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def siblings(tree, pos):
        return [(pos >> k & 1, (level[(pos >> k) ^ 1 : ((pos >> k) ^ 1) + 1] or [None])[0]) for k, level in enumerate(tree[:-1])]

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [levels([leaf(r) for r in g]) for g in groups]
    over = levels([t[-1][0] for t in trees])
    out = []
    for k, (g, tree) in enumerate(zip(groups, trees)):
        for pos, r in enumerate(g):
            path = siblings(tree, pos) + siblings(over, k)
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r[:3] + (r[3] + 1,) + r[4:]) if changed else leaf(r)
            for right, other in path:
                folded = h(folded) if other is None else h(other, folded) if right else h(folded, other)
            root = over[-1][0]
            out.append((r[0], leaf(r), tree[-1][0], root, h(*(o for _, o in path if o)), folded, folded == root))
    return out


def op11(docs, items, k=20):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for doc_id, c in own:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w, n in asked.items() if w in c)
            if score:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def op4(docs, shards=24):
    rows = sorted(((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, before, out, slots = sum(r[2] for r in rows), 0, [], Counter()
    for doc_id, crc, size in rows:
        shard = min(shards - 1, (2 * before + size) * shards // (2 * total))  # where the row's middle byte lies
        out.append((doc_id, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    return out
