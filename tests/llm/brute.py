"""Plain versions of the operators, to hold results against on small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows, window=50):
    first = {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            f = first[tuple(w[i : i + window])]
            if f is not None and (d is None or f < d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near_components(rows, k=3, percent=85):
    sets = {d: shingles(t, k) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def exact_dedup(rows):
    groups = {}
    for d, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(d)
    return [
        (d, min(g), len(g), d == min(g), sha(t)) for t, g in groups.items() for d in g
    ]


def rule_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(x + i for x in at for i in range(3))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_dedup(rows):
    """{doc_id: removed line numbers}; doc_ids must differ. Lines with a word count; of those, one edit
    per 20 characters of the shorter line may differ, two at most."""
    def counts(line):
        return bool(WORD.search(line))

    first = {}
    for d, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for n, line in enumerate((text or "").split("\n")):
            if counts(line):
                first.setdefault(line, (d is None, d, n))

    def near(a, b):
        most = min(2, min(len(a), len(b)) // 20)
        return abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most

    gone = {x for x in first if any(first[y] < first[x] and near(x, y) for y in first)}
    return {
        d: [n for n, x in enumerate((t or "").split("\n")) if counts(x) and (x in gone or first[x] != (d is None, d, n))]
        for d, t in rows
    }


def alignment(rows, encode_a, bytes_a, encode_b, bytes_b):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)] by walking both lists."""
    told = []
    for d, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        if b"".join(bytes_a(x) for x in a) != whole or b"".join(bytes_b(x) for x in b) != whole:
            a, b = [], []
        spans = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(of(x))))
                at = out[-1][1]
            spans.append(out)
        pairs = [(x, y) for x, (s, e) in zip(a, spans[0]) for y, (t, f) in zip(b, spans[1]) if s < f and t < e]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            inside = [[str(x) for x, (s, e) in zip(ids, of) if low <= s and e <= cut] for ids, of in zip((a, b), spans)]
            groups.append("|".join(map(",".join, inside)))
            low = cut
        told.append((d, len(a), len(b), groups, pairs))
    counts = {}
    for *_, pairs in told:
        for p in set(pairs):
            counts[p] = counts.get(p, 0) + 1
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (d, n_a, n_b, len(groups), len(pairs), sum(counts[p] == best[p[0]] for p in pairs), sum(counts[p] for p in pairs),
         sha(";".join(groups)) if groups else "")
        for d, n_a, n_b, groups, pairs in told
    ]


def prefix_trie(rows):
    """Rows of the operator, sorted, from (conv_id, turn, role, text) rows whose turns differ within a conversation."""
    import zlib

    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    trie = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            trie.setdefault(whole[:d], []).append(c)
            if d == len(whole):
                trie.setdefault(("end", whole), []).append(c)
    nodes = {k: v for k, v in trie.items() if not (k and k[0] == "end")}
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        own_bytes = len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[k] for k in kids.get(path, [])) or 1
        saved[path] = (len(nodes[path]) - 1) * own_bytes + sum(saved[k] for k in kids.get(path, []))
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
         sha(",".join(map(str, sorted(trie.get(("end", p), []))))))
        for p, m in nodes.items()
    )
