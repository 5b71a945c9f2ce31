"""Line dedup, Jaccard join and suffix dedup against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from engram.llm import jaccard, linededup, suffixdedup
from engram.llm.components import components

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def test_patience():
    assert linededup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert linededup.patience([1, 1, 2], [1, 2]) == [(0, 0), (2, 1)]
    assert linededup.patience([], [1]) == []
    assert linededup.removed_lines([(0, 1, 50), (1, 2, 50)], [(3, 1, 50), (4, 2, 50), (9, 7, 5)]) == [3, 4]
    assert linededup.removed_lines([(0, 1, 5)], [(3, 1, 5)]) == []


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            t[i + 1][k + 1] = t[i][k] + 1 if x == y else max(t[i][k + 1], t[i + 1][k])
    return t[-1][-1]


def test_gap_without_unique_lines():
    a, b = [1, 2, 1, 2], [8, 1, 2, 9]
    lines = lambda v, c=25: [(n, h, c) for n, h in enumerate(v)]
    assert linededup.removed_lines(lines(a), lines(b)) == [1, 2]
    # the copy whose lines are adjacent, at the edge of the gap and beside an anchor
    assert linededup.removed_lines(lines([1, 7, 1, 2, 1, 2, 5]), lines([1, 2, 5])) == [0, 1, 2]
    assert linededup.removed_lines(lines([1, 2, 7, 2]), lines([8, 1, 2])) == [1, 2]
    rng = random.Random(3)
    for _ in range(400):
        # every line at least twice in a: no anchors
        a = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        a = rng.sample(a + a, 2 * len(a))
        b = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        got = linededup.patience(a, b, list(range(len(a))), list(range(len(b))))
        assert all(a[i] == b[k] for i, k in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))
        assert len(got) == plain_lcs(a, b)


def test_line_dedup(docs, rows):
    keyed = {}
    for i, t, *_ in rows:
        if t is not None:
            keyed[(1 << 63) - 1 if i is None else i, t] = [x.strip(BLANK) for x in t.split("\n")]
    # rows of one id and text are one document; ids are distinct otherwise here
    order = sorted(keyed)
    owner, holders = {}, {}
    for k in order:
        for x in keyed[k]:
            if x:
                owner.setdefault(x, k)
                holders.setdefault(x, set()).add(k)

    def shared(k):
        full = [x for x in keyed[k] if x]
        return [(n, hash(x), len(x)) for n, x in enumerate(full) if len(holders[x]) > 1]

    want = {}
    for k in order:
        cut = set()
        for a in {owner[x] for x in keyed[k] if x} - {k}:
            cut |= set(linededup.removed_lines(shared(a), shared(k)))
        left, n = [], 0
        for raw, x in zip(k[1].split("\n"), keyed[k]):
            if not x or n not in cut:
                left.append(raw)
            n += bool(x)
        want[k] = (n, len(cut), hashlib.sha256("\n".join(left).encode()).hexdigest())
    got = linededup.report(docs).collect()
    assert len(got) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    plain = sorted(((i, *want[(1 << 63) - 1 if i is None else i, t]) if t is not None else (i, 0, 0, empty) for i, t, *_ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == plain
    kept = linededup.dedup(docs)
    assert kept.columns == docs.columns
    assert kept.where("text is null").count() == 2


def test_line_dedup_meets_every_block(spark):
    x, y, z = "first short line of thirty chars", "second short one of thirty chars", "a third short one of thirty char"
    long, other = "a long line of more than forty characters, shared", "another line of more than forty characters, shared"
    texts = [
        # lines whose first holders differ, in one block of two later documents
        x, y, f"q1\n{x}\n{y}\nq2", f"q3\n{x}\n{y}\nq4",
        # moved blocks: the third document has the order of the second
        f"{long}\nq5\n{other}", f"{other}\nq6\n{long}", f"{other}\nq7\n{long}",
        # a short line behind a long one that a document before has alone
        f"q8\n{z}{z}\nq9", f"{z}{z}\nend\nq10", f"q11\n{z}{z}\nend", "end",
    ]
    got = {r.doc_id: r.n_removed for r in linededup.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # all pairs, each aligned
    lines = [[(n, hash(v), len(v)) for n, v in enumerate(t.split("\n"))] for t in texts]
    want = {k: len({n for e in range(k) for n in linededup.removed_lines(lines[e], lines[k])}) for k in range(len(texts))}
    assert want == {0: 0, 1: 0, 2: 0, 3: 2, 4: 0, 5: 1, 6: 2, 7: 0, 8: 1, 9: 2, 10: 0}
    assert got == want


def plain_blocks(a, b, least):
    """Numbers of b's lines in common blocks with a: patience diff by recursion, gaps without
    unique lines by the longest common subsequence. Lines are strings, none blank."""

    def rising(pairs):
        best = []
        for n, (x, y) in enumerate(pairs):
            best.append(max((best[k] for k in range(n) if pairs[k][0] < x), key=len, default=[]) + [(x, y)])
        return max(best, key=len, default=[])

    def lcs(i, j, k, m):
        t = {(x, y): [] for x in range(i, j + 1) for y in range(k, m + 1)}
        for x in range(i, j):
            for y in range(k, m):
                t[x + 1, y + 1] = t[x, y] + [(x, y)] if a[x] == b[y] else max(t[x, y + 1], t[x + 1, y], key=len)
        return t[j, m]

    def go(i, j, k, m):
        if i >= j or k >= m:
            return []
        if a[i:j] == b[k:m]:
            return list(zip(range(i, j), range(k, m)))
        own = [(a[i:j].index(v) + i, y) for y, v in enumerate(b[k:m], k) if a[i:j].count(v) == 1 and b[k:m].count(v) == 1]
        anchors = rising(own)
        if not anchors:
            return lcs(i, j, k, m)
        out, x, y = [], i, k
        for u, v in [*anchors, (j, m)]:
            out += go(x, u, y, v)
            if u < j:
                out.append((u, v))
            x, y = u + 1, v + 1
        return out

    cut, block = set(), []
    for pair in [*go(0, len(a), 0, len(b)), None]:
        if pair and block and pair == (block[-1][0] + 1, block[-1][1] + 1):
            block.append(pair)
            continue
        if sum(len(b[y]) for _, y in block) >= least:
            cut |= {y for _, y in block}
        block = [pair] if pair else []
    return cut


def test_line_dedup_like_all_pairs(spark):
    """Many short shared lines: every document against every earlier one."""
    rng = random.Random(11)
    name = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "."
    for shape in range(3):
        blocks = [[name(rng.randint(6, 30)) for _ in range(rng.randint(1, 5))] for _ in range(14)]
        texts = []
        for _ in range(50):
            lines = []
            # blocks keep their order, so that no two alignments are equally good
            for n in sorted(rng.sample(range(len(blocks)), rng.randint(1, 5))):
                lines += [name(20) for _ in range(rng.randint(0, 2) * min(shape, 1))] + blocks[n] + [name(20)] * (shape == 2)
            texts.append(lines)
        texts += [list(rng.choice(texts)) for _ in range(6)]
        got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in linededup.report(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
        total = 0
        for i, t in enumerate(texts):
            cut = set().union(*[plain_blocks(texts[e], t, linededup.MIN_CHARS) for e in range(i)])
            total += len(cut)
            assert got[i] == (len(cut), hashlib.sha256("\n".join(v for y, v in enumerate(t) if y not in cut).encode()).hexdigest()), (shape, i)
        assert total > 100


def test_line_dedup_shares(spark, monkeypatch):
    """Pairs of one earlier document in several shares, and long documents."""
    head = [f"line {i} of a long licence text" for i in range(30_000)]
    rows = [(0, "\n".join(head))] + [(i, f"own {i}\n\n" + "\n".join(head[i * 3 : i * 3 + 3]) + "\nend") for i in range(1, 41)] + [(99, "\n".join(["x", *head]))]
    monkeypatch.setattr(linededup, "SHARE", 7)
    got = {r.doc_id: r.n_removed for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 99: 30_000} | {i: 3 + (i > 1) for i in range(1, 41)} or got == {0: 0, 99: 30_000} | dict.fromkeys(range(1, 41), 3)


def test_line_dedup_clashing_names(spark):
    names = ["doc", "th", "cut", "parts", "row", "lines", "kept", "n_cut", "share", "first_doc", "h"]
    df = spark.createDataFrame([(1, "a line of more than forty characters is here", *names), (2, "a line of more than forty characters is here\nand", *names)], ["doc_id", "text", *names])
    got = linededup.dedup(df)
    assert got.columns == df.columns and [r.text for r in got.orderBy("doc_id").collect()][1] == "and"
    assert got.where(" and ".join(f"`{n}` = '{n}'" for n in names)).count() == 2


def jaccard_components(rows):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets.setdefault(i, s)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_join(docs, rows):
    want = jaccard_components(rows)
    got = jaccard.report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert sorted({r.doc_id for r in jaccard.dedup(docs).collect() if r.doc_id is not None}) == sorted(i for i, (_, c) in want.items() if c == i)


def test_jaccard_large_family(spark):
    """A family beyond the frequent-run bound, with members that only link through others."""
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(df).collect()} == want


def test_jaccard_buckets_of_a_band():
    """A set's signatures go to the buckets of its band, with its fingerprint once for 255 of them."""
    rng = np.random.default_rng(1)
    big = np.unique(rng.integers(1, 1 << 63, 6000, dtype=np.uint64))
    near = np.unique(np.append(big[:-50], rng.integers(1, 1 << 63, 50, dtype=np.uint64)))
    small = np.unique(rng.integers(1, 1 << 63, 100, dtype=np.uint64))
    share = np.ones(len(jaccard.HI), np.int64)
    share[np.searchsorted(jaccard.HI, 100)] = 5
    sender = jaccard.Sender(share)
    sender.add(np.arange(3), np.zeros(3, bool), [big, near, small])
    rows = pa.Table.from_batches(list(sender.batches())).to_pylist()
    first = np.cumsum(share) - share
    pairs = set()
    for r in rows:
        e = np.frombuffer(r["entries"], jaccard._ENTRY)
        assert len(r["sigs"]) == 5 * int(e["count"].astype(int).sum())
        assert all(first[b] <= r["bucket"] < first[b] + share[b] for b in e["band"])
    for k in {r["bucket"] for r in rows if r["entries"]}:
        found = jaccard.meet(pa.Table.from_pylist([r for r in rows if r["bucket"] == k]))
        pairs |= {(x["na"], x["nb"]) for x in found.to_pylist() if x["kind"] == 1}
    assert pairs and pairs <= {(len(big), len(near)), (len(near), len(big))}
    assert max(np.frombuffer(r["entries"], jaccard._ENTRY)["count"].max() for r in rows if r["entries"]) == 255


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[9] == 7


def suffix_plain(rows):
    out, seen = [], {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            seen.setdefault(raw[p : p + 50], i)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        cut = bytearray(len(raw))
        for p in range(len(raw) - 49):
            first = seen[raw[p : p + 50]]
            if first is not None and (i is None or first < i):
                cut[p : p + 50] = b"\x01" * 50
        left = bytes(b for b, c in zip(raw, cut) if not c)
        spans = sum(1 for k in range(len(raw)) if cut[k] and (k == 0 or not cut[k - 1]))
        out.append((i, len(raw), sum(cut), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup(docs, rows):
    assert sorted(map(tuple, suffixdedup.report(docs).collect()), key=str) == suffix_plain(rows)
    cut = suffixdedup.dedup(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_suffix_many_rows_of_one_id(spark):
    """A thousand rows without an id and some of one id: none gets another's ranges."""
    import random

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    common = word(120)
    rows = [(1, common)]
    rows += [(None, word(180) if k % 2 else common + word(60)) for k in range(1000)]
    rows += [(7, word(90) + (common if k % 3 == 0 else "")) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, suffixdedup.report(df).collect()), key=str) == suffix_plain(rows)


def test_suffix_slices_of_a_bucket(monkeypatch):
    """A bucket worked off in slices shows what it shows in one."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n = 4000
    docs = np.zeros(80, suffixdedup._ENTRY)
    docs["doc"], docs["th"], docs["count"] = rng.permutation(80) // 2, np.arange(80), n // 80
    found = np.zeros(n, suffixdedup._ANCHOR)
    found["part"], found["ctx"] = rng.integers(0, 700, n), rng.integers(0, 3, n)
    found["at"], found["left"], found["right"] = rng.integers(50, 9000, n), 30, 50
    table = pa.table({"bucket": pa.array([1], pa.int32()), "docs": pa.array([docs.tobytes()], pa.binary()), "anchors": pa.array([found.tobytes()], pa.binary())})

    def shown(size, homes=5):
        monkeypatch.setattr(suffixdedup, "SLICE", size)
        cut = lambda raw, width: sorted(raw[i : i + width] for i in range(0, len(raw), width)) if raw else raw
        return sorted((r["doc"], r["th"], cut(r["covered"], 8), cut(r["open"], suffixdedup._OPEN.itemsize)) for r in suffixdedup.gather(pa.concat_tables([suffixdedup.meet(table, homes)])).to_pylist())

    whole = shown(10**9)
    assert len(whole) == len({r[:2] for r in whole}) > 50 and whole == shown(300) == shown(7) == shown(300, 1)


def test_frames_of_any_origin(spark, rows):
    """A join and a union with local rows, whose size the optimizer can't know."""
    few = [r[:2] for r in rows[:50]]
    local = spark.createDataFrame(few, "doc_id long, text string")
    other = spark.createDataFrame([(i,) for i in sorted({r[0] for r in few})], "doc_id long")
    for df in (local.join(other, "doc_id"), local.limit(20).union(local.subtract(local.limit(20)))):
        own = [tuple(r) for r in df.collect()]
        assert sorted(map(tuple, suffixdedup.report(df).collect()), key=str) == suffix_plain(own)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.report(df).collect()} == jaccard_components(own)


def test_suffix_clashing_columns(docs, rows):
    clash = docs.withColumnsRenamed({"lang": "doc", "n": "th", "fp": "covered"})
    cut = suffixdedup.dedup(clash)
    assert cut.columns == clash.columns and cut.count() == len(rows)


def test_index_family_levels():
    import numpy as np

    f = suffixdedup.IndexFamily(4)
    for d in range(9):
        f.add([b"abcdef", bytes([65 + d]) * 4], np.array([d, d]))
    assert len(f.levels) <= 4
    who, place = f.add([b"xabcdz", b"BBBB", b"newer"], np.array([9, 9, 9]))
    assert sorted(zip(who.tolist(), place.tolist())) == [(0, 1), (1, 0)]


def test_empty_tables(empty):
    assert linededup.report(empty).count() == 0
    assert jaccard.report(empty).count() == 0
    assert suffixdedup.report(empty).count() == 0
