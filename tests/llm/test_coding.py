"""Vector codes, source divergence and piece encoding against plain versions."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from engram.llm import codes, divergence, pieces, queries

# ------------------------------------------------------------------ op11


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label). Loops over Python integers."""
    fine = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((r for r in fine if r[1] and len(r[1]) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not starts:
        return []
    dim = len(starts[0][1])
    fine, starts, w = [r for r in fine if len(r[1]) == dim], [r for r in starts if len(r[1]) == dim][:entries], dim // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(r[1])[p] for r in starts] for p in range(parts)]

    def assign(v):
        out = []
        for p, x in enumerate(cut(v)):
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        got = [assign(r[1]) for r in fine]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(r[1])[p] for r, g in zip(fine, got) if g[p][0] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    got = [assign(r[1]) for r in fine]
    errors = [sum(d for _, d in g) for g in got]
    total = collections.Counter()
    for r, e in zip(fine, errors):
        total[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for k, _ in g), e, total[r[2]], sha) for r, g, e in zip(fine, got, errors)]


def vectors(n=150, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 0.4, (n, dim)), 3)
    x[rng.random((n, dim)) < 0.3] = 0.125  # ties
    return [(int(i) * 3 % 211, x[i].tolist(), int(i) % 4 if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("case", ["mixed", "few", "none"])
def test_codes(spark, case):
    rows = vectors()
    rows += [rows[3], rows[3], (None, rows[5][1], 1), (None, rows[5][1], None), (1000, None, 1), (1001, [math.nan] * 32, 2), (1002, [math.inf] + [0.0] * 31, 2), (1003, [None] + [0.0] * 31, 2), (1004, [0.5] * 16, 3), (1005, [], 3), (-7, [1.0] * 5, 3)]
    rows = {"mixed": rows, "few": rows[:7], "none": [(1, None, 1), (2, [], 2), (3, [math.nan] * 32, 1)]}[case]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(4)
    as_float = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in rows]
    for args in ({}, {"entries": 6, "rounds": 3, "parts": 8}):
        got = [tuple(r) for r in codes.compress(df, **args).collect()]
        assert sorted(got, key=repr) == sorted(plain_codes(as_float, **args), key=repr)


def test_codes_one_group(spark):
    """One vector and one label on a third of the rows; empty tables; very large components."""
    rows = vectors(60, 32)
    hot = [(500 + k, rows[0][1], 9) for k in range(40)]
    df = spark.createDataFrame(rows + hot, "vec_id long, embedding array<float>, label int").repartition(6)
    got = {r.vec_id: r for r in codes.compress(df).collect()}
    assert len({(r.code, r.error) for k, r in got.items() if k >= 500}) == 1 and got[500].label_error == 40 * got[500].error
    assert codes.compress(df.limit(0)).count() == 0
    big = spark.createDataFrame([(1, [1e30] * 32, 1), (2, [-1e30] * 32, 1), (3, [0.0] * 32, 1)], df.schema)
    far = {r.vec_id: r.error for r in codes.compress(big, entries=1, rounds=0).collect()}
    most = codes.bound(32)
    assert far == {1: 0, 2: 32 * (2 * most) ** 2, 3: 32 * most**2} and far[2] < 1 << 63


def test_codes_decode(spark):
    df = spark.createDataFrame(vectors(40, 32), "vec_id long, embedding array<float>, label int")
    book = codes.codebooks(df, entries=4)
    out = codes.decode(codes.encode(df, book), book).collect()
    flat = {r.vec_id: [math.floor(256 * float(np.float32(c))) for c in r.embedding] for r in df.collect()}
    assert all(sum((a - b) ** 2 for a, b in zip(flat[r.vec_id], r.decoded)) == r.error for r in out) and len(out) == 40


# ------------------------------------------------------------------ op12


def plain_audit(rows, least, top=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    seen, n, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = term.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
        n.update((lang, source, w) for w in words)
        seen.update((lang, w) for w in set(words))
    kept = collections.defaultdict(list)
    for (lang, w), k in seen.items():
        if k >= least:
            kept[lang].append(w)
    share = lambda c, total, v: 1 + 1_000_000_000 * (c + 5) // (total + 5 * v)
    out = []
    for lang in {g[0] for g in groups}:
        words, own = kept[lang], sorted(s for g, s in groups if g == lang)
        p = {s: {w: share(n[lang, s, w], sum(n[lang, s, x] for x in words), len(words)) for w in words} for s in own}
        total = {w: sum(n[lang, s, w] for s in own) for w in words}
        q = {w: share(total[w], sum(total.values()), len(words)) for w in words}
        for s in own:
            parts = {"pair": [(sum(abs(p[s][w] - p[o][w]) for w in words), o) for o in own if o != s], "term": [(p[s][w] - q[w], w) for w in words if n[lang, s, w] and p[s][w] > q[w]]}
            for part, found in parts.items():
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(ranked if part == "pair" else ranked[:top])]
    return out


@pytest.mark.parametrize("least, chunk, held", [(2, 4 << 20, 4_000_000), (2, 64, 3), (30, 4 << 20, 4_000_000), (10_000, 4 << 20, 4_000_000)])
def test_divergence(spark, monkeypatch, least, chunk, held):
    rng = random.Random(least)
    words = ["".join(rng.choice("abCdéßZ字") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for k in range(240):
        source = rng.choice(["s0", "s0", "s1", "s2", "é", "z", None])
        text = " ".join(rng.choice(words[: 20 + 10 * (k % 5)]) + rng.choice(["", ".", "1x", "\n"]) for _ in range(rng.randint(0, 30)))
        rows.append((text, rng.choice(["en", "en", "fr", None]), source))
    rows += [(None, "en", "s9"), ("", "xx", "lone"), ("", "xx", "two"), ("!! 12", "yy", None), rows[0], rows[0], ("word " * 20000, "en", "s0"), (None, None, None)]
    df = spark.createDataFrame([(*r, 7, 3, "q") for r in rows], "text string, lang string, source string, n int, docs int, term string").repartition(5)
    if chunk < 1000:  # bounds of a task: seen by a local worker through the function's own globals
        monkeypatch.setattr(divergence, "BUCKET_ROWS", 20)
    got = sorted(map(tuple, divergence.audit(df, min_docs=least).collect()))
    assert got == sorted(plain_audit(rows, least))
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_blocks():
    """Pairs are tallied in blocks without a change of the result."""
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted({(rng.choice("ab"), f"t{rng.randrange(30)}", f"s{rng.randrange(9)}") for _ in range(300)})
    table = pa.table({"lang": [r[0] for r in rows], "source": [r[2] for r in rows], "term": [r[1] for r in rows], "n": [rng.randint(1, 3) for _ in rows]})

    def total(held):
        old, divergence.PAIRS = divergence.PAIRS, held
        try:
            out = collections.Counter()
            for r in divergence._tally(table).to_pylist():
                out[r["lang"], r["a"], r["b"], r["ca"], r["cb"]] += r["terms"]
            return out
        finally:
            divergence.PAIRS = old

    assert total(7) == total(1) == total(10**6) and all(a < b for _, a, b, _, _ in total(7))


# ------------------------------------------------------------------ op13

POOL = [" ", "  ", "▁", "a", "the", "☃", "\n", "\t", "é", "<s>", "<unk>", "<0x41>", "\0", "💥", "字", "１", "ﬁ", "　", "�", "ﷺ", "é", "Å", "ing", ".\n"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["", " ", *("".join(rng.choice(POOL) for _ in range(rng.randint(0, 30))) for _ in range(n))]


def test_pieces(spark, rows, docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = pieces.codec_from(path), sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def want(i, t):
        found = library.encode(t or "", return_type="proto")
        ids = [p.id for p in found.pieces]
        spans = np.array([(p.begin, p.end) for p in found.pieces], "<u4").tobytes()
        return (i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids).encode()), sha(spans))

    extra = [(5000 + k, t, "en", 1, "x") for k, t in enumerate([*odd_texts(300), "x" * 30_000, "ab " * 40_000, "\n" * 3000, "字" * 500])]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    assert sorted(map(tuple, pieces.digests(df, codec).collect()), key=repr) == sorted((want(r[0], r[1]) for r in [*rows, *extra]), key=repr)
    clash = df.withColumns({"token_ids": F.lit(1), "decoded": F.lit("d"), "token_ends": F.lit("e")})
    coded = pieces.encode_documents(clash, codec)
    back = pieces.decode_ids(coded, codec).collect()
    assert all(r.decoded == library.decode(library.encode(r.text or "")) for r in back)
    for r in back:
        raw = (r.text or "").encode()
        assert r.token_starts == sorted(r.token_starts) and (not raw or r.token_ends[-1] == len(raw))
        assert b"".join(raw[a:b] for a, b in zip(r.token_starts, r.token_ends)) == raw  # every byte is under one piece
    assert pieces.digests(empty, codec).count() == pieces.encode_documents(empty, codec).count() == 0


def test_pieces_decode_any_ids():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library, rng = pieces.codec_from(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3), rng.randrange(3, 259), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids)


def test_pieces_without_heap():
    """Both ways to merge a part give the same pieces."""
    codec, rng = pieces.codec_from(public_tokenizers.path("piece_bpe_32k.model")), random.Random(2)
    words = ["▁" + "".join(rng.choice("etaoinshrdlu.,é▁") for _ in range(rng.randint(0, 39))) for _ in range(400)]
    short = [codec.merge(w) for w in words]
    codec.simple = False
    assert short == [codec.merge(w) for w in words]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_character_map(rule):
    """Compiled maps as the library has them, with all its settings of white space."""
    for k in range(8):
        flags = {"add_dummy_prefix": bool(k & 1), "escape_whitespaces": bool(k & 2), "remove_extra_whitespaces": bool(k & 4)}
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
        codec = pieces.Codec(library.serialized_model_proto())
        for t in odd_texts(150, seed=k):
            text, places = codec.normalize(t)
            assert text == library.normalize(t)
            assert len(places) == len(text.encode()) + 1 and (np.diff(places) >= 0).all() and places[-1] <= len(t.encode())


def _message(*fields) -> bytes:
    """A protobuf message of (number, value): bytes, int or float."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for k, v in fields:
        out += varint(k << 3 | (2 if isinstance(v, bytes) else 5 if isinstance(v, float) else 0))
        out += varint(len(v)) + v if isinstance(v, bytes) else struct.pack("<f", v) if isinstance(v, float) else varint(v)
    return out


def test_pieces_other_models():
    """User symbols, unused pieces, a character map with contractions, and no byte pieces."""
    rng = random.Random(6)
    charmap = pieces.Model(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).charmap
    words = ["a", "b", "c", "e", "▁", "ab", "bc", "abc", "▁a", "▁ab", "▁abc", "ee", "é", "1", "b▁", "cc"]
    own = [(w.encode(), float(-k % 5), 1) for k, w in enumerate(words)] + [(b"aa", 3.0, 5), (b"aaa", 3.5, 1), (b"XY", 0.0, 4), (b"XYZ", 0.0, 4)]
    for mapped in (b"", charmap):
        for squeeze in (0, 1):
            raw = _message((1, _message((1, b"<unk>"), (2, 0.0), (3, 2))), (1, _message((1, b"<s>"), (2, 0.0), (3, 3))), *((1, _message((1, w), (2, s), (3, k))) for w, s, k in own), (2, _message((3, 2), (35, 0))), (3, _message((1, b"own"), (2, mapped), (3, 1), (4, squeeze), (5, 1))))
            codec, library = pieces.Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
            for _ in range(400):
                t = "".join(rng.choice(["a", "aa", "b", "c", " ", "  ", "XY", "XYZ", "é", "é", "１", "?", "☃", "\t"]) for _ in range(rng.randint(0, 14)))
                found = library.encode(t, return_type="proto")
                ids, start, end = codec.encode(t)
                assert ids.tolist() == [p.id for p in found.pieces], t
                assert list(zip(start.tolist(), end.tolist())) == [(p.begin, p.end) for p in found.pieces], t
                assert codec.decode(ids.tolist()) == library.decode(ids.tolist()), t


def test_queries_have_sql():
    assert {"op11_vector_codes", "op12_source_divergence"} <= set(queries.oracle_sql())
