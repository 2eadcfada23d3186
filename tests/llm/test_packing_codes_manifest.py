"""Packing, vector codes and manifests on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fieldglass.llm import manifest as m
from fieldglass.llm import packing as p
from fieldglass.llm import vector_codes as v
from fieldglass.llm.word_codec import WordCodec

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, start string, part string, doc string, name string, x int"
ODD = [
    None, "", " \n", "It's don't 'tis \"'s x", "A<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "Straße ÉCOLE é H̱ İ ΑΣ x y", "a\x00 a a\x1cb",
    "1234 5.6,7 cAÉ12Ö", "x" * 5000 + " " + "é" * 300, "... ,, !?\n\n", "漢字 かな　q", "a\u0085b", "ÀÉÎ×÷ßŸÞþÿ Á ¿Qué?", "I'LL 'LL", "One. Two! Three?\nFour", "w " * 9000,
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, ("en", "de", None)[i % 3], "s", len(t or ""), 1, "x", "p", "d", "n", 2) for i, t in enumerate(texts)], DOCS)


def tokenizer():
    from fieldglass.llm.queries import word_tokenizer

    return word_tokenizer()


def test_word_codec_is_the_library():
    library = tokenizers.Tokenizer.from_file(tokenizer())
    rng = random.Random(5)
    signs = list("abcXYZ éÉß×'<|>.,!?0189\n\t́ Σ漢") + ["<|endoftext|>", "'s", "word ", "Word, "]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    codec = WordCodec(tokenizer())
    for _ in range(2):  # the second time from what is remembered
        for t, (ids, ends) in zip(texts, codec.documents([t.encode() for t in texts])):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
            assert not len(ends) or ends[-1] <= len(ids)


def test_word_codec_of_long_texts_small_memory_and_other_tokenizers(monkeypatch):
    import public_tokenizers

    from fieldglass.llm import word_codec

    library = tokenizers.Tokenizer.from_file(tokenizer())
    monkeypatch.setattr(word_codec, "PIECE", 50)
    monkeypatch.setattr(word_codec, "REMEMBERED", 64)
    codec = WordCodec(tokenizer())
    text = " ".join(f"word{i} é{i % 7}." for i in range(400)) + "y" * 300
    for t in (text, "short one", text[::-1]):
        assert codec.documents([t.encode()])[0][0].tolist() == library.encode(t, add_special_tokens=False).ids
    other = WordCodec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word
    found = other.documents([b"One two.  Three\nfour", b""])
    assert found[0][0].tolist() == other.tokenizer.encode("One two.  Three\nfour", add_special_tokens=False).ids and not len(found[1][0])


def least_cost(place, cost, size):
    best = [0] + [10**9] * (len(place) - 1)
    for j in range(1, len(place)):
        for i in range(j):
            if place[j] - place[i] <= size:
                best[j] = min(best[j], best[i] + p.padding(int(place[j] - place[i]), size) + cost[j])
    return best[-1]


def test_cuts_are_the_best():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.choice([7, 10, 16, 32])
        place = np.concatenate([[0], np.cumsum([rng.randint(1, min(size, rng.choice([2, 5, 9, size]))) for _ in range(rng.randint(1, 40))])])
        cost = np.array([0] + [rng.choice([0, 1, 4]) for _ in place[1:]])
        ends = p.best_cuts(place, cost, size)
        due = dict(zip(place.tolist(), cost.tolist()))
        windows = np.diff(np.concatenate([[0], ends]))
        assert ends[-1] == place[-1] and windows.max() <= size
        assert sum(p.padding(int(w), size) for w in windows) + sum(due[int(e)] for e in ends) == least_cost(place, cost, size)


def check_packing(rows, texts, size, library):
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_window.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return [sum(r["length"] for r in x) for x in by_window.values()]


def test_packing(spark, monkeypatch):
    library = tokenizers.Tokenizer.from_file(tokenizer())
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta.", "gamma,", "delta!\n"]) for _ in range(rng.randint(1, 400))) for _ in range(150)]
    for size in (4096, 64):
        windows = check_packing(p.pack(docs(spark, texts).repartition(3), tokenizer(), size=size).collect(), texts, size, library)
        assert sum(p.padding(w, size) for w in windows) < 0.05 * sum(windows)
    assert p.pack(docs(spark, []), tokenizer()).count() == 0
    twice = docs(spark, ["a b", None]).unionByName(docs(spark, ["a b", None]))
    assert sorted((r["doc_id"], r["length"]) for r in p.pack(twice, tokenizer()).collect()) == [(0, 3), (0, 3), (1, 1), (1, 1)]
    assert p.pack(docs(spark, ["a"]).selectExpr("CAST(NULL AS string) AS doc_id", "text"), tokenizer()).first()["doc_id"] is None


def test_packing_a_task_is_the_best(spark):
    """One task's windows cost as little as the brute-force search over the same boundaries."""
    packer = p.Packer(32, 2, 3, 9)
    rng = random.Random(3)
    place, cost = [0], [0]
    for i in range(12):
        n = rng.randint(1, 30)
        cuts = sorted({rng.randint(0, n) for _ in range(4)})
        packer.add(i, np.arange(n), np.array(cuts))
        for c in cuts:
            if 0 < c < n:
                place.append(place[0] + c + (packer.docs[-1][1]))
                cost.append(3)
        place.append(packer.held)
        cost.append(0)
    windows = {}
    ends = dict(zip(place, cost))
    for _, _, length, _, _, w, offset in packer.take(True):
        windows[w] = max(windows.get(w, 0), offset + length)
    at = spent = 0
    for w in sorted(windows):
        at += windows[w]
        spent += p.padding(windows[w], 32) + ends[at]
    assert spent == least_cost(np.array(place), cost, 32)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [int(np.floor(c * 4096)) if abs(c) < 2**50 else int(c) * 4096 for c in x]) for i, label, x in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    kept.sort(key=lambda r: r[0])
    step = len(kept[0][2]) // parts
    cut = lambda x: [x[k * step : (k + 1) * step] for k in range(parts)]
    books = [[cut(r[2])[k] for r in kept[:entries]] for k in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            mine = {}
            for r in kept:
                mine.setdefault(near(cut(r[2])[k], books[k])[1], []).append(cut(r[2])[k])
            for e, own in mine.items():
                books[k][e] = [sum(c) // len(own) for c in zip(*own)]
    out = {}
    for i, label, x in kept:
        found = [near(part, books[k]) for k, part in enumerate(cut(x))]
        out[i] = ("".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), 2**63 - 1), label)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {i: (c, e, min(sum(x[1] for x in out.values() if x[2] == label), 2**63 - 1), digest) for i, (c, e, label) in out.items()}


@pytest.mark.parametrize("scale", [1.0, 3e5, 1e30])
def test_vector_codes(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(i, (None, 1, 1, 2)[i % 4], [float(c) * scale for c in rng.normal(size=16)]) for i in range(60)]
    rows += [(100, 1, None), (101, 1, [None] * 16), (102, 2, [float("nan")] * 16), (103, 2, [float("inf")] * 16), (104, None, []), (60, 3, rows[5][2]), (61, 3, rows[5][2])]
    frame = spark.createDataFrame([(*r, "code", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, dim int")
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in v.compress(frame.repartition(3)).collect()}
    assert got == brute_codes(rows)


def test_vector_codes_odd_tables(spark):
    kind = "vec_id long, label int, embedding array<double>"
    make = lambda rows: v.compress(spark.createDataFrame(rows, kind)).collect()
    assert make([]) == [] and make([(1, 1, None)]) == []
    few = make([(2, None, [1.0] * 10), (1, None, [0.5] * 10), (None, 5, [1.0] * 10), (3, 5, [1.0] * 9), (1, None, [0.5] * 10)])
    assert sorted((r["vec_id"] or 0, r["error"]) for r in few) == [(0, 0), (1, 0), (1, 0), (2, 0)]  # another length takes no part; filled up to 16
    many = make([(i, i % 3000, [float(i % 5)] * 8) for i in range(6000)])
    assert len(many) == 6000 and {r["label_error"] for r in many} == {0}


def test_partial_distances_are_the_nearest():
    rng = np.random.default_rng(6)
    for _ in range(30):
        part, book = rng.integers(-4, 5, (50, 3)), rng.integers(-4, 5, (rng.integers(1, 9), 3))
        full = ((part[:, None] - book[None]) ** 2).sum(axis=2)
        for hint in (None, rng.integers(0, len(book), 50)):
            at, best = v.nearest(part, book, hint)
            assert (at == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, i, fanout):
    for level in levels[:-1]:
        a = i - i % fanout
        yield level[a:i], level[i + 1 : a + fanout]
        i //= fanout


def brute_manifest(rows, fanout):
    field = lambda f: "-" if f is None else f"{len(str(f).encode())}:{f}"
    leaf = lambda r, extra=0: h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"] if r["n_chars"] is None else r["n_chars"] + extra, r["text"])))
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        built[name] = brute_tree([leaf(r) for r in trees[name]], fanout)
    top = brute_tree([built[n][-1][0] for n in names], fanout)
    out = []
    for t, name in enumerate(names):
        for i, r in enumerate(trees[name]):
            way = [*siblings(built[name], i, fanout), *siblings(top, t, fanout)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = leaf(r, int(hit))
            for left, right in way:
                folded = h(*left, folded, *right)
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), built[name][-1][0], root, h(*[s for a, b in way for s in a + b]), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("fanout", "parts"), [(2, 1), (2, 5), (3, 4), (5, 3)])
def test_manifest(spark, monkeypatch, fanout, parts):
    rows = [(i, f"text {i} é", ("en", "en", "en", None, "de", "", "zz")[i % 7] if i < 90 else "en", None if i % 5 == 0 else "s", None if i % 11 == 0 else i) for i in range(230)]
    rows += [(None, None, None, None, None), (None, "x", "en", None, 5), (7, "same", "en", "s", 1), (7, "same", "en", "s", 1), (8, "", "only", "s", 0), (9, "long " * 20_000, "en", "s", 9)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, part int, at int")
    monkeypatch.setattr(m, "LEAST_LEAVES", max(1, len(rows) // parts))
    monkeypatch.setattr(m, "MERGED", 2)
    got = sorted((tuple(r) for r in m.manifest(frame, fanout=fanout).collect()), key=str)
    assert got == brute_manifest(frame.collect(), fanout)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    frame = docs(spark, ["alone"])
    assert [tuple(r) for r in m.manifest(frame).collect()] == brute_manifest(frame.collect(), 2)
    assert m.manifest(frame.limit(0)).count() == 0


def test_mountain_range_is_the_tree():
    rng = random.Random(9)
    for _ in range(60):
        n, fanout = rng.randint(1, 60), rng.choice([2, 3, 4])
        leaves = [h(str(i)) for i in range(n)]
        levels = brute_tree(leaves, fanout)
        edge = sorted({0, n, *(rng.randint(0, n) for _ in range(4))})
        ranges = []
        for a, b in zip(edge, edge[1:]):
            r = m.MountainRange(n, fanout)
            for i in range(a, b):
                r.push(0, i, leaves[i].encode())
            ranges.append(r)
        whole = m.MountainRange(n, fanout)
        for r in ranges:
            for level, i, digest in r.stack:
                assert levels[level][i] == digest.decode()
                whole.push(level, i, digest)
        assert [x[2].decode() for x in whole.stack] == [levels[-1][0]]
