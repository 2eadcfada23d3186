"""Duplicates, mixing, language, tokens and language-model scores on small tables."""

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from fieldglass.llm.exact_dedup import exact_dedup, sha256_hex
from fieldglass.llm.language_id import identify_language
from fieldglass.llm.lm_scoring import backoff_scores
from fieldglass.llm.mixing import mix, rake
from fieldglass.llm.near_dup import near_duplicates
from fieldglass.llm.sentencepiece_codec import CharacterMap, PieceCodec, encode_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, id int, digest string"


def docs(spark, texts, langs=None):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", 1, "x", "y", 1, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


PROSE = [" ".join(f"w{(i * 7 + k * (1 + i % 3)) % 50}" for k in range(40 + i)) for i in range(6)]
TEXTS = [
    "a  b\tc", "a b c", None, "", " ", "a b c", "A b c", "one two", "One  TWO", *PROSE, PROSE[0] + " tail", PROSE[0].replace("w7 ", "zz ", 1),
    "x" * 5000, " ".join(["rep"] * 3000), "é à ü", "é à ü", "12 34", "\n\n", PROSE[1] + " " + PROSE[2], PROSE[1] + " " + PROSE[2] + " end",
]


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def test_exact_dedup(spark):
    for digest in (sha256_hex, lambda t: t.substr(1, 1)):  # the second puts many texts under one digest
        got = {r["doc_id"]: r for r in exact_dedup(docs(spark, TEXTS), digest=digest).collect()}
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
        for i, t in enumerate(norm):
            same = [j for j, u in enumerate(norm) if u == t]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(same), len(same), i == min(same)), (i, got[i])
            if digest is sha256_hex:
                assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert len(got) == len(TEXTS)


def test_exact_dedup_hot_and_null_ids(spark):
    rows = [(i, "same text") for i in range(3000)] + [(None, "same text"), (None, "alone"), (7, "same text")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot_groups=2).collect()
    assert len(got) == 3003
    assert {r["group_size"] for r in got if r["keep_id"] == 0} == {3002}
    assert sum(r["kept"] for r in got) == 2
    assert exact_dedup(docs(spark, [])).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    texts = list(TEXTS)
    base = [f"v{k}" for k in range(300)]
    for _ in range(60):  # a group whose members differ from the base by up to a few words each
        t = list(base)
        for k in rng.integers(0, 300, rng.integers(1, 9)):
            t[k] = f"n{rng.integers(10**6)}"
        texts.append(" ".join(t))
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark, texts)).collect()}
    want = brute_components(texts)
    assert len(got) == len(texts)
    for i, (n, c) in enumerate(want):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), (i, texts[i], got[i], (n, c))
    assert near_duplicates(docs(spark, [])).count() == 0
    assert [r["kept"] for r in near_duplicates(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()] == [False]


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    import fieldglass.llm.near_dup as nd

    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = np.random.default_rng(5)
    base = [f"v{k}" for k in range(120)]
    texts = []
    for _ in range(50):
        t = list(base)
        for k in rng.integers(0, 120, rng.integers(1, 7)):
            t[k] = f"n{rng.integers(10**6)}"
        texts.append(" ".join(t))
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts)]


def test_language(spark):
    en, fr = "the cat and the dog were there with that thing", "le chat et la souris étaient là avec cette chose"
    texts = [(en if i % 2 else fr) + f" {i}" for i in range(40)] + [None, "", "123 !!", en * 3000]
    langs = {i: ("en" if i % 2 else "fr") for i in range(40)} | {i: None for i in range(40, 44)}
    got = {r["doc_id"]: r for r in identify_language(docs(spark, texts, langs)).collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in range(40))
    assert [got[i]["lang_pred"] for i in (40, 41, 42, 43)] == ["und", "und", "und", "en"]
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert identify_language(docs(spark, [])).count() == 0
    assert identify_language(docs(spark, ["abc"], {0: None})).first()["lang_pred"] == "und"


def test_mixing_meets_marginals(spark):
    rows = [(i, "w " * (1 + i % 5), ["en", "de", None][i % 3], ["a", "b"][i % 7 == 0], i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mark int")
    from pyspark.sql import functions as F

    targets = {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "category string, share double"),
        "lang": spark.createDataFrame([("en", 0.5), ("de", 0.3), ("(none)", 0.2)], "category string, share double"),
    }
    got = mix(df, topic=F.col("mark").cast("string"), targets=targets, rate=0.25).collect()
    mass = sum(r["n_tokens"] for r in got)
    for column, want in (("source", {"a": 0.5, "b": 0.5}), ("lang", {"en": 0.5, "de": 0.3, "(none)": 0.2})):
        for k, share in want.items():
            assert abs(sum(r["n_tokens"] * r["weight"] for r in got if r[column] == k) / mass - share) < 1e-3
    expected = sum(r["n_tokens"] * r["probability"] for r in got)
    assert abs(expected / mass - 0.25) < 1e-3
    assert abs(sum(r["n_tokens"] for r in got if r["kept"]) / mass - 0.25) < 0.05
    assert mix(docs(spark, [])).count() == 0
    assert mix(docs(spark, [None, "", "a b"])).count() == 3


def model():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    raw = model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    odd = ["", " ", "  ", " a", "a ", "a  b   c", "\n", "▁", "a▁b ▁", "<s> hi </s>", "<0x41>", "日本語 x", "😀 é", "\x00a", "hello  world  ", "x" * 3000]
    texts = odd + [t for t in TEXTS if t is not None] + [None]
    import public_tokenizers

    got = {r["doc_id"]: r for r in encode_documents(docs(spark, texts), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        ids = sp.encode(t)
        r = got[i]
        assert r["ids"] == ",".join(map(str, ids)) and r["n_tokens"] == len(ids)
        assert r["decoded"] == sp.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(r["ids"].encode()).hexdigest()
        data = t.encode()
        if ids:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(data) and r["starts"][1:] == r["ends"][:-1]
        for start, end, piece in zip(r["starts"], r["ends"], sp.id_to_piece(ids)):
            if not piece.startswith("<0x") and "▁" not in t:
                assert data[start:end].decode().strip(" ") == piece.strip("▁")
    assert encode_documents(docs(spark, []), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_language_scores_are_the_counts(spark):
    """Predictions and scores against naive Bayes worked out n-gram by n-gram."""
    import zlib

    bits, mask = 10, (1 << 64) - 1
    texts = ["der Hund liegt", "the dog lies", "le chien dort", "Das Haus", "the house", "la maison", None, "", "42 !", "the Hund", "dort das", "ab"] * 3
    langs = {i: ("de", "en", "fr")[i % 3] if i % 12 < 6 or i % 12 == 8 else None for i in range(len(texts))}

    def buckets(text):
        codes = [ord(c) for c in text.lower()] + [32, 32]
        for i in range(len(codes) - 2):
            h = 0
            for order in (1, 2, 3):
                h = (h + codes[i + order - 1] + order) * 0x9E3779B97F4A7C15 & mask
                h ^= h >> 29
                yield h >> (64 - bits)

    counts, n = {}, Counter()
    for i, t in enumerate(texts):
        if langs[i] and t is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(langs[i], Counter()).update(buckets(t))
            n[langs[i]] += 1
    rows = [(i, t, langs[i], "s", 1, "x", "y", 1, "d") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in identify_language(spark.createDataFrame(rows, SCHEMA), bits=bits).collect()}
    for i, t in enumerate(texts):
        if not t or not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        logs = {}
        for lang in sorted(counts):
            c, total = counts[lang], sum(counts[lang].values()) + 0.5 * (1 << bits)
            logs[lang] = math.log(n[lang] / sum(n.values())) + sum(math.log((c[b] + 0.5) / total) for b in buckets(t))
        best = max(logs, key=logs.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-4
    many = [(i, "abc def", f"l{i}", "s", 1, "x", "y", 1, "d") for i in range(300)]
    assert len({r["lang_pred"] for r in identify_language(spark.createDataFrame(many, SCHEMA), bits=bits).collect()}) == 1
    with pytest.raises(ValueError):
        import fieldglass.llm.language_id as li

        keep, li.CELLS = li.CELLS, 1 << 12
        try:
            identify_language(spark.createDataFrame(many, SCHEMA), bits=bits)
        finally:
            li.CELLS = keep


def test_character_map_is_the_librarys():
    """The compiled map of a standard rule, applied by longest prefix, with places."""
    import sentencepiece

    from fieldglass.llm.sentencepiece_codec import _fields

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    spec = dict(_fields(rule.serialized_normalizer_spec() if callable(rule.serialized_normalizer_spec) else rule.serialized_normalizer_spec))
    chars = CharacterMap(spec[2])
    for text in ("ﬁne ½ ①", "ｱｲｳ ｶﾞ", "plain", "Å é", ""):
        out, places = chars.apply(text.encode())
        import unicodedata

        assert out.decode() == unicodedata.normalize("NFKC", text)
        assert len(places) == len(out) + 1 and places[-1] == len(text.encode())
        assert all(a <= b for a, b in zip(places, places[1:]))
    out, places = chars.apply("ﬁx".encode())
    assert out == b"fix" and places.tolist() == [0, 0, 3, 4]
    assert PieceCodec(model()).plain


def test_spans_are_the_librarys():
    """Bytes under each piece against the surfaces that the library tells."""
    import sentencepiece

    codec, sp = PieceCodec(model()), sentencepiece.SentencePieceProcessor(model_proto=model())
    for t in [t or "" for t in TEXTS] + ["  two  spaces ", "▁x", "a▁b  c", "é½ \n\tq ", " ", "naïve café"]:
        _, n, borders, _ = codec.encode(t)
        data = t.encode()
        assert borders[0] == 0 and borders[-1] == len(data) and (np.diff(borders) >= 0).all()
        found = sp.encode(t, return_type="proto").pieces
        if not any(p.piece.startswith("<0x") for p in found):
            assert [p.surface for p in found] == [data[borders[i] : borders[i + 1]].decode() for i in range(n)]


def test_backoff_scores(spark):
    texts = [t for t in TEXTS if t is None or len(t) < 5000] * 2
    got = {r["doc_id"]: r for r in backoff_scores(docs(spark, texts)).collect()}
    tokens = [words(t) for t in texts]
    counts = [Counter() for _ in range(4)]
    for w in tokens:
        for o in (1, 2, 3):
            counts[o].update(tuple(w[i : i + o]) for i in range(len(w) - o + 1))
    total = sum(counts[1].values())
    seen = lambda g: counts[len(g)][g] if len(g) == 1 or counts[len(g)][g] >= 2 else 0

    def score(g):
        if len(g) == 1:
            return counts[1][g] / total
        if seen(g) and seen(g[:-1]):
            return seen(g) / seen(g[:-1])
        return 0.4 * score(g[1:])

    for i, w in enumerate(tokens):
        want = sum(math.log(score(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))
        assert got[i]["n_tokens"] == len(w)
        assert abs(got[i]["log_score"] - want) < 2e-3, (i, w[:5], got[i], want)
    assert backoff_scores(docs(spark, [])).count() == 0


def brute_backoff(texts, least):
    """Log scores by counting tuples of words."""
    tokens = [words(t) for t in texts]
    counts = Counter(tuple(w[i : i + o]) for w in tokens for o in (1, 2, 3) for i in range(len(w) - o + 1))
    total = sum(len(w) for w in tokens)
    seen = lambda g: counts[g] if len(g) == 1 or counts[g] >= least else 0

    def score(g):
        if len(g) == 1:
            return counts[g] / total
        return seen(g) / seen(g[:-1]) if seen(g) else 0.4 * score(g[1:])

    return [sum(math.log(score(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w))) for w in tokens]


def test_backoff_words_share_no_counts(spark, monkeypatch):
    """So many words that 21-bit numbers would make some thousand of them share counts; small parts."""
    import fieldglass.llm.lm_scoring as lm

    monkeypatch.setattr(lm, "PART_TOKENS", 40_000)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"v{k}" for k in rng.integers(0, 100_000, 300)) for _ in range(500)] + [None, ""]
    texts += texts[:40]
    got = {r["doc_id"]: r["log_score"] for r in backoff_scores(docs(spark, texts)).collect()}
    for i, want in enumerate(brute_backoff(texts, lm.LEAST)):
        assert abs(got[i] - want) < 2e-3, (i, got[i], want)


def test_backoff_keeps_all_counts(spark):
    """N-grams that occur once count; pruning is an option."""
    texts = [t for t in TEXTS if t is None or len(t) < 5000]
    for options, least in (({}, 1), ({"least": 2}, 2), ({"least": 3}, 3)):
        got = {r["doc_id"]: r["log_score"] for r in backoff_scores(docs(spark, texts), **options).collect()}
        for i, want in enumerate(brute_backoff(texts, least)):
            assert abs(got[i] - want) < 2e-3, (i, least, got[i], want)


def test_raking_goes_on_until_marginals_are_met(spark):
    """Sources that are mostly of one language take more than ten rounds; contradicting targets are told of."""
    cells = []
    for i in range(100):
        mass = 10_000_000 // (i + 1)
        cells += [(f"s{i}", f"l{i % 4}", "t", mass), (f"s{i}", f"l{(i + 1) % 4}", "t", mass // 100)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, mass long")
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.8}
    got = rake(df, powers).collect()
    for place, m in enumerate(("source", "lang", "topic")):
        mass, w = Counter(), Counter()
        for r in got:
            mass[r[place]] += r["mass"]
            w[r[place]] += r["w"]
        total = sum(x ** powers[m] for x in mass.values())
        assert all(abs(w[k] / (x ** powers[m] / total) - 1) < 1e-4 for k, x in mass.items()), m
    apart = spark.createDataFrame([("a", "en", "t", 5), ("b", "de", "t", 5)], "source string, lang string, topic string, mass long")
    half = [("a", 0.5), ("b", 0.5)], [("en", 0.8), ("de", 0.2)]
    targets = {m: spark.createDataFrame(x, "category string, share double") for m, x in zip(("source", "lang"), half)}
    with pytest.warns(UserWarning, match="contradict"):
        assert len(rake(apart, targets=targets).collect()) == 2


def test_raking_in_rounds_of_windows(spark, monkeypatch):
    import fieldglass.llm.mixing as mixing

    df = spark.createDataFrame([(s, g, "t", m) for s, g, m in (("a", "x", 90), ("a", "y", 10), ("b", "x", 20), ("b", "y", 80))], "source string, lang string, topic string, mass long")
    want = {r[:2]: r["w"] for r in rake(df).collect()}
    monkeypatch.setattr(mixing, "FEW", 0)
    got = {r[:2]: r["w"] for r in rake(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
