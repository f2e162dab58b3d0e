"""The training-data operators against brute force, and in awkward cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import common, html_extract, langid, media, minhash
from lexmill.llm import substring_dedup as repeats
from lexmill.llm.bpe import OwnRunCache, WordBpe, _decoded, digest, encode_decode
from lexmill.llm.components import connected_components
from lexmill.llm.exact_dedup import exact_dedup
from lexmill.llm.html_extract import extract, main_text
from lexmill.llm.langid import forward_backward, language_id
from lexmill.llm.line_dedup import line_dedup
from lexmill.llm.media import media_columns
from lexmill.llm.minhash import near_components
from lexmill.llm.packing import pack
from lexmill.llm.quality import quality
from lexmill.llm.queries import oracle_sql, queries
from lexmill.llm.substring_dedup import cut_bytes, merged_spans, substring_dedup, whole_characters, without_repeats
from lexmill.llm.word_bpe import RunCache, default_tokenizer_path

# Columns that clash with names the operators use inside.
DDL = "doc_id long, text string, lang string, source string, n_chars long, key string, salt int, doc long, fp long, bands string, n_lines string, component string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with the other columns filled or null."""
    return spark.createDataFrame([(*r, None, "k", 1, 2, None, "b", "x", None) for r in rows], DDL)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = " ".join(word() for _ in range(200))
    rows = [
        (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", None), (4, base, "en", "s"), (5, base, "fr", "s"), (6, base + " tail", "de", "s"),
        (7, "line one\nsame\nsame\n\nend", "en", "s"), (8, "same\nother", "en", "s"), (9, "  same \nthird", "en", "s"), (9, "  same \nthird", "en", "s"),
        (10, "x" * 70_000, "es", "t"), (11, " ".join(word() for _ in range(20_000)), "es", "t"), (12, "日本語 🎉 <|endoftext|> 'tis DON'T", None, "t"),
        (13, "é" * 300, "fr", None), (14, "z" + "é" * 300, "fr", None), (15, "ab " * 100 + "\0\x85", "en", "u"), (16, "one", "en", "u"), (None, "no id", "en", "u"), (None, base, None, None),
    ]
    return rows, frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def text_of(row):
    return row[1] or ""


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_names_and_empty_tables(spark, none):
    assert sorted(n for n in queries() if n.startswith("op")) == sorted(f"op{n}_{x}" for n, x in [(1, "packing"), (2, "line_dedup"), (3, "suffix_array"), (4, "bpe"), (5, "language_id"), (6, "quality"), (7, "minhash"), (8, "media"), (9, "html"), (10, "exact_dedup")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (pack(none), line_dedup(none), substring_dedup(none), without_repeats(none), encode_decode(none), language_id(none), quality(none, labels), near_components(none), media_columns(none), exact_dedup(none)):
        assert out.count() == 0
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_sql(spark, duck, sf_dir):
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, sf_dir)
        expected = duck.sql(sql)
        order = [expected.columns.index(c) for c in df.columns]
        assert counted(df.collect()) == counted(tuple(r[i] for i in order) for r in expected.fetchall())


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[text_of(r)].append(r[0])
    expected = collections.Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            expected[i, keep, len(ids), left and i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
            left = left and i != keep
    return expected


@pytest.mark.parametrize("share", [1024, 3])
def test_exact(spark, awkward, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = [*awkward[0], *[(5, "x", None, None)] * 3, (None, "alone", None, None), (None, "alone", None, None), *[(400 + i, "hot", None, None) for i in range(60)]]
    out = exact_dedup(frame(spark, rows), salts=3).collect()
    assert counted(out) == brute_exact(rows)
    assert sum(r["kept"] for r in out) == len({text_of(r) for r in rows})


def test_lines(awkward):
    rows, df = awkward
    pages, holds = collections.Counter(r[3] for r in rows), collections.Counter()
    for r in rows:
        holds.update({(r[3], k.strip(" ")) for k in text_of(r).split("\n")})
    gone = {k for k, n in holds.items() if k[1] and n >= 3 and n > 0.3 * pages[k[0]]}
    out = line_dedup(df, max_ratio=0.3, min_pages=3)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    expected = counted((r[0], "\n".join(k for k in text_of(r).split("\n") if (r[3], k.strip(" ")) not in gone), r[3]) for r in rows)
    assert gone and counted(out.select("doc_id", "text", "source").collect()) == expected


CASES = ["", " ", "a", "Don't STOP <|endoftext|>x <|startoftext|>. a<|endoftext|>.", "é J̌ É. ≠ ≠ .̸", "ΣΑΣ. ΑΣ ας İstanbul ﬁle", "    x y \x85 a\x1cb \x1c", "rock'street 's't've.'s ''' a'", "1234.5x ½ Ⅷ x²", "—. a—. é. É! ñ|", "日本語 テスト。 مرحبا 🎉👍🏽 é🎉.", "\x00\x01 ‍ a‍b", "x" * 3000, "a.b.c... (d) [e] {f}~ `g`", "ǅ ŉ ß ẞ", "don’t l’été qu'il", "<| a|> <|end"]


def test_lines_take_linear_time(spark):
    once = lambda n: "\n".join(f"line {i % (n // 2)} of the page" for i in range(n))
    rows = [(i, once(20_000), "en", "s") for i in range(3)] + [(i, "other", "en", "s") for i in range(3, 10)]
    began = time.monotonic()
    out = line_dedup(frame(spark, rows), max_ratio=0.25, min_pages=3).collect()
    assert [r["n_dropped"] for r in sorted(out, key=lambda r: r["doc_id"])] == [20_000] * 3 + [1] * 7
    assert time.monotonic() - began < 20


def test_bpe_equals_the_library(awkward, spark):
    from tokenizers import Tokenizer

    path = default_tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    own, texts = WordBpe(path), CASES + [text_of(r) for r in awkward[0]]
    for kind in (RunCache, OwnRunCache):
        found = kind(path).numbered(pa.array(texts))
        ids, decoded = found.ids().to_pylist(), found.spelt(_decoded(OwnRunCache(path), found.part_ids)).to_pylist()
        for t, i, d in zip(texts, ids, decoded, strict=True):
            expected = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(i, "<u4").tolist() == expected, t[:80]
            assert d == library.decode(expected, skip_special_tokens=False)
    assert all(own.encode(t) == library.encode(t, add_special_tokens=False).ids for t in CASES)
    rows = digest(encode_decode(awkward[1])).collect()
    lengths = collections.Counter(len(library.encode(text_of(r), add_special_tokens=False).ids) for r in awkward[0])
    assert collections.Counter(r["n_tokens"] for r in rows) == lengths


def test_packing_is_gapless_and_whole(spark, awkward):
    from tokenizers import Tokenizer

    rows = [r for r in awkward[0] if r[0] is not None] + [(100 + i, "some words here " * (i * 7 % 90), "en", "s") for i in range(400)]
    library = Tokenizer.from_file(default_tokenizer_path())
    library.no_truncation()
    library.no_padding()
    pieces = pack(frame(spark, rows).repartition(5), windows=4).collect()
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"]].append(p)
    short = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        short += at < 4096
    assert short == 1
    texts = {r[0]: text_of(r) for r in rows}
    for doc, ps in documents.items():
        ids = np.array(library.encode(texts[doc], add_special_tokens=False).ids + [2], "<u4")
        copies = sum(r[0] == doc for r in rows)
        starts = sorted((p["start"], p["length"]) for p in ps)
        assert sum(n for _, n in starts) == copies * len(ids)
        for p in ps:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
    assert set(documents) == set(texts)


@pytest.mark.parametrize("seed", range(5))
def test_windows_are_filled_by_best_fit_and_the_fullest_goes_out(seed):
    """The placing told again on lengths alone, with one window after another asked."""
    from lexmill.llm.packing import Packer, Piece

    rng = random.Random(seed)
    full, sizes = 40, [rng.choice([1, 3, 9, 17, 25, 38, 40, 95]) for _ in range(400)]
    packer = Packer(0, full, 3)
    for i, n in enumerate(sizes):
        packer.add(Piece(i, 0, memoryview(bytes(4 * n)), n))
    out, windows = [], []
    for i, n in enumerate(sizes):
        start = 0
        while n - start >= full:
            out.append([(i, start, full)])
            start += full
        left = n - start
        if not left:
            continue
        used = [sum(p[2] for p in w) for w in windows]
        fitting = [w for w, u in zip(windows, used, strict=True) if u + left <= full]
        if fitting:
            best = max(fitting, key=lambda w: sum(p[2] for p in w))
            best.append((i, start, left))
            if sum(p[2] for p in best) == full:
                out.append(best)
                windows = [w for w in windows if w is not best]
            continue
        if len(windows) == 3:
            fullest = max(windows, key=lambda w: sum(p[2] for p in w))
            room = full - sum(p[2] for p in fullest)
            fullest.append((i, start, room))
            out.append(fullest)
            windows = [w for w in windows if w is not fullest]
            start, left = start + room, left - room
        windows.append([(i, start, left)])
    found = collections.defaultdict(list)
    for doc, start, length, _, _, sequence, *_ in packer.rows:
        found[sequence].append((doc, start, length))
    assert [found[k] for k in sorted(found)] == out
    assert sorted(sum(p[2] for p in w) for w in windows) == sorted(full - f for f in packer.free)
    left = sum(full - f for f in packer.free)
    assert sum(map(len, packer.merge())) == left % full


def test_bpe_digests_equal_the_library(spark, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer_path())
    library.no_truncation()
    library.no_padding()
    expected = collections.Counter()
    for r in awkward[0]:
        ids = library.encode(text_of(r), add_special_tokens=False).ids
        expected[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert counted(digest(encode_decode(awkward[1])).collect()) == expected


def brute_repeats(texts):
    seen = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        out.append(gone)
    return out


@pytest.mark.parametrize(("at_once", "piece"), [(2048, 1 << 20), (2, 5000)])
def test_repeated_substrings(spark, awkward, monkeypatch, at_once, piece):
    monkeypatch.setattr(repeats, "AT_ONCE", at_once)
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 5)))
    shared = [" ".join(word() for _ in range(n)) for n in (60, 90, 300)]
    rows = [*awkward[0], (-(1 << 63), awkward[0][3][1], None, None), (0, awkward[0][3][1], None, None)]
    rows += [(500, " ".join(word() for _ in range(40_000)) + shared[1] + "x" * 90_000, "en", "s")] * 2
    for i in range(40):
        middle = rng.choice(shared)
        if rng.random() < 0.5:
            a = rng.randrange(len(middle))
            middle = middle[:a] + "#" + middle[a + 1 :]
        rows.append((200 + i, " ".join(word() for _ in range(rng.randint(0, 40))) + middle + " ".join(word() for _ in range(rng.randint(0, 40))), "en", "s"))
    texts = [text_of(r).encode() for r in rows]
    expected = collections.Counter()
    for r, t, gone in zip(rows, texts, brute_repeats(texts), strict=True):
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        expected[r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    df = frame(spark, rows)
    assert counted(substring_dedup(df).collect()) == expected
    left = without_repeats(df)
    assert left.columns == df.columns and left.count() == len(rows)
    assert left.where("doc_id = 1").first()["text"] is None


@pytest.mark.parametrize("seed", range(4))
def test_passes_equal_grouping(seed):
    rng = np.random.default_rng(seed)
    values = rng.choice(np.array([97, 98], dtype=np.uint8), size=(300, 5 + 3 * seed), p=[0.9, 0.1])
    group = np.sort(rng.integers(0, 20, 300)) * 7
    rows, split = repeats._passes(values, group)
    classes = collections.defaultdict(list)
    for i in range(300):
        classes[int(group[i]), values[i].tobytes()].append(i)
    found = collections.defaultdict(list)
    for i, g in zip(rows.tolist(), split.tolist(), strict=True):
        found[g].append(i)
    assert sorted(map(sorted, found.values())) == sorted(c for c in classes.values() if len(c) > 1)
    assert (np.diff(split) >= 0).all() and not len(repeats._passes(values[:0], group[:0])[0])


def test_spans():
    assert merged_spans([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
    assert whole_characters("aéb".encode(), [(2, 4)]) == [(3, 4)] and whole_characters("é".encode(), [(0, 1)]) == []


def brute_components(texts, k, percent):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(upper))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, awkward, k):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = {r[0]: text_of(r) for r in awkward[0] if r[0] is not None}
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for c in range(18):
            words = list(base)
            for _ in range(rng.randrange(0, 14)):
                words[rng.randrange(120)] = rng.choice(vocabulary)
            texts[1000 + 100 * g + c] = " ".join(words).replace("w1", "W1")
    rows = [(i, t, "en", "s") for i, t in texts.items()] + [(9, texts[9], "en", "s"), (None, "no id", None, None)]
    out = near_components(frame(spark, rows), k=k).collect()
    expected = brute_components(texts, k, 80)
    assert len(out) == len(rows) and len({c for _, c in expected.values()}) < len(texts)
    for r in out:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_words_that_hash_alike_are_not_linked(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a, "en", "s"), (2, b, "en", "s"), (3, "other words here", "en", "s")]
    assert {r["doc_id"]: r["component_id"] for r in near_components(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingles_are_compared_themselves(k):
    from lexmill.llm.shingles import really_linked

    rng = random.Random(k)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        b = [x if rng.random() > 0.08 else "z" for x in a] + [rng.choice("abcd")] * rng.randrange(0, 3)
        x, y = ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set() for w in (a, b))
        assert really_linked(" ".join(a), "\t".join(b).upper(), k, 80) == bool(x and y and 100 * len(x & y) >= 80 * len(x | y))


def test_near_duplicates_with_repeated_ids(spark):
    prose = lambda seed: " ".join(random.Random(seed).choice("abcdefgh") * random.Random(seed * 99 + i).randint(1, 9) + str(i) for i in range(40))
    rows = [(9, prose(1), "en", "s"), (9, prose(2), "en", "s"), (5, prose(1) + " end", "en", "s"), (12, prose(2) + " end", "en", "s"), (12, prose(2) + " end", "en", "s"), (7, prose(3), "en", "s")]
    out = counted((r["doc_id"], r["component_id"], r["kept"]) for r in near_components(frame(spark, rows)).collect())
    assert out == collections.Counter({(9, 5, False): 1, (5, 5, True): 1, (9, 9, True): 1, (12, 9, False): 2, (7, 7, True): 1})


def test_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(4, text, "en", "s"), (4, text, "en", "s"), (4, text + " x", "fr", "s"), (6, text, "en", "s"), (None, text, "en", "s"), (7, " ", "en", "s"), (7, None, "en", "s"), (8, "alone", "en", "s")]
    df = frame(spark, rows)
    out = minhash.without_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 4, 7, 7, 8]


def test_templates_below_the_threshold(spark, monkeypatch):
    """Many texts that share most words without being linked, and a few pairs among them that are."""
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    rng = random.Random(8)
    word = lambda: "w" + str(rng.randrange(10**6))
    base = [word() for _ in range(80)]
    texts = {}
    for i in range(60):
        own = [word() for _ in range(18)]
        texts[i] = " ".join(base + own)
        if i % 7 == 0:
            texts[1000 + i] = " ".join(base + own[:-2] + [word(), word()])
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_components(frame(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert out == brute_components(texts, 2, 80)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 900, dtype=np.uint64)
    for size in (1, 5, 900):
        s = minhash.sketches([np.unique(a[:size])], 160)
        assert (s != np.uint64(2**64 - 1)).all()
    both = minhash.sketches([np.unique(a[:800]), np.unique(a[100:])], 800)
    assert abs((both[0] == both[1]).mean() - 700 / 900) < 0.06
    assert (minhash.sketches([a[:0]], 8) == np.uint64(2**64 - 1)).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert all(got.get(x, x) == find(x) for x in parent)


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    scores, move, start = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    length = np.array([4, 2])
    marginal, pairs, log_z = forward_backward(scores, length, move, start)
    total = np.zeros((3, 3))
    for c, n in enumerate(length):
        weights = {}
        for path in itertools.product(range(3), repeat=int(n)):
            weights[path] = np.exp(start[path[0]] + sum(scores[c, i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weights.values())
        assert np.isclose(log_z[c], np.log(z))
        for i in range(n):
            for y in range(3):
                assert np.isclose(marginal[c, i, y], sum(w for p, w in weights.items() if p[i] == y) / z)
        for p, w in weights.items():
            for a, b in zip(p, p[1:], strict=False):
                total[a, b] += w / z
    assert np.allclose(pairs, total)


def test_whole_chains_equal_one_sweep():
    rng = np.random.default_rng(3)
    size = np.array([1, 5, 64, 65, 1000, 129])
    scores, move, start = rng.normal(size=(int(size.sum()), 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    move += 4 * np.eye(3)
    found, at = langid.chain_marginals(scores, size, move, start), 0
    for n in size.tolist():
        expected, _, _ = forward_backward(scores[None, at : at + n], np.array([n]), move, start)
        assert np.allclose(found[at : at + n], expected[0], atol=1e-4)
        at += n


def test_features_of_words_equal_a_plain_list():
    word, place = langid.word_features(pa.array(["chat", "é"]), 1 << 16)
    marked = [b"\x02chat\x03", "\x02é\x03".encode()]
    for i, w in enumerate(marked):
        kinds = {("gram", w[a : a + n]) for n in (2, 3, 4) for a in range(len(w) - n + 1)} | {("head", w[:n]) for n in range(2, 6) if n <= len(w)} | {("tail", w[-n:]) for n in range(2, 6) if n <= len(w)} | {("word", w)}
        repeats_of = sum(len(w) - n + 1 for n in (2, 3, 4)) - len({(n, w[a : a + n]) for n in (2, 3, 4) for a in range(len(w) - n + 1)})
        assert (word == i).sum() == len(kinds) + repeats_of
    assert ((place >= 0) & (place < 1 << 16)).all()
    again, same = langid.word_features(pa.array(["é", "chat", "chatte"]), 1 << 16)
    shared = set(same[again == 1]) & set(same[again == 2])
    assert set(same[again == 1]) == set(place[word == 0]) and {"ch", "cha", "chat"} and len(shared) >= 9


def test_all_labels_are_learned_and_long_texts_count_whole():
    assert langid.places_of(4) == langid.PLACES and langid.places_of(1000) * 1000 <= langid.WEIGHTS
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b for a in letters[:13] for b in letters[:10]]
    texts = [" ".join(f"{x}{x}{c}" for c in letters) for x in names]
    model = langid.fit(texts, names)
    assert model.labels == tuple(sorted(names))
    assert sum(a == b for a, b in zip(langid.predict(model, pa.array(texts))[0], names, strict=True)) > 120
    two = langid.fit(["the cat and the dog " * 40, "le chat et le chien " * 40], ["en", "fr"])
    assert langid.predict(two, pa.array(["the cat and the dog " * 60 + "le chat et le chien " * 100]))[0] == ["fr"]


def test_language(spark, sf_dir, awkward):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    odd = {r["doc_id"]: r for r in language_id(awkward[1]).collect()}
    assert len(odd) == 18 - 1 and all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    mixed, _ = langid.predict(langid.fit(["the cat and the dog " * 9, "le chat et le chien " * 9], ["en", "fr"]), pa.array(["le chat the dog", "1 2", None]).fill_null(""))
    assert set(mixed[:1]) <= {"en", "fr"} and mixed[1:] == ["und", "und"]


def test_quality(spark, awkward):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["quality"] == r["predicted"] for r in held) >= 0.9 * len(held)
    odd = quality(awkward[1], labels).collect()
    assert len(odd) == len(awkward[0]) and all(0 <= r["score"] <= 1 for r in odd)


def test_risk_and_its_gradient():
    from lexmill.llm import quality as q

    rng = np.random.default_rng(2)
    p, u, w = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4)), rng.normal(size=4)
    loss = lambda f: np.log1p(np.exp(-f))
    plus, minus = q.risk_parts(w, p, u, 0.4)
    assert np.isclose(plus, 0.4 * np.mean([loss(x @ w) for x in p]))
    assert np.isclose(minus, np.mean([loss(-(x @ w)) for x in u]) - 0.4 * np.mean([loss(-(x @ w)) for x in p]))

    def slope(of, w):
        return np.array([(of(w + d) - of(w - d)) / 2e-6 for d in np.eye(4) * 1e-6])

    for prior in (0.1, 0.4, 5.0):
        a, b = q.risk_parts(w, p, u, prior)
        goal = (lambda v: sum(q.risk_parts(v, p, u, prior))) if b >= 0 else (lambda v: -q.risk_parts(v, p, u, prior)[1])  # noqa: B023
        assert np.allclose(q.risk_gradient(w, p, u, prior, 0.01), slope(goal, w) + 0.01 * w, atol=1e-5)
    assert q.risk_parts(w, p, u, 5.0)[1] < 0
    tell = lambda v: np.mean([loss(x @ v) for x in p]) + np.mean([loss(-(x @ v)) for x in u])
    assert np.allclose(q.apart_gradient(w, p, u, 0.0), slope(tell, w), atol=1e-5)


def test_class_prior_is_near_the_share():
    from lexmill.llm import quality as q

    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.8):
        pos, neg = rng.normal(2, 1, (20_000, 1)), rng.normal(-2, 1, (20_000, 1))
        mixed = np.concatenate([pos[: int(5000 * share)], neg[: int(5000 * (1 - share))]])
        assert abs(q.class_prior(pos[5000:9000, 0], mixed[:, 0]) - share) < 0.06
        assert abs(q.fit(pos[5000:9000], mixed).prior - share) < 0.06


def test_runs_of_words_count_in_every_text():
    from lexmill.llm import quality as q

    text = b"a b c d e f g g g g h i j k"
    assert np.isclose(q.features([text, b""])[0, -3], 4 / 14) and q.features([b""]).shape == (1, q.N_FEATURES)


def test_quality_with_repeated_ids(spark):
    good, bad = "Plain words of a good text, number {}. It goes on.", "$$$ BUY NOW {} !!! ###"
    rows = [(i, (good if i % 2 else bad).format(i), "en", "s") for i in range(200)]
    rows += [(1, good.format(1), "en", "s")] * 50 + [(3, "other text of three", "en", "s"), (None, "no id", None, None), (5, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(0, 200, 3)] + [(9, 0), (9, 1), (9, None), (None, 1)], "doc_id long, quality int")
    out = quality(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    again = quality(frame(spark, list(reversed(rows))).repartition(3), labels).collect()
    assert counted((r["doc_id"], r["predicted"]) for r in out) == counted((r["doc_id"], r["predicted"]) for r in again)


def test_media(spark, awkward, monkeypatch):
    monkeypatch.setattr(media, "HOT", 1)
    rows, df = awkward
    out = media_columns(df).collect()
    expected = collections.Counter()
    for r in rows:
        t = text_of(r).encode()
        p = t + bytes(-len(t) % 64 or (0 if t else 64))
        expected[r[0], len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44, hashlib.sha256(media.wave_header(len(p)) + p).hexdigest(), media.features(p)] += 1
    assert counted(out) == expected
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    assert b"".join(media.chunks_of(data)) == data
    assert len(set(media.chunks_of(data)) & set(media.chunks_of(b"inserted" + data))) > 0.7 * len(media.chunks_of(data))
    slow, h = [], 0
    for b in data[:300]:
        h = (h * 2 + int(media._GEAR[b])) & 0xFFFFFFFF
        slow.append(h)
    assert media.gear(np.frombuffer(data[:300], dtype=np.uint8)).tolist() == slow


PAGE = """<html><body><header><h1>Site</h1></header><div id=menu><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></div>
<div class="content"><h2>Title</h2><p>First para, with text. And &eacute; more; yes.<p>Second&nbsp;para has <b>bold</b> words, and<br>breaks.</div>
<div class="comments"><p>Nice post, I really liked it, thanks. Bob.</p></div><div class=sidebar>Links</div><form><input><label>Name</label></form>
<script>if (a<b) {"</p>"}</script><div id="cookie-notice">We use cookies, ok.</div><footer>c</footer></body>"""


def test_html(spark):
    assert main_text(PAGE) == "Title\nFirst para, with text. And é more; yes.\nSecond para has bold words, and breaks."
    odd = '<div id="header">Top</div><div style="overflow:hidden" data-x="hidden ad"><h1>T</h1><div class="article-header"></div><p>Kept text, here.</p><p hidden>Not</p><p aria-hidden="true">Nor</p></div>'
    assert main_text(odd) == "T\nKept text, here."
    assert main_text('<article><header class="header"><h1>T</h1></header><p>x, y.</p><section class="user-comments">no</section></article>') == "T\nx, y."
    assert main_text("<p title=it's>one</p><p alt=\"a>b\">two</p><p class=\"open>three</p>") == "one\ntwo\nthree"
    assert main_text("<a =\"" * 20_000 + "x") is not None
    assert main_text("<p>a</p>tail <!-- x") == "a\ntail" and main_text("<p>a</p>b<!-- x > y") == "a\nb"
    for page, text in (("", ""), ("<", "<"), ("a < b & c", "a < b & c"), ("<p>x", "x"), ("<script>never", ""), ("plain", "plain"), ("<p>a</p><!-- x", "a")):
        assert main_text(page) == text
    rows = [(1, "u", None, 0), (2, None, PAGE, 0), (2, None, PAGE, 0), (3, "v", "<p>" + "word " * 50_000, 0)]
    out = sorted(extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect(), key=lambda r: r["page_id"])
    assert [r["n_chars"] for r in out] == [len(r["text"]) for r in out] and out[0]["text"] == "" and len(out[3]["text"]) == 50_000 * 5 - 1


PROSE = "Some text of the article, which goes on for a while. It has commas, full stops; and more than one sentence."


def test_html_parts_and_wrappers():
    article, text = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>", f"Title\n{PROSE}\n{PROSE}"
    for page in (
        f'<form id="aspnetForm"><div class="content">{article}</div></form>',
        f'<div id="content" class="has-sidebar">{article}</div><div id="sidebar"><p>Side text.</p></div>',
        f'<div class="post comments-open">{article}</div>',
        f'<div class="other"><p>Other</p></div><div class="content no-sidebar">{article}</div>',
        f'<div class="text">{article}</div><div class="comments">{f"<p>{PROSE}</p>" * 5}</div>',
        f'<body><div class=menu><a href=x>Home</a></div><div>{article}</div><div class="cookie-notice">We use cookies, yes.</div><footer><p>{PROSE}</p></footer></body>',
        f'<div class=wrap><div class=x1><span>Home</span></div><div class=x2><div>Now</div><div>Then</div></div><div class=x3>{article}</div></div>',
    ):
        assert main_text(page) == text, page
    # No name tells the last page's other blocks from the article: their ratios do.
    assert len(html_extract.parse(page).texts) == 6


def test_html_ratios_equal_brute_force():
    for page in (PAGE, PAGE * 3, "<div><ul><li>a, b.<li><a>c</a></ul><div>x<div>y. <a>z</a></div></div>tail</div>"):
        parsed = html_extract.parse(page)

        def path(node, of=parsed):
            return () if node <= 0 else (*path(of.parent[node]), of.step[node])

        found = html_extract.path_ratios(parsed, list(range(len(parsed.texts))))
        for node, value in enumerate(found):
            own = [i for i in range(len(parsed.texts)) if path(parsed.node[i])[: len(path(node))] == path(node)]
            length = sum(len(parsed.texts[i]) - parsed.linked[i] for i in own)
            marks = sum(parsed.texts[i].count(c) for i in own for c in ".,;:!?")
            assert np.isclose(value, length / len(own) * (1 + np.log1p(marks / len(own))))


def test_html_takes_linear_time():
    began = time.monotonic()
    for piece in ("<div>text", "<div>text<b>x", "<li><div>a", "<p><b><i>a", "</p>a<div class=comment>"):
        main_text(piece * 20_000)
    assert time.monotonic() - began < 5


def test_pipeline(spark, awkward):
    import corpus_pipeline as C

    rows, df = awkward
    extra = [(300 + i, f"The shared line here.\nwords of document number {i} " + " ".join(random.Random(i).choice("abcdefgh") * 3 for _ in range(60)), "en", "s") for i in range(8)]
    docs = frame(spark, rows + extra)
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = out
    packed = C.STAGES[-1][1](spark, docs, "").collect()
    assert {p["doc_id"] for p in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not {1, 2, 3} & {p["doc_id"] for p in packed} and {i for i, *_ in extra} <= {p["doc_id"] for p in packed}
    assert all(stage(spark, frame(spark, []), "").count() == 0 for _, stage in C.STAGES)


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Each stage's decisions on the small tables, told again in plain Python."""
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = C.language_stage(spark, docs, sf_dir)
    strange = ["Dzień dobry, jak się masz? To jest przykładowy tekst w języku polskim, którego model nie zna.", "Это пример текста на русском языке для проверки", "bu türkçe bir metindir ve model onu daha önce görmedi", "12 345", None]
    model_of = {r["doc_id"]: r for r in docs.collect()}
    planted = spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate(strange)], docs.schema)
    after = {r["doc_id"] for r in C.language_stage(spark, docs.unionByName(planted), sf_dir).collect()}
    assert not [i for i in after if i >= 10**6] and len(after) >= 0.99 * len(model_of)
    assert kept.count() >= 0.99 * docs.count()
    lined = C.line_stage(spark, kept, sf_dir)
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in kept.collect()}
    pages, holds = collections.Counter(s for _, s in texts.values()), collections.Counter()
    for t, s in texts.values():
        holds.update({(s, k.strip(" ")) for k in t.split("\n")})
    gone = {k for k, n in holds.items() if k[1] and n >= 3 and n > 0.02 * pages[k[0]]}
    left = {i: "\n".join(k for k in t.split("\n") if (s, k.strip(" ")) not in gone) for i, (t, s) in texts.items()}
    assert {r["doc_id"]: r["text"] for r in lined.collect()} == left
    near = C.near_stage(spark, lined, sf_dir)
    chosen = {i for i, (_, c) in brute_components(left, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in near.collect()} == chosen
    cut = {r["doc_id"]: r["text"] for r in C.substring_stage(spark, near, sf_dir).collect()}
    order = sorted(chosen)
    for i, gone in zip(order, brute_repeats([left[i].encode() for i in order]), strict=True):
        runs = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        assert cut[i].encode() == cut_bytes(left[i].encode(), whole_characters(left[i].encode(), runs))
    sums = C.run(spark, sf_dir).groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"] for r in sums} == chosen


def test_special_tokens_keep_their_case(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer_path())
    library.no_truncation()
    library.no_padding()
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>Some WORDS.", "a<|ENDOFTEXT|>. <|endoftext|>", "É<|EndOfText|>.", "<|ENDOFTEXT|> <|endoftext|> END"]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for kind in (RunCache, OwnRunCache):
        found = kind(default_tokenizer_path()).numbered(pa.array(texts)).ids().to_pylist()
        assert [np.frombuffer(i, "<u4").tolist() for i in found] == expected
    rows = encode_decode(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    assert {r["doc_id"]: r["n_tokens"] for r in digest(rows).collect()} == dict(enumerate(map(len, expected)))
    packed = pack(frame(spark, [(0, texts[0], "en", "s")])).first()
    assert packed["ids_crc32"] == zlib.crc32(np.array([*expected[0], 2], "<u4").tobytes())


def test_one_copy_of_a_mirrored_page_reaches_packing(spark):
    import corpus_pipeline as C
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer_path())
    library.no_truncation()
    library.no_padding()
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    mirrored, banner = "\n".join(prose(20) for _ in range(5)), "Subscribe to the letter of this site."
    # Copies that differ in blank lines and in spaces at the ends of lines are copies too.
    rows = [(i, mirrored if i % 2 else mirrored.replace("\n", " \n\n"), "en", "s") for i in range(30)]
    rows += [(100 + i, f"{banner}\n{prose(40)}", "en", "s") for i in range(20)]
    docs = frame(spark, rows)
    for _, stage in C.STAGES[1:-1]:
        docs = common.settle(stage(spark, docs, ""), "stage")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(left) == [0, *range(100, 120)] and left[0].split() == mirrored.split()
    assert all(banner not in t and t for t in left.values())
    packed = [p for p in C.packing_stage(spark, docs, "").collect() if p["doc_id"] == 0]
    assert sum(p["length"] for p in packed) == len(library.encode(mirrored, add_special_tokens=False).ids) + 1
