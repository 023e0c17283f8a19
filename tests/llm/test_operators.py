"""Every operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandline.llm import chat, common, decontaminate, minhash, packing, pii, projections, quality, substrings, toxicity, warc

ALPHABET = ["alpha", "beta", "Gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "ñu", "omikron."]


def words(rng, n):
    return [rng.choice(ALPHABET) + str(rng.randint(0, 60)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, n) for n in (80, 120, 60, 200, 40)]
    rows = [" ".join(b) for b in base]
    rows += [rows[0], rows[0], rows[1].upper()]  # exact copies and a copy but for case
    for k in range(12):  # near copies of one text
        copy = list(base[3])
        copy[rng.randrange(len(copy))] = f"changed{k}"
        rows.append(" ".join(copy))
    rows += [None, "", "   \n\t ", "one", "one", "two words", " ".join(["same"] * 90), " ".join(words(rng, 9000))]
    rows += [" ".join(words(rng, 30) + base[4] + words(rng, 25)), " ".join(words(rng, 12) + base[4][:36] + words(rng, 9))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "src", 0, f"extra{i}", 1.0, "x") for i, t in enumerate(texts)]
    rows += [(None, "a null id", "en", "src", 0, "e", None, None), (2, texts[2], None, None, None, None, None, None)]  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a string, score double, key string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def tokens(text, pattern=r"[^\x20\x09-\x0D]+", lower=True):
    t = (text or "").translate({c: c + 32 for c in range(65, 91)}) if lower else text or ""
    return re.findall(pattern, t)


def classes(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


# ------------------------------------------------------------------ shared parts


def test_word_hashes_follow_words(texts):
    seen = {}
    for lo, hi, w in common.word_slices(pa.array(texts), common.BLANK_WORDS, common.LOWER):
        for i in range(lo, hi):
            own = w.hash[w.first[i - lo] : w.first[i - lo + 1]].tolist()
            expected = tokens(texts[i])
            assert len(own) == len(expected)
            assert all(seen.setdefault(a, b) == b for a, b in zip(expected, own, strict=True))
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("task_links", [200_000, 7])
def test_components(spark, task_links, monkeypatch):
    monkeypatch.setattr(common, "TASK_LINKS", task_links)
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in common.components(spark, frame, common.Scratch(spark, "t")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == classes({x for p in real for x in p}, real)


# ------------------------------------------------------------------ 1 embeddings


def vectors(spark, many=0):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i] + 0.05 * rng.standard_normal(16)).tolist(), i % 3) for i in range(20)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(5)] + [(300, (base[1] * 3).tolist(), 1), (301, base[1].tolist(), 2)]
    rows += [(310, None, 0), (311, [0.0] * 16, 0), (312, [float("nan")] * 16, 0), (313, [None] * 16, 0), (314, base[2].tolist(), None), (315, [], 0), (316, [1.0, 2.0], 0), (None, base[3].tolist(), 0)]
    rows += [(400 + i, (base[5] + 0.08 * rng.standard_normal(16)).tolist(), 2) for i in range(many)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, key string")


@pytest.mark.parametrize("many, block", [(0, 1024), (150, 64)])
def test_embeddings_brute_force(spark, many, block):
    rows, frame = vectors(spark, many)
    got = {r["vec_id"]: r for r in rows_of(projections.near_duplicates(frame, neighbours=16, passes=24, block=block))}
    good = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for x, (i, v, c) in enumerate(good):
        for j, u, d in good[x + 1 :]:
            if c == d and len(u) == len(v) and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.93:
                links.append((i, j))
    root = classes([r[0] for r in rows if r[0] is not None], links)
    assert {k: v["component_id"] for k, v in got.items() if k is not None} == root
    assert {k: v["n_links"] for k, v in got.items() if k is not None} == {k: sum(k in p for p in links) for k in root}
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert all(v["kept"] == (k == v["component_id"]) for k, v in got.items() if k is not None)


def test_embeddings_empty(spark):
    assert projections.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("cone", [0.0, 1.0])
def test_embeddings_passes_grow_with_the_label(spark, cone):
    """A label much larger than the window, and one whose vectors all lean to one side, lose no pair."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1200, 24)) + cone
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    near = base / np.linalg.norm(base, axis=1, keepdims=True) + 0.38 * side / np.linalg.norm(side, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base[:1200])] + [(5000 + i, v.tolist(), 0) for i, v in enumerate(near[:300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in projections.near_duplicates(frame, passes=4, neighbours=4).collect()}
    assert [i for i in range(300) if got[5000 + i] != got[i]] == []


def test_embeddings_passes_for_large_labels():
    depth = lambda n: np.log2(n / 256)
    assert [projections.passes_needed(depth(n), 0.93, 1e-5) for n in (256, 6e3, 1e6, 1e7)] == [1, 15, 47, 75]


def test_embeddings_across_partitions_and_rounding(spark):
    """Windows reach over partition bounds, and pairs close to the threshold are settled on full vectors."""
    rng = np.random.default_rng(18)
    base = rng.standard_normal((60, 20))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal(base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = 0.93 + np.linspace(-4e-3, 4e-3, 60)
    near = base * cos[:, None] + side * np.sqrt(1 - cos**2)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(1000 + i, v.tolist(), 0) for i, v in enumerate(near)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in projections.near_duplicates(frame, passes=30, neighbours=16, partition_rows=150).collect()}
    v = np.array([r[1] for r in rows])
    ids = [r[0] for r in rows]
    hit = v @ v.T >= 0.93
    assert got == classes(ids, [(ids[x], ids[y]) for x in range(120) for y in range(x + 1, 120) if hit[x, y]])
    q, step, off = projections.rounded(v)
    assert (np.linalg.norm(v - q * step[:, None].astype(float), axis=1) <= off).all()


# ------------------------------------------------------------------ 2 minhash


@pytest.mark.parametrize("options", [{}, {"node_rows": 3}, {"node_rows": 3, "last_depth": 3, "few_strays": 0, "lead_every": 1}, {"shingle": 5}])
def test_minhash_brute_force(docs, texts, options):
    got = rows_of(minhash.near_duplicates(docs, **options))
    n = options.get("shingle", 2)
    sets = {}
    for i, t in enumerate(texts):
        w = tokens(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = classes(sets, links)
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_minhash_large_node_is_compared_in_blocks(spark):
    rng = random.Random(9)
    base = words(rng, 60)
    rows = []
    for k in range(90):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(60)] = f"c{rng.randint(0, 9)}"
        rows.append((k, " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, node_rows=4, few_strays=0, last_depth=2).collect()}
    sets = {i: {tuple(w[k : k + 2]) for k in range(len(w) - 1)} for i, w in ((i, t.lower().split()) for i, t in rows)}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == classes(sets, links)


def test_minhash_crowded_nodes_lose_no_pairs(spark):
    """Documents with most of their shingles in common: nodes stay mixed and branch on, and pairs must outlive that."""
    rng = random.Random(12)
    common_part = [f"c{k}" for k in range(100)]
    rows = []
    for k in range(40):
        own = [f"d{k}w{j}" for j in range(25)]
        rows += [(k, " ".join(common_part + own)), (1000 + k, " ".join(common_part + own[:15] + [f"e{k}w{j}" for j in range(10)]))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame, last_depth=5, node_rows=2, few_strays=0).collect()}
    assert [k for k in range(40) if got[1000 + k] != k or got[k] != k] == []


def test_minhash_nodes_keep_pairs_at_any_depth():
    """Two sets of similarity 0.8 meet in a node of a depth at least as often as the docstring states."""
    rng = np.random.default_rng(4)
    shared = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        two = [np.unique(x[:360]), np.unique(x[40:])]  # 320 of 400
        sig = minhash.signature_tokens(np.concatenate(two), np.array([0, 360]))
        nodes = [set(minhash.roots(1).tolist()) for _ in two]
        for _ in range(5):
            nodes = [set(minhash.children(np.array(sorted(n), np.uint64), sig[k : k + 1], np.zeros(len(n), int))[1].tolist()) for k, n in enumerate(nodes)]
        shared += bool(nodes[0] & nodes[1])
    assert shared / 300 > 0.6


def test_minhash_groups_are_confirmed_exactly():
    rng = random.Random(2)
    rule = minhash.Rule(2, 80, 100)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(40, 58))), np.uint64) for _ in range(40)]
    values, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    want = [(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    a, b = minhash.group_links(np.arange(40), values, ends, np.triu(np.ones((40, 40), bool), 1), rule)
    assert want and {k: v for k, v in classes(range(40), list(zip(a.tolist(), b.tolist(), strict=True))).items()} == classes(range(40), want)
    size = np.full(40, minhash.GROUP_SHINGLES // 8)
    seen = set()
    for ids, bits in minhash.bounded_groups(np.arange(40), size, np.triu(np.ones((40, 40), bool), 1)):
        assert size[0] * len(ids) <= minhash.GROUP_SHINGLES
        pairs = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(ids) ** 2).reshape(len(ids), -1)
        seen |= {(int(ids[x]), int(ids[y])) for x, y in zip(*np.nonzero(pairs), strict=True)}
    assert seen == {(i, j) for i in range(40) for j in range(i + 1, 40)}


def test_minhash_repeated_ids_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (2, text + " more"), (2, "another text of this id"), (3, None), (3, text), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(f).collect()) for f in (frame, frame.orderBy("text"))]
    assert runs[0] == runs[1] and {(3, 29, 1), (3, 0, 1), (4, 0, 4), (1, 29, 1)} <= set(runs[0])
    assert len({c for d, _, c in runs[0] if d == 2}) == 1


def test_minhash_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.drop_near_duplicates(empty).columns == empty.columns


# ------------------------------------------------------------------ 3 toxicity


def test_decoding_restores_obfuscated_words(spark, empty):
    clean = "the stupid idiot met a loser in the trash " * 30
    model = toxicity.log_model(toxicity.trigram_counts(spark.createDataFrame([(clean,), (None,), ("",)], "text string")))
    for token, word in (("1d10t", "idiot"), ("stup1d", "stupid"), ("l0s3r", "loser"), ("tr@sh", "trash"), ("idiiiiot", "idiot")):
        assert toxicity.decode(token, model) == word
    restore = toxicity.Restorer(model)
    assert restore.words(b"i d i o t") == [b"idiot"] and restore.words(b"t.r.a.s.h") == [b"trash"] and restore.words(b"loser!!!") == [b"loser"]
    assert toxicity.trigram_counts(empty).sum() == 0
    for text in ("so 1d10ts,y0u,l0s3r5/and-tr@sh", "pu55 ki11 a$$ st.up.id", "x" * 30 + "1d10t" + "y" * 30):
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [text[a:b] for a, b in zip(*toxicity.suspects(raw, np.array([0, len(raw)])), strict=True)]
        assert found and all(any(w in x for x in found) for w in re.findall(r"1d10t|l0s3r|tr@sh|pu55|ki11|a\$\$|st\.up\.id", text))


def test_decoding_is_the_best_path(spark):
    """Viterbi against every path of the lattice."""
    rng = random.Random(15)
    model = toxicity.log_model(toxicity.trigram_counts(spark.createDataFrame([("the stupid idiot met a loser in the trash " * 3,)], "text string")))

    def paths(token):
        out, previous, run = [("", 0.0)], "", 0
        for c in token:
            run, previous = (run + 1 if c == previous else 1), c
            if "a" <= c <= "z":
                offers = [(c, toxicity._KEEP_REPEAT if run > 1 else 0.0)] + ([("", toxicity._DROP_REPEAT)] if run > 1 else [])
            else:
                offers = [(x, toxicity._SWAP) for x in toxicity.LOOKALIKES[c]] + [("", toxicity._DROP_FILLER)] + ([("", toxicity._DROP_REPEAT)] if run > 1 else [])
            out = [(t + x, s + cost) for t, s in out for x, cost in offers]
        return out

    def score(text, cost):
        a = b = 0
        for c in text:
            cost += model[a, b, ord(c) - 96]
            a, b = b, ord(c) - 96
        return cost + model[a, b, 0]

    for _ in range(60):
        token = "".join(rng.choice("aidot10$3!t") for _ in range(rng.randint(1, 7)))
        best = max(score(t, s) for t, s in paths(token))
        got = toxicity.decode(token, model)
        assert max(score(t, s) for t, s in paths(token) if t == got) == pytest.approx(best)


def test_toxicity_learns_and_handles_odd_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        t = words(rng, 30)
        if i % 4 == 0:
            t[rng.randrange(30)] = rng.choice(["idiot", "1d10t", "i d i o t", "idiooot"]) if i > 20 else "idiot"
        rows.append((i, " ".join(t), "lang"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "idiot", "x")]
    labels += [(1, None, None), (None, 1, 1), (0, 1, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows_of(toxicity.toxicity_report(docs, marks))}
    assert len(got) == len(rows)
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == int(i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert all(got[i]["held_out"] == (i in held) for i in range(240)) and got[900]["predicted"] == got[901]["predicted"] == 0
    assert {r["score"] for r in rows_of(toxicity.toxicity_report(docs, marks.limit(0)))} == {0.5}


# ------------------------------------------------------------------ 4 packing


def test_packing_round_trip(docs, texts):
    import public_tokenizers
    import tokenizers

    hf = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for capacity in (2048, 64):
        got = rows_of(packing.pack(docs, capacity=capacity, group_rows=20))
        fill, seen = {}, {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == fill.get(r["sequence_id"], 0)
            fill[r["sequence_id"]] = r["offset"] + r["length"]
            seen.setdefault(r["doc_id"], []).append(r)
        assert max(fill.values()) <= capacity
        for i, t in enumerate(texts):
            ids = np.array([*hf.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in seen[i]})
            assert [m[0] for m in mine] == list(range(-(-len(ids) // capacity)))
            assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine) and sum(m[2] for m in mine) == len(ids)
            assert all(m[2] == capacity for m in mine[1:])
        assert len(seen[2]) == 2 * len({r["piece"] for r in seen[2]})  # the repeated row is packed too
        assert len(fill) <= sum(r["length"] for r in got) / capacity * 1.05 + 2


def test_packing_repeated_rows_make_no_hot_group(spark):
    docs = spark.createDataFrame([(1, "the same text of a row")] * 400 + [(None, "x")] * 200, "doc_id long, text string")
    assert len({r["_row"] for r in packing.cut_pieces(docs).collect()}) == 600
    got = rows_of(packing.pack(docs, capacity=64, group_rows=50))
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(got) == 600 and max(fill.values()) <= 64


def test_token_ids_of_odd_texts():
    import public_tokenizers
    import tokenizers

    hf = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["<|endoftext|>", "hello <|endoftext|> world", "<|endoftext|><|endoftext|> a", "a<|endoftext|", "x  y\u00a0 z\u3000w", "\u2003 lead", "tail ", " ", "\n\n a", "don't we'll 12 345", "é" * 50, "a" * 3000, None, ""]
    for texts_ in (odd, odd[:1], odd[4:], [t for t in odd for _ in range(3)]):
        for i, _, start, n, crc in packing.document_pieces(pa.array(texts_), 2048):
            ids = np.array([*hf.encode(texts_[i] or "", add_special_tokens=False).ids, 0], "<u4")
            assert start + n <= len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())


def test_segments_of_equal_hash_are_told_apart(monkeypatch):
    from strandline.llm.packing import Encoder, default_vocabulary

    text = "one two three four two one"
    want = Encoder(default_vocabulary()).bpe.encode_ordinary(text)
    monkeypatch.setattr(packing, "mix", lambda x: x & np.uint64(1))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert Encoder(default_vocabulary()).encode(raw, np.array([0, len(raw)]), 0, 1)[0].tolist() == want


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 5, 5, 4, 4, 3, 3, 2, 2])
    loose = [[0], [1], [2, 8], [3, 9], [4, 6], [5, 7]]
    packed = packing.local_search(loose, lengths, 10)
    assert sorted(i for b in packed for i in b) == list(range(10)) and all(lengths[b].sum() <= 10 for b in packed) and len(packed) == 4


@pytest.mark.parametrize("seed", range(4))
def test_local_search_packs_real_lengths(seed):
    """Each step raises the squared fill, and the loose placement shrinks to the lower bound plus 1 %."""
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.3, 0.9, 3000).astype(int), 1, 2047)
    loose = packing.arrival_order(lengths, 2048)
    search = packing.LocalSearch(loose, lengths, 2048)
    apply, squares = search._apply, []

    def watched(*step):
        out = apply(*step)
        squares.append(sum(f * f for f in search.fill))
        return out

    search._apply = watched
    packed = search.run()
    assert sorted(i for b in packed for i in b) == list(range(3000)) and all(lengths[b].sum() <= 2048 for b in packed)
    assert all(x <= y for x, y in zip(squares, squares[1:], strict=False)) and search.steps > len(packed) / 2
    assert len(packed) <= np.ceil(lengths.sum() / 2048) * 1.01 + 1 < len(loose)


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


# ------------------------------------------------------------------ 5 personal data


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_spans_are_the_plain_patterns():
    rng = random.Random(8)
    for _ in range(4000):
        t = "".join(rng.choice("a.@1-+9 ()%25.4é") for _ in range(rng.randint(0, 60)))
        plain = sorted([(m.start(), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, t) if pii.valid(k, m.group())], key=lambda s: (s[0], pii.KINDS.index(s[2])))
        assert plain == pii.base_spans(t)


def test_field_adds_spans_and_leaves_clean_text(spark):
    rows = [(1, "write to kim (at) mail (dot) org or call (020) 555-1234 now"), (2, "the onea at thand is of 2014-04-30 , order 1234 of 7"), (3, None), (4, ""), (5, "host 10.0.0.1 and jo@x.org 4111 1111 1111 1111 +1 (068) 555-2748"), (5, "é 999.1.1.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(pii.pii_report(docs).orderBy("doc_id", "spans"))
    assert [k.split(":")[0] for k in got[0]["spans"].split(",")] == ["email", "phone"] and got[0]["n_email"] == 0
    assert got[1]["spans"] == "" and got[2]["spans"] == "" and got[3]["spans"] == ""
    five = got[5]
    assert (five["n_email"], five["n_ip"], five["n_card"], five["n_phone"]) == (1, 1, 1, 1)
    assert five["base_sha256"] == pii.sha_of(pii.base_spans(rows[4][1]))
    clean = {r["text"] for r in pii.redact(docs).collect()}
    assert "host <ip> and <email> <card> <phone>" in clean and None in clean


def test_field_reads_single_digits_and_spans_never_overlap():
    for text, kind in (("ping 1 . 2 . 3 . 4 now", "ip"), ("10 . 2 . 3 . 4", "ip")):
        base, spans = pii.find_spans([text], pii.default_field())[0]
        assert base == [] and [k for *_, k in spans] == [kind]
    rng = random.Random(41)
    pieces = ["kim (at) mail (dot) org", "1 . 2 . 3 . 4", "(020) 555-1234", "jo@x.org", "10.0.0.1", "the river", "at", "dot", ".", "4111 1111 1111 1111", "é"]
    for base, spans in pii.find_spans([" ".join(rng.choice(pieces) for _ in range(60)) for _ in range(40)], pii.default_field()):
        added = sorted(set(spans) - set(base))
        assert set(base) <= set(spans) and all(b <= c for (_, b, _), (c, _, _) in zip(added, added[1:], strict=False))
        assert all(b <= c or d <= a for a, b, _ in added for c, d, _ in base)


def test_unread_stretches_change_nothing(texts):
    """Cut sequences and skipped tokens give the path of the whole text."""
    rng = random.Random(42)
    field = pii.default_field()
    odd = ["kim (at) mail (dot) org", "call (020) 555-1234", "at home . then", "1 2 3", "v 1.2.3", "the river and the green Haus of les Para , immer", "une chose . "]
    many = [t or "" for t in texts] + [" ".join(rng.choice(odd) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    tokens = pii.tokens_of(many)
    score = field.scores(tokens)
    cut = np.searchsorted(tokens.owner, np.arange(len(many) + 1))
    whole = np.concatenate(field.viterbi([score[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], cells=500))
    parts = field.stretches(score, tokens.owner)
    got = np.zeros(len(score), np.int64)
    for (a, b, _, _), path in zip(parts, field.viterbi([score[a:b] for a, b, *_ in parts], [p[2] for p in parts], [p[3] for p in parts]), strict=True):
        got[a:b] = path
    assert (got == whole).all() and sum(b - a for a, b, *_ in parts) < len(score)


def test_field_memory_on_very_long_texts():
    import tracemalloc

    text = " ".join(str(k % 100000).zfill(5) for k in range(170_000))  # 1 MB of numbers
    tracemalloc.start()
    pii.find_spans([text, *["short"] * 600], pii.default_field())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 1_000_000 and peak < 500e6


def test_pii_empty(empty):
    assert pii.pii_report(empty).count() == 0 and pii.redact(empty).columns == empty.columns


def test_field_on_unseen_lines():
    rows = pii.labelled_rows(4)
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    field = pii.train_field([r for i, r in enumerate(rows) if i % 4])
    wrong = 0
    for text, spans in held:
        want = sorted((a, b, k) for a, b, k in spans if pii.plausible(k, text[a:b]))
        wrong += pii.find_spans([text], field)[0][1] != want
    assert wrong <= 0.02 * len(held)  # every line and every kind counts


# ------------------------------------------------------------------ 6 decontamination


def brute_contamination(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = tokens(text, pattern), set(), set()
    for item, t in items:
        v = tokens(t, pattern)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == v[k : k + n]:
                    hit.update(range(s, s + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("part_windows", [100_000, 60])
def test_decontamination_brute_force(spark, docs, texts, part_windows):
    items = [(1, " ".join(texts[0].split()[5:40])), (2, "two words"), (3, None), (4, "..."), (5, texts[3][:200]), (12, texts[0]), (12, texts[0]), (None, texts[1]), (7, "One")]
    benchmark = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, found int")
    got = rows_of(decontaminate.contamination_report(docs, benchmark, part_windows=part_windows))
    assert len(got) == docs.count()
    for r in got:
        n, hit, found = brute_contamination(texts[r["doc_id"]] if r["doc_id"] is not None else "a null id", [i for i in items if i[0] is not None])
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(found), decontaminate.digest_of(found), hit > 0)


def test_decontamination_empty(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, none).count() == docs.count()
    assert decontaminate.drop_contaminated(empty, none).columns == empty.columns


# ------------------------------------------------------------------ 7 substrings


@pytest.mark.parametrize("window, phrase", [(35, 8), (12, 4)])
def test_substrings_brute_force(docs, texts, window, phrase):
    got = rows_of(substrings.remove_repeats(docs, window=window, phrase=phrase, shard_words=300, part_words=500))
    all_texts = [*texts, texts[2], "a null id"]  # the repeated row, the row without id
    seen: dict = {}
    for i, t in enumerate(all_texts):
        w = tokens(t, lower=False)
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), []).append((i, k))
    gone = [set() for _ in all_texts]
    for places in seen.values():
        if len(places) > 1:
            for i, k in places:
                gone[i].update(range(k, k + window))
    assert len(got) == docs.count()
    for r in got:
        i = len(all_texts) - 1 if r["doc_id"] is None else r["doc_id"]
        w = tokens(all_texts[i], lower=False)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())


def test_substrings_null_ids_are_occurrences(spark):
    rng = random.Random(31)
    shared = words(rng, 50)
    rows = [(None, " ".join(words(rng, 9) + shared)), (7, " ".join(shared + words(rng, 20))), (None, " ".join(words(rng, 60))), (7, " ".join(words(rng, 44)))]
    got = sorted((r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(44, 0), (59, 50), (60, 0), (70, 50)]


def test_automata_find_exactly_the_windows_of_passages():
    rng = random.Random(32)
    for _ in range(60):
        passages = [[rng.choice("abcd") for _ in range(rng.randint(12, 40))] for _ in range(rng.randint(1, 5))]
        automaton = substrings.PhraseAutomaton([" ".join(p).encode() for p in passages], 12, 4)
        windows = {tuple(p[k : k + 12]) for p in passages for k in range(len(p) - 11)}
        text = [rng.choice("abcde") for _ in range(60)]
        at = rng.randrange(40)
        text[at : at + 15] = rng.choice(passages)[:15]
        want = {k + j for k in range(len(text) - 11) if tuple(text[k : k + 12]) in windows for j in range(12)}
        assert {x for a, b in automaton.occurrences([w.encode() for w in text]) for x in range(a, b)} == want


def test_substrings_empty(empty):
    assert substrings.remove_repeats(empty).count() == 0


# ------------------------------------------------------------------ 8 archives


def test_archives_round_trip(spark):
    big = "<html>" + "x" * 1200
    rows = [(1, "http://a\r\nb", big), (2, None, big), (9, "http://c", big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 900 + "\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", big), (1, "again", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, keeper string")
    got = list((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(pages, file_bytes=2000).collect())
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        keeper = max(j for j, _, g in rows if j is not None and (g or "") == (h or ""))
        revisit = len(raw) >= 1000 and keeper != i
        expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    got, expected = (sorted(x, key=lambda r: (r[0] is None, *map(str, r))) for x in (got, expected))
    assert got == expected
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_normaliser_reads_any_gzip_layout():
    records = [warc.record_bytes(i, "u", "response", b"x" * i * 700, "d", i * 700, None) for i in range(6)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    mono = whole.compress(b"".join(records)) + whole.flush()
    assert warc.records_of(mono) == records
    members = b""
    for r in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        members += z.compress(r) + z.flush()
    assert warc.records_of(members) == records
    with pytest.raises(ValueError):
        warc.records_of(mono[: len(mono) // 2])


# ------------------------------------------------------------------ 9 preferences


def brute_preference(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    out = [n, "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in a[:n])]
    for side in (a[n:], b[n:]):
        text, spans = "", []
        for r, t in side:
            head = f"<|{r}|>\n"
            if r == "assistant":
                spans.append((len(text) + len(head), len(text) + len(head) + len(t) + len("<|end|>")))
            text += f"{head}{t}<|end|>\n"
        out += [text, spans]
    return out


def test_preferences_brute_force(spark):
    talks = {
        0: [("user", "hi"), ("assistant", "yes é"), ("user", "more")],
        1: [("user", "hi"), ("assistant", "no"), ("assistant", "")],
        2: [("user", "same"), ("assistant", "same")],
        3: [("user", "same"), ("assistant", "same")],
        4: [("user", "a"), ("assistant", "b")],
        5: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")],
        6: [("", ""), ("user", "x")],
        7: [("assistant", "y")],
    }
    rows = [(c, k, r or None, t or None, "clash") for c, turns in talks.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "x"), (8, 0, "user", "no partner", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r["pair_id"]: r for r in chat.format_preferences(turns, chat.neighbour_pairs(turns)).collect()}
    assert set(got) == {0, 1, 2, 3}
    for k, r in got.items():
        n, prompt, chosen, cm, rejected, rm = brute_preference(talks[2 * k], talks[2 * k + 1])
        assert (r["n_prompt"], r["prompt"], r["chosen"], r["rejected"]) == (n, prompt, chosen, rejected)
        assert [tuple(s) for s in r["chosen_mask"]] == cm and [tuple(s) for s in r["rejected_mask"]] == rm
    assert chat.preference_report(turns.limit(0)).count() == 0


def test_preferences_of_odd_ids(spark):
    """Negative ids meet no rival, and ids beyond doubles are halved exactly."""
    big = 2**53
    talks = {c: [("user", f"q{c % 7}"), ("assistant", f"a{c}")] for c in (-2, -1, 0, 1, big, big + 1, big + 2, big + 3)}
    turns = spark.createDataFrame([(c, k, r, t) for c, x in talks.items() for k, (r, t) in enumerate(x)], "conv_id long, turn long, role string, text string")
    got = [(r["rival"], r["pair_id"], r["chosen_id"], r["rejected_id"], r["n_prompt"]) for r in chat.preference_report(turns).collect()]
    assert sorted(x[1:4] for x in got if not x[0]) == sorted((c >> 1, c, c + 1) for c in talks if c % 2 == 0)
    assert sorted(x[1:] for x in got if x[0]) == sorted((c, c, c, 1) for c in talks)


# ------------------------------------------------------------------ 10 quality


def test_quality_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        t = words(rng, 60)
        good = i % 3 > 0
        rows.append((i, " ".join(t if good else [w.upper() + "$$$" for w in t]), "x"))
        labels.append((i, int(good), 0))
    rows += [(900, None, "x"), (901, "", "x"), (None, "text", "x"), (5, rows[5][1], "again")]
    labels += [(2, None, 0), (None, 0, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, _y string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows_of(quality.quality_report(docs, marks))
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in held) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in rows_of(quality.quality_report(docs, marks.limit(0)))} == {0.5}


@pytest.mark.parametrize("every", [2, 5])
def test_quality_score_follows_the_share_of_labels(spark, every):
    """Labels that say nothing of the text: the score is the share of good labels, whatever it is."""
    rng = random.Random(16)
    rows = [(i, " ".join(words(rng, 40))) for i in range(600)]
    marks = spark.createDataFrame([(i, int(i % every == 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = rows_of(quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string"), marks))
    assert abs(np.mean([r["score"] for r in got]) - 1 / every) < 0.1


# ------------------------------------------------------------------ pipeline


def corpus(spark, path, labelled):
    rng = random.Random(21)
    rows, labels = [], []
    items = [" ".join(words(rng, 24)) for _ in range(3)]
    for i in range(300):
        t = words(rng, 70)
        if i % 3 == 0:
            t = [w.upper() + "$$$" for w in t]
        elif i % 20 == 1:
            t[30:42] = items[i % 3].split()[5:17]
        elif i % 10 == 4 and rows[i - 3][0] % 3:
            t = rows[i - 3][1].split()
            t[rng.randrange(70)] = f"changed{i}"
        rows.append((i, " ".join(t), "en", "src", 0))
        labels.append((i, int(i % 3 > 0), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels if labelled else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_brute_force(spark, tmp_path, labelled):
    rows, items = corpus(spark, str(tmp_path), labelled)
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t, *_ in rows if i % 3 or not labelled}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in docs.items()}
    root = classes(docs, [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    assert any(root[i] != i for i in root)
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    windows = {tuple(w[k : k + 10]) for w in map(plain, items) for k in range(len(w) - 9)}
    text = {i: t for i, t, *_ in rows}
    held = {i for i in docs if any(tuple(w[k : k + 10]) in windows for w in [plain(text[i])] for k in range(len(w) - 9))}
    assert held
    want = {i for i in docs if root[i] == i and i not in held}
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert {r["doc_id"] for r in got} == want


@pytest.fixture(scope="module")
def stage_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stages"))
    return path, *corpus(spark, path, True)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, stage_dir, name, stage):
    """Nulls in any column, empty and very long texts, repeats, columns with clashing names, and an empty table."""
    path, rows, items = stage_dir
    schema = "doc_id long, text string, lang string, source string, n_chars long, _score double, _found string, key long, component_id string, spans string"
    good = rows[7][1]
    odd = [(1, good), (1, good), (2, rows[2][1]), (3, None), (4, ""), (None, good + " one"), (None, None), (5, " ".join(words(random.Random(77), 20_000))), (6, items[0]), (7, "mail jo@x.org now " + rows[5][1]), (7, "mail jo@x.org now " + rows[5][1])]
    docs = spark.createDataFrame([(i, t, None, "s", None, 1.0, "f", 2, None, "z") for i, t in odd], schema)
    got = stage(spark, docs, path).collect()
    assert stage(spark, docs.limit(0), path).count() == 0
    if name == "pack":
        ids = [r["doc_id"] for r in got]
        assert set(ids) == {i for i, _ in odd} and ids.count(1) == 2 and ids.count(None) == 2
        return
    assert got and set(got[0].asDict()) == set(docs.columns) and all(r["_score"] == 1.0 and r["_found"] == "f" and r["key"] == 2 and r["spans"] == "z" for r in got)
    kept = [(r["doc_id"], r["text"]) for r in got]
    if name == "quality":
        assert all(k in odd for k in kept) and kept.count((1, good)) == 2
    elif name == "near_dedup":
        assert sorted(map(str, kept)) == sorted(map(str, odd))  # repeated rows are one document, which stays
    elif name == "decontaminate":
        assert (6, items[0]) not in kept and len(kept) == len(odd) - 1
    else:
        assert len(kept) == len(odd) and sum("jo@x.org" in (t or "") for _, t in kept) == 0 and (3, None) in kept and (4, "") in kept


def test_quality_score_is_the_difference_of_compressed_sizes():
    import zstandard as zstd

    rng = random.Random(51)
    sample = [(" ".join(words(rng, 50)), 1) for _ in range(30)] + [(" ".join(w.upper() + "$$" for w in words(rng, 50)), 0) for _ in range(30)]
    model = quality.fit_quality_rows(sample, share=0.5)
    texts_ = [sample[0][0], sample[-1][0], "", None, "é" * 700, " ".join(words(rng, 3000)), sample[0][0]]
    got = quality.quality_scores(pa.array(texts_), model)
    for t, score in zip(texts_, got, strict=True):
        raw, sizes = (t or "").encode(), []
        for d in (model.bad, model.good):
            z = zstd.ZstdCompressor(level=model.level, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(z.compress(raw[i : i + model.piece_bytes])) for i in range(0, len(raw), model.piece_bytes)))
        x = (sizes[0] - sizes[1]) / len(raw) if raw else 0.0
        assert score == pytest.approx(1 / (1 + np.exp(-(model.weights[0] * x + model.weights[1]))))
    assert got[0] == got[-1] and got[0] > got[1]


def test_scores_of_empty_tables(spark, empty):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_report(empty, marks).count() == 0 and toxicity.toxicity_report(empty, marks).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://somewhere:7077"})()

    with pytest.raises(ValueError):
        common.shared_root(Cluster())


def test_scratch_tables_go(spark):
    import os

    scratch = common.Scratch(spark, "gone")
    a, b = scratch.settle(spark.range(3), "a"), scratch.settle(spark.range(4), "b")
    scratch.keep(b)
    at = scratch.base.removeprefix("file://")
    assert len(os.listdir(at)) == 1 and b.count() == 4 and a is not b


def test_blocks_mark_a_pair_of_several_nodes_once(spark):
    """Three trees hold the same documents: their pairs are marked in one of them, none is lost."""
    ids = range(1, 61)
    component = {d: 1 if d <= 30 else d for d in ids}  # thirty strays
    labelled = spark.createDataFrame([(k, d, 10, 0, 0, 0, 0, component[d]) for k in (5, -7, 9) for d in ids if not (k == -7 and d == 60)], f"{minhash._ROW}, component long")
    nodes = spark.createDataFrame([(k, 1, 60, 30) for k in (5, -7, 9)], "key long, main long, n long, strays long")
    marked = []
    for g in minhash.block_groups(labelled, nodes, minhash.Rule(2, 80, 100), block=16).collect():
        n = len(g["ids"])
        for x, y in np.argwhere(np.unpackbits(np.frombuffer(g["similar"], np.uint8), count=n * n).reshape(n, n)):
            marked.append(tuple(sorted((g["ids"][x], g["ids"][y]))))
    assert sorted(marked) == [(a, b) for a in ids for b in ids if a < b and component[a] != component[b]]
