"""Operators 11 to 13 against brute force: odd rows, long texts and conversations, ties, repeats, clashing names, hot rows."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from strandline.llm import bitpack, repair, tries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TALK = "conv_id long, turn long, role string, text string, h long, kind string, n_ids long"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def ordered(rows):
    """Rows of each conversation in order: (conv_id, turn, role, text) with None left in the turn only."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda q: (q[1] is not None, q[1] or 0, q[2], q[3])):
        out.setdefault(c, []).append((t, r, x))
    return out


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(11)
    system, hello = ("system", "Be brief."), ("user", "hello there , you")
    rows = []
    for c in range(0, 130):
        turns = [system] * (c % 3 == 0) + [hello] * (c % 2)
        for k in range(rng.randint(0, 5)):
            turns.append((("user", "assistant")[k % 2], rng.choice(["yes.", "no", "may be !", "a b c?", ""])))
        rows += [(c, k, r, x) for k, (r, x) in enumerate(turns)]
    rows += [(200, 0, *hello), (200, 0, *hello), (200, 0, "user", "another"), (201, None, None, None), (201, 3, "tool", "x."), (201, 3, "", "y."), (202, 1, "user", None)]
    rows += [(-21, 0, *hello), (-21, 1, "assistant", "so it is."), (None, 0, *hello), (None, 1, *hello)]
    rows += [(300, k, ("user", "assistant")[rng.random() < 0.5], rng.choice(["long.", "talk", "no end", f"turn {k}."])) for k in range(700)]
    rows += [(301, k, r, x) for _, k, r, x in rows[-700:-200]]
    rows += [(320 + k, 0, "user", "w " * 3000) for k in range(3)]
    return rows


@pytest.fixture(scope="module")
def table(spark, talks):
    return spark.createDataFrame([(*r, 5, "x", 1) for r in talks], TALK).repartition(7)


# ------------------------------------------------------------------ 12: tries


def brute_trie(rows):
    own = ordered([(c, t, r or "", x or "") for c, t, r, x in rows if c is not None])
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        block = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = [q[1:] for q in own.get(block, [])[:h]] + [q[1:] for q in own[c][h:]]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out, below = {}, {}
    for path, members in nodes.items():
        saved = (len(members) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        leaf = not any(path + (t,) in nodes for t in {tuple(built[c][len(path)]) for c in members if len(built[c]) > len(path)})
        for d in range(len(path) + 1):
            s = below.setdefault(path[:d], [0, 0, 0])
            s[0] += leaf
            s[1] += saved
            s[2] += d == len(path) - 1
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        out[min(members), len(path)] = (min(nodes[path[:-1]]) if path else None, len(members), below[path][2], below[path][0], below[path][1], hashlib.sha256(ends.encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard", [3, 60, 1 << 16])
def test_trie_brute_force(spark, table, talks, shard):
    got = rows_of(tries.trie_report(table, shard=shard))
    made = {(r["conv_id"], r["depth"]): tuple(r[c] for c in tries.RESULT[2:]) for r in got}
    assert len(made) == len(got)
    assert made == brute_trie(talks)


def test_trie_over_many_ranges(spark, talks):
    """Ranges cut conversations anywhere: digests and numbers are carried over."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        rows = [r for r in talks if r[0] in (300, 301, 200, 40, 41)]
        got = rows_of(tries.trie_report(spark.createDataFrame([(*r, 5, "x", 1) for r in rows], TALK), shard=50))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["conv_id"], r["depth"]): tuple(r[c] for c in tries.RESULT[2:]) for r in got} == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert rows_of(tries.trie_report(spark.createDataFrame([], TALK))) == []
    assert rows_of(tries.trie_report(spark.createDataFrame([(None, 0, "user", "x", 0, "", 0)], TALK))) == []


def test_trie_of_turnless_and_repeated_conversations(spark):
    rows = [(c, 0, "user", "same words here") for c in range(2000, 2400)] + [(c, 1, "assistant", "ok.") for c in range(2000, 2400, 2)]
    got = rows_of(tries.trie_report(spark.createDataFrame([(*r, 0, "", 0) for r in rows], TALK), shard=100))
    assert {(r["conv_id"], r["depth"]): tuple(r[c] for c in tries.RESULT[2:]) for r in got} == brute_trie(rows)


def test_louds_navigation():
    rng = random.Random(2)
    for n in (1, 2, 7, 200):
        parent = [-1]
        for k in range(1, n):
            parent.append(rng.randint(-1, k - 1))
        depth = [0] * n
        for k in range(n):
            depth[k] = depth[parent[k]] + 1 if parent[k] >= 0 else 0
        key = np.array(rng.sample(range(10_000), n))
        above = np.array([key[p] if p >= 0 else -5 for p in parent])
        order, par = tries.level_order(np.array(depth), key, above, np.array([rng.random() for _ in range(n)]))
        trie = tries.Louds.of_parents(par)
        assert sorted(order.tolist()) == list(range(n)) and (trie.parent == par).all() and (np.diff(par) >= 0).all()
        assert [key[order[p]] if p >= 0 else -5 for p in par] == above[order].tolist()
        for node in range(-1, n):
            lo, hi = trie.child_range(node)
            assert [k for k in range(n) if par[k] == node] == list(range(lo, hi))
        sizes = trie.roll_up(np.ones(n, int))[0]
        for k in range(n):
            assert sizes[k] == 1 + sum(sizes[j] for j in range(n) if par[j] == k)
        assert (trie.children() == np.bincount(par + 1, minlength=n + 1)[1:]).all()


# ------------------------------------------------------------------ 13: repair


def brute_damage(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
        out[c] += [row] * (2 if kind == 3 else 1)
    return {c: ordered(v).get(c, []) for c, v in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, r, x in rows:
        body = x.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def search(rows, faults):
    """Cheapest edits by trying all of them; at most three insertions in a row, which is one more than ever helps."""
    best, follows = [(10**9, "", "")], {"": "su", "s": "u", "u": "a", "a": "u"}

    def go(at, last, cost, audit, lines, inserted):
        if cost > best[0][0]:
            return
        if at == len(rows) and last in ("", "a"):
            best[0] = min(best[0], (cost, audit, "\n".join(lines)))
        for new in follows[last]:
            if new != "s" and inserted < 3:
                go(at, new, cost + 2, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[new]], inserted + 1)
        if at < len(rows):
            _, r, x = rows[at]
            go(at + 1, last, cost + 3, audit + "D", lines, 0)
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                for new in follows[last]:
                    if r[:1] == new:
                        go(at + 1, new, cost + more, audit + "K", [*lines, f"{r}:{x}"], 0)
                    if new != "s":
                        go(at + 1, new, cost + 2 + more, audit + "R", [*lines, {"u": "user:", "a": "assistant:"}[new] + x], 0)

    go(0, "", 0, "", [], 0)
    return best[0]


def plain_viterbi(rows, faults):
    """The same by dynamic programming over whole audit strings, for conversations too long to search."""
    follows, roles = {"": "su", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}

    def close(ways):
        for _ in range(3):
            for last, (cost, audit) in list(ways.items()):
                for new in follows[last]:
                    if new != "s" and (new not in ways or (cost + 2, audit + "I") < ways[new]):
                        ways[new] = (cost + 2, audit + "I")
        return ways

    ways = close({"": (0, "")})
    for (_, r, _x), fault in zip(rows, faults, strict=True):
        new_ways = {}

        def offer(state, cost, audit, new_ways=new_ways):
            if state not in new_ways or (cost, audit) < new_ways[state]:
                new_ways[state] = (cost, audit)

        for last, (cost, audit) in ways.items():
            offer(last, cost + 3, audit + "D")
            if fault not in ("blank", "duplicate"):
                for new in follows[last]:
                    if r[:1] == new:
                        offer(new, cost + (fault == "truncated"), audit + "K")
                    if new in roles:
                        offer(new, cost + 2 + (fault == "truncated"), audit + "R")
        ways = close(new_ways)
    return min(ways[s] for s in ("", "a") if s in ways)


def brute_report(rows):
    out = {}
    for c, own in brute_damage(rows).items():
        faults = faults_of(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        counts = (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal)
        out[c] = own, faults, counts
    return out


def test_repair_brute_force(spark, table, talks):
    got = {r["conv_id"]: r for r in rows_of(repair.repair_report(table))}
    want = brute_report(talks)
    assert set(got) == set(want)
    for c, (own, faults, counts) in want.items():
        r = got[c]
        assert tuple(r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal")) == counts, c
        if len(own) <= 7:
            cost, audit, text = search(own, faults)
            assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), c
        else:
            assert (r["cost"], r["audit"]) == plain_viterbi(own, faults), c


def test_repair_random_conversations():
    """The streaming decoder against the search, on short conversations of any shape."""
    rng = random.Random(5)
    for _ in range(400):
        rows = [(k, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", " "]), rng.choice(["a.", "b!", "cut", "a.", " ", "d?"])) for k in range(rng.randint(0, 5))]
        faults, now = faults_of(rows), repair.Conversation(1)
        for (t, r, x), fault in zip(rows, faults, strict=True):
            now.add(t, r, x, fault == "duplicate")
        made, (cost, audit, text) = now.close(), search(rows, faults)
        assert (made["cost"], made["audit"], made["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), rows


def test_repair_forgets_what_is_settled():
    """The decoder of a conversation of many turns holds few rows, however they go wrong."""
    rng, now, most = random.Random(8), repair.Conversation(1), 0
    for k in range(20_000):
        now.add(k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["x.", "", "cut", "y!"]), rng.random() < 0.1)
        most = max(most, len(now.pending))
    assert len(now.close()["audit"]) >= 20_000 and most < 200


def test_repair_of_nothing(spark):
    assert rows_of(repair.repair_report(spark.createDataFrame([], TALK))) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = rows_of(repair.repair_report(spark.createDataFrame([(gone, 0, "user", "x", 0, "", 0)], TALK)))
    assert row == {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


# ------------------------------------------------------------------ 11: packed ids


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 15, 16, 17, 24, 31, 32])
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
        raw = bitpack.pack_bits(ids, bits)
        assert len(raw) == -(-n // 8) * bits and (bitpack.unpack_bits(raw, n, bits) == ids).all()


def test_bits_for():
    assert [bitpack.bits_for(k) for k in (0, 1, 2, 255, 256, 31_999, 50_256, 65_535, 65_536)] == [1, 1, 2, 8, 9, 15, 16, 16, 17]


class Kept(io.BytesIO):
    def close(self):
        self.flush()


def test_token_file_random_access():
    rng, sink = np.random.default_rng(3), Kept()
    writer, docs = bitpack.TokenWriter(sink, 15, block=64), []
    for k in range(40):
        ids = rng.integers(0, 1 << 15, int(rng.integers(1, 300))).astype(np.uint32)
        docs.append(ids)
        writer.add([None if k == 0 else k], np.array([len(ids)]), ids)
    writer.close()
    file, flat = bitpack.TokenFile(Kept(sink.getvalue())), np.concatenate(docs)
    assert file.doc_ids == [None, *range(1, 40)] and file.total == len(flat)
    for _ in range(200):
        lo, hi = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert (file.ids(lo, hi) == flat[lo:hi]).all()
    assert all((file.document(k) == d).all() for k, d in enumerate(docs))
    assert np.concatenate([x for *_, x in file.documents(100)]).tolist() == flat.tolist()


def brute_ids(path, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["alpha", "Beta", "ñu", "über", "12345", "\n\n", "  ", "　", "<|endoftext|>", "don't", "日本", "🙂", "$$$", " x"]
    rows = [(k * 3, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(150)]
    return [*rows, (500, None), (501, ""), (502, " \n\t"), (None, "a null id"), (503, " ".join(rng.choices(words, k=20_000))), (504, "x" * 5000)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_round_trip(spark, corpus, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in corpus], "doc_id long, text string, start long, path string, tie string").repartition(5)
    got = sorted((tuple(r) for r in bitpack.token_round_trip(docs, tokenizer=path, file_ids=4000).collect()), key=lambda r: r[1])
    assert got == brute_ids(path, corpus, bitpack.END_ID)


def test_token_rows_that_repeat(spark):
    rows = [(5, "same text")] * 40 + [(5, "another")] * 3 + [(4, "first")]
    got = sorted((tuple(r) for r in bitpack.token_round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: r[1])
    want = brute_ids(bitpack.default_tokenizer(), rows, bitpack.END_ID)
    assert sorted((r[0], *r[2:]) for r in got) == sorted((r[0], *r[2:]) for r in want)
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()] and got[0][0] == 4


def test_token_files_of_nothing(spark):
    assert bitpack.token_round_trip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
