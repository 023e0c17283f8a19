"""Substring dedup (operator 7): repeated-phrase automata.

A window is ``window`` consecutive words of one document; every word covered by a window whose word sequence also starts
anywhere else is removed. Hashing confirms which passages recur; automata locate them.

1. Anchors. Of the ``phrase``-word phrases inside a window, the one with the smallest hash is its anchor. Equal windows
   have equal anchors, so a window can recur only if its anchor phrase does. About one position in fourteen is an anchor,
   and only these are counted over the corpus.
2. Copies. Documents of equal word sequence are one class; a class of several with a window loses all its words, and only
   one of its rows goes on, to stand for the class.
3. Confirmed passages. Windows over recurring anchors are counted by a 128-bit digest of their words. A window counted
   twice or more is confirmed and owned by one document; runs of windows that a document owns are its passages. So every
   confirmed window lies in one passage, and every window of a passage is confirmed.
4. Sharded automata. The passages of an owner go to one shard of bounded words. A shard interns the words of its passages
   and compiles an Aho-Corasick automaton over phrases of word numbers, so chosen that each window of a passage holds one:
   the rarest phrase of the shard that will do. Every document streams whole through the automata of the shards whose
   owners it shares a counted window with, and through no other, as no passage there can occur in it. Each phrase found is
   extended word by word along its passage; an extent of ``window`` words or more is an occurrence, and its words go.

A shard that very many documents reach is compiled in several tasks, which share its documents. Counts are pre-aggregated
before they are shuffled, and joins are between plain scans, so that Spark splits hot phrases.

Defined results: null and empty texts have no words; rows with a null id are documents like others; repeated rows are
copies of each other; texts under ``window`` words are never touched.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import ASIS, BLANK_WORDS, U64, Scratch, longs, mix, roll, text_buffer, word_slices

WINDOW = 35
PHRASE = 8
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sliding(values: np.ndarray, size: int, best=np.minimum) -> np.ndarray:
    """best over each run of ``size`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= size:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = size - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(hashes: np.ndarray, grams: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions that are the anchor of some window, anchor hash of each window) of one document.

    ``grams`` are hashes of the document's phrases; ties within a window are all anchors.
    """
    width = window - phrase + 1
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = sliding(grams, width)
    # a phrase is an anchor if the largest minimum among windows over it is itself
    padded = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    return np.flatnonzero(sliding(padded, width, np.maximum) == grams), least


def sequence_digest(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    return int(mix(np.array([np.bitwise_xor.reduce(mix(hashes + mix(np.arange(len(hashes), dtype=U64)))) + U64(len(hashes))], U64)).view(np.int64)[0])


def window_digests(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words of each window."""
    if len(hashes) < window:
        return np.zeros(0, U64), np.zeros(0, U64)
    return roll(hashes, window), roll(mix(hashes ^ U64(0x6A09E667F3BCC909)), window)


def _documents(column: pa.Array, phrase: int):
    """row, word hashes, phrase hashes, raw text of each text of a column."""
    data, offsets = text_buffer(column)
    for lo, hi, w in word_slices(column, BLANK_WORDS, ASIS):
        grams, _ = w.grams(phrase)
        for i in range(lo, hi):
            a, b = int(w.first[i - lo]), int(w.first[i - lo + 1])
            yield i, w.hash[a:b], grams[a : max(a, b - phrase + 1)], data[offsets[i] : offsets[i + 1]]


def _survey(window: int, phrase: int):
    def run(batches):
        for batch in batches:
            n, digest, sha, found = [], [], [], []
            for _, h, grams, raw in _documents(batch.column(2), phrase):
                n.append(len(h))
                digest.append(sequence_digest(h))
                sha.append(hashlib.sha256(b" ".join(raw.tobytes().split())).hexdigest())
                at, _ = anchors(h, grams, window, phrase)
                found.append(grams[at].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_words", "digest", "full_sha", "anchors"],
            )

    return run


def _chosen(batch, phrase: int):
    """Documents of a batch (text, key, digest, ...) whose text is the one of the digest."""
    digests = batch.column(2).to_pylist()
    for i, h, grams, raw in _documents(batch.column(0), phrase):
        if sequence_digest(h) == digests[i]:
            yield i, h, grams, raw


def _values(lists, i: int) -> np.ndarray:
    return np.asarray(lists[i].values, np.int64).view(U64)


def _window_counts(window: int, phrase: int):
    """Digest and count (2: more than once) of each window over a recurring anchor of its document."""

    def run(batches):
        for batch in batches:
            keys, recurring = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3)
            out = []
            for i, h, grams, _ in _chosen(batch, phrase):
                _, least = anchors(h, grams, window, phrase)
                wanted = np.isin(least, _values(recurring, i))
                one, two = window_digests(h, window)
                one, first, count = np.unique(one[wanted], return_index=True, return_counts=True)
                out.append((one, two[wanted][first], np.minimum(count, 2), int(keys[i])))
            if out:
                size = [len(o[0]) for o in out]
                yield pa.RecordBatch.from_arrays(
                    [longs(np.concatenate([o[0] for o in out])), longs(np.concatenate([o[1] for o in out])), pa.array(np.repeat([o[3] for o in out], size), pa.int64()), pa.array(np.concatenate([o[2] for o in out]), pa.int64())], names=["w1", "w2", "key", "n"]
                )

    return run


# ------------------------------------------------------------------ passages


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _passages(window: int, phrase: int, shard_words: int):
    """Passages (words joined by one blank) of documents that own confirmed windows.

    Long passages are cut, with an overlap that leaves no window out; ``cut`` numbers the shard's worths of an owner.
    """
    most_words = max(shard_words // 8, 1)

    def run(batches):
        for batch in batches:
            keys, owned, out = batch.column(1).to_numpy(zero_copy_only=False), batch.column(3), []
            for i, h, _, raw in _chosen(batch, phrase):
                start, end = runs_of(np.isin(window_digests(h, window)[0], _values(owned, i)))
                words, before = raw.tobytes().split(), 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    for lo in range(a, b, most_words):
                        hi = min(lo + most_words, b)  # windows lo..hi
                        own = words[lo : hi + window - 1]
                        out.append((int(keys[i]), before // shard_words, b" ".join(own).decode(), len(own)))
                        before += len(own)
            kinds = {"owner": pa.int64(), "cut": pa.int64(), "passage": pa.string(), "words": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return run


# ------------------------------------------------------------------ automata


class PhraseAutomaton:
    """Aho-Corasick over phrases of the word numbers of some passages; finds every occurrence of their windows in a text."""

    def __init__(self, passages: list[bytes], window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.number: dict[bytes, int] = {}  # 0 is any word of no passage, 1 stands between passages
        ids, starts = [1], []
        for p in passages:
            starts.append(len(ids))
            ids += [self.number.setdefault(w, len(self.number) + 2) for w in p.split(b" ")]
            ids.append(1)
        self.ids = ids
        self.places: dict[tuple, list[int]] = {}
        for at in self._choose(np.array(ids, U64), starts):
            self.places.setdefault(tuple(ids[at : at + phrase]), []).append(at)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, places in self.places.items():
            self.automaton.add_word(words, places)
        if self.places:
            self.automaton.make_automaton()

    def _choose(self, ids: np.ndarray, starts: list[int]) -> list[int]:
        """Positions of phrases so that every window of a passage holds one; rare phrases first, then late ones."""
        width, out = self.window - self.phrase + 1, []
        if len(ids) < self.phrase:
            return out
        _, which, count = np.unique(roll(mix(ids), self.phrase), return_inverse=True, return_counts=True)
        often = count[which.ravel()]
        for a, b in zip(starts, [*[s - 1 for s in starts[1:]], len(ids) - 1], strict=True):
            at = a  # the first window that holds no phrase yet
            while at + self.window <= b:
                part = often[at : at + width]
                pick = at + width - 1 - int(part[::-1].argmin())
                out.append(pick)
                at = pick + 1
        return out

    def occurrences(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Word spans (start, end) of the text that equal at least a window of a passage."""
        if not self.places or len(words) < self.window:
            return []
        number, theirs, out = self.number, self.ids, []
        mine = list(map(number.get, words, repeat(0)))
        done: dict[int, int] = {}  # of each alignment, where it was last followed to
        for last, places in self.automaton.iter(tuple(mine)):
            p = last - self.phrase + 1
            for q in places:
                if done.get(q - p, -1) > p:
                    continue
                left, right = _reach_back(mine, p, theirs, q), _reach(mine, p, theirs, q)
                done[q - p] = p + right
                if left + right >= self.window:
                    out.append((p - left, p + right))
        return out


def _reach(a: list[int], i: int, b: list[int], j: int, step: int = 32) -> int:
    """How many words agree from a[i] and b[j] on."""
    n, most = 0, min(len(a) - i, len(b) - j)
    while n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
    while n < most and a[i + n] == b[j + n]:
        n += 1
    return n


def _reach_back(a: list[int], i: int, b: list[int], j: int) -> int:
    """How many words agree before a[i] and b[j]."""
    n, most = 0, min(i, j)
    while n < most and a[i - n - 1] == b[j - n - 1]:
        n += 1
    return n


def _locate(window: int, phrase: int):
    """Streams the documents of each (shard, part) through the automaton of the passages that come before them."""

    def run(batches):
        here, passages, automaton = None, [], None
        for batch in batches:
            shard, part, keys, texts = (batch.column(k).to_pylist() for k in range(4))
            out_key, out_span = [], []
            for s, r, key, text in zip(shard, part, keys, texts, strict=True):
                if (s, r) != here:
                    here, passages, automaton = (s, r), [], None
                if key is None:  # null keys sort first: a passage
                    passages.append(text.encode())
                    continue
                if automaton is None:
                    automaton, passages = PhraseAutomaton(passages, window, phrase), []
                spans = automaton.occurrences(text.encode().split())
                if spans:
                    out_key.append(key)
                    out_span.append([x for span in spans for x in span])
            yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out_span, pa.list_(pa.int64()))], names=["key", "spans"])

    return run


def _remove(window: int, phrase: int):
    """Documents without the words of their spans."""

    def run(batches):
        for batch in batches:
            keys, spans = batch.column(1), batch.column(3)
            row, removed, sha, text = [], [], [], []
            for i, h, _, raw in _chosen(batch, phrase):
                ends = np.asarray(spans[i].values, np.int64)
                cover = np.zeros(len(h) + 1, np.int64)
                np.add.at(cover, ends[::2], 1)
                np.add.at(cover, ends[1::2], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = b" ".join(w for w, g in zip(raw.tobytes().split(), gone.tolist(), strict=True) if not g)
                row.append(i)
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                text.append(kept.decode())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string())], names=["key", "n_removed", "kept_sha256", "kept_text"])

    return run


# ------------------------------------------------------------------ the operator


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, phrase: int = PHRASE, shard_words: int = 200_000, part_words: int = 2_000_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (and kept_text: null where nothing was removed).

    An automaton holds about ``shard_words`` words of passages and streams about ``part_words`` words of documents.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    survey = scratch.settle(source.mapInArrow(_survey(window, phrase), "doc_id long, key long, n_words long, digest long, full_sha string, anchors array<long>"), "survey")
    judged = survey.where(F.col("n_words") >= window)
    same = ["digest", "n_words", "full_sha"]
    copies = scratch.settle(judged.groupBy(*same).agg(F.min("key").alias("key"), F.count("*").alias("copies")), "classes")

    # one text of each class goes on
    ids = judged.groupBy("key", "digest").agg(F.min("doc_id").alias("doc_id"))
    lone = scratch.settle(copies.join(ids, ["key", "digest"]).select("key", "digest", "copies", "doc_id", "n_words"), "lone")
    spread = judged.select("doc_id", "key", "digest", "anchors").join(lone.select("key", "digest", F.col("doc_id").alias("_id")), ["key", "digest"]).where(F.col("doc_id").eqNullSafe(F.col("_id")))
    spread = scratch.settle(spread.dropDuplicates(["key", "digest"]).select("key", F.explode("anchors").alias("anchor")), "anchors")
    recurring = scratch.settle(spread.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "recurring")
    met = scratch.settle(spread.join(recurring, "anchor"), "met")
    per_doc = met.groupBy("key").agg(F.collect_set("anchor").alias("recurring"))

    keyed = lone.withColumnRenamed("doc_id", "_id").join(per_doc, "key")
    texts = source.join(keyed, "key").where(F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "key", "digest", "recurring", "copies", "n_words")
    texts = scratch.settle(texts, "texts")
    scratch.drop(spread)

    counts = scratch.settle(texts.select("text", "key", "digest", "recurring").mapInArrow(_window_counts(window, phrase), "w1 long, w2 long, key long, n long"), "windows")
    owners = counts.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min("key").alias("owner")).where("n > 1").select("w1", "w2", "owner")
    owners = scratch.settle(owners, "owners")
    meets = scratch.settle(counts.select("w1", "w2", "key").join(owners, ["w1", "w2"]).select("key", "owner").distinct(), "meets")
    owned = scratch.settle(owners.groupBy(F.col("owner").alias("key")).agg(F.collect_list("w1").alias("owned")), "owned")
    scratch.drop(counts, owners)
    passages = texts.select("text", "key", "digest").join(owned, "key").select("text", "key", "digest", "owned")
    passages = scratch.settle(passages.mapInArrow(_passages(window, phrase, shard_words), "owner long, cut long, passage string, words long"), "passages")

    total = passages.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    sharded = passages.withColumn("shard", F.pmod(F.xxhash64("owner", "cut"), F.lit(total // shard_words + 1)))
    # a class of copies loses all its words anyway; other documents go to the shards of the passages that they meet
    open_ = texts.where("copies = 1").select("text", "key", "digest", "n_words")
    reach = meets.join(sharded.select("shard", "owner").distinct(), "owner").select("key", "shard").distinct()
    reach = scratch.settle(reach.join(open_.select("key", "n_words"), "key"), "reach")
    parts = reach.groupBy("shard").agg(F.ceil(F.sum("n_words") / part_words).cast("int").alias("parts"))
    parts = scratch.settle(parts, "parts")
    shaped = ["shard", "part", "key", "text"]
    each = sharded.join(parts, "shard").withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "key": F.lit(None).cast("long"), "text": F.col("passage")}).select(shaped)
    dealt = reach.select("key", "shard").join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("key", "shard"), "parts").cast("int"))
    streamed = dealt.join(open_.select("key", "text"), "key").select(shaped)
    found = each.unionByName(streamed).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("key").asc_nulls_first()).mapInArrow(_locate(window, phrase), "key long, spans array<long>")
    found = scratch.settle(found, "found")

    spans = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    worked = open_.join(spans, "key").select("text", "key", "digest", "spans").mapInArrow(_remove(window, phrase), "key long, n_removed long, kept_sha256 string, kept_text string")
    worked = worked.select("key", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []))
    worked = scratch.settle(worked, "worked")

    rows = survey.select("doc_id", "n_words", "digest", "full_sha", F.col("key").alias("_key")).join(copies, same, "left").join(worked, "key", "left")
    copy = F.coalesce(F.col("copies"), F.lit(1)) > 1
    out = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "full_sha")).alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    result = scratch.settle(rows.select(*out), "result")
    scratch.keep(result)
    return result


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, k, md5(array_to_string(w[k : k + 34], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS k FROM d WHERE len(w) >= 35)
), hit AS (SELECT doc_id, k FROM win SEMI JOIN (SELECT g FROM win GROUP BY g HAVING count(*) > 1) USING (g)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(k, k + 34)) AS p FROM hit)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (
  SELECT word.doc_id, string_agg(word.x, ' ' ORDER BY word.p) AS t
  FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY 1
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
