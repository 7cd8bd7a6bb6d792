"""Operators over documents against brute force on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sourcerank.llm import decontaminate, jaccard_join, packing, suffix_dedup, token_output
from sourcerank.llm.subwords import Encoder, tokenizer_file

from .conftest import frame


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_file())


def test_encoder_equals_library(library, texts):
    odd = ["", " ", "  a", "a \n b", "it's     x", "<|endoftext|> y", "a\t b", "x. 　y", " lead", "trail ", "日 本", "a\n\n b\n"]
    every = odd + [t for _, t, _ in texts if t]
    got = Encoder(tokenizer_file()).encode(every)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in every]


def test_new_words_are_learned_as_arrays(library):
    words = ["", "a b", "plain", "end.", "é,", "²;", "٣.", "...", "x<|endoftext|>,", "7!?", "tab\tin.", "plain.", "end"]
    encoder = Encoder(tokenizer_file())
    encoder.encode(["some plain words"])
    ids, sizes = encoder._learn(pa.array(words, pa.large_string()))
    want = [library.encode(" " + w, add_special_tokens=False).ids for w in words]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_ids_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 70_000):
        ids = rng.integers(0, 70_000, n).astype("<u4")
        assert (token_output.unpack_ids(*token_output.pack_ids(ids), n) == ids).all()


def test_token_files(spark, docs, no_docs, texts, library):
    got = token_output.token_table(docs, tokenizer_file(), segment_ids=500).orderBy("start").collect()
    want, start = [], 0
    for i, t, _ in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_output.token_table(no_docs, tokenizer_file()).count() == 0


def test_packing(docs, no_docs, texts, library):
    size = 128
    rows = packing.packed(docs, tokenizer_file(), 2, size).collect()
    wanted = Counter()
    for i, t, _ in texts:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(held) <= 1.05 * -(-sum(r.length for r in rows) // size) + 1
    assert packing.packed(no_docs, tokenizer_file()).count() == 0


def test_plan_covers_any_histogram():
    rng = np.random.default_rng(3)
    for counts in (np.zeros(65, int), rng.integers(0, 50, 65), np.eye(65, dtype=int)[3] * 7, np.eye(65, dtype=int)[64] * 9):
        counts[0] = 0
        runs = packing.plan(counts)
        for n in range(1, 65):
            starts = runs[runs[:, 0] == n, 1].tolist()
            assert (starts[:1] == [0]) == bool(counts[n]) and len(set(starts)) == len(starts)


def brute_links(texts, width, threshold):
    sets = []
    for _, t, _ in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and shared >= threshold * (len(sets[a]) + len(sets[b]) - shared):
                up[top(a)] = top(b)
    least = defaultdict(list)
    for k, (i, _, _) in enumerate(texts):
        if i is not None:
            least[top(k)].append(i)
    return Counter((i, len(sets[k]), min(least[top(k)], default=i)) for k, (i, _, _) in enumerate(texts))


@pytest.mark.parametrize("width, threshold", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_jaccard_join(docs, texts, width, threshold):
    got = Counter(tuple(r) for r in jaccard_join.linked(docs, width, threshold).collect())
    assert got == brute_links(texts, width, threshold)


def test_jaccard_join_of_nothing(no_docs):
    assert jaccard_join.linked(no_docs).count() == 0


def test_fragments_of_linked_sets_agree():
    rng = np.random.default_rng(2)
    threshold = Fraction(9, 10)
    for n in (9, 12, 40, 300):
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone = rng.integers(0, n // 9 + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, max(0, n // 19 - gone)).astype(np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if shared >= threshold * (len(a) + len(b) - shared) and len(a) + len(b) > 2 * shared:
                keys = [jaccard_join.fragment_keys(x, threshold) for x in (a, b)]
                assert len(np.intersect1d(*keys))


def brute_repeats(texts, length):
    raws = [(t or "").encode() for _, t, _ in texts]
    times = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for (i, _, _), r in zip(texts, raws):
        spans = []
        for k in range(len(r) - length + 1):
            if times[r[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + r[at:a], b
        kept += r[at:]
        out.append((i, len(r), len(r) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot_blocks", [4096, 1])
def test_repeated_strings(docs, texts, hot_blocks):
    found = suffix_dedup.digest(suffix_dedup.repeats(docs, 200, hot_blocks=hot_blocks))
    assert Counter(tuple(r) for r in found.collect()) == brute_repeats(texts, 200)


def test_kept_bytes_as_text(spark):
    """A character that lost bytes goes wholly."""
    shared = "é" * 99 + "x" * 4
    rows = [(1, "a" + shared + "é" * 3), (2, "b" + shared + "ö"), (3, "c" * 10), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    raw = {r.doc_id: r for r in suffix_dedup.repeats(docs, 200).collect()}
    text = {r.doc_id: r for r in suffix_dedup.repeats(docs, 200, as_text=True).collect()}
    assert raw.keys() == text.keys() == {r[0] for r in rows}
    for k in raw:
        assert text[k].kept == bytes(raw[k].kept).decode("utf-8", "ignore") and text[k].spans == raw[k].spans
    assert raw[1].n_removed > 0 and text[3].kept == "c" * 10 and text[4].kept == ""


def test_repeated_strings_of_nothing(no_docs):
    assert suffix_dedup.repeats(no_docs).count() == 0


def brute_matches(texts, items, window):
    word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = defaultdict(set)
    for name, t in items:
        w = re.findall(word, lower(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(name)
    out = []
    for i, t, _ in texts:
        w = re.findall(word, lower(t))
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= {str(x) for x in windows[tuple(w[k : k + n])] if x is not None}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, docs, texts, block_bytes):
    long = texts[90 % len(texts)][1] or texts[5][1]
    passage = " ".join(texts[40][1].split()[10:40])
    items = [(1, passage), (2, passage.upper() + " more words here"), (3, "river stone"), (4, ""), (5, None), (6, "The, of and"), (None, "quiet table never"), (3, "river stone"), (7, long[:400])]
    bench = spark.createDataFrame([(a, b, "x", "y") for a, b in items], "item_id long, text string, key string, n_hit string")
    got = decontaminate.digest(decontaminate.matches(docs, bench, 13, block_bytes=block_bytes))
    assert Counter(tuple(r) for r in got.collect()) == brute_matches(texts, items, 13)


def test_decontamination_of_nothing(spark, docs, no_docs, texts):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.matches(docs, bench)
    assert found.count() == len(texts) and found.filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.matches(no_docs, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench).count() == len(texts)


def test_spans_cut_the_hit_words(spark):
    docs = frame(spark, [(1, "Ä start. River  stone, end", "en")])
    bench = spark.createDataFrame([(1, "river stone")], "item_id long, text string")
    row = decontaminate.matches(docs, bench).first()
    raw = "Ä start. River  stone, end".encode()
    assert [raw[a:b] for a, b in zip(row.spans[::2], row.spans[1::2])] == [b"River  stone"]
