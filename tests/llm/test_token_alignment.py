import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sourcerank.llm import token_alignment as ta
from sourcerank.llm.subwords import Encoder, tokenizer_file

A, B = tokenizer_file(), tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def spelled(both, text):
    """(id, bytes) of both sides by the libraries themselves."""
    a, b = both
    letters = {c: k for k, c in enumerate(ta.byte_letters())}
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def told(both, text):
    """Groups and links of one text, token by token."""
    if not text:
        return "", [], 0, 0, 0
    left, right = spelled(both, text)
    raw = f" {text}".encode()
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return "", [], 0, 0, 0
    place, sides = 0, []
    for side in (left, right):
        place, spans = 0, []
        for i, x in side:
            spans.append((i, place, place + len(x)))
            place += len(x)
        sides.append(spans)
    cuts = sorted({e for _, _, e in sides[0]} & {e for _, _, e in sides[1]})
    groups, before = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, _ in side if before <= s < cut) for side in sides))
        before = cut
    links = [(i, j) for i, s, e in sides[0] for j, t, f in sides[1] if s < f and t < e]
    return ";".join(groups), links, len(left), len(right), len(groups)


def expected(both, rows):
    found = [(doc, *told(both, text)) for doc, text in rows]
    counts = Counter(link for _, _, links, *_ in found for link in links)
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    out = []
    for doc, said, links, n_a, n_b, n_groups in found:
        best = sum(counts[x] == top[x[1]] for x in links)
        out.append((doc, n_a, n_b, n_groups, len(links), best, sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=repr)


ODD = [
    "plain words, and more.",
    "two  spaces   three\n\nlines\t\ttabs ",
    " leading",
    "été 日本語 テスト 🙂🙃 ﬁ ½ é",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "a▁b ▁",
    "\x00\x01​ 　x",
    "don't we'll I'VE 123,456.78 (x) [y] {z} #tag @me $5 50%",
    "x" * 700,
    "", " ", "\n", None,
]


def test_groups_and_links_of_odd_texts(spark, both):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[0]), (None, ODD[0])]
    df = spark.createDataFrame([(d, t, 1, "x", 2.0) for d, t in rows], "doc_id long, text string, count long, part string, best double").repartition(2)
    got = sorted((tuple(r) for r in ta.scored(df, A, B, block_bytes=64).collect()), key=repr)
    assert got == expected(both, rows)


def test_a_space_at_the_end_is_a_token(spark, both):
    rows = [(k, t) for k, t in enumerate(["word ", "two words ", "ends.\n ", "12 ", "é ", "two spaces  ", "line\n", " both "])]
    got = sorted((tuple(r) for r in ta.scored(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()), key=repr)
    assert got == expected(both, rows) and all(r[1] for r in got)


def test_whole_table(spark, both):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 2000").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in table.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (10_000, ta.BLOCK_BYTES):
        got = sorted((tuple(r) for r in ta.scored(df, A, B, block_bytes=block_bytes).collect()), key=repr)
        assert got == expected(both, rows)


def test_alignments_carry_ids_and_groups(spark, both, no_docs):
    rows = [(k, t) for k, t in enumerate(ODD)]
    for r in ta.alignments(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect():
        said, _, n_a, n_b, n_groups = told(both, rows[r["doc_id"]][1])
        assert (len(r["a_ids"]), len(r["b_ids"])) == (n_a, n_b)
        groups = [["|".join(",".join(str(i) for i, g in zip(r[f"{s}_ids"], r[f"{s}_group"]) if g == k) for s in "ab")][0] for k in range(n_groups)]
        assert ";".join(groups) == said
    assert ta.alignments(no_docs, A, B).count() == 0 and ta.scored(no_docs, A, B).count() == 0


def test_coalescing_equals_common_ends():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 30)
        ends = [np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}), np.int64) for _ in range(2)]
        shared = sorted({*ends[0].tolist()} & {*ends[1].tolist()})
        for got, own in zip(ta.coalesced(*ends), ends):
            assert got.tolist() == [sum(c < e for c in shared) for e in own.tolist()]
        a, b = ta.overlaps(*ends)
        starts = [[0, *e[:-1].tolist()] for e in ends]
        want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        assert list(zip(a.tolist(), b.tolist())) == want


@pytest.mark.parametrize("plain", [False, True])
def test_word_table_equals_the_library(monkeypatch, plain):
    from sourcerank.llm import subwords

    monkeypatch.setattr(subwords, "KNOWN_WORDS", 60)
    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = plain
    mine = Encoder(A, plain=plain)
    rng = random.Random(9)
    parts = ["word", "Wort", "naïve", "日本", "12", "3.5", "½", "²", "x²", "é", "'s", "don't", ".", ",", "!!", "...", "?!", "&&&", "$$$", ")", "#", " ", "  ", "\n", "<|endoftext|>", "🙂", "_", "-", " ", "it's."]
    for _ in range(400):
        texts = ["".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 14))) for _ in range(6)]
        want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert mine.encode(texts) == want


def test_tasks_grow_with_the_blocks(docs):
    got = ta.scored(docs.repartition(40), A, B)  # a block for each partition with rows, 30 or more
    assert got.rdd.getNumPartitions() >= 30 / ta.BLOCKS_AT_ONCE  # the session has 4 shuffle partitions
    assert got.count() == docs.count()


def test_tokens_of_a_slice_stay_small():
    import pyarrow as pa

    from sourcerank.llm import common

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    column = pa.array([" ".join(rng.choices(words, k=300)) for _ in range(1400)], pa.large_string())
    both, offsets = ta.Aligner(A, B), common.bytes_of(column)[1]
    assert offsets[-1] > 2 << 20
    tracemalloc.start()
    for first, last in common.slices(offsets, ta.TOKEN_BYTES):
        t = both.tokens(column.slice(first, last - first).to_pylist())
        ta.overlaps(t["a_ends"], t["b_ends"])
        both.told(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_workers_let_the_tokenizers_go(spark, docs):
    import pyarrow as pa

    from sourcerank.llm import common

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(k[0] == "aligner" for k in common._held)], pa.int64())], ["n"])

    ta.blocks(docs.repartition(8), A, B).count()
    assert spark.range(0, 8, 1, 8).mapInArrow(kept, "n long").agg({"n": "sum"}).first()[0] == 0
