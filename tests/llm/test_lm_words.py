"""What the language model knows of single words: contexts decide between words of one class."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sourcerank.llm import lm_score
from sourcerank.llm.common import id_and_text

from .conftest import frame

HABITS = {"red": "apple", "blue": "ocean", "cold": "winter", "warm": "summer"}


@pytest.fixture(scope="module")
def habits(spark):
    """Texts in which every second word follows from the one before; all words are equally frequent."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"{w} {HABITS[w]}" for w in rng.choices(list(HABITS), k=60)), "en") for k in range(400)]
    rows += [(900, " ".join(f"{a} {b}" for a, b in HABITS.items()), "en")]
    rows += [(901, " ".join(f"{a} {b}" for a, b in zip(HABITS, reversed(HABITS.values()), strict=True)), "en")]
    return id_and_text(frame(spark, rows).repartition(2))


def test_context_decides_between_words_of_one_class(habits):
    lex = lm_score.lexicon(lm_score.word_counts(habits), classes=1)
    assert len(set(lex.classes[: len(lex.hashes)])) == 1
    net = lm_score.trained(habits, lex, share=1.0)
    got = {r.doc_id: r.mean_log_prob for r in lm_score.scored_with(habits, lex, net).filter("doc_id >= 900").collect()}
    assert got[900] > got[901] + 0.5


def test_words_of_a_class_add_up_in_every_context(habits):
    lex = lm_score.lexicon(lm_score.word_counts(habits), classes=2)
    net = lm_score.trained(habits, lex, share=1.0)
    ((hashes, first),) = lm_score.texts_words(pa.array(["red apple cold"]))
    contexts, known = lex.numbers(hashes), np.arange(len(lex.hashes))
    chances = np.array([net.log_chances(np.array([contexts[0], k, contexts[2]]), first, lex)[1] for k in known])
    alone = lm_score.Network(net.vectors, net.places, net.out)
    shares = np.array([alone.log_chances(np.array([contexts[0], k, contexts[2]]), first, lex)[1] for k in known])
    for c in set(lex.classes[known]):
        here = lex.classes[known] == c
        assert np.exp(chances[here]).sum() == pytest.approx(np.exp(shares[here]).sum(), rel=1e-4)
    assert np.abs(chances - shares).max() > 0.1


def test_vocabulary_and_buckets_follow_from_the_corpus(spark):
    small, large = (spark.createDataFrame([(1, n)], "word long, n long") for n in (10**6, 10**9))
    assert lm_score.sizes(small)[0] < lm_score.sizes(large)[0]
    assert lm_score.sizes(small)[1] < lm_score.sizes(large)[1]


def test_rare_words_have_the_shares_of_their_counts(habits):
    counts = lm_score.word_counts(habits)
    lex = lm_score.lexicon(counts, vocabulary=3, counted=True)
    net = lm_score.trained(habits, lex)
    n = {np.int64(r.word): r.n for r in counts.collect()}
    texts = {r.doc_id: r.text for r in habits.filter("doc_id < 6 or doc_id >= 900").collect()}
    got = {r.doc_id: r for r in lm_score.scored_with(habits, lex, net, counts).collect()}
    assert len(got) == habits.count()
    for i, t in texts.items():
        ((hashes, first),) = lm_score.texts_words(pa.array([t]))
        numbers = lex.numbers(hashes)
        buckets = np.bincount(lex.numbers(np.array(list(n)).view(np.uint64)), list(n.values()), lex.pad)
        shares = [np.log(n[w] / buckets[k]) if k >= 3 else 0 for w, k in zip(hashes.view(np.int64), numbers, strict=True)]
        context = net.log_chances(numbers, first, lex) - lex.rest[numbers]
        assert got[i].n_tokens == len(numbers) and got[i].log_prob == pytest.approx(context.sum() + sum(shares), rel=1e-5)


def test_repeated_and_missing_ids_keep_their_own_scores(spark):
    rows = [(None, "one two two", "en"), (None, "three", "en"), (5, "one", "en"), (5, "four four five", "en"), (6, None, "en")]
    got = lm_score.scored(frame(spark, rows).repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (0, 3), (5, 1), (5, 3), (6, 0)]
    assert all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in got)


def test_a_step_tells_what_it_used():
    words, sizes = np.arange(1, 41, dtype=np.uint64), np.arange(40, 0, -1).astype(float)
    classes = np.repeat([0, 1], 20)
    lex = lm_score.Lexicon(words, np.append(classes, np.arange(2, 2 + lm_score.RARE)), np.zeros(48), *lm_score.trees(np.append(classes, np.arange(2, 2 + lm_score.RARE)), np.append(sizes, np.ones(lm_score.RARE))), np.zeros(48))
    net = lm_score.Network.fresh(lex.pad, 2 + lm_score.RARE, odds=lex.odds)
    numbers = np.random.default_rng(1).integers(0, 48, 500)
    contexts = net.contexts(numbers, np.array([0, 200, 200, 500]))
    met = contexts.ravel(), lex.nodes[lex.ways(numbers)[0]]
    told = net.step(contexts, numbers, lex, net.blank_squares(), 0.05)
    for rows, (used, times) in zip(met, told, strict=True):
        want = np.unique(rows, return_counts=True)
        assert used.tolist() == want[0].tolist() and times.tolist() == want[1].tolist()
