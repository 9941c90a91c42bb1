"""Cases in which a corpus operator once did less than the whole job."""

import numpy as np

from sylvaframe.llm import byte_bpe, ngram_join, toxicity


def test_toxicity_reads_the_whole_of_long_runs():
    long = "".join(chr(0x4E00 + i) for i in range(1000))
    for w in ("a", "b" * 24, long[:25], long[:47], long[:48], long):
        grams = {f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)}
        marked = [u if len(w) > 24 else f"<{u}>" for u in toxicity.units(w)]
        assert {m[i : i + n] for m in marked for n in (3, 4, 5) for i in range(len(m) + 1 - n)} == grams
        _, there = toxicity.char_grams(toxicity.units(w), 1 << 30)
        assert there.sum() == sum(max(0, len(m) + 1 - n) for m in marked for n in (3, 4, 5))
    assert toxicity.units("One two_THREE") == ["one", "two_three"]


def test_toxicity_finds_what_lies_behind_the_24th_character():
    rng = np.random.default_rng(1)
    calm = ["river", "garden", "window", "yellow", "morning", "letter", "paper", "summer"]
    texts, toxic = [], []
    for i in range(240):
        words = [*rng.choice(calm, 8)]
        if i % 2:
            words[6] = "vilescum"
        texts.append("_".join(words))
        toxic.append(i % 2)
    net = toxicity.fit(texts[:200], np.array(toxic[:200]), epochs=20)
    scores = toxicity.Scorer(net).document_logits(texts[200:])
    assert ((scores > 0) == np.array(toxic[200:], bool)).all()


def test_near_copies_of_shared_and_missing_ids(spark):
    import corpus_pipeline

    say = lambda *seeds: " ".join(f"w{s}x{k}" for s in seeds for k in range(60))
    rows = [(3, say(0)), (5, say(0) + " tail"), (5, say(1)), (5, say(2)), (None, say(1)), (None, say(3)), (None, say(3)), (None, say(3) + " end"), (None, None), (None, ""), (9, say(2)), (2, say(4)), (2, say(4))]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, class_id string, key int").repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    ends = [x for x in got if x[0] is None and x[1].startswith("w3")]
    assert len(ends) == 1 and ends[0][1] in (say(3), say(3) + " end")
    assert sorted((i or 0, t) for i, t in got if (i, t) not in ends) == sorted([(3, say(0)), (5, say(1)), (5, say(2)), (0, ""), (2, say(4))])


def test_edges_between_chunks_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = rng.integers(0, 60000, (4, 100)).astype("<u2")
        signs = base[rng.integers(0, 4, 30)]
        signs[rng.random(signs.shape) < rng.random() * 0.4] = 7
        ids, chunk = rng.permutation(1000)[:30], rng.integers(0, 3, 30)
        sides = [np.flatnonzero(chunk == k) for k in range(3)]
        every = np.arange(30)
        edges = []
        for a in range(3):
            edges += ngram_join.forest(ngram_join.plausible(signs, sides[a], sides[a], 0.7), sides[a], sides[a], ids)
            for b in range(a + 1, 3):
                linked = ngram_join.plausible(signs, sides[a], sides[b], 0.7)
                if linked.any():
                    edges += ngram_join.between(linked, sides[a], sides[b], ids, signs, 0.7)
        place = {int(x): i for i, x in enumerate(ids)}
        joined = np.eye(30, dtype=bool)
        for x, y in edges:
            joined[place[x], place[y]] = joined[place[y], place[x]] = True
        want = ngram_join.components_of(ngram_join.plausible(signs, every, every, 0.7), every, every, 30)
        got = ngram_join.components_of(joined, every, every, 30)
        assert (want == got).all()


def test_remembered_words_are_not_merged_again():
    """A remembered word with marks behind it costs no second merge; pairs are known before the first text."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = byte_bpe.Codec(path, public_tokenizers.PATTERN)
    n_pairs, merged = len(own.pairs), []
    many = own.merge_many
    own.merge_many = lambda pieces: merged.append(pieces) or many(pieces)
    texts = ["x thoninghees esboezci asosmiosciónqueado", "x thoninghees### esboezci.\nthoninghees, asosmiosciónqueado&&& aaaaaaaa bbbbbbbbbb"]
    got = [np.frombuffer(own.encode([t])[0], np.int32).tolist() for t in texts]
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert got == [library.encode_ordinary(t) for t in texts]
    again = {p for pieces in merged[1:] for p in pieces}
    assert merged and not {" thoninghees".encode(), " asosmiosciónqueado".encode()} & again and len(own.pairs) == n_pairs > 0
