"""Mixing, alignment and lexical search on small tables and against brute force; repeated ids, long labelled texts."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sylvaframe.llm import alignment, lexical, mixing, ngram_join, queries, quality_rules, topk, toxicity
from sylvaframe.llm._common import labelled_sample

SCHEMA = "doc_id long, text string, source string, size int, shard int, draws string, target double, id long, h long, item string, rank int"
EXTRA = (1, 2, "d", 0.5, 3, 4, "i", 5)
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma,", "été", "naïve", "x", "<|endoftext|>", "<s>", "<0x41>", "it's", "12", "::", "漢字", "▁", "Ᲊ", "\x1c", "ﬁ", "\xa0"]
    plain = ["alpha", "beta", "gamma", "delta", "one", "two", "12", "été"]
    say = lambda n, some=words: "".join(rng.choice(some) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))
    copy = say(40, plain)
    texts = [None, "", " ", "\n", "one", copy, copy, copy + "tail", "a" * 3000, " " * 2500 + "x", say(20_000, plain), "the " * 50]
    texts += [say(rng.randrange(1, 60), plain if i % 2 else words) for i in range(120)]
    found = [(i, t, ["src0", "src0", "b", "a", None, "été"][i % 6], *EXTRA) for i, t in enumerate(texts)]
    return found + [found[20]] * 3 + [(None, "alpha beta", "a", *EXTRA), (7, "another text of id seven", "b", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def reshared(sizes, weights, share, most):
    """Targets by sharing the excess again until none is above its limit."""
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if unit * weights[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ -= full
    return target


def test_hypergeometric_draws(spark):
    n, k, d, times = 40, 12, 15, 20_000
    u = F.shiftrightunsigned(F.xxhash64(F.col("id")), 11) * 2.0**-53
    drawn = spark.range(times).select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), u).alias("x")).groupBy("x").count().collect()
    for r in drawn:
        p = math.comb(k, r["x"]) * math.comb(n - k, d - r["x"]) / math.comb(n, d)
        assert abs(r["count"] - times * p) < 5 * math.sqrt(times * p) + 5
    edge = [(5, 5, 3, 3), (5, 0, 3, 0), (7, 3, 7, 3), (7, 3, 0, 0), (1, 1, 1, 1)]
    frame = spark.createDataFrame(edge, "n long, k long, d long, want long")
    assert all(r["got"] == r["want"] for r in frame.withColumn("got", mixing.hypergeometric(F.col("n"), F.col("k"), F.col("d"), F.lit(0.7))).collect())


def test_splitting_tree_adds_up(spark):
    quotas = spark.createDataFrame([(0, 300), (1, 0), (2, 41), (3, 7)], "place int, blocks long")
    for shards in (1, 3, 16):
        leaves = mixing.splitting_tree(quotas, shards, 1).collect()
        by_place, by_shard = Counter(), Counter()
        for r in leaves:
            by_place[r["place"]] += r["quota"]
            by_shard[r["shard"]] += r["quota"]
        assert by_place == {0: 300, 2: 41, 3: 7} and max(by_shard.values()) - min(by_shard[i] for i in range(shards)) <= 1


def test_mix(docs, none, rows):
    mixed = mixing.mix(docs, shards=5, blocks=64, keep=("doc_id", "source", "text")).cache()
    got = mixed.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), words(r[1])) for r in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += sum(d["words"] for d in r["draws"])
        target[r["source"]] = r["target"]
        assert len({d["pass"] for d in r["draws"]}) == len(r["draws"]) and all(0 < d["words"] <= r["size"] and 0 <= d["shard"] < 5 for d in r["draws"])
        assert sum(d["words"] for d in r["draws"]) <= 2 * r["size"] and r["source_size"] > 0
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = reshared([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)
    for s, t in zip(order, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 4  # equal rows at the cut share its words evenly
    again = mixing.mix(docs.repartition(7), shards=5, blocks=64, keep=("doc_id", "source", "text"))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    parts = mixing.shards_of(mixed, text_col="text").collect()
    assert len(parts) == sum(len(r["draws"]) for r in got)
    places = defaultdict(list)
    for r in parts:
        places[r["shard"]].append(r["place"])
        assert words(r["text"]) == r["words"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert mixing.mix(none).count() == 0


def test_mix_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(queries.OP11_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op11_mix_sources(spark, sf).collect()) == want


def plain_alignment(rows):
    """Each row's tokens, groups and links by the libraries and double loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    t, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    level = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    found = []
    for r in rows:
        text = r[1] or ""
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        ends = []
        for parts in ([bytes(level[c] for c in t.id_to_token(i)) for i in a], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]):
            if b"".join(parts) != (" " + text).encode():
                a, b = [], []
            ends.append(np.cumsum([len(p) for p in parts]).tolist())
        ea, eb = ends if a else ([], [])
        cuts, links, groups, last, i, j = sorted(set(ea) & set(eb)), [], [], 0, 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            step_a, step_b = ea[i] <= eb[j], eb[j] <= ea[i]
            i, j = i + step_a, j + step_b
        for c in cuts:
            groups.append(([x for x, e in zip(a, ea) if last < e <= c], [x for x, e in zip(b, eb) if last < e <= c]))
            last = c
        found.append((r[0], a, b, links, groups))
    return found


def test_alignment(docs, none, rows):
    rows = [r for r in rows if len(r[1] or "") < 20_000]
    plain = plain_alignment(rows)
    count = Counter(p for x in plain for p in set(x[3]))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = []
    for doc_id, a, b, links, groups in plain:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((str(doc_id), len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    table = docs.where("text is null or length(text) < 20000")
    for limit in (1 << 20, 0):  # counts by a broadcast and by a shuffle
        got = [(str(r[0]), *r[1:]) for r in alignment.align(table, A, B, batch_bytes=3000, broadcast_rows=limit).collect()]
        assert sorted(got) == sorted(want)
    assert sum(w[1] == 0 for w in want) > 5 and alignment.align(none, A, B).count() == 0
    pairs = alignment.occurrences(table.where("doc_id = 5"), A, B).collect()
    text = next(r[1] for r in rows if r[0] == 5)
    assert sum(r["weight"] for r in pairs) == len((" " + text).encode()) and len(pairs) == len(plain[5][3])
    shared = alignment.occurrences(table.where("doc_id = 5"), A, B, shared=True).count()
    assert shared == sum(len(x) * len(y) for x, y in plain[5][4])


def test_products_of_sparse_matrices():
    rng = np.random.default_rng(3)
    for _ in range(30):
        dense = [(rng.random((rng.integers(1, 9), 7)) < 0.4) * rng.integers(1, 4, 7) for _ in range(2)]
        a, b = (alignment.Csr(alignment.offsets((m > 0).sum(1)), np.nonzero(m)[1].astype(np.int32), m[m > 0].astype(np.int32), 7) for m in dense)
        rows, columns, values = alignment.product(a, b.transposed())
        out = np.zeros((len(dense[0]), len(dense[1])), int)
        out[rows, columns] = values
        assert (out == dense[0] @ dense[1].T).all()
        assert alignment.row_sizes(a, b.transposed()).tolist() == ((dense[0] > 0).astype(int) @ (dense[1] > 0).sum(0)).tolist()


def plain_ranking(items, docs, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n, length, df = len(counted), sum(c.total() for _, c in counted), Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in counted:
            m = 50 + 50 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in set(split(text)) if w in c)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_lexical_search(spark, docs, none, rows):
    items = [(1, "alpha beta Gamma delta"), (2, None), (3, "..."), (4, "été 漢字 zzz"), (5, rows[40][1]), (6, "the THE tail"), (6, "the THE tail")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("s"))
    want = plain_ranking(sorted(set(items), key=str), [r[:2] for r in rows], 10)
    for blocks in ({}, {"item_block": 2, "block_rows": 64, "block_bits": 1 << 14, "broadcast_rows": 0}):
        got = lexical.rank(table, docs, k=10, **blocks)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and sorted(map(tuple, got.collect())) == want
    assert lexical.rank(table, none).count() == 0 and lexical.rank(table.limit(0), docs).count() == 0


def test_bounds_are_never_below_scores(rows):
    texts = [r[1] for r in rows if lexical.terms(r[1])]
    signer = lexical.Signer()
    n, most, widths, bits = signer.sign(texts)
    owned = lexical.Queries.of([(1, texts[30]), (2, "alpha beta x"), (3, "absent")], len(texts), sum(n))
    owned = owned.weighted({t: sum(w in set(lexical.terms(x)) for x in texts) for t, w in enumerate(owned.words)})
    import pyarrow as pa

    loose = 0
    for width in set(widths):
        some = [i for i, w in enumerate(widths) if w == width]
        block = pa.table({"id": some, "h": some, "n": [n[i] for i in some], "most": [most[i] for i in some], "width": [width] * len(some), "bits": [bits[i] for i in some]})
        bound = owned.bounds(lexical.sliced(block).to_pylist()[0], range(3))
        for place, i in enumerate(some):
            exact = owned.scores(texts[i], np.arange(3))
            assert (bound[:, place] >= exact).all()
            loose += int((bound[:, place] > 0).sum() - (exact > 0).sum())
    assert loose < len(texts)


def test_joins_keep_different_texts_of_one_id(spark):
    say = lambda k: " ".join(f"{k}{i}" for i in range(60))
    docs = spark.createDataFrame([(1, say("a")), (1, say("b")), (2, say("a") + " end"), (3, say("b") + " end"), (3, say("b") + " end")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_links"], r["class_id"]) for r in ngram_join.ngram_join(docs).collect()}
    assert got == {(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1)}


def test_top_k_of_repeated_ids_and_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in rng.integers(0, 20, 60)] + [(0, [1.0] * 6)] * 9 + [(5, [1.0] * 6)] * 7 + [(9, [1.0] * 6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for scale, factor in ((1, 1), (1, 2**28 + 1)):
        large = table.withColumn("embedding", F.transform("embedding", lambda x: x * factor))
        got = sorted(map(tuple, topk.top_k(large, F.col("id") % 5 == 0, k=4, scale=scale, candidate_block=8, query_block=4).collect()))
        want = []
        for q in sorted({i for i, _ in rows if i % 5 == 0}):
            pairs = sorted((-sum(int(x) * int(y) for x, y in zip(v, w)) * factor * factor, j) for i, v in rows if i == q for j, w in rows if j != q)
            want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(pairs[:4])]
        assert got == sorted(want)


def test_a_long_labelled_text_leaves_the_others_in(spark):
    docs = spark.createDataFrame([(i, ("bad words here " if i % 2 else "good plain text ") * (5000 if i == 3 else 4)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, labels["quality"], 100, 10_000, "doc_id", "text")
    assert sorted(r["doc_id"] for r in sample.collect()) == [i for i in range(40) if i != 3]
    assert toxicity.train(docs, labels, max_chars=10_000) is not None
    for train in (toxicity.train, quality_rules.train):
        with pytest.raises(ValueError):
            train(docs, labels, max_chars=70)
