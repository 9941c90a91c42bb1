"""Each corpus operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sylvaframe.llm import byte_bpe, chat_format, components, ngram_join, packing, quality_rules, sharding, token_counts, topk, toxicity, url_rules
from sylvaframe.llm._common import labelled_sample

SCHEMA = "doc_id long, text string, lang string, size int, shard string, id string, stats int, score double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma,", "Delta.", "été", "naïve", "x", "<|endoftext|>", "<s>", "it's", "12", "::", "漢字", "á"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))
    base = say(60)
    texts = [None, "", " ", "\n \n", "one", say(5), base, base, base.replace("alpha", "ALPHA"), base + " tail", "a" * 3000, say(30_000), "the the the the the the"]
    texts += [say(rng.randrange(1, 80)) for _ in range(25)] + ["ab" * 40, "\x00z", "▁▁ x"]
    found = [(i, t, "en", 1, "s", "k", 2, 0.1) for i, t in enumerate(texts)]
    return found + [found[6]] * 2


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none, rows):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = sorted(map(tuple, token_counts.count_tokens(docs, model, batch_bytes=5000, chunk_bytes=100).collect()))
    assert got == sorted((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in rows)
    assert token_counts.count_tokens(none, model).count() == 0
    own = token_counts.counter(model, 100)
    assert sum(own.lengths(list(own.parts("a" * 700)))) == len(sp.encode("a" * 700))
    for text in (own.guard, own.guard + "abc", f"{own.guard} ab " * 60, "ab " * 60 + own.guard, own.guard * 300):
        assert sum(own.lengths(list(own.parts(text)))) == len(sp.encode(text))


def test_byte_bpe(docs, none, rows):
    import base64

    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, path, P.PATTERN)
    assert sorted((r["doc_id"], r["ids"]) for r in encoded.collect()) == sorted((r[0], library.encode_ordinary(r[1] or "")) for r in rows)
    decoded = byte_bpe.decode(encoded, path, P.PATTERN, keep=["doc_id"])
    assert sorted((r["doc_id"], bytes(r["bytes"])) for r in decoded.collect()) == sorted((r[0], (r[1] or "").encode()) for r in rows)
    assert byte_bpe.encode(none, path, P.PATTERN).count() == 0
    codec, rng = byte_bpe.codec(path, P.PATTERN), random.Random(5)
    odd = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "é", "1", "'s", "!", "Ᲊ", "՘", "\x1c", "\xa0", "the "]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.encode(odd)] == [library.encode_ordinary(x) for x in odd]
    for text in ("a" * 9000, "ab" * 5000, "".join(rng.choice("abcdeth") for _ in range(20_000))):
        assert codec.merge(text.encode()) == library.encode_ordinary(text)
    pieces = [bytes(rng.choices(b"abth", k=rng.randrange(2, 40))) for _ in range(3000)]
    pieces = [p for p in pieces if p not in codec.ranks]
    assert [np.frombuffer(x, np.int32).tolist() for x in codec.merge_many(pieces)] == [library.encode_ordinary(p.decode()) for p in pieces]


def greedy_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        middle, used, left = (low + high) // 2, 1, 0
        fits = all(s <= middle for s in sizes)
        for s in sizes:
            if left + s > middle:
                used, left = used + 1, 0
            left += s
        if fits and used <= shards:
            high = middle
        else:
            low = middle + 1
    return low


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(spark, docs, none, shards):
    many = docs.select("doc_id", "text").union(spark.range(3000).select(F.col("id") + 1000, F.concat(F.lit("t"), (F.col("id") % 700).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")))))
    got = sharding.shard(many, shards, rows_per_slot_block=100).collect()
    hashes = {r["doc_id"]: r["h"] for r in many.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    group, by_shard, where = defaultdict(int), defaultdict(list), {}
    for r in got:
        h = hashes[r["doc_id"]]
        group[h] += r["size"]
        by_shard[r["shard"]].append(r["slot"])
        assert where.setdefault(h, r["shard"]) == r["shard"]
    assert len(got) == many.count()
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    totals = defaultdict(int)
    for r in got:
        totals[r["shard"]] += r["size"]
    assert max(totals.values()) == greedy_capacity([group[h] for h in sorted(group)], shards)
    texts = {r["doc_id"]: r["text"] or "" for r in many.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)
    assert sharding.shard(none, shards).count() == 0


def brute_join(rows, n=5, threshold=0.8):
    def grams(text):
        w = (text or "").lower().encode().split()
        return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()

    sets = [(i, t or "", grams(t)) for i, t in rows if i is not None]
    links, root = defaultdict(int), {i: i for i, *_ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a, s) in enumerate(sets):
        for j, b, t in sets[x + 1 :]:
            if a == b or (s and t and len(s & t) >= threshold * len(s | t) - 1e-9):
                links[i] += 1
                links[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted((i, find(i), links[i]) for i, *_ in sets)


def test_ngram_join(spark, docs, none):
    rng = random.Random(1)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(99)) for _ in range(90)]
    near = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(90)] = str(rng.random())
        near.append((100 + i, " ".join(words)))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect()] + near + [(300 + i, "copy me now please again") for i in range(30)] + [(None, base[0]), (400, "One  two"), (401, "one two")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("component", F.lit(1)).repartition(3)
    got = ngram_join.ngram_join(table, block_rows=8, broadcast_rows=10).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, (r for r in got if r["doc_id"] is not None))) == brute_join(rows)
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None]
    assert ngram_join.ngram_join(none).count() == 0


def test_choose_bands():
    bands, rows = ngram_join.choose_bands(0.8, 0.9995, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 30)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("round_tokens", [3000, 1 << 21])
def test_packing(docs, none, rows, round_tokens):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, 2, window=256, lowest_tier=32, round_tokens=round_tokens).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], p["length"], ids, p["doc_tokens"]))
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"], p["tier"], p["step_id"]))
    times = defaultdict(int)
    for r in rows:
        times[r[0]] += 1
    for i, text in {r[0]: r[1] for r in rows}.items():
        want = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i])
        if times[i] == 1:
            assert [x for _, _, ids, _ in own for x in ids] == want and [s for s, *_ in own] == np.cumsum([0, *(n for _, n, *_ in own)])[:-1].tolist()
        assert sum(n for _, n, *_ in own) == times[i] * len(want) and {d for *_, d in own} == {len(want)}
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, *_ in parts] == np.cumsum([0, *(n for _, n, *_ in parts)])[:-1].tolist()
        total = sum(n for _, n, *_ in parts)
        assert {t for _, _, t, _ in parts} == {total} and total & (total - 1) == 0 and total <= 256
    assert packing.pack(none, path, 2).count() == 0


def test_packing_falls_back_without_word_splits(docs):
    own = packing.Encoder(P.path("byte_bpe_50k.json"))
    assert not own.by_word
    assert np.frombuffer(own.encode(["Hello  there"])[0], np.uint32).tolist() == own.tokenizer.encode("Hello  there").ids


def test_packing_encodes_words_as_the_library_does():
    own = packing.Encoder(P.path("word_bpe_49k.json"), memory_bytes=20_000)
    assert own.by_word
    rng = random.Random(3)
    signs = [*"abcABC'sStTréÉßŸſİıŉǅÅK10²½.,!?-_#$ \t\n\x0b\x1c\x85 　̸́<|>=漢字かな한하😀\x00\x7f×÷ªºĲķŁ", "'re", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "don't"]
    for _ in range(3):
        texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(1000)]
        assert [np.frombuffer(x, np.uint32).tolist() for x in own.encode(texts)] == [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_chat_format(spark):
    odd = "\\### <|end|> <\\| \\<| <| \\\\ <|next|>|<|start|>x<|message|> <"
    turns = [(1, 0, "user", odd), (1, 1, "user", ""), (1, 2, "assistant", None), (1, 3, "assistant", odd), (1, 4, "tool|<|", "|>"), (2, 0, None, None), (2, 5, "assistant", "é漢" * 9)]
    turns += [(3, 0, "assistant", "tie")] * 2 + [(None, None, "user", "lost")] + [(4, i, "user" if i % 2 else "assistant", "t" * i) for i in range(300)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("blocks", F.lit(1)).repartition(3)
    chats = chat_format.format_chats(table)
    got = chats.select("conv_id", "formatted", "loss_spans", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        want = [(t[2] or "", t[3] or "") for t in sorted((t for t in turns if t[0] == r["conv_id"]), key=lambda t: (t[1] is not None, t[1]))]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        assert r["formatted"].count("<|start|>") == 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:]))
    assert len(got) == 5 and chat_format.format_chats(table.limit(0)).count() == 0


def test_url_rules(spark):
    rng = random.Random(4)
    labels = ["net", "org", "example", "a", "b-c", "", "www", "de"]
    hosts = [".".join(rng.choices(labels, k=rng.randrange(1, 5))) for _ in range(60)]
    paths = ["", "/", "/en/", "/en/x", "/en", "/de/y/z", "/é"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts).title()}{rng.choice(paths)}{rng.choice(['', '?q=://x/', '#f'])}" for _ in range(800)] + [None, "", "no scheme/x", "a\nb://c.net/en/"] + ["http://www.net/en/"] * 200
    rules = list({(rng.choice(hosts), rng.choice(paths)): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rules", F.lit(2)).repartition(3)
    rule_table = spark.createDataFrame([(h, p, v) for (h, p), v in rules], "host string, path string, verdict string")
    for r in url_rules.judge_urls(table, rule_table, partitions=7).collect():
        url = urls[r["page_id"]] or ""
        rest = url.partition("://")[2] if "://" in url else ""
        host = rest
        for c in "/?#":
            host = host.partition(c)[0]
        path = rest[len(host) :].partition("?")[0].partition("#")[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [((len(h + p), h + p), v) for (h, p), v in rules if (host == h or host.endswith("." + h) or h == "") and path.startswith(p)] if "://" in url or True else []
        fits = [f for f in fits if f[0][1] or host == host]
        want = max(fits, default=None)
        assert (r["host"], r["path"]) == (host, path)
        assert len(r["rule"] or "") == (want[0][0] if want else 0) and (want is None) == (r["rule"] is None)
    assert url_rules.judge_urls(table.limit(0), rule_table).count() == 0
    assert url_rules.judge_urls(table, rule_table.limit(0)).where("verdict <> 'allow' or rule is not null").count() == 0


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network({"a": 1, "b": 2}, buckets=16, window=6)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, mask, y, w = rng.standard_normal((6, 3, 16)), np.ones((6, 3)), np.array([1.0, 0, 1]), np.ones(3)
    mask[4:, 1] = 0
    _, _, g, d_x = net.gradients(x, mask, y, w)
    for k in ("W", "U", "A", "v", "o", "b", "a", "c"):
        at = tuple(rng.integers(s) for s in net.weights[k].shape)
        ends = []
        for step in (1e-3, -1e-3):
            net.weights[k][at] += step
            ends.append(net.gradients(x, mask, y, w)[0])
            net.weights[k][at] -= step
        assert abs((ends[0] - ends[1]) / 2e-3 - g[k][at]) < 1e-4


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    plain = ["the", "sea", "is", "calm", "today", "we", "walk", "far", "home", "again"]
    make = lambda bad, n: " ".join(rng.choice(plain) if not bad or rng.random() > 0.08 else rng.choice(["vile", "scum"]) for _ in range(n)) + (" vile" if bad else "")
    rows = [(i, make(i % 4 == 0, rng.randrange(20, 260))) for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = table.select("doc_id", F.lit(None).cast("int").alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    net = toxicity.train(table, labels.union(labels.limit(5)), max_rows=400)
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    scored = table.withColumn("score", toxicity.toxicity(net, table, F.col("text"))).collect()
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) == len(right) and np.mean(right) > 0.95
    odd = docs.withColumn("score", toxicity.toxicity(net, docs, docs["text"])).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert none.withColumn("score", toxicity.toxicity(net, none, none["text"])).count() == 0
    assert toxicity.train(table, labels.where("toxic = 0")) is None
    starts = toxicity.window_starts(101, 48)
    assert starts[-1] + 48 >= 101 and all(b - a < 48 for a, b in zip(starts, starts[1:]))


def plain_logit(net, text):
    """The highest window's logit, one window and one word at a time."""
    w, h = net.weights, net.hidden
    words, best = toxicity.units(text), -np.inf
    sig = lambda x: 1 / (1 + np.exp(-x))
    for start in toxicity.window_starts(len(words), net.window):
        xs = [net.embed([word])[0] for word in words[start : start + net.window]]
        if not xs:
            return w["c"][0]
        both = []
        for d, order in enumerate((xs, xs[::-1])):
            state, out = np.zeros(h), []
            for x in order:
                g = x @ w["W"][d] + w["b"][d, 0]
                z, r = sig(g[:h] + state @ w["U"][d][:, :h]), sig(g[h : 2 * h] + state @ w["U"][d][:, h : 2 * h])
                new = np.tanh(g[2 * h :] + (r * state) @ w["U"][d][:, 2 * h :])
                state = z * state + (1 - z) * new
                out.append(state)
            both.append(out if d == 0 else out[::-1])
        states = np.hstack([np.array(both[0]), np.array(both[1])])
        e = np.exp(np.tanh(states @ w["A"] + w["a"]) @ w["v"])
        best = max(best, (e / e.sum()) @ states @ w["o"] + w["c"][0])
    return best


def test_toxicity_scores_equal_a_plain_forward_pass(rows):
    net = toxicity.Network({"alpha": 1, "beta": 2, "it": 3}, buckets=64, window=6, seed=1)
    net.weights["words"][1:] *= 20
    texts = [r[1] if r[1] is None or len(r[1]) < 4000 else r[1][:4000] for r in rows]
    got = toxicity.Scorer(net, words=10).document_logits(texts)
    want = [plain_logit(net, t) for t in texts]
    some = [i for i, t in enumerate(texts) if toxicity.units(t)]
    assert len(some) > 20 and np.allclose(got[some], np.array(want)[some], atol=1e-4)
    assert np.isfinite(got).all()


def test_top_k(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.3, 9).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, [0.5] * 9) for i in range(40)] + [(300, None), (301, [None] * 9), (302, [float("nan")] * 9), (303, [float("inf")] + [0.0] * 8), (None, [0.1] * 9), (304, []), (310, [0.9, -0.9]), (5, rows[5][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(0)).repartition(3)
    whole = {i: np.pad(np.floor(256 * np.array(v)).astype(int), (0, 9 - len(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (q for q in whole if q % 10 == 0):
        best = sorted((-int(whole[q] @ v), c) for c, v in whole.items() if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    for segments in (1, 2, 4):
        got = topk.top_k(table, F.col("id") % 10 == 0, segments=segments, query_block=4, candidate_block=30)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    few = table.where("vec_id in (0, 10, 20)")
    assert topk.top_k(few, F.col("id") % 10 == 0).count() == 6
    assert topk.top_k(table.limit(0), F.col("id") % 10 == 0).count() == 0


def test_products_stay_exact():
    big = np.array([[2**30, 1]]), np.array([[2**30, 3]])
    assert topk.products(*big)[0, 0] == 2**60 + 3


def brute_measure(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else {w for w in windows if windows.index(w) != len(windows) - 1 - windows[::-1].index(w)}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_quality_measures(docs, none, rows):
    got = docs.where("doc_id <> 11").select("doc_id", quality_rules.text_stats(F.col("text")).alias("s")).collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        assert tuple(r["s"][n] for n in quality_rules.COUNTS) == brute_measure(texts[r["doc_id"]])
    assert quality_rules.repeated_words("a b c a b c a".split()) == 7 and quality_rules.repeated_words(["a", "b"]) == 0
    assert quality_rules.judged(none, []).count() == 0
    judged = quality_rules.judged(docs.withColumnRenamed("stats", "Stats"), [])
    assert judged.columns == [*docs.columns[:6], "Stats", "score", "_stats"] and judged.where("Stats <> 2").count() == 0
    kept = judged.where("_stats.kept").count()
    assert kept == docs.select(quality_rules.text_stats(F.col("text")).alias("s")).where(~quality_rules.base_failed(F.col("s"))).count()


def test_decision_list():
    rng = np.random.default_rng(1)
    data = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    low = ((data["a"] > 0.8) & (data["b"] <= 0.5)) | (data["c"] > 0.9)
    rules = quality_rules.learn_list(data, low)
    caught = np.zeros(900, bool)
    for rule in rules:
        caught |= quality_rules.covered(rule, data, 900)
    assert (caught & low).sum() > 0.9 * low.sum() and (caught & ~low).sum() < 0.05 * (~low).sum()
    assert quality_rules.learn_list({"a": np.ones(60)}, rng.random(60) > 0.5) == []


def test_list_verdicts_equal_what_the_rules_cover(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["word", "WORD", "no", "12", "!!", "x" * 9], size=rng.integers(50, 90))) for _ in range(200)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    test = quality_rules.Test
    rules = [(test("n_upper_share", True, 0.25), test("n_words", False, 70.0)), (test("n_digits_share", False, 0.06),), (test("chars_per_word", True, 3.6), test("n_marks_share", True, 0.15))]
    stats = table.select("doc_id", quality_rules.text_stats(F.col("text")).alias("s"))
    of = quality_rules.features(F.col("s"))
    data = stats.select("doc_id", *(c.alias(n) for n, c in of.items())).toPandas().sort_values("doc_id")
    values = {n: data[n].to_numpy(float) for n in of}
    want = np.zeros(200, int)
    for k in (3, 2, 1):
        want[quality_rules.covered(rules[k - 1], values, 200)] = k
    got = {r["doc_id"]: r["stats"] for r in quality_rules.judged(table, rules).collect()}
    assert [got[i]["rule"] for i in range(200)] == want.tolist() and len(set(want)) == 4
    assert all(s["kept"] == (s["rule"] == 0 and not s["base_failed"]) for s in got.values())


def test_labelled_samples_hold_each_id_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 1) for i in range(50)], "doc_id long, text string, label int")
    docs = docs.unionByName(spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("copy "), F.col("id") % 100).alias("text"), F.lit(2).alias("label")))
    labels = spark.createDataFrame([(i, i % 2, i % 3) for i in range(40)] + [(3, None, None), (4, 1, 2)], "doc_id long, quality int, toxic int")
    sample = lambda rows, chars: labelled_sample(docs, labels, labels["quality"], rows, chars, "doc_id", "text").collect()
    rows = sample(100, 10_000)
    assert sorted(r["doc_id"] for r in rows) == list(range(40)) and {r["doc_id"]: r["label"] for r in rows}[4] == 1
    assert len(sample(10, 10_000)) == 10 and 0 < len(sample(100, 60)) < 10 and sample(100, 60) == sample(100, 60)
    assert isinstance(quality_rules.train(docs, labels), list) and labels.limit(0).count() == 0
    assert quality_rules.train(docs, labels.limit(0)) == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("score", F.lit("x")).withColumn("Stats", F.lit(1))
    extra = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = docs.union(extra).union(docs.limit(2)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.exceptAll(docs).count() == 0, name
        if name == "n-gram Jaccard join":
            links = {i: c for i, c, _ in brute_join([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect()])}
            assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for c in links.values()})
        assert stage(spark, docs.limit(0), sf).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_queries_digest_the_operators(spark):
    from sylvaframe.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op2_byte_bpe(spark, sf).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(queries.queries()) == 13
