"""Operators against brute force, held-out data, exact round trips; queries against their SQL."""

import random
import re

import numpy as np
import pytest
from conftest import SF, same_rows

import corpus_pipeline
from brindle.llm import balltree, bpe, egojoin, langid, minhash, packing, pii, queries, urltree, vectors


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same_rows(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def test_all_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")} == set(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "packing"]


def _components(n, edges):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_vectors_against_brute_force(spark, monkeypatch, small):
    """Whatever the size of blocks, shards and nodes: many levels and waves, or one."""
    if small:
        for m, name, n in [(vectors, "FAN", 2), (balltree, "FAN", 2), (egojoin, "FAN", 2), (balltree, "SHARD", 64), (balltree, "GROUP", 2), (egojoin, "SPAN", 2), (vectors, "BLOCK_BYTES", 1536)]:
            monkeypatch.setattr(m, name, n)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12))
    x = np.concatenate([base, base[:40] + rng.normal(size=(40, 12)) * 0.05, np.repeat(base[:1], 700, 0) + rng.normal(size=(700, 12)) * 0.02]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    y = x.astype(float)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    comp = _components(len(x), np.argwhere(u @ u.T >= egojoin.COSINE))
    assert {tuple(r) for r in egojoin.near_duplicates(df).collect()} == {(i, c) for i, c in enumerate(comp) if i != c}
    s = np.round(y @ y.T, 9)
    np.fill_diagonal(s, -np.inf)
    want = {(i, r, int(j)) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:10], 1)}
    assert {(r["vec_id"], r["rank"], r["neighbor_id"]) for r in balltree.top_k(df).collect()} == want


def test_ball_tree_prunes_nothing_it_needs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 5)) * 3
    ids, best = np.arange(900), balltree.Best(900, 7)
    balltree.search(x, ids, balltree.Tree(x, 16), ids, best)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -np.inf)
    assert all((best.id[i] == np.lexsort((ids, -s[i]))[:7]).all() for i in range(900))


def test_minhash_against_all_pairs(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(4000)]
    texts = [" ".join(r.choices(words, k=r.randint(30, 200))) for _ in range(120)]
    for t in texts[:50]:
        w = t.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0]] * 20
    import pyarrow as pa

    sig = minhash.signatures(pa.array(texts))
    near = [(a, b) for a in range(len(texts)) for b in range(a) if (sig[a] != sig[b]).sum() <= minhash.RADIUS]
    comp = _components(len(texts), near)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(x) for x in minhash.near_duplicates(df).collect()} == {(i, c) for i, c in enumerate(comp) if i != c}


def test_language_id_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1 and n_chars > 200")
    got = langid.identify(held, langid.fit(train)).join(held.select("doc_id", "lang"), "doc_id").where("found <> 'und'")
    assert got.where("found = lang").count() >= 0.97 * got.count() > 100


def _ngrams(text):
    """Bucket numbers of a text's n-grams, one after the other, and its letters."""
    folded = ""
    for c in text:
        c = c.lower() if c.isalpha() and len(c.lower()) == 1 else " " if ord(c) < 0x3000 else c
        folded += "" if c == " " and folded.endswith(" ") else c
    out = []
    for order in langid.ORDERS:
        for i in range(len(folded) - order + 1):
            h = 0
            for c in folded[i : i + order]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            x = (h * 0x9E3779B1 + order * 0x7FEB352D) % 2**32
            x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
            out.append(x >> 32 - langid.BITS)
    return out, sum(c != " " for c in folded)


def test_language_id_against_counting_by_hand(spark):
    """The whole of operator 9, model and scores, against dictionaries and sums of logarithms."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    counts, docs_by = {}, Counter()
    for r in {(r["doc_id"], r["lang"], r["text"] or ""): r for r in rows if r["doc_id"] is not None and r["lang"] is not None}.values():
        counts.setdefault(r["lang"], Counter()).update(_ngrams(r["text"] or "")[0])
        docs_by[r["lang"]] += 1
    total = {g: sum(c.values()) + 0.5 * 2**langid.BITS for g, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for r in rows:
        grams, letters = _ngrams(r["text"] or "")
        score = {g: math.log(docs_by[g] / sum(docs_by.values())) + sum(math.log((c[x] + 0.5) / total[g]) for x in grams) for g, c in counts.items()}
        best, second = sorted(score.values(), reverse=True)[:2]
        odds = best - score[r["lang"]] if r["lang"] in score else 0
        g = got[r["doc_id"]]
        if not letters:
            assert (g["found"], g["kept"]) == ("und", False)
        else:
            assert score[g["found"]] > best - 1e-3 * len(grams) and abs(g["margin"] - (best - second) / letters) < 1e-2
            if abs(odds - max(langid.ODDS, letters * langid.ODDS_A_LETTER)) > 1:
                assert g["kept"] == (odds <= max(langid.ODDS, letters * langid.ODDS_A_LETTER))


def test_marginals_are_exact_without_loops():
    w, flat, t, s = pii.model()
    rng = np.random.default_rng(1)
    tokens = pii.training_rows(3, 11)[0][0]
    told = [i for i, x in enumerate(tokens) if pii.is_telling(x)]
    unary = np.tile(flat, (len(tokens), 1))
    for i in told:
        unary[i] = np.array(pii.features(tokens[i], tokens[i - 1] if i else "", tokens[i - 2] if i > 1 else "")) @ w
    a = [unary[0]]  # forward-backward over every token
    for i in range(1, len(tokens)):
        a.append(unary[i] + np.logaddexp.reduce(a[-1][:, None] + t, axis=0))
    b = [np.zeros(pii.L)]
    for i in range(len(tokens) - 1, 0, -1):
        b.append(np.logaddexp.reduce(t + (unary[i] + b[-1])[None, :], axis=1))
    want = np.exp(np.array([x + y - np.logaddexp.reduce(x + y) for x, y in zip(a, b[::-1])]))[told]
    n = len(told)
    got = pii.marginals(unary[told], np.array([told[0], *[-1] * (n - 1)]), np.array([*[-1] * (n - 1), len(tokens) - 1 - told[-1]]), np.array([(k, k + 1) for k in range(n - 1)]).reshape(-1, 2), np.diff(told) - 1, np.zeros((0, 2), int))
    assert np.allclose(got, want, atol=1e-4) and rng is not None


def test_personal_data_on_held_out_rows():
    hit = found = real = 0
    for tokens, labels in pii.training_rows(150, seed=99):
        text, at, want = " ".join(tokens), 0, set()
        for x, y in zip(tokens, labels):
            want |= {(at, y)} if y else set()
            at += len(x) + 1
        starts = [0, *np.cumsum([len(x) + 1 for x in tokens])]
        got = {(max(s for s in starts if s <= a), pii.LABELS.index(k)) for a, _, k in pii.label([text])[0]}
        hit, found, real = hit + len(got & want), found + len(got), real + len(want)
    assert hit / real > 0.95 and hit / found > 0.95


def test_skip_links_carry_a_label():
    spans = pii.label(['token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" was seen, later 9f8e7d6c5b4a39281706f5e4d3c2b1a0 again'])[0]
    assert [k for *_, k in spans] == ["SECRET", "SECRET"]


def _public():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(), special_tokens={})


def _packed(sizes, workers, capacity, classes):
    """Harmonic packing, one document after the other."""
    full, out = {}, []
    for i, n in sorted(sizes):
        for k, start in enumerate(range(0, n, capacity)):
            size = min(n - start, capacity)
            key = i % workers, min(capacity // size, classes)
            at = full[key] = full.get(key, -1) + 1
            out.append((*key, at // key[1], at % key[1], i, k, start, size))
    return sorted(out)


@pytest.mark.parametrize("workers, capacity, classes", [(None, packing.CAPACITY, packing.CLASSES), (3, 256, 5)])
def test_packing_against_one_document_after_the_other(spark, workers, capacity, classes):
    """Every bin, every slot; only a worker's last bin of a class may be open."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    enc = _public()
    sizes = [(r["doc_id"], len(enc.encode_ordinary(r["text"])) + 1) for r in docs.collect() if r["text"]]
    got = sorted(tuple(r) for r in packing.pack(docs, capacity=capacity, classes=classes, workers=workers).collect())
    assert got == _packed(sizes, workers or packing.WORKERS, capacity, classes)
    full = {}
    for w, c, b, _, _, _, _, n in got:
        full.setdefault((w, c, b), []).append(n)
    assert all(sum(v) <= capacity and (len(v) == c or (w, c, b + 1) not in full) for (w, c, b), v in full.items())


def test_bpe_against_the_public_encoder(spark):
    ranks, enc = bpe.load(), _public()
    mine = bpe.Encoder(ranks)
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    odd = ["", " ", "\n\n  x", "a  b   c ", "don't", "日本語 テキスト", "🙂🙂 🙂", "x" * 5000, "ab" * 3000, " " * 700 + "y", "\t\r\n ", "٣٤٥ ½", "a b", "é" * 400]
    for text in rows + odd:
        assert mine.encode(text).tolist() == enc.encode_ordinary(text)
        assert bpe.Decoder(bpe.token_table(ranks)).feed(mine.encode(text).tolist()) == text
    import pyarrow as pa

    ids, at = bpe.encode_texts(pa.array(rows + odd), mine)
    assert [ids[a:e].tolist() for a, e in zip(at, at[1:])] == [enc.encode_ordinary(t) for t in rows + odd]


def test_a_growing_word_is_emitted_as_it_grows():
    """Of 200 pieces of one word (of spaces, of digits), a window of pieces is read before the first id, and held later."""
    encoder = bpe.Encoder(bpe.load())
    for c in "x", " ", "7", "!", "é":
        s, held, first = bpe.Stream(encoder), [], None
        for k in range(200):
            if s.feed(c * 1000) and first is None:
                first = k
            held.append(len(s.pending) + len(s.run.window))
        assert first <= 2 * encoder.ahead // 1000 + 1 and max(held) <= 2 * encoder.ahead + 2 * 1000 + bpe.LONG


def test_stream_equals_whole():
    r = random.Random(8)
    ranks = bpe.load()
    ahead = bpe.lookahead(ranks)
    enc = bpe.Encoder(ranks, ahead)
    for _ in range(20):
        text = "".join(r.choice(["ing", "the ", "  ", "é", "🙂", "a", "\n", "zz", "12"]) for _ in range(800))
        pieces, i = [], 0
        while i < len(text):
            j = i + r.randint(1, 90)
            pieces.append(text[i:j])
            i = j
        assert list(bpe.encode_stream(pieces, enc)) == enc.encode(text).tolist()
        t, out, data = bpe.Transducer(ranks, ahead), [], text.replace(" ", "").encode()
        for k in range(0, len(data), 37):
            out += t.feed(data[k : k + 37])
        assert out + t.finish() == [ranks[x] for x in bpe.merge_long(data, ranks)]
        d, ids = bpe.Decoder(bpe.token_table(ranks)), enc.encode(text).tolist()
        assert "".join(d.feed(ids[k : k + 3]) for k in range(0, len(ids), 3)) + d.finish() == text


def test_templates_by_hand(spark):
    rows = [(k, f"http://a.org/{lang}/{k}.html", int(lang != "bad")) for k in range(300) for lang in ("en", "de", "bad")] + [(k, f"http://a.org/user/u{k}x", None) for k in range(300)]
    got = urltree.templates(spark.createDataFrame(rows, "page_id long, url string, good int"))
    t = {(r["template"], r["kept"], r["n_urls"]) for r in got.select("template", "kept", "n_urls").distinct().collect()}
    assert ("/bad/{num}.html", False, 300) in t and ("/user/{mix}", True, 300) in t
    assert ("/*/{num}.html", True, 600) in t  # en and de are alike, bad isn't


def test_pipeline_against_its_stages(spark):
    """run() equals the operators applied by brute force, one document at a time where they allow it."""
    got = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in langid.identify(docs).where("kept").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in kept}
    import pyarrow as pa

    ids = sorted(rows)
    texts = pa.array([rows[i] for i in ids])
    sig, ok = minhash.signatures(texts), minhash.has_words(texts)
    near = [(a, b) for a in range(len(ids)) for b in range(a) if ok[a] and ok[b] and (sig[a] != sig[b]).sum() <= minhash.RADIUS]
    comp = _components(len(ids), near)
    want, enc = {}, _public()
    for k, i in enumerate(ids):
        if comp[k] == k:
            clean = pii.redact(rows[i], pii.label([rows[i]])[0])
            n = len(enc.encode_ordinary(clean))
            want[i] = n + 1 if n else 0
    total = {}
    for r in got.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
    assert total == {i: n for i, n in want.items() if n}
