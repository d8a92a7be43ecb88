"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: each operator's defined result."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF

from brindle.llm import balltree, bpe, egojoin, langid, minhash, packing, pii, queries, urltree, warc, wrapper
from brindle.llm import vectors as grid

EN = "the cat and the dog were in the house with the children of the town and they had been there for the whole day"
DE = "der hund und die katze waren in dem haus mit den kindern der stadt und sie waren den ganzen tag dort gewesen"
DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, sig string, key long, node long, found string, _id long, _text string, worker int, tokens int"
LONG = " ".join(f"word{k % 5003}x{k % 71}" for k in range(120_000))


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (14 - len(r))) for r in rows], DOC)


@pytest.fixture(scope="module")
def some(spark):
    return docs(spark, [
        (1, EN, "en", "s", len(EN)), (2, EN, "en", "s", len(EN)), (2, EN, "en", "s", len(EN)), (3, DE, "en", None, 5), (4, DE, "de", "s", None), (5, None, "en", "s", None), (6, "", "en", "s", 0),
        (None, EN, "en", "s", 1), (7, EN, None, "s", 1), (8, "12 34 !!", "en", "s", 1), (9, LONG, "xx", "s", 1), (10, "mail a.b@c.org or a.b@c.org now", "en", "s", 31)])


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_language_id(spark, some, none):
    train = docs(spark, [(k, EN if k % 2 else DE, "en" if k % 2 else "de") for k in range(60)])
    model = langid.fit(train)
    got = {(r["doc_id"], r["found"], r["kept"]) for r in langid.identify(some, model).collect()}
    assert {(1, "en", True), (2, "en", True), (3, "de", False), (4, "de", True), (5, "und", False), (6, "und", False), (None, "en", True), (7, "en", True), (8, "und", False)} <= got
    assert langid.identify(some, model).count() == some.count()
    kept = langid.keep_identified(some, model)
    assert kept.schema == some.schema and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 2, 4, 7, 9, 10]
    assert langid.identify(none).count() == 0 and langid.keep_identified(none).count() == 0


def test_minhash(some, none):
    assert {tuple(r) for r in minhash.near_duplicates(some).collect()} == {(2, 1), (7, 1), (4, 3)}
    kept = minhash.drop_near_duplicates(some)
    assert kept.columns == some.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 5, 6, 8, 9, 10]
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0


def test_repeated_id_of_a_kept_document(spark):
    d = docs(spark, [(1, EN), (1, EN), (2, DE)])
    assert sorted(r["doc_id"] for r in minhash.drop_near_duplicates(d).collect()) == [1, 2]
    d = docs(spark, [(1, EN), (1, DE), (1, DE, "de"), (3, EN)])
    assert sorted((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(d).collect()) == [(1, DE), (1, EN)]


def test_few_ids_share_many_rows(spark):
    """Rows that share two ids are different rows: the sample holds both languages."""
    d = docs(spark, [(3 + k % 2, f"{EN if k % 2 else DE} {k}", "en" if k % 2 else "de") for k in range(20_000)])
    model = langid.fit(d)
    assert model.langs == ("de", "en") and 0.4 < np.exp(model.prior)[0] < 0.6
    same = docs(spark, [(1, EN, "en")] * 9_000 + [(2, DE, "de")] * 9_000)
    assert langid.fit(same).langs == ("de", "en")


def test_pii(some, none):
    got = {r["doc_id"]: r for r in pii.find_private(some).collect()}
    assert got[5]["text"] is None and got[6]["text"] == "" and got[5]["entities"] == []
    assert got[10]["text"] == "mail [EMAIL] or [EMAIL] now" and [(e["start"], e["end"], e["kind"]) for e in got[10]["entities"]] == [(5, 14, "EMAIL"), (18, 27, "EMAIL")]
    assert pii.find_private(some).count() == some.count() and got[1]["text"] == EN
    out = pii.redact_private(some)
    assert out.schema == some.schema and {r["doc_id"]: r["n_chars"] for r in out.collect()}[10] == 27
    assert pii.find_private(none).count() == 0 and pii.redact_private(none).count() == 0


def test_packing(some, none):
    rows = packing.pack(some).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["worker"], r["class"], r["bin"]), []).append(r["tokens"])
    assert all(sum(v) <= packing.CAPACITY and len(v) <= k[1] for k, v in sizes.items())
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 7, 8, 9, 10} and sum(r["doc_id"] == 2 for r in rows) == 2
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.token_counts(some).collect()}
    assert sum(r["tokens"] for r in rows if r["doc_id"] == 9) == counts[9] + 1 > 120_000
    assert sum(r["tokens"] for r in packing.pack_words(some).collect() if r["doc_id"] == 9) == 120_001
    assert packing.pack(none).count() == 0


def test_bpe(some, none):
    got = {r["doc_id"]: r for r in bpe.encode(some).collect()}
    assert got[5]["ids"] == [] and got[6]["n_tokens"] == 0 and all(r["round_trip"] for r in got.values())
    assert bpe.encode(some).count() == some.count() and bpe.encode(none).count() == 0
    back = bpe.decode(bpe.encode(some)).collect()
    assert {r["doc_id"]: r["text"] for r in back}[9] == LONG
    assert bpe.decode(none.selectExpr("doc_id", "cast(null as array<int>) ids")).count() == 0
    odd = bpe.decode(some.where("doc_id = 2").selectExpr("doc_id", "array(-1, 40, null, 2000000000) ids")).collect()
    assert [r["text"] for r in odd] == ["\ufffdI\ufffd\ufffd"] * 2


VEC = "vec_id long, embedding array<float>, label int, id long, vector string, cell string, block long, a long, b long, lo string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *[None] * 8) for i, v in rows], VEC)


def test_embeddings(spark):
    u, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    v = vectors(spark, [(1, u), (2, u), (2, u), (3, w), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [1.0, 0.0]), (None, u), (9, [2.0, 0.0, 1.0])])
    assert {tuple(r) for r in egojoin.near_duplicates(v).collect()} == {(2, 1), (9, 1)}
    top = {(r["vec_id"], r["rank"]): (r["neighbor_id"], r["score"]) for r in balltree.top_k(v, 2).collect()}
    assert top == {(1, 1): (9, 2.5), (1, 2): (2, 1.25), (2, 1): (9, 2.5), (2, 2): (1, 1.25), (3, 1): (1, 0.0), (3, 2): (2, 0.0), (9, 1): (1, 2.5), (9, 2): (2, 2.5)}
    empty = vectors(spark, [])
    assert egojoin.near_duplicates(empty).count() == 0 and balltree.top_k(empty).count() == 0
    assert balltree.top_k(vectors(spark, [(1, u)])).count() == 0 and egojoin.near_duplicates(vectors(spark, [(1, None)])).count() == 0


PAGE = "page_id long, url string, html string, host string, expr string, text string, seg string, tpl string, n long, good int, lo string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (11 - len(r))) for r in rows], PAGE)


def test_pages(spark):
    p = pages(spark, [(1, "http://h.org/a/1", "<p>one</p>"), (1, "http://h.org/a/1", "<p>one</p>"), (2, None, None), (3, "nonsense", ""), (None, "http://h.org/a/2", "<p>two</p><p>three</p>"), (4, "http://H.org/" + "x/" * 3000, "<b>" * 3000 + "deep"), (5, "http://h.org", "<")])
    got = {r["page_id"]: r for r in wrapper.extract(p).collect()}
    assert wrapper.extract(p).count() == 7 and got[2]["text"] == "" and got[3]["fields"] == [] and got[4]["text"] == "deep"
    t = {r["page_id"]: r for r in urltree.templates(p.withColumn("good", p["good"])).collect()}
    assert t[2]["host"] == "" and t[3]["host"] == "" and t[4]["host"] == "h.org" and t[1]["template"] == "/{word}/{num}" and all(r["kept"] for r in t.values())
    empty = pages(spark, [])
    assert wrapper.extract(empty).count() == 0 and urltree.templates(empty).count() == 0 and warc.deduplicated(warc.captures(empty)).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert {(r["url"] or "")[-3:]: r["good"] for r in urltree.labelled_pages(p.limit(5), labels).collect()}["a/2"] == 0


def test_archives(spark):
    rec = spark.createDataFrame([
        ("r1", "response", "u1", "2020", "d1", b"body", "x"), ("r2", "response", "u2", "2021", "d1", b"body", "x"), ("r2", "response", "u2", "2021", "d1", b"body", "x"), ("r3", "revisit", "u3", "2019", "d1", None, "x"), ("r4", "revisit", "u4", None, "d9", None, "x"),
        ("r5", "metadata", None, None, None, b"meta", "x"), (None, "response", "u6", "2020", "d2", b"", "x"), (None, "revisit", None, None, None, None, "x"), ("r7", "response", "u7", None, "d3", None, "x")], warc.SCHEMA + ", original_id string")
    state = {(r["record_id"], r["state"], r["original_id"]) for r in warc.resolve(rec).collect()}
    assert state == {("r1", "original", None), ("r2", "duplicate", "r1"), ("r3", "resolved", "r1"), ("r4", "unresolved", None), ("r5", "other", None), (None, "original", None), (None, "unresolved", None), ("r7", "original", None)}
    got = sorted((r["record_id"] or "", r["kind"], r["payload_bytes"], r["original_id"]) for r in warc.deduplicated(rec).collect())
    assert [g for g in got if g[0][0] == "r"] == [("r1", "response", 4, None), ("r2", "revisit", 0, "r1"), ("r3", "revisit", 0, "r1"), ("r4", "revisit", 0, None), ("r5", "metadata", 4, None), ("r7", "response", 0, None)]
    assert len(got) == 8 and all(g[0].startswith("urn:sha1:") for g in got if g[0][0] != "r")


def test_wrapper_accepts_its_pages():
    rng = np.random.default_rng(5)

    def page():
        rows = "".join(f"<tr><td>{rng.integers(99)}</td><td>{'<b>x</b>' if rng.random() < 0.4 else ''}y</td></tr>" for _ in range(rng.integers(1, 6)))
        return f"<html><body>{'<h1>t</h1>' if rng.random() < 0.5 else ''}<table>{rows}</table>{'<p>more</p>' * rng.integers(0, 4)}</body></html>"

    folded = [wrapper.fold(*wrapper.tokens(page())) for _ in range(60)]
    w = wrapper.infer(sorted({e for e, _ in folded}, key=str))
    for e, texts in folded:
        assert wrapper.slots(e) == len(texts) and -1 not in wrapper.slot_map(e, w)
    assert wrapper.load(wrapper.dump(w)) == w


def test_top_k_of_every_hundredth(spark, monkeypatch):
    """Queries are the ids divisible by 100 alone, among all rows, whatever the number of waves and slices of queries.
    Scores that single precision can't tell apart keep their order, at any scale."""
    for name, n in [("SHARD", 64), ("GROUP", 2), ("FAN", 2), ("QUERIES", 8 * 6 * 3)]:
        monkeypatch.setattr(balltree, name, n)
    rng = np.random.default_rng(5)
    for scale in (1.0, 1e17):
        x = rng.normal(size=(1300, 6))
        x[600:640] = x[500] * (1 + np.arange(40)[::-1, None] * 3e-9)
        x[800:900] = x[100]
        x *= scale
        ids = np.arange(-300, 1000)
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
        want = set()
        for i in np.flatnonzero(ids % 100 == 0):
            s = np.round(x @ x[i], 9) if scale == 1 else x @ x[i]
            s[i] = -np.inf
            near = np.lexsort((ids, -s))[:10] if scale == 1 else np.argsort(-s)[:10]
            want |= {(int(ids[i]), r, int(ids[j])) for r, j in enumerate(near, 1)}
        got = {(r["vec_id"], r["rank"], r["neighbor_id"]) for r in balltree.top_k(df, every=100).collect()}
        if scale == 1:
            assert got == want
        else:  # copies and last digits may stand in any order there
            at = dict(zip(ids.tolist(), x))
            score = lambda rows: {(q, r): at[q] @ at[n] for q, r, n in rows}
            a, b = score(got), score(want)
            assert len(got) == len(want) == 130 and a.keys() == b.keys() and all(abs(a[i] - b[i]) <= 1e-12 * abs(b[i]) for i in b)
    assert balltree.top_k(df.where("vec_id % 100 <> 0"), every=100).count() == 0


def test_op10_asks_for_every_hundredth(spark):
    rows = queries.op10_top_k(spark, SF).collect()
    assert {r["vec_id"] for r in rows} == {0, 100, 200, 300, 400} and len(rows) == 50
    assert any(r["neighbor_id"] % 100 for r in rows)


def test_long_rows_go_to_small_row_groups(spark, monkeypatch):
    """Shards are rows of MBs: a row group holds few of them, not the 100 after which Parquet first looks at its size."""
    monkeypatch.setattr(grid, "LONG_ROWS", {**grid.LONG_ROWS, "parquet.block.size": str(1 << 16)})
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(6000, 8)))], "vec_id long, embedding array<double>")
    shards = grid.blocks(df, "vec_id", "embedding", 8, None, normal=False, rows=128)
    groups = [g.total_byte_size for f in shards.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file:")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert shards.count() >= 47 and max(groups) < 1.5 * (1 << 16)
