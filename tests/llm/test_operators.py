"""Every operator against a plain restatement, over nulls, empty and repeated rows, ties and clashing columns."""

import html
import re

import numpy as np
import pytest

import corpus_pipeline
from volscreen.llm import bpe, common, html as pages, jaccard, lines, mixing, search, sharding, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, tok string, rep string"


def words(n, start=0):
    return " ".join(f"w{(start + i) * 7919 % 1009}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    near = words(80).split()
    near[40] = "other"
    texts = [
        words(80), words(80), " ".join(near), words(30, 500), None, "", " \t\n ", "one two", "ONE two", "a\nb\nc\nd\ne", "x\na\nb\nc\ny\nb\nc\nd",
        "long " * 3000, words(20, 900) + "\n" + words(40, 300), words(40, 300) + " tail", "é ü ß   x", "a\nb\nc\nd\ne",
    ]
    return [(i, t, None if i % 3 else "en", None if i % 4 == 3 else f"s{i % 3}", 1, "w", "t", "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids and repeated rows."""
    return spark.createDataFrame([*rows, rows[2], rows[9], (None, words(80), *rows[0][2:]), (None, None, *rows[0][2:])], SCHEMA)


def test_substrings(docs, rows):
    split = {r[0]: (r[1] or "").encode().split() for r in rows}
    first = {}
    for i in sorted(split):
        for p in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][p : p + 13]), i)
    for r in substrings.dedup_substrings(docs).collect():
        w = split[r.doc_id]
        cut = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < r.doc_id:
                cut[p : p + 13] = [True] * 13
        assert (r.n_words, r.n_removed) == (len(w), sum(cut))
        assert r.kept == b" ".join(x for x, c in zip(w, cut, strict=True) if not c).decode()


def test_window_hashes_are_two():
    g = int(common._GRAM.flat[0])
    a, b = np.array([5, 7], np.uint64), np.array([6, (7 - g) % (1 << 64)], np.uint64)
    assert common.gram_hashes(a, 2) == common.gram_hashes(b, 2)
    assert common.gram_hashes(a, 2, 1) != common.gram_hashes(b, 2, 1)
    first, second = (common.WordHasher(salt=s)([b"one two"])[0] for s in (0, 1))
    assert not set(first) & set(second)


def test_index_joins_compacted_runs(spark, tmp_path):
    index = substrings.FingerprintIndex(spark, f"file://{tmp_path}/i")
    batches = [[(1, 0), (2, 0), (9, 0)], [(1, 5), (3, 5)], [(2, 7), (3, 7), (4, 7)]]
    shared = [sorted(r.fp for r in index.append(spark.createDataFrame(b, "fp long, doc long"))[0].collect()) for b in batches]
    assert shared == [[], [1], [2, 3]]
    # the first two runs became one before the third batch was joined
    assert [r.count() for *_, r in index.runs] == [5, 3]
    assert sorted(tuple(x) for *_, r in index.runs for x in r.collect()) == sorted(x for b in batches for x in b)
    assert len(list((tmp_path / "i").iterdir())) == 2 and not spark.catalog.listTables()


def test_index_goes_on_in_a_second_session(spark, docs, rows, tmp_path):
    root = f"file://{tmp_path}/days"
    want = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    days = [docs.where("doc_id < 9"), docs.where("doc_id >= 9")]
    got = [r for day in days for r in substrings.dedup_substrings(day, index=substrings.FingerprintIndex(spark, root)).collect()]
    assert {r.doc_id: r for r in got} == want and len(got) == len(rows)


def thue_morse():
    w = "a"
    for _ in range(10):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_in_polynomials(spark):
    one, two = thue_morse()
    rest = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"
    docs = spark.createDataFrame([(1, f"{one} {rest}"), (2, f"{two} {rest}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.dedup_substrings(docs).collect()] == [0, 0]
    short = spark.createDataFrame([(1, f"{one} a b c d"), (2, f"{two} a b c d")], "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard.jaccard_components(short).collect()) == [1, 2]


def test_lines(docs, rows):
    seen, want = set(), {}
    for i, t, *_ in rows:
        parts = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(parts) - 2):
            key = tuple(parts[p : p + 3])
            if key in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(key)
        want[i] = (len(parts), len(gone), None if t is None else "\n".join(x for p, x in enumerate(parts) if p not in gone))
    got = {r.doc_id: (r.n_lines, r.n_lines_removed, r.line_kept) for r in lines.dedup_lines(docs).collect()}
    assert got == want


def test_jaccard(docs, rows):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {r[0]: shingles(r[1]) for r in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


def test_jaccard_texts_of_one_id(spark):
    def near(start):
        w = words(80, start).split()
        w[40] = "other"
        return " ".join(w)

    texts = [(1, words(80)), (1, words(80, 200)), (1, words(80, 400)), (1, words(80, 200)), (2, near(0)), (3, near(200)), (4, near(400)), (5, words(80, 600))]
    texts += [(None, words(80, 700)), (None, words(80, 850)), (6, near(700)), (7, near(850))]
    got = sorted({(r.doc_id or 0, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()})
    assert got == [(0, None), (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, None), (7, None)]


def test_pipeline_near_copies_of_null_ids(spark):
    near = {}
    for start in (0, 200, 400):
        w = words(80, start).split()
        w[40] = "other"
        near[start] = " ".join(w)
    rows = [(None, words(80)), (None, near[0]), (None, words(80, 200)), (2, near[200]), (3, words(80, 400)), (4, near[400]), (None, words(80, 600)), (None, None)]
    kept = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    ids = [(r.doc_id, r.text) for r in kept]
    assert len(ids) == 5 and {(2, near[200]), (3, words(80, 400)), (None, words(80, 600)), (None, None)} < {*ids}
    assert sum(r in [(None, words(80)), (None, near[0])] for r in ids) == 1
    # rows of one id: the copy of document 1 goes, the unrelated text stays; of repeated rows one stays
    rows = [(1, words(80)), (5, near[0]), (5, words(80, 600)), (6, near[400]), (6, near[400])]
    kept = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, words(80)), (5, words(80, 600)), (6, near[400])])


def test_jaccard_holds_little_of_the_texts(spark, docs, rows, monkeypatch):
    """Batches for Python are bounded by bytes at every write, and tokens are counted in blocks of BLOCK bytes."""
    import pyarrow as pa

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    for name in ("staged", "stored", "bucketed"):
        plain = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda *a, plain=plain: seen.append(spark.conf.get(key)) or plain(*a))
    assert jaccard.jaccard_components(docs).count() == len(rows)
    assert seen and {*seen} == {str(1 << 22)} and spark.conf.get(key) == before

    class Caught:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [" ".join(f"t{i}x{j}" for j in range(300_000)) for i in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array(texts)], ["doc", "text"])
    out = list(jaccard._tokens_and_sketches(Caught(), 4)(iter([batch])))
    assert [sum(x is not None for x in b.column("doc").to_pylist()) for b in out] == [1, 1, 1]
    packed = [len(x or b"") // 4 for b in out for c in ("once", "often") for x in b.column(c).to_pylist()]
    assert sum(packed) == 3 * (300_000 - 4)


CLASHES = ("doc", "th", "starts", "lines", "covered", "n_lines", "n_lines_removed", "line_kept", "toxic_score", "scored_text", "copies", "copy", "row_key", "key", "size", "taken", "idx", "component_id", "ids")


def test_clashing_columns(spark, rows):
    data = [(*r[:5], *range(len(CLASHES))) for r in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(8)], "doc_id long, toxic int")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        got, want = stage(spark, docs, "").collect(), stage(spark, plain, "").collect()
        assert sorted(str(tuple(r[:5])) for r in got) == sorted(str(tuple(r)) for r in want), name
        assert all(r[5:] == tuple(range(len(CLASHES))) for r in got), name
    model = toxicity.train(docs, labels)
    kept = toxicity.score(docs, model, keep="toxic_score").collect()
    assert len(kept) == len(rows) and all(0 <= r.toxic_score <= 1 and r.scored_text == CLASHES.index("scored_text") for r in kept)
    got = {r.doc_id: (r.n_lines, r.doc) for r in lines.dedup_lines(docs).collect()}
    assert got == {i: (0 if t is None else len(t.split("\n")), 0) for i, t, *_ in rows}


def test_bpe_round_trip(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r[0]: r[1] or "" for r in rows}
    for r in bpe.encode_documents(docs, bpe.tokenizer_path()).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)


def test_bpe_repairs_joins():
    """A tokenizer that keeps the space before a word disagrees at joins; the repaired ids are those of the whole text."""
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), bpe.ChunkEncoder(path)
    rng = np.random.default_rng(4)
    vocab = [*words(300).split(), "don't", "naïve", "数据", "1234567", "...", "a" * 400]
    texts = ["", " ", "one"]
    for n in (5, 400, 1500, 3000):
        picked = [vocab[i] for i in rng.integers(0, len(vocab), n)]
        gaps = rng.choice([" ", "  ", "\n", "\t ", "\n\n"], n)
        texts.append("".join(w + g for w, g in zip(picked, gaps, strict=True)))
        texts.append(texts[-1] + texts[-1][: len(texts[-1]) // 2])
    ids, decoded = coder([t.encode() for t in texts])
    for t, i, d in zip(texts, ids, decoded, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want
        assert d.decode() == library.decode(want, skip_special_tokens=False)
    assert coder.repaired > 0 and coder.reused > 0


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs, 4).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    by_text = {}
    for r in got:
        by_text.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert all(len(v) == 1 for v in by_text.values())


def test_lpt_against_a_plain_restatement(docs, rows):
    """With few groups every one is scheduled by itself: largest first, to the shard of the least load."""
    got = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 4).collect()}
    groups: dict = {}
    for i, t, *_ in rows:
        size, ids = groups.setdefault(t, [0, []])
        groups[t] = [size + len((t or "").encode()) + 1, [*ids, i]]
    loads, put = [0] * 4, [0] * 4
    for size, _ids in sorted(groups.values(), key=lambda g: -g[0]):
        loads[loads.index(min(loads))] += size
    for size, ids in groups.values():
        put[got[ids[0]]] += size
    assert sorted(put) == sorted(loads)


def test_mixing(docs, rows):
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in {r.source for r in got}:
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 1


def test_mixing_null_ids(spark):
    rows = [(None if i % 2 else i // 4, words(20 + i, 30 * i), f"s{i % 3}") for i in range(24)] + [(None, "", "s0"), (None, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("s0", "s1", "s2"):
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 1
    # the stage enters every text of null id as often as a text of its own id
    alone = spark.createDataFrame([(None, words(30), "s0"), (None, words(50, 300), "s0")], docs.schema)
    assert {r.text for r in corpus_pipeline.mix(spark, alone, "").collect()} == {words(30), words(50, 300)}


def vectors(spark, n=400):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((n, 16)).astype("float32").round(3)
    data = [(i, [float(x) for x in v], "c") for i, v in enumerate(m)]
    data += [(n + i, data[100][1], "c") for i in range(12)]
    data += [(n + 50, None, "c"), (n + 100, [0.0] * 16, "c"), (n + 101, [None] + [1.0] * 15, "c"), (n + 102, [float("nan")] * 16, "c"), (n + 103, [], "c"), (None, [1.0] * 16, "c")]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, score string")


def usable(data):
    return [(i, np.array(v)) for i, v, _ in data if i is not None and v and None not in v and np.isfinite(v).all()]


def test_exact_top_k(spark):
    data, df = vectors(spark)
    whole = [(i, np.floor(1024 * np.float32(v).astype(float)).astype(np.int64)) for i, v in usable(data)]
    want = {}
    for q, u in whole:
        if q % 100 == 0:
            want[q] = [(i, s) for s, i in sorted((-int(u @ v), i) for i, v in whole if i != q)[:10] for s in [-s]]
    got = {}
    for r in search.exact_top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_exact_top_k_of_large_products(spark):
    rng = np.random.default_rng(5)
    vecs = [[float(x) for x in rng.integers(-(1 << 20), 1 << 20, 3)] for _ in range(60)]  # products beyond 2**53
    vecs[7], vecs[8], vecs[9] = [1e300, 0.0, 0.0], [0.5, 0.25, 0.0], [1.7e308, 0.0, 0.0]
    got = search.exact_top_k(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>"), query_mod=4).collect()
    whole = [[int(x * 1024) if abs(x) < 1e9 else int(min(x * 1024, 1.7976931348623157e308)) for x in v] for v in vecs]
    for query in range(0, 60, 4):
        score = {i: sum(a * b for a, b in zip(whole[query], v, strict=True)) for i, v in enumerate(whole) if i != query}
        held = {i: max(-(1 << 63), min((1 << 63) - 1, s)) for i, s in score.items()}
        best = sorted(held, key=lambda i: (-held[i], i))[:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)] == [(i, held[i]) for i in best]


def test_queries_of_many_blocks(spark, monkeypatch):
    data, df = vectors(spark)
    # rows of one id in different blocks are one query
    df = df.unionByName(spark.createDataFrame([(100, [float(i) for i in range(16)], "c"), (200, data[100][1], "c")], df.schema))
    for f in (search.exact_top_k, search.approximate_neighbours):
        once = sorted(map(tuple, f(df, query_mod=20).collect()))
        with monkeypatch.context() as m:
            m.setattr(search, "BLOCK", 4)
            m.setattr(search, "PROBED", 4)
            assert sorted(map(tuple, f(df, query_mod=20).collect())) == once, f.__name__


def test_neighbours(spark):
    data, df = vectors(spark)
    unit = [(i, np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float))) for i, v in usable(data) if np.any(v)]
    got = {}
    for r in search.approximate_neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q, u in unit:
        if q % 50 == 0:
            best = {i for s, i in sorted((-round(float(u @ v), 12), i) for i, v in unit if i != q)[:5]}
            hits, total = hits + len(best & got[q]), total + 5
    assert hits / total >= 0.9
    assert got[100] == {400, 401, 402, 403, 404}


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((300, 16)).round(3)
    data = [(i + 1, [float(x) for x in v]) for i, v in enumerate(m)]
    data += [(100, [x * 50 for x in data[99][1]])] * 13 + [(400 + i, data[99][1]) for i in range(7)] + [(100, data[99][1])] * 8
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(1)
    got = [(r.vec_id, r.score) for r in search.exact_top_k(df).where("query_id = 100").orderBy("rank").collect()]
    whole = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in data]
    queries = {tuple(u) for i, u in whole if i == 100}
    want = sorted((-int(np.array(q) @ u), i) for q in queries for i, u in whole if i != 100)[:10]
    assert got == [(i, -s) for s, i in want]
    once = spark.createDataFrame([r for r in data if max(map(abs, r[1])) < 20], df.schema).coalesce(1)
    near = [r.vec_id for r in search.approximate_neighbours(once).where("query_id = 100").orderBy("rank").collect()]
    assert near == [400, 401, 402, 403, 404]


def test_html(spark):
    page = (
        '<html><head><title>t</title><script>var a="<p>x</p>";</script></head><body><nav><a href=/>home</a></nav><!-- <p>no</p> -->'
        "<article><h1>A &amp; B</h1><p>some  words <b>here</b><br>and\nhere<p>more of the words</article><div class='comments'><p>nice</div><footer>&copy; us</footer>"
    )
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (3, "u", "", "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract_pages(df).collect())
    text = "A & B\n\nsome words here and here\n\nmore of the words"
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (3, "", 0)]
    assert html.unescape("&copy;") not in text and not re.search("nice", text)


def test_html_parts_inside_an_article():
    weights = pages.fit()
    advert = "word " * 40
    links = "<ul>" + '<li><a href="/x">some other page</a></li>' * 15 + "</ul>"
    head, lead, body, last = "seven words stand in this head line", "a lead of four", "body " * 60, "closing words of it"
    for gap in (f"<aside>{advert}</aside>", f'<div class="newsletter"><p>{advert}</p></div>', f'<div class="ad">{advert}</div>', f"<nav>{links}</nav>", links):
        inner = f"<h1>{head}</h1><p>{lead}</p>{gap}<p>{body}</p>{gap}<p>{last}</p>"
        for page in (f"<article>{inner}</article>", f"<main><div>{inner}</div></main>", f'<div id="content">{inner}</div>'):
            text = pages.extract(f"<html><body><nav><a href=/>home</a></nav>{page}<footer>us</footer></body></html>", weights).split("\n\n")
            assert [t for t in text if t != "some other page"] == [head, lead, body.strip(), last], page
    # links outside of the article still part it from what stands before them
    page = f"<body><div>welcome guest</div>{links}<article><h1>{head}</h1><p>{body}</p></article>{links}</body>"
    assert pages.extract(page, weights) == f"{head}\n\n{body.strip()}"


def test_html_topics_and_deep_links():
    weights = pages.fit()
    page = '<article><p>one two</p><p class="notice-period">the notice period is long</p><p class="notice">gone</p><p>three four</p></article>'
    assert pages.extract(page, weights) == "one two\n\nthe notice period is long\n\nthree four"
    deep = list(pages.tokens("<a><b><i><u><s><em>deep</em></s></u></i></b></a>plain"))
    assert [(t[1], t[3]) for t in deep if t[0] == "text"] == [("deep", True), ("plain", False)]


def test_html_names_that_are_no_boilerplate():
    weights = pages.fit()
    body, end = "<p>" + "body " * 30 + "</p>", "<p>the closing words</p>"
    text = "\n\n".join(["the head line", ("body " * 30).strip(), "the closing words"])
    for page in (
        f'<article><header class="entry-header"><h1>the head line</h1></header>{body}{end}</article>',
        f'<main><header class="page-header"><h1>the head line</h1></header>{body}{end}</main>',
        f'<main><div class="post-header"><h1>the head line</h1></div>{body}{end}</main>',
        f'<div class="x"><div class="post-header"><h1>the head line</h1></div>{body}{end}</div>',
        f'<div class="x"><h1 class="header">the head line</h1>{body}{end}</div>',
        *(f'<div class="content {c}"><h1>the head line</h1>{body}{end}</div>' for c in ("has-sidebar", "no-sidebar", "with-sidebar", "has-right-sidebar", "content--has-sidebar")),
        *(f'<article><h2 id="{i}">the head line</h2>{body}{end}</article>' for i in ("share", "notice", "related-work")),
        f'<article><h1>the head line</h1>{body}<section id="related-work">{end}</section></article>',
    ):
        assert pages.extract(f"<html><body>{page}</body></html>", weights) == text, page
    # the same words still name boilerplate elsewhere
    for gone in (
        '<div class="sidebar">{}</div>', '<div class="content sidebar">{}</div>', '<div class="header">{}</div>', '<div id="share">{}</div>', '<section id="related-posts">{}</section>',
        '<section id="comments">{}</section>', '<div class="has-ads ad">{}</div>',
    ):
        outer = gone.format("<p>not of the article</p>")
        assert pages.extract(f"<body>{outer}<article><h1>the head line</h1>{body}{end}</article></body>", weights) == text, gone
        if "header" not in gone:
            assert pages.extract(f"<body><article><h1>the head line</h1>{body}{outer}{end}</article></body>", weights) == text, gone


def test_html_scan_decides_what_no_list_names():
    """Boilerplate in neutral elements: the scan leaves it out; without the scan it would stand in the text."""
    weights = pages.fit()
    body = "<p>" + "body " * 40 + "</p>"
    text = "the head line\n\n" + ("body " * 40).strip()
    notes = ('<div class="legal">all prices may change at any time</div>', '<div class="x1"><p>you are reading this as a guest today</p></div>', '<div class="ad">buy our shoes now</div>')
    for note in notes:
        for main in (f"<article><h1>the head line</h1>{body}</article>", f"<main><div><h1>the head line</h1></div><div>{body}</div></main>", f"<h1>the head line</h1><article>{body}</article>"):
            assert pages.extract(f"<html><body>{note}{main}{note}</body></html>", weights) == text, (note, main)
    # pages without such elements: a headline of one word in an element of its own stays
    free = f'<body><nav><a href="/">home</a></nav><div id="content"><div><h1>Bread</h1></div><div>{body}</div></div><footer>us</footer></body>'
    assert pages.extract(free, weights) == "Bread\n\n" + ("body " * 40).strip()
    # few words in an article do not make the rest of a page boilerplate
    cards = f'<body><div id="content">{body}</div><div><article>a card</article></div></body>'
    assert ("body " * 40).strip() in pages.extract(cards, weights)


def test_best_run_against_every_run():
    rng = np.random.default_rng(9)
    for _ in range(300):
        scores = [int(x) for x in rng.integers(-5, 6, int(rng.integers(0, 14)))]
        runs = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        lo, hi = pages.best_run(scores, [None] * len(scores))
        assert sum(scores[lo:hi]) == max([0, *(r[0] for r in runs)])
    # what parts two texts of one region costs nothing, what stands before them still does
    assert pages.best_run([4, -9, 2, -50, 3, -1, 1], [None, None, 1, None, 1, None, None]) == (2, 5)


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    vocab = [f"v{i}" for i in range(60)]
    data, marks = [], []
    for i in range(800):
        bad = i % 8 == 0
        text = list(rng.choice(vocab, 40)) + (["vile"] if bad else [])
        data.append((i, " ".join(text), "x"))
        marks.append((i, int(bad)))
    data += [(900, None, "x"), (901, "", "x"), (None, "v1", "x"), (900, None, "x")]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [(r.predicted, int(r.doc_id % 8 == 0)) for r in got if r.held_out and r.doc_id < 800]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, none).collect())


def test_toxicity_of_inflected_words(spark):
    """Toxic words of one stem, each with an ending that no other text has; clean texts share the other beginnings."""
    rng = np.random.default_rng(6)
    vocab = [f"v{i}" for i in range(60)]
    data = [(i, " ".join([*rng.choice(vocab, 40), *([f"Réprou{i}x", f"réprou{i}y"] if i % 8 == 0 else [f"rézon{i}x", f"rézon{i}y"])])) for i in range(800)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(800)], "doc_id long, toxic int")
    got = [(r.predicted, int(r.doc_id % 8 == 0)) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect() if r.held_out]
    assert sum(a == b for a, b in got) / len(got) > 0.95 and any(b for _, b in got)
    assert sum(a for a, b in got if b) / sum(b for _, b in got) > 0.9


def test_toxicity_features_that_are_wanted():
    hasher, texts = common.WordHasher(), [words(300).encode(), b"", "Été été étés, étés".encode(), b"one"]
    every = toxicity.features(hasher, texts)
    flags = np.zeros(toxicity.BUCKETS, bool)
    flags[np.concatenate(every)[::3]] = True
    for x, y in zip(every, toxicity.features(hasher, texts, flags), strict=True):
        assert np.array_equal(x[flags[x]], y)
    # two words; beginnings of 3 and 4 letters; those that are frequent: both
    assert [len(x) for x in every[1:]] == [0, 6, 2]


def test_risk_against_a_plain_restatement():
    """One step from the start moves every weight against the slope of the non-negative risk, by finite differences."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 6)) for _ in range(60)]
    p, u, prior = rows[:20], rows[20:], 0.3

    def risk(w, b):
        z = [np.array([w[r].sum() + b for r in side]) for side in (p, u)]
        left = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
        assert left > 0
        return prior * np.logaddexp(0, -z[0]).mean() + left

    start = np.log(prior / (1 - prior))
    slope = [(risk(1e-5 * np.eye(12)[j], start) - risk(-1e-5 * np.eye(12)[j], start)) / 2e-5 for j in range(12)]
    before = toxicity.EPOCHS
    toxicity.EPOCHS = 1
    try:
        w, _ = toxicity.fit(p, u, prior)
    finally:
        toxicity.EPOCHS = before
    assert np.allclose(w[:12], -toxicity.RATE * np.sign(slope), atol=1e-4) and not w[12:].any()


def test_odd_rows(spark, odd):
    n = odd.count()
    for f in (substrings.dedup_substrings, lines.dedup_lines, jaccard.jaccard_components, sharding.shard_documents, mixing.taken_words):
        assert len(f(odd).collect()) == n, f.__name__
    empty = spark.createDataFrame([], SCHEMA)
    for f in (substrings.dedup_substrings, lines.dedup_lines, jaccard.jaccard_components, sharding.shard_documents, mixing.taken_words):
        assert f(empty).count() == 0, f.__name__
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.exact_top_k(none).count() == 0 and search.approximate_neighbours(none).count() == 0
