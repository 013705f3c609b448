import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import jaccard_join, language_id, mixing, ngram_lm, sentencepiece_codec, substring_dedup, url_filter
from quire.llm.text import text_bytes

from .conftest import words


def test_substring_dedup(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    first = {}
    for i, t in rows:
        w = words(t, lower=False)
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = Counter()
    for i, t in rows:
        w = words(t, lower=False)
        gone = {k + j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()] += 1
    assert sum(k[2] for k in want) > 500
    got = substring_dedup.remove_duplicates(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got.collect()) == want
    assert substring_dedup.remove_duplicates(empty).count() == 0
    # factors name a smaller document with the same words, and cover the same words
    texts, covered = {i: words(t, lower=False) for i, t in rows}, {}
    for f in substring_dedup.factors(docs).collect():
        own, source = texts[f.id][f.start : f.end], texts[f.source][f.source_start : f.source_start + f.end - f.start]
        assert f.source < f.id and len(own) == f.end - f.start >= 50 and own == source, f
        covered.setdefault(f.id, set()).update(range(f.start, f.end))
    assert {(i, len(c)) for i, c in covered.items()} == {(k[0], k[2]) for k in want if k[2]}
    assert substring_dedup.factors(empty).count() == 0


def test_substring_dedup_factors(spark):
    """A factor is as long as its source goes on, across blocks; at its boundary the parse finds the next source."""
    w = [f"w{i}" for i in range(1000)]
    texts = {1: w[:100], 2: w[50:150], 3: w[:150], 4: ["x", *w[200:900]], 5: ["y", "y", *w[200:900], "z"], 6: w[200:249]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in substring_dedup.factors(df).collect()}
    assert got == {(2, 0, 50, 1, 50), (3, 0, 100, 1, 0), (3, 51, 150, 2, 1), (5, 2, 702, 4, 1)}


def test_substring_dedup_hot_anchors(spark, monkeypatch):
    """Anchors dealt by their windows' hashes give the same spans."""
    monkeypatch.setattr(substring_dedup, "REPORTED", 1)
    shared = " ".join(f"s{i}" for i in range(70))
    df = spark.createDataFrame([(i, f"{'a ' * (i % 3)}x{i} {shared} y{i}") for i in range(1500)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_duplicates(df, texts_too=False).collect()}
    assert got[0] == (72, 0) and all(got[i][1] == 70 for i in range(1, 1500))


def test_lm(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    tokens = [(i, [*words(t), b"\0end"]) for i, t in rows]
    train = [t for i, t in tokens if fold(i) != 2]
    count = Counter(w for t in train for w in t)
    n, v = sum(count.values()), len(count)
    pairs, context = Counter(), Counter()
    for t in train:
        for a, b in zip([b"\0begin", *t], t, strict=False):
            pairs[a, b] += 1
            context[a] += 1
    got = {}
    for r in ngram_lm.score_documents(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert Counter(i for i, _ in rows) == Counter({i: len(x) for i, x in got.items()})
    for i, t in tokens:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i) == 2, len(t), sum(count[w] > 0 for w in t), n) and math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 for r in got[i])
    assert ngram_lm.score_documents(empty).count() == 0


def test_lm_weights():
    rng = np.random.default_rng(1)
    width = ngram_lm.BINS + 1
    p2, p1 = rng.random(50), rng.random(50) / 50
    cells = 3 * width * width + np.arange(50)
    w = ngram_lm.learn_weights(cells, np.ones(50), p2, p1, 1e-6)
    loss = lambda x: -np.log(x[0] * p2 + x[1] * p1 + x[2] * 1e-6).sum()
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0
    assert loss(w[3]) <= min(loss(x) for x in ([0.5, 0.4, 0.1], [0.9, 0.05, 0.05], [0.3, 0.6, 0.1])) + 1e-6
    assert (w[5] == w[3]).all()


def test_lm_is_a_distribution(spark):
    """A model of a few words gives all continuations of a context 1 in all."""
    texts = ["a b a", "b a", "a", "b b a", "a a b"] * 6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    probe = df.unionByName(spark.createDataFrame([(i, t) for i, t in ((10_001, "a"), (10_003, "zz"))], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in ngram_lm.score_documents(probe).collect()}
    assert all(x < 0 for x in got.values()) and got[10_001] > got[10_003]


def brute_components(rows, n=5):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return Counter((i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows))


def test_jaccard(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect())
    assert got == brute_components(rows)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_chains_and_rounds(spark, monkeypatch):
    """Chains whose ends aren't alike, and texts that share much but not enough, with every number of rounds."""
    rows, base = [], [f"w{i}" for i in range(60)]
    for i in range(12):
        rows.append((i, " ".join(base[i : i + 40])))
        rows.append((100 + i, " ".join([*base[:20], *[f"u{i}_{k}" for k in range(30)]])))
        rows.append((200 + i, " ".join([*base[:35], f"v{i}", *base[36:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    for rounds, few in ((0, 0), (2, 0)):
        monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", rounds)
        monkeypatch.setattr(jaccard_join, "FEW_PAIRS", few)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()) == want


def test_language_id(spark, docs, empty):
    rows = [(i, ("the cat and the dog went " if i % 2 else "le chat est dans la maison ") * (i % 4 + 1), "en" if i % 2 else "fr") for i in range(200)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language_id.detect(docs.select("doc_id", "text", "lang"), model)
    for r in got.collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    probe = spark.createDataFrame([("the dog and the cat",), ("la maison est le chat",), (None,)], "text string")
    assert [r.lang_pred for r in language_id.detect(probe, model).collect()] == ["en", "fr", "und"]
    assert language_id.detect(empty, model).count() == 0
    assert language_id.fit(empty) is None and [r.lang_pred for r in language_id.detect(probe, None).collect()] == ["und"] * 3


def test_language_windows():
    model = language_id.train([b"aaaa", b"bbbb"] * 40, ["A", "B"] * 40, epochs=20)
    p = language_id.score(model, [b"a" * 1000, b"b" * 10, b"a" * 256 + b"b" * 256, b""])
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and abs(p[2, 0] - 0.5) < 0.2 and np.allclose(p.sum(1), 1)


def test_mixing(spark, docs, empty):
    rows = [(i, "good fine text here " * 5 if i % 3 == 0 else "poor weak words there " * 5 if i % 3 == 1 else "bad vile trash talk " * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, ("high", "low", "toxic")[i % 3]) for i in range(0, 300, 2)], "doc_id long, domain string")
    targets = {"high": 0.6, "low": 0.3, "toxic": 0.1}
    got = mixing.mixed(df, labels, targets).toPandas()
    totals = {d: (got.n_tokens * got.rate * got[f"p_{d}"]).sum() for d in targets}
    assert all(abs(totals[d] / got.n_tokens.sum() - targets[d]) < 0.01 for d in targets) and (got.rate >= 0).all()
    assert abs((got.n_tokens * got.copies).sum() - sum(totals.values())) < 0.1 * sum(totals.values())
    hard = mixing.mixed(df, labels, None, {"high": 1.0, "low": 1.0, "toxic": 0.0}).toPandas()
    assert (hard[hard.doc_id % 3 == 2].rate < 0.5).all() and (hard[hard.doc_id % 3 != 2].rate >= 0.5).all()
    own = mixing.mixed(docs, labels, targets)
    assert own.count() == docs.count() and own.where("n_tokens = 0").count() == 3
    assert mixing.mixed(empty, labels, targets).count() == 0
    assert set(mixing.mixed(df, labels.limit(0), targets).toPandas().p_high.round(6)) == {0.333333}
    nothing = spark.createDataFrame([(None, 1), (1, None), (0, 0), (1, 0), (1, 1)], "q int, t int").select(mixing.quality_domain(F.col("q"), F.col("t")).alias("d"))
    assert [r.d for r in nothing.collect()] == [None, None, "low", "high", "toxic"]


def test_mixing_reaches_rare_domains(spark, caplog):
    """Targets within reach are met where a rare domain must grow and posteriors aren't sharp; what can't be met is told."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (3000, 3))
    x[np.arange(3000), rng.choice(3, 3000, p=[0.98, 0.015, 0.005])] += 5
    x = np.exp(x + np.log([0.98, 0.015, 0.005]))
    p, n = x / x.sum(1, keepdims=True), rng.integers(20, 400, 3000)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>").repartition(2).cache()
    targets = n.sum() * np.array([0.2, 0.2, 0.6])
    with caplog.at_level("INFO", "quire.llm.mixing"):
        r = mixing.rates(p, mixing.fit_rates(members, targets))
        assert np.abs(p.T @ (n * r) - targets).sum() <= 1e-5 * targets.sum() and (r >= 0).all()
        assert caplog.records[-1].levelname == "INFO"
        mixing.fit_rates(members, n.sum() * np.array([0.0, 0.0, 1.0]), 3)
        assert caplog.records[-1].levelname == "WARNING"


@pytest.fixture(scope="module")
def piece_model():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def test_pieces_equal_the_library(piece_model, docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
    texts = ["a  b", "  foo", "x   y \n z ", " ", "", "don't </s> a\r\n", "日本語 😀 ok", "▁a▁▁b", "aaaaaaaaaaaa", "é è ü" * 5, "\0\1 z", "the " * 50 + " " * 40 + "q"]
    texts += [r.text for r in docs.collect() if r.text]
    model = sentencepiece_codec.Model.read(piece_model)
    ids, at = model.encode(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == library.encode(t), t[:50]
        assert model.decode(own).decode() == t.replace("▁", " ")
    got = sentencepiece_codec.encoded(docs, piece_model)
    assert all(r.decoded == (docs_text or "") for r, docs_text in zip(got.orderBy("doc_id", "decoded").collect(), [r.text for r in docs.orderBy("doc_id", "text").collect()], strict=True))
    assert sentencepiece_codec.encoded(empty, piece_model).count() == 0
    with pytest.raises(ValueError):
        model.decode(np.array([40_000]))


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_is_the_best_sum():
    import struct

    part = lambda number, body: varint(number << 3 | 2) + varint(len(body)) + body
    piece = lambda text, score, kind=1: part(1, part(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -3.2, "ba": -3.1, "aba": -6.0, "é": -4.0}
    data = piece("<unk>", 0, 2) + b"".join(piece(t, s) for t, s in scores.items()) + part(2, varint(3 << 3) + varint(1)) + part(3, part(1, b"identity") + varint(4 << 3) + varint(0))
    model = sentencepiece_codec.Model.read(data)
    names, worst = {p.decode().replace(" ", "▁"): i for i, p in enumerate(model.pieces)}, min(scores.values()) - sentencepiece_codec.UNKNOWN_PENALTY

    def best(word):
        table = [(0.0, [])]
        for i in range(1, len(word) + 1):
            options = [(table[j][0] + scores[word[j:i]], [*table[j][1], names[word[j:i]]]) for j in range(i) if word[j:i] in scores]
            options += [(table[i - 1][0] + worst, [*table[i - 1][1], 0])] if word[i - 1] not in scores else []
            table.append(max(options, key=lambda o: o[0]))
        return table[-1][0]

    texts = ["abab", "aba é", "bbaab", "xaby", "", "ab ab aba"]
    ids, at = model.encode(*text_bytes(pa.array(texts)))
    for k, t in enumerate(texts):
        own = ids[at[k] : at[k + 1]].tolist()
        got = sum(worst if i == 0 else scores[model.pieces[i].decode().replace(" ", "▁")] for i in own)
        want = sum(best("▁" + w) for w in t.split(" ")) if t else 0
        assert math.isclose(got, want), t


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]


def test_url_rules(spark):
    urls = ["https://A.example.com/en/x?q", "http://www.EXAMPLE.com/en/", "http://notexample.com/en/", "http://x.org/es/", "http://com", "http://a.net/es/#f", "no scheme", None, "http://x.com:80/", "ftp://u@h.com/p#://z"]
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df.drop("host"), RULES).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("com/", "allow")
    assert got[3][2:] == (None, "allow") and got[4] == ("com", "", None, "allow") and got[5][2:] == ("net/es/", "block") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8][0] == "x.com:80" and got[9][:2] == ("u@h.com", "/p")
    assert url_filter.judge(df.limit(0), RULES).count() == 0


def test_url_propagation(spark):
    """Hosts are judged as plain iterations over the link graph judge them."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a><a href="/own">y</a>' for h in hosts)
    pages = [("http://good.com/", link("near.org", "far.org")), ("http://near.org/", link("far.org")), ("http://bad.net/es/", link("good.com")), ("http://shady.org/", link("bad.net", "bad.net", "near.org")), ("http://worse.org/a", link("shady.org")), ("http://alone.org/", None)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    edges = Counter()
    for u, h in pages:
        src = u.split("/")[2]
        for piece in (h or "").split('href="https://')[1:]:
            if (dst := piece.split("/")[0]) != src:
                edges[src, dst] += 1
    hosts = {x for e in edges for x in e} | {u.split("/")[2] for u, _ in pages}
    t0, b0 = {h: float(h == "good.com") for h in hosts}, {h: float(h == "bad.net") for h in hosts}
    trust, bad = dict(t0), dict(b0)
    out, into = defaultdict(int), defaultdict(int)
    for (a, b), n in edges.items():
        out[a] += n
        into[b] += n
    for _ in range(url_filter.ROUNDS):
        trust, bad = (
            {h: 0.15 * t0[h] + 0.85 * sum(trust[a] * n / out[a] for (a, b), n in edges.items() if b == h) for h in hosts},
            {h: 0.15 * b0[h] + 0.85 * sum(bad[b] * n / into[b] for (a, b), n in edges.items() if a == h) for h in hosts},
        )
    want = {h: "block" if bad[h] and bad[h] >= 0.5 * (bad[h] + trust[h]) else "allow" for h in hosts}
    got = {r.host: r.verdict for r in url_filter.judge(df, RULES).where("rule is null").collect()}
    assert got == {h: want[h] for h in got} and got["worse.org"] == "block" and got["near.org"] == "allow"


def _chain_pages(n):
    """A blocked host linked from the end of a chain of n hosts, and a good one at the chain's side."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    pages = [("http://bad.net/es/", None), ("http://good.com/", link("side.org")), ("http://side.org/", link("good.com")), ("http://h0.org/", link("bad.net"))]
    return pages + [(f"http://h{i}.org/", link(f"h{i - 1}.org", *(["side.org"] if i == 3 else []))) for i in range(1, n)]


def test_url_propagation_converges(spark):
    """Chains longer than the SQL's rounds are judged as the solved equations judge them."""
    pages = _chain_pages(12)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    hosts = [u.split("/")[2] for u, _ in pages]
    at = {h: i for i, h in enumerate(hosts)}
    a = np.zeros((len(hosts), len(hosts)))
    for u, h in pages:
        for piece in (h or "").split('href="https://')[1:]:
            a[at[u.split("/")[2]], at[piece.split("/")[0]]] += 1
    forth, back = a / np.maximum(1, a.sum(1, keepdims=True)), a / np.maximum(1, a.sum(0, keepdims=True))
    seed = lambda h: np.eye(len(hosts))[at[h]]
    trust = np.linalg.solve(np.eye(len(hosts)) - 0.85 * forth.T, 0.15 * seed("good.com"))
    bad = np.linalg.solve(np.eye(len(hosts)) - 0.85 * back, 0.15 * seed("bad.net"))
    edges = url_filter.host_edges(df.select(url_filter.host_of(F.col("url")).alias("host"), "html"))
    nodes = spark.createDataFrame([(h, int(h == "good.com"), int(h == "bad.net")) for h in hosts], "host string, allowed long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(nodes, edges).collect()}
    assert all(np.allclose(got[h], (trust[i], bad[i]), rtol=1e-7, atol=0) for h, i in at.items())
    assert got["h11.org"][1] > got["h11.org"][0]  # a block, 12 links from the only seed that is near
    with pytest.raises(ValueError, match="settled in 8 rounds"):
        url_filter.propagate(nodes, edges, most_rounds=8)
