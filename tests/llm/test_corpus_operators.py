"""Every corpus operator against a brute-force version, and on odd input."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import decontaminate, exact_dedup, html_main, language_id, ngram_lm, packing, queries, simhash, suffix_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null and empty texts, ties, repeated rows and ids, white space only, a long text, columns whose names operators use.
ODD = [(5, None), (1, ""), (2, "a b  c\td"), (9, "ab cd"), (3, "a bc d"), (3, "a bc d"), (None, "lone text"), (None, "other text"), (4, " \n "), (7, "word " * 60_000), (8, "é" * 300), (6, "w1 w2 w3 w4")]


def odd(spark):
    rows = [(i, t, "x", "y", "z", 1, 2) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, norm string, fp string, h string, sha int, rank int")


def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


# ------------------------------------------------------------------------------------------------ 1


def test_html_template_matches_a_plain_reading(spark, sf_dir):
    rows = html_main.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|<footer>)", source[r.page_id], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<nav>menu</nav>", ""), ("<article><p>a&lt;b&nbsp;c<br>d<p>e</article>", "a<b c d\n\ne"),
    ("<article><h1>T</h1><p>x<div class='ad-slot'>buy</div><p>y<section id=comments><p>nice</section></article><footer>f", "T\n\nx\n\ny"),
    ("<main><header><h1>T</h1></header><form>name<input></form><p>b<b>o</b>ld<script>if (a<b) c</script> <!-- n > --> end</main", "T\n\nbold end"),
    ("<body><header>Site</header><div class=sidebar><p>" + "long text. " * 30 + "</div><div id=content><p>" + "main. " * 30 + "</div>", " ".join(["main."] * 30)),
    ("<article><p>one <a href='x>y'>link</a> two</article>", "one link two"), ("<article><p>a <ins class='ad'>buy</ins>b <span hidden>no</span>c</p><ol class=commentlist><li>nice</ol></article>", "a b c"),
    ("<body class='has-sidebar'><div class='cookie-notice' role=alert>We use cookies</div><article><p>x</article><div class='related-posts'><article><p>teaser</article></div>", "x"),
])
def test_html_cases(page, text):
    assert html_main.main_text(page) == text


def test_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        cost = lambda x: -sum(o for o, b in zip(odds, x, strict=True) if b) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        assert math.isclose(cost(html_main.min_cut(odds, edges)), min(map(cost, itertools.product([False, True], repeat=n))), abs_tol=1e-9)


def test_html_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, 3), (1, None, None, 3), (None, "u", "<p>" + "x " * 200_000, 4)], "page_id long, url string, html string, text int")
    out = html_main.extract(rows).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 399_999]
    assert html_main.extract(rows.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------ 2


def brute_groups(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        out.append((i, min(g)[3], len(g), i == min(g)[3], hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keys", [50_000, 1])
def test_exact_groups(spark, keys):
    out = exact_dedup.exact_groups(odd(spark), bucket_keys=keys).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, out), key=str) == brute_groups(ODD)
    assert exact_dedup.exact_groups(nothing(spark)).count() == 0


def test_exact_dedup_keeps_one_row_of_each_group(spark):
    kept = exact_dedup.exact_dedup(odd(spark)).collect()
    texts = [re.sub(r"\s", "", r.text or "") for r in kept]
    assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", t or "") for _, t in ODD})
    assert kept[0].asDict().keys() == set(odd(spark).columns)


def test_directory_splits_until_buckets_fit(spark):
    cells = spark.createDataFrame([(i, 10) for i in range(64)] + [(60_000, 500)], "cell int, n long")
    rows = exact_dedup.directory(cells, 100).collect()
    load = Counter()
    for r in rows:
        load[r.bucket] += 500 if r.cell == 60_000 else 10
    assert len(rows) == 65 and all(n <= 100 or b == 60_000 for b, n in load.items())
    assert all(r.bucket == r.cell >> (16 - r.depth) << (16 - r.depth) for r in rows)


# ------------------------------------------------------------------------------------------------ 3


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(3000)]
    item = [rng.choice(vocabulary) for _ in range(30)]
    near = list(item)
    near[7] = near[21] = "other"
    clean = [rng.choice(vocabulary) for _ in range(400)]
    upper = " ".join(item).upper().replace(" ", ", ")
    rows = [(1, " ".join(clean[:50] + item + clean[50:])), (2, " ".join(clean[:9] + near)), (3, " ".join(clean)), (4, upper), (5, " ".join(clean + item[:12])), (6, None), (7, ""), (8, " ".join(item[5:19]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "tiny item"), (12, None), (13, "exactly six words in this item")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert {i for i, r in found.items() if r.contaminated} == {1, 2, 4, 8}
    assert (found[1].item_id, found[1].start_word, found[1].n_words, found[1].n_equal) == (10, 50, 30, 30)
    assert found[2].n_equal == 28
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 5, 6, 7]
    assert decontaminate.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_agrees_with_brute_force(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [tokens(r.text) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = " " + " ".join(tokens(r.text)) + " "
        if any(" " + " ".join(i) + " " in w for i in items):
            want.add(r.doc_id)
    got = {r.doc_id for r in decontaminate.contaminated(docs, bench).where("contaminated").collect()}
    assert want <= got and len(got - want) <= 2


def test_two_substitutions_in_thirteen_words_leave_a_seed():
    for a, b in itertools.combinations(range(13), 2):
        bad = {a, b}
        assert any(all(s + k not in bad for k, u in enumerate(m) if u == "1") for m in decontaminate.MASKS for s in range(13 - len(m) + 1)), (a, b)


# ------------------------------------------------------------------------------------------------ 4


def test_toxicity_learns_and_handles_odd_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    right = sum((found[i] >= 0.5) == bool(y) for i, y in truth.items())
    assert right / len(truth) > 0.9
    out = toxicity.scored(odd(spark), model).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 4, 5)}) == 1
    assert toxicity.scored(nothing(spark), model).count() == 0
    kept = toxicity.keep_clean(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == sum(r.score < 0.5 for r in out)
    assert {r.score for r in toxicity.scored(odd(spark), toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_gradients_match_differences():
    import numpy as np

    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(3).items()}
    rng = np.random.default_rng(0)
    x, ids = rng.standard_normal((6, toxicity._IN)).astype(np.float32), np.array([[0, 1], [2, 3], [4, 6], [5, 6]])
    p = {k: v.astype(np.float32) for k, v in p.items()}
    logit, kept = toxicity.forward(p, x, ids, keep=True)
    g, dx = toxicity.backward(p, x, ids, kept, np.ones(2, np.float32))
    loss = lambda: float(toxicity.forward(p, x, ids).sum())
    for name in ("uf", "ub", "wf", "cb", "wa", "va", "out"):
        flat, want = p[name].reshape(-1), g[name].reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 4)):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - want[k]) < 5e-3, name
    old = x[2, 1]
    x[2, 1] = old + 1e-2
    up = loss()
    x[2, 1] = old - 1e-2
    down = loss()
    assert abs((up - down) / 2e-2 - dx[2, 1]) < 5e-3


def test_windows_overlap_and_cover():
    import numpy as np

    row, first, n = toxicity.windows(np.array([0, 0, 5, 5 + 40, 45 + 41, 86 + 1000]))
    assert set(row) == set(range(5))
    for r, (a, b) in enumerate(((0, 0), (0, 5), (5, 45), (45, 86), (86, 1086))):
        own = [(f, f + k) for q, f, k in zip(row, first, n, strict=True) if q == r]
        assert set().union(*(range(*x) for x in own)) == set(range(a, b))
        assert all(x[1] > y[0] for x, y in zip(own, own[1:], strict=False))


# ------------------------------------------------------------------------------------------------ 5


def test_language_follows_text_declaration_and_host(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = {r.lang: r.text for r in docs.where("n_chars > 800").collect()}
    page = lambda lang, text: f"<html lang='{lang}'><body><article><p>{html.escape(text)}</article>"
    rows = [(k, "http://a.example.com/x", page(lang, t)) for k, (lang, t) in enumerate(sorted(sample.items()))]
    rows += [(100 + k, "http://only-fr.example.org/p", page("fr", sample["fr"])) for k in range(20)]
    rows += [(200, "http://only-fr.example.org/q", "<html><body></body></html>"), (201, None, None), (202, "http://b.net/", page("fr", "")), (202, "http://b.net/", page("fr", ""))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("post", F.lit("clash"))
    out = language_id.identify(pages, docs).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.lang for r in out}
    assert [got[k] for k in range(len(sample))] == sorted(sample)
    assert got[200] == "fr" and got[202] == "fr" and got[201] in sample
    assert language_id.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language_id.identify(pages, docs.limit(0)).collect()} == {None}


# ------------------------------------------------------------------------------------------------ 6


def test_lm_counts_and_normalises(spark):
    rows = [(1, "the cat sat"), (2, "The cat ran the race"), (3, None), (4, "a b a b a b"), (4, "a b a b a b"), (5, "unseen words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    training = docs.where("doc_id <> 5")
    folder = ngram_lm.train(training)
    out = {(r.doc_id): r for r in ngram_lm.scored(docs, folder).collect()}
    counts = Counter(w for i, t in rows if i != 5 for w in [*words(t), b"</s>"])
    total, kinds = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*words(t), b"</s>"]
        assert out[i].n_tokens == len(w) and out[i].n_known == sum(counts[x] > 0 for x in w) and out[i].train_tokens == total
        assert math.isclose(out[i].base_score, sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w))
    assert ngram_lm.scored(nothing(spark), folder).count() == 0
    empty = ngram_lm.train(nothing(spark))
    assert {(r.base_score, r.score) for r in ngram_lm.scored(docs, empty).collect()} == {(0.0, 0.0)}


# ------------------------------------------------------------------------------------------------ 7


def brute_repeats(rows):
    seen, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.setdefault(b[k : k + 100], (i, k))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_bytes(spark, monkeypatch, hot):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, phrase = text(260), text(60)
    rows = [(1, text(90) + shared), (2, shared[30:] + text(50)), (3, text(99)), (4, "ab" * 300), (5, None), (6, ""), (7, shared[:99]), (8, text(40) + shared[:140] + text(30) + shared[100:] + text(10)), (9, "z" * 250)]
    rows += [(20 + k, text(80) + phrase + text(80)) for k in range(12)] + [(40, rows[0][1]), (41, rows[7][1])]
    monkeypatch.setattr(suffix_dedup, "PART", 150)  # texts are scanned in overlapping parts
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"tag": F.lit(1), "start": F.lit("x")}).repartition(3)
    out = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_repeated_bytes_odd_rows(spark):
    out = suffix_dedup.remove_repeats(odd(spark)).collect()
    assert len(out) == len(ODD)
    assert {r.n_removed for r in out if r.doc_id == 7} == {299_995}  # all but the first word
    assert suffix_dedup.remove_repeats(nothing(spark)).count() == 0


# ------------------------------------------------------------------------------------------------ 8


def test_url_rules(spark):
    urls = ["http://A.example.COM/en/71?x", "http://a.example.com/en/9", "https://x.net/de/1", "http://net/de/", "http://notnet/de/", "ftp://example.net/de/8#f", "no scheme", None, "", "http://org", "http://q.org/es/", "HTTP://u://x.com/en/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("key", F.lit(1))
    rules = spark.createDataFrame(list(queries.URL_RULES), "host string, path string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()]

    def brute(k, u):
        rest = (u or "").split("://", 1)[1] if u and "://" in u else None
        host = re.split(r"[/?#]", rest)[0] if rest is not None else ""
        path = re.split(r"[?#]", rest[len(host) :])[0] if rest is not None else ""
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (k, host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "allow")

    assert sorted(got, key=str) == sorted([brute(k, u) for k, u in enumerate(urls)] + [brute(0, urls[0])], key=str)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_are_those_of_the_contract(spark, tmp_path):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    asked = [(word, key, k) for k, (word, key) in enumerate(rule.split() for rule in contract.split(", "))]
    spark.createDataFrame([(k, f"https://www.{key}x") for _, key, k in asked], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.verdict, r.rule) for r in queries.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == {k: (word, key) for word, key, k in asked}


def test_bloom_filter_has_no_false_negatives(spark):
    rules = spark.createDataFrame([(f"h{i}.com", f"/p{i % 7}", "block") for i in range(3000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i % 7}/x") for i in range(3000)] + [(9000 + i, f"http://other{i}.org/") for i in range(500)], "page_id long, url string")
    out = url_filter.filter_urls(pages, rules)
    assert out.where("verdict = 'block'").count() == 3000


# ------------------------------------------------------------------------------------------------ 9


def test_packing_places_every_piece(spark, sf_dir):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 100_000).dropDuplicates(["doc_id"]))
    rows = packing.pack(docs, path).collect()
    tokenizer = Tokenizer.from_file(path)
    import numpy as np

    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    total = 0
    for d in docs.collect():
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        total += len(ids)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == 1 or all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.length <= 2048 and zlib.crc32(ids[r.start : r.start + r.length]) == r.ids_crc32
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for slots in sequences.values():
        at = 0
        for offset, n in sorted(slots):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) * 1.05 + 1


def test_quick_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    exact = Tokenizer.from_file(path)
    texts = ["", " ", "it's  a\n\n test<|endoftext|>", "\u00a0x\u0085y", "aaaa" * 500, "日本語 text", "é\u0301 ñ ß", "tab\t\tx \r\n y", "a" * 399 + " b", "1234567 8.9", "don't DON'T", "\ud7ff", "x" + " " * 900 + "y", "\u2028line"]
    assert packing.encoder(path)(texts) == [exact.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_fills_slots_once():
    rng = random.Random(5)
    for _ in range(20):
        histogram = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(rng.randint(1, 300))}
        use, ranks = defaultdict(list), defaultdict(list)
        for length, rank, count, first, offset in packing.plan(histogram):
            ranks[length] += range(rank, rank + count)
            for k in range(count):
                use[first + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
        for slots in use.values():
            at = 0
            for offset, n in sorted(slots):
                assert offset == at
                at += n
            assert at <= 2048
    assert packing.plan({}) == []


def test_packing_odd_rows(spark):
    rows = packing.pack(odd(spark), queries.tokenizer_path()).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD)
    assert packing.pack(nothing(spark), queries.tokenizer_path()).count() == 0


# ------------------------------------------------------------------------------------------------ 10


def brute_fingerprint(t):
    w = words(t)
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, 2**63), 2**63 if d is None else d)
    shown = lambda x: None if x == 2**63 else x
    return sorted(((d, f"{fp[i]:016x}", shown(least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_components(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    long = " ".join(f"w{k}" for k in range(4000))
    rows += [(1000 + k, long + f" tail{k} x y") for k in range(30)] + [(None if i is None else i + 5000, t) for i, t in ODD]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == brute_components(rows)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_bit_sliced_links_find_all_pairs(spark, monkeypatch, bucket):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    edges = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    roots = {r.u: r.root for r in simhash.components(edges).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {x: roots.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_near_dedup_keeps_the_smallest_of_a_component(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(9, long), (4, long + " end of it"), (5, "quite another text here"), (7, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    want = {c for _, _, c in brute_components(rows)}
    assert {r.doc_id for r in simhash.near_dedup(docs).collect()} == want
    assert simhash.near_groups(nothing(spark)).count() == 0
