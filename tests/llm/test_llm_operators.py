"""Each operator on odd rows and empty tables, and against a plain version on small ones."""

import bisect
import hashlib
import html as entities
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from citewright.llm import common, decontam, exact, html, lines, lm, minhash, packing, quality, sharding, suffix

SF = "/root/testdata/sf0.001"


def documents(spark):
    return common.table(spark, SF, "documents").select("doc_id", "text")


def texts(spark):
    return {r.doc_id: r.text or "" for r in documents(spark).collect()}


# --- exact dedup ---


def plain_groups(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    return {(k, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for k in g}


@pytest.mark.parametrize("bits", [{}, {"max_bits": 1 << 16, "bits_per_row": 1}])
def test_exact_groups(spark, odd, empty, bits):
    out = exact.exact_groups(odd, **bits).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == plain_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert len(out) == odd.count() and all(r.kept == (r.doc_id == r.keep_id) for r in out)
    assert exact.exact_groups(empty).count() == 0
    left = exact.exact_dedup(odd)
    assert left.columns == odd.columns and 6 not in [r.doc_id for r in left.collect()]


@pytest.mark.parametrize("bits", [{"max_bits": 1 << 16}, {"max_bits": 1 << 16, "bits_per_row": 2}])
def test_filters_by_range(spark, bits):
    assert exact.filter_sizes(20_000, max_bits=1 << 16) == (5, 1 << 16) and exact.filter_sizes(10**9, max_bits=1 << 28) == (60, 1 << 28)
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.pmod("id", F.lit(15_000))).alias("text"))
    out = exact.exact_groups(rows, **bits).agg(F.sum(F.col("kept").cast("int")), F.max("group_size"), F.count("*")).first()
    assert tuple(out) == (15_000, 2, 20_000)


# --- line dedup ---


def plain_lines(docs):
    seen, out = {}, {}
    for key, text in sorted(docs.items()):
        ls = text.split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            if seen.setdefault(tuple(ls[i : i + 3]), (key, i)) != (key, i):
                gone |= {i, i + 1, i + 2}
        out[key] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone))
    return out


def test_line_dedup(spark, odd, empty):
    want = plain_lines(texts(spark))
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.line_dedup(documents(spark)).collect()}
    assert got == want and any(n for _, n in want.values())
    rows = lines.line_dedup(odd).collect()
    assert len(rows) == odd.count() and {r.text for r in rows if r.doc_id == 11} == {"z\nq"} and rows[0].__fields__[:3] == ["doc_id", "text", "n_chars"]
    assert lines.line_dedup(empty).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    n = 200_000
    body = "\n".join(f"line {i}" for i in range(n // 2))
    rows = spark.createDataFrame([(1, body + "\n" + body)], "doc_id bigint, text string")
    (out,) = lines.line_dedup(rows).collect()
    assert (out.n_lines, out.n_removed, out.n_spans) == (n, n // 2, 1) and out.text == body


# --- sharding ---


def plain_shards(docs, shards):
    """Weighted rendezvous with equal weights: the greatest -1 / ln(u), u from the first 52 bits of an MD5."""
    unit = lambda key, salt: (int(hashlib.md5(f"{key}:{salt}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return {k: max(range(shards), key=lambda i: (-1 / np.log(unit(k, i)), -i)) for k in docs}


def test_shards_are_those_of_the_plain_version(spark):
    docs = texts(spark)
    rows = sharding.op3_rendezvous(spark, SF).collect()
    now, grown = plain_shards(docs, 8), plain_shards(docs, 9)
    assert {(r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows} == {(k, len(t.encode()) + 1, zlib.crc32(t.encode()), now[k], grown[k]) for k, t in docs.items()}
    assert len(rows) == len(docs) and Counter(r.shard for r in rows) == Counter(now.values())

def test_shards(spark, odd, empty):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count()
    for s, group in itertools.groupby(sorted(rows, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in group] == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert all(r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows)
    assert sharding.shard(empty).count() == 0


def test_shards_follow_weights_and_move_little(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shard(keys, weights=(1, 2, 1), grown=4).groupBy("shard", "grown_shard").count().collect()
    of = Counter()
    for r in out:
        of[r.shard] += r["count"]
    assert abs(of[1] / 20_000 - 0.5) < 0.02 and abs(sum(r["count"] for r in out if r.grown_shard == 3) / 20_000 - 0.5) < 0.02


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) "</p>"</script></head><body class="has-sidebar"><header>Site name</header>
<nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><div id="cookie-notice">We use cookies.</div><main><article><header><h1>Head &amp; line</h1></header>
<p>First&nbsp;one <a title="x>y" href=z>linked</a> wo<b>rd</b>.<p>Short.</p><form>Mail <input> <button>Go</button></form><aside class="promo">Buy</aside>
<section class="comments"><article class="comment"><p>Nice post</p></article></section></article></main><div class="sidebar"><p>Many words in the sidebar here</p></div><footer>&copy; 2020</footer></body></html>"""


def test_html_page():
    tree = html.grow(*html.labelled_rows())
    assert html.main_text(PAGE, tree) == "Head & line First one linked word. Short."
    assert html.main_text("", tree) == "" and html.main_text("<p>a<br>b &lt;c&gt;", tree) == "a b <c>"
    assert html.main_text("<div" * 2000 + "<p>" * 2000, tree) is not None
    rows, labels = html.labelled_rows()
    assert all(html.is_main(tree, r) == bool(y) for r, y in zip(rows, labels, strict=True))


def test_html_names_alone_decide_little():
    tree = html.grow(*html.labelled_rows())
    text = "Some words of a text that stand here for long enough to count as one of their own."
    for page in ('<article class="comments-open"><p>{}</p></article>', '<article class="post promo"><p>{}</p></article><footer>Ad</footer>', '<main class="social"><p>{}</p></main>', '<div id="content" class="legal"><p>{}</p></div><nav><a href="x">y</a></nav>', "<form><p>{}</p></form>"):
        assert html.main_text(page.format(text), tree) == text
    pages = common_pages("/root/testdata/sf0.01")
    for gone in (r'\s(class|id|role)="[^"]*"', r'\s(class|id|role)="[^"]*"|(?<=<)(article|nav|footer|aside)\b|(?<=</)(article|nav|footer|aside)\b'):
        same = total = 0
        for page in pages.values():
            truth = [b.inside for b in html.blocks(page)]
            found = html.blocks(re.sub(gone, lambda m: "div" if m[0][0] != " " else "", page))
            same += sum(html.is_main(tree, row) == t for row, t in zip(html.features(found), truth, strict=True))
            total += len(truth)
        assert same >= 0.99 * total


def common_pages(folder):
    rows = pq.read_table(f"{folder}/pages.parquet", columns=["page_id", "html"]).to_pylist()
    return {r["page_id"]: r["html"] for r in rows}


def test_html_pages(spark, empty):
    def plain(page):
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        return " ".join(entities.unescape(re.sub(r"<(?:/?p|/?h1|br)>", " ", article).replace("<b>", "")).split())

    pages = {r.page_id: r.html for r in common.table(spark, SF, "pages").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in html.op5_block_tree(spark, SF).collect()}
    assert got == {k: (plain(p), len(plain(p))) for k, p in pages.items()}
    odd = spark.createDataFrame([(None, None, "x"), (1, "", None), (1, "<p>a", "n")], "page_id int, html string, Text string")
    assert sorted(r.text for r in html.extract(odd).collect()) == ["", "", "a"]
    assert html.extract(empty.withColumn("html", F.lit("x"))).count() == 0


# --- decontamination ---


def plain_search(docs, items):
    words = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(item))
    out = {}
    for key, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        out[key] = (len(w), len(hit), sorted(ids))
    return out


def test_wu_manber_finds_all():
    rng = random.Random(5)
    for _ in range(60):
        text = bytes(rng.choices(b"ab ", k=200))
        patterns = list({bytes(rng.choices(b"ab ", k=rng.randint(3, 9))) for _ in range(12)})
        got = sorted(decontam.WuManber(patterns, rng.randint(1, 5)).find(text))
        assert got == sorted((i, p) for p in patterns for i in range(len(text)) if text.startswith(p, i))


def test_search(spark, odd, empty, monkeypatch):
    items = [(i, t) for i, t in enumerate(list(texts(spark).values())[:4])] + [(90, "A b, C."), (91, None), (92, "..."), (None, "été naïve"), (93, "L1 l2 l3 L4")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    docs = documents(spark).unionByName(odd.filter("doc_id is not null and doc_id < 11").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [("" if i is None else i, t) for i, t in items])
    for limit in (500_000, 40):
        monkeypatch.setattr(decontam, "WINDOWS_A_PASS", limit)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.search(docs, benchmark).collect()}
        assert got == want
    assert decontam.search(odd, benchmark).count() == odd.count() and decontam.search(empty, benchmark).count() == 0
    none = decontam.decontaminate(odd, benchmark.limit(0))
    assert none.count() == odd.count() and none.columns == odd.columns


# --- packing ---


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for source in (documents(spark), odd):
        rows = packing.pack(source).collect()
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
        for key, text in {(r.doc_id, r.text) for r in source.collect() if r.doc_id not in (None, 11)}:
            ids = whole.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
            parts = sorted(by_doc[key], key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
            assert all(r.length == 1024 for r in parts[1:])
            for r in parts:
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        places = defaultdict(list)
        for r in rows:
            places[r.sequence_id].append((r.offset, r.length))
        for p in places.values():
            p.sort()
            assert [a for a, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 1024
    assert packing.pack(empty).count() == 0


def test_bin_completion():
    rng = random.Random(2)
    for _ in range(40):
        counts = dict(Counter(rng.randint(1, 12) for _ in range(rng.randint(1, 9))))
        packed = packing.pack_counts(counts, 12, nodes=None)
        assert Counter(s for use, n in packed for s in use * n) == Counter(counts) and all(sum(use) <= 12 for use, _ in packed)
        sizes = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)

        def fewest(left, bins):
            if not left:
                return len(bins)
            return min(fewest(left[1:], [*bins[:i], b + left[0], *bins[i + 1 :]]) for i, b in enumerate([*bins, 0]) if b + left[0] <= 12)

        left = np.bincount(sizes, minlength=13)
        assert packing.lower_bound(left) <= sum(n for _, n in packed) == fewest(sizes, []) <= sum(n for _, n in packing.best_fit(left))


def plain_best_fit(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - s)
    return len(rooms)


def test_never_more_sequences_than_best_fit():
    rng = random.Random(3)
    for n in (50, 700, 3000):
        counts = Counter(min(1023, int(rng.lognormvariate(5.5, 0.9)) + 1) for _ in range(n))
        sizes = list(counts.elements())
        packed = packing.pack_counts(counts, nodes=300)
        assert Counter(s for use, m in packed for s in use * m) == counts and max(sum(use) for use, _ in packed) <= 1024
        least = plain_best_fit(sizes, 1024)
        assert sum(m for _, m in packing.best_fit(np.bincount(sizes, minlength=1025))) == least >= sum(m for _, m in packed)


def test_tokenizers_agree_on_odd_texts():
    from tokenizers import Tokenizer
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    for t in ("", " " * 300_000, "a" * 5000, "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext|>\n<|endoftext",  "it's I'LL \t\n x  y \r\n\r\n", "é́ 日本 \x00　x"):
        assert list(encode(t)) == whole.encode(t, add_special_tokens=False).ids


# --- quality ---


def test_machine_equals_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.SLOTS).astype("f"), rng.normal(size=(quality.SLOTS, 3)).astype("f"))
    slots, x = np.array([3, 9, 4, 100], np.int32), np.array([0.5, 1, 2, 0.25], np.float32)
    want = 0.3 + m.weights[slots] @ x + sum(m.factors[a] @ m.factors[b] * p * q for (a, p), (b, q) in itertools.combinations(zip(slots, x, strict=True), 2))
    assert abs(m.margins(slots, x, np.array([0]))[0] - want) < 1e-3


def test_quality(spark, odd, empty):
    docs, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    machine = quality.train(docs, labels, length=F.col("n_chars"))
    scored = quality.score(docs, machine, length=F.col("n_chars")).withColumn("out", common.remainder("doc_id", 5) == 0)
    rows = scored.join(labels, "doc_id").filter("out").select("score", "predicted", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert sum(r.predicted for r in rows if r.quality) >= 0.95 * len(good)
    out = quality.score(odd, machine).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert quality.score(empty, machine).count() == 0
    unlabelled = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, unlabelled).collect()} == {0.5}


# --- near duplicates ---


def plain_components(docs, percent=75):
    sets = {}
    for k, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2):
        common_ = len(sets[a] & sets[b])
        if 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_) and find(a) != find(b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (find(k), len(sets[k])) for k in sets}


def variants(n=70, seed=4):
    """Families of edited copies: pairs of every similarity, chains among them."""
    rng = random.Random(seed)
    out = {}
    for family in range(3):
        base = [f"w{family}_{rng.randrange(400)}" for _ in range(80)]
        for i in range(n):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 5, 6])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            out[family * 1000 + i] = " ".join(words)
    return out


def test_near_duplicates(spark, odd, empty):
    for docs in (texts(spark), variants()):
        want = plain_components(docs)
        got = minhash.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
        assert {r.doc_id: (r.component_id, r.n_shingles) for r in got.collect()} == want
    rows = {(r.doc_id, r.component_id, r.n_shingles) for r in minhash.near_duplicates(odd).collect()}
    assert {(1, 1, 0), (2, 2, 0), (5, 5, 3), (6, 5, 3), (7, 5, 3), (None, None, 0)} <= rows
    left = minhash.near_dedup(odd)
    assert left.columns == odd.columns and {6, 7}.isdisjoint(r.doc_id for r in left.collect())
    assert minhash.near_duplicates(empty).count() == 0


def test_in_bucket_links(spark, monkeypatch):
    """With the pairs tried first cut off and small blocks, the buckets alone still find every link."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    docs = variants(40, 8)
    frame = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame).collect()} == {k: c for k, (c, _) in plain_components(docs).items()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(500, x) for x in range(501, 600)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.key: r.component for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: find(k) for k in list(root)}


# --- language model ---


def test_lm(spark, odd, empty):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = lm.op4_context_mixing(spark, SF).collect()
    tokens = {k: t.encode().lower().split() + [lm.END] for k, t in texts(spark).items()}
    counts = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
        assert r.score < 0
    model = lm.learn(docs)
    out = lm.score(odd, model).collect()
    assert len(out) == odd.count() and all(np.isfinite(r.score) for r in out)
    assert lm.score(empty, model).count() == 0
    assert all(np.isfinite(r.score) for r in lm.score(odd, lm.learn(empty)).collect())


def test_bits_make_probabilities(spark):
    """Over all tokens of two letters and the end, the model's probabilities sum to at most 1, and depend on nothing later."""
    model = lm.learn(documents(spark))
    letters = [bytes([b]) for b in range(33, 127)]
    words = [a + b for a in letters for b in letters] + letters + [lm.END]
    for kind in (0, 3):
        codes, spellings = model.mixer.token_logs(model.coder, words, np.full(len(words), kind))
        assert 0 < np.exp2(codes + spellings).sum() <= 1
        assert 0 < np.exp2(spellings[spellings < 0]).sum() <= 1
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 40, 5000):
        counts = (1000 * rng.pareto(0.7, n)).astype(int) + 1
        lengths = lm.code_lengths(counts)
        codes = [bin(c)[3:] for c in lm.canonical(lengths).tolist()]
        assert [len(c) for c in codes] == lengths.tolist() and (n == 1 or sum(2.0 ** -len(c) for c in codes) == 1)
        assert n > 40 or not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert sum(lm.code_lengths(np.array([1, 1, 2, 4])) * [1, 1, 2, 4]) == 14


def test_held_out_texts_score_above_the_word_counts(spark):
    """Where words are seen often enough, mixed contexts beat the add-one counts on held-out texts, and texts that occur twice score apart."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    held_out = common.remainder("doc_id", 7) == 2
    model = lm.learn(docs.filter(~held_out).unionByName(docs.filter(~held_out & (F.col("doc_id") % 5 == 0))))
    rows = lm.score(docs, model, keep=["doc_id"]).withColumn("held_out", held_out).collect()
    per_token = lambda chosen, c: sum(r[c] for r in chosen) / sum(r.n_tokens for r in chosen)
    held = [r for r in rows if r.held_out]
    # of words that training knows well: the rest costs a spelling, which add-one counts do not pay
    known = [r for r in held if r.n_known == r.n_tokens]
    assert known and per_token(known, "score") > per_token(known, "base_score")
    trained = [r for r in rows if not r.held_out]
    gain = lambda chosen: per_token(chosen, "score") - per_token(chosen, "base_score")
    assert gain([r for r in trained if r.doc_id % 5 == 0]) > gain([r for r in trained if r.doc_id % 5]) > gain(held)


def test_score_depends_on_the_words_before(spark):
    """Mixed contexts reach over words: ASCII texts in the order learned score higher than the same words shuffled."""
    rng = random.Random(7)
    names = [f"w{i}" for i in range(60)]
    follow = {n: rng.sample(names, 2) for n in names}

    def made():
        out = [rng.choice(names)]
        while len(out) < 80:
            out.append(rng.choice(follow[out[-1]]))
        return out

    model = lm.learn(spark.createDataFrame([(" ".join(made()),) for _ in range(300)], "text string").repartition(2))
    held = [made() for _ in range(20)]
    rows = [(i, 0, " ".join(ws)) for i, ws in enumerate(held)] + [(i, 1, " ".join(rng.sample(ws, len(ws)))) for i, ws in enumerate(held)]
    got = {(r.i, r.shuffled): r.score for r in lm.score(spark.createDataFrame(rows, "i int, shuffled int, text string"), model).collect()}
    assert all(got[i, 0] > got[i, 1] + 10 for i in range(len(held)))
    # spelled words see bytes across the border: an unseen word after two different words
    logs = [model.mixer.token_logs(model.coder, [w, b"unseen"], np.zeros(2, int), np.array([True, False]))[1][1] for w in (b"w1", b"w22")]
    assert logs[0] != logs[1]


def test_tokens_of_many_texts_at_once():
    """Words, kinds and sizes are those of lower() and split(), text by text."""
    made = ["", " ", "\n", "a", "A b\tc\x0b\x0cd\r\n", "\x1cx \x85y\xa0 Ä ä", "Привет мир abc", " é", "a\x00b", "日本 x 日本", "\n\n", "b" * 5000]
    rng = random.Random(3)
    made += ["".join(rng.choice("aB \n\tЖé日") for _ in range(rng.randrange(40))) for _ in range(300)]
    for chosen in (made, made[:1], made[-1:], made[:3]):
        raw = [t.encode() for t in chosen]
        distinct, words, of, kinds, sizes = lm.tokens_of(raw)
        assert distinct.to_pylist() == words and len(set(words)) == len(words)
        plain = [t.lower().split() + [lm.END] for t in raw]
        assert [words[i] for i in of.tolist()] == [w for ws in plain for w in ws] and sizes.tolist() == [len(ws) for ws in plain]
        want = []
        for ws in plain:
            kind = 0
            for w in ws:
                want.append(kind)
                kind = kind if w.isascii() else lm.kind_of(w)
        assert kinds.tolist() == want


def coded(words, slot_bits=16):
    counts = Counter(words)
    head = [w for w, c in counts.items() if c > 2]
    return lm.Coder(head, [counts[w] for w in head], sum(c for c in counts.values() if c <= 2), slot_bits)


def zipf_words(n, seed=5):
    rng = np.random.default_rng(seed)
    return [b"w%d" % min(x, 3000) if x % 3 else "ж{}".format(x % 700).encode() for x in rng.zipf(1.3, n).tolist()]


def test_bits_of_a_run_lie_in_one_row():
    """The bits of a code are in one row of slots for each RUN of them, have a slot each, and are the code's."""
    words = zipf_words(3000)
    coder = coded(words)
    ids = coder.ids(words)
    symbols = np.where(ids < 0, len(coder.rank), ids)
    lengths, codes = coder.word_lengths[symbols], coder.word_codes[symbols]
    at = 0
    for which, begins, runs, phase in coder.parts(words, np.arange(len(words)), np.zeros(len(words), int), np.ones(len(words), bool)):
        ends = np.append(begins, len(runs.bits))
        for i in range(0 if phase else len(which)):
            bits = "".join(map(str, runs.bits[ends[i] : ends[i + 1]]))
            assert len(bits) == lengths[at] and int("1" + bits, 2) == codes[at]
            at += 1
        for k in range(lm.PREDICTORS):
            slots = runs.slots(k)
            assert 0 <= slots.min() and slots.max() < 1 << coder.slot_bits[k]
            assert (np.bincount(runs.run) <= lm.RUN).all() and len(set(zip(runs.run.tolist(), (slots >> lm.RUN).tolist()))) == len(runs.symbol)
            assert len(set(zip(runs.run.tolist(), slots.tolist()))) == len(slots)
    assert at == len(words)


def test_learning_a_block_is_that_of_single_bits():
    """Counts, map and weights after blocks of bits are those of plain sums over the bits; each block is predicted by what came before."""
    words = zipf_words(6000)
    coder = coded(words)
    tables = lambda: [np.zeros((1 << b, 2), np.float32) for b in coder.slot_bits]
    got, want = lm.Mixer.of(tables()), lm.Mixer.of(tables())
    squares, plain_squares = np.zeros(got.weights.shape), np.zeros(got.weights.shape)
    first = np.arange(len(words)) % 50 == 0
    for _, _, runs, phase in coder.parts(words, np.arange(len(words)), np.zeros(len(words), int), first):
        got.learn(runs, phase, squares)
        slots, bits = [runs.slots(k) for k in range(lm.PREDICTORS)], runs.bits
        n = [c[s].astype(float) for c, s in zip(want.counts, slots)]
        x = [np.log((v[:, 1] + 0.4) / (v[:, 0] + 0.4)) for v in n] + [np.ones(len(bits))]
        level = [sum((v.sum(axis=1) > limit).astype(int) for limit in (0, 2, 11)) for v in n[-2:]]
        gate = level[1] * 4 + level[0] + 16 * phase
        z = np.clip(sum(w[gate] * v for w, v in zip(want.weights, x)), -14, 14)
        cell = np.clip(np.rint(z * 2), -16, 16).astype(int) + 16 + gate * 33
        np.add.at(want.ones, cell, bits)
        np.add.at(want.total, cell, 1)
        error = bits - 1 / (1 + np.exp(-z))
        step = np.array([np.bincount(gate, error * v, 32) for v in x]) / np.maximum(np.bincount(gate, minlength=32), 1)
        plain_squares += step * step
        want.weights = (want.weights + 0.05 * step / np.sqrt(plain_squares + 1e-8)).astype(np.float32)
        for c, s in zip(want.counts, slots):
            np.add.at(c, (s, bits), 1)
    assert all((a == b).all() for a, b in zip(got.counts, want.counts))
    assert np.allclose(got.weights, want.weights, atol=1e-3) and abs(got.total - want.total).sum() < 1e-3 * want.total.sum()
    # scoring sorts tokens by word; each has the score that it has by itself, among its neighbours
    first[:2] = True
    codes, spellings = got.token_logs(coder, words, np.zeros(len(words), int), first)
    for i in [0, 1, 50, 51, 777, *np.flatnonzero(spellings)[:5].tolist()]:
        a = max(j for j in range(i + 1) if first[j])
        alone = got.token_logs(coder, words[a : i + 1], np.zeros(i + 1 - a, int), first[a : i + 1])
        assert np.isclose(alone[0][-1], codes[i], atol=1e-5) and np.isclose(alone[1][-1], spellings[i], atol=1e-5)


# --- suffix arrays ---


def plain_spans(docs, length=100):
    seen, out = set(), {}
    for key, b in sorted(docs.items()):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[key] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("arrays", [512, 0])
def test_suffix_array(arrays, monkeypatch):
    monkeypatch.setattr(suffix, "_ARRAYS_UPTO", arrays)
    rng = random.Random(1)
    for _ in range(150):
        t = np.array([rng.randint(1, rng.choice([1, 2, 4, 700])) for _ in range(rng.randint(1, 50))] + [0])
        sa, x = suffix.suffix_array(t), t.tolist()
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        shared = suffix.permuted_prefixes(t, sa)
        for a, b in itertools.pairwise(sa.tolist()):
            assert shared[b] == next((k for k in range(len(x)) if max(a, b) + k >= len(x) or x[a + k] != x[b + k]))


@pytest.mark.parametrize("contexts", [20_000, 1])
def test_substring_dedup(spark, odd, empty, contexts, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_CONTEXTS", contexts)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 5000)
    docs = {k: t for k, t in texts(spark).items() if k < 120}
    passage = "a passage that several documents share, with more than one hundred bytes in it, so that it has to go from all but the first of them. "
    docs |= {8999: "z" * 300, 9000: ("0123456789abcdef" * 4 + "-") * 40, 9001: "x" * 400, 9006: "y" + "x" * 300 + "z" * 200, 9007: ("0123456789abcdef" * 4 + "-") * 7 + "end", 9002: "ab" * 300 + passage, 9003: passage * 3, 9004: "zz " + passage + " yy", 9005: ""}
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.substring_dedup(rows).collect()}
    assert got == plain_spans({k: t.encode() for k, t in docs.items()})
    out = suffix.substring_dedup(odd).collect()
    assert len(out) == odd.count() and {r.n_removed for r in out if r.doc_id is None} == {0}
    assert suffix.substring_dedup(empty).count() == 0


def test_long_texts_of_few_letters(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 1 << 18)
    docs = {1: "x" * 5_000_000, 2: "ab " * 400_000, 3: "y" * 99 + "x" * 1000}
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.substring_dedup(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    assert out == {1: (5_000_000, 4_999_999, 1), 2: (1_200_000, 1_199_997, 1), 3: (1099, 1000, 1)}
    at, h = suffix.anchors(np.full(20_000, 120, np.uint8))
    assert suffix._near_repeats(at, np.zeros(len(at), int), np.arange(len(at)), h, 100).sum() == len(at) - 1


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(0)
    for _ in range(20):
        shared = rng.integers(97, 101, 100, dtype=np.uint8)
        found = []
        for _ in range(2):
            before = rng.integers(97, 123, rng.integers(0, 300), dtype=np.uint8)
            data = np.concatenate([before, shared, rng.integers(97, 123, 50, dtype=np.uint8)])
            at, h = suffix.anchors(data)
            found.append({int(x) for p, x in zip(at, h[at], strict=True) if len(before) <= p <= len(before) + 68})
        assert found[0] & found[1]


# --- the pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, kept = common.table(spark, SF, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4] and kept[0] == kept[1]
    parts = sorted((r.doc_id, r.piece, r.ids_crc32, r.length) for r in docs.collect())
    assert sorted((r.doc_id, r.piece, r.ids_crc32, r.length) for r in corpus_pipeline.run(spark, SF).collect()) == parts


def test_stages_against_plain_versions(spark):
    """What each stage keeps of the one before, by the plain versions of its operators."""
    import corpus_pipeline

    first, lines_, near, clean, _ = (stage for _, stage in corpus_pipeline.STAGES)
    held = lambda df: {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
    kept = common.stored(first(spark, common.table(spark, SF, "documents"), SF))
    scored = quality.score(common.table(spark, SF, "documents"), quality.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"), length=F.col("n_chars")), length=F.col("n_chars"))
    assert set(held(kept)) == {r.doc_id for r in scored.filter("score >= 0.3").collect()}
    short = common.stored(lines_(spark, kept, SF))
    assert held(short) == {k: t for k, (t, _) in plain_lines(held(kept)).items()} and short.filter("n_chars != length(text)").count() == 0
    single = common.stored(near(spark, short, SF))
    groups = plain_components(held(short))
    assert held(single) == {k: t for k, t in held(short).items() if groups[k][0] == k}
    left = held(clean(spark, single, SF))
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    found = plain_search(list(held(single).items()), items)
    assert left == {k: t for k, t in held(single).items() if not found[k][1]}


def test_pipeline_on_odd_rows(spark, odd, empty):
    import corpus_pipeline

    for source, extra in ((odd, [F.col("n_chars").alias("n_chars"), F.lit(1).alias("kept")]), (empty, []), (odd, [])):
        docs = source.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), *extra)
        before = source.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = common.stored(stage(spark, docs, SF))
            assert docs.columns == [c for c in corpus_pipeline.COLUMNS if c in source.columns or c in ("lang", "source")][: len(docs.columns)] and "kept" not in docs.columns
            assert docs.count() <= before
            before = docs.count()
        keys = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == keys


def test_batches_keep_columns(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, [1.5])], "id int, t string, x array<double>")
    out = common.map_batches(rows, ["id", "x"], [F.col("t")], "n int", lambda: lambda t: [pa.array([len(v or "") for v in t.to_pylist()], pa.int32())])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, None, 1), (2, [1.5], 0)]
