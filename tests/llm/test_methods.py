"""Operators against plain versions of what they compute."""

import hashlib
import random
import re
from collections import defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetcast.llm import decontaminate, graph, html, jaccard, langid, mixing, pii, sharding, suffixes, texts, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with families of near copies, shared passages and plain prose."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    out, passage = [], prose(40)
    for _ in range(12):
        base = prose(rng.randint(3, 160))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 50)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(copy)
    out += [prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60)) for _ in range(25)]
    out += [prose(rng.randint(0, 9)) for _ in range(25)]
    rng.shuffle(out)
    return [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(out)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in docs}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_is_exact(spark, corpus, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    got = jaccard.join(spark.createDataFrame(corpus, "doc_id long, text string"), words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(corpus, words, percent)


def test_size_bands_hold_all_similar_sizes():
    bands = jaccard.Bands(85, 4000)
    for r in range(1, 4000, 7):
        low = -(-85 * r // 100)
        assert bands.of(np.array([low]))[0] >= bands.of(np.array([r]))[0] - 1
        assert (r + low) * 15 // 185 <= bands.difference(int(bands.of(np.array([r]))[0]))


@pytest.mark.parametrize("twos, slack", [(0, 0), (3, 2), (2, 0), (0, 4), (0, 24)])
def test_similar_sets_share_an_index_entry(twos, slack):
    rng = np.random.default_rng(1)
    index = jaccard.Index(jaccard.Bands(85, 400), defaultdict(lambda: 1))
    weight = np.array([index.bands.difference(b) + 1 + slack for b in range(len(index.segments))])
    index.twos = np.minimum(twos, weight // 2)
    index.segments, index.slack = weight - index.twos, np.full(len(weight), slack)
    index.used[:] = True
    for n in (6, 7, 13, 20, 33, 60, 150, 300):
        for _ in range(40):
            base = rng.integers(0, 2**63, n, dtype=np.uint64)
            m = rng.integers(0, n * 15 // 185 + 1)
            other = np.concatenate([base[m:], rng.integers(0, 2**63, rng.integers(0, m + 1), dtype=np.uint64)])
            if 100 * len(np.intersect1d(base, other)) >= 85 * len(np.union1d(base, other)):
                s = jaccard.ShingleSets(pa.array(["", ""]), 4)
                sets = [np.unique(base), np.unique(other)]
                s.sizes, s.tokens = np.array([len(x) for x in sets]), np.concatenate(sets)
                s.at = np.concatenate([[0], np.cumsum(s.sizes)])
                owner, entry = index.entries(s)
                assert np.intersect1d(entry[owner == 0], entry[owner == 1]).size


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200 + 1)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


@pytest.mark.parametrize("bucket, part", [(1 << 22, 50_000), (600, 3)])
def test_suffixes_against_all_strings(spark, corpus, bucket, part, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(suffixes, "PART", part)
    docs = [*corpus, (2000, "ab" * 80), (2001, "xab" * 5 + "ab" * 60), (2002, "é" * 60), (2003, "a" + "é" * 40)]
    first, want = {}, {}
    for i, t in sorted(docs):
        b, gone = t.encode(), set()
        for k in range(len(b) - 49):
            if first.setdefault(b[k:k + 50], i) < i:
                gone.update(range(k, k + 50))
        want[i] = (len(b), len(gone), sum(k - 1 not in gone for k in gone), bytes(c for k, c in enumerate(b) if k not in gone))
    got = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string"), keep_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_multikey_order():
    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(0, 4, 500) for _ in range(3))
    o = suffixes.multikey_order(a, b, c)
    assert [(a[i], b[i], c[i]) for i in o] == sorted(zip(a, b, c))


def test_span_hashes_do_not_depend_on_place():
    data = np.frombuffer(b"one two one two", np.uint8)
    h = texts.SpanHash(data).of(np.array([0, 8, 4]), np.array([7, 15, 11]))
    assert h[0] == h[1] != h[2]


def test_languages_are_told_apart(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    got = langid.identify(docs, langid.fit(docs.filter("NOT held")), ["lang", "held"]).filter("held")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_toxic_words_are_learned():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [([rng.choice(words) for _ in range(40)], i % 4 == 0) for i in range(400)]
    for t, bad in rows:
        if bad:
            t[rng.randrange(40)] = "zzbad" + rng.choice(["ly", "ness", "er", ""])
    labels = np.array([bad for _, bad in rows], np.float32)
    data = pa.array([" ".join(t) for t, _ in rows])
    net = toxicity.train(data.slice(0, 300), labels[:300])
    assert ((net.raw(data.slice(300)) >= 0.5) == labels[300:]).mean() > 0.95


@pytest.mark.parametrize("text, spans", [
    ("mail a.b@c.de and @a.b x@y@z.w.", "email:5:13,email:25:30"),  # y@z.w, as the pattern has it
    ("10.0.0.1 300.1.1.1 1.2.3.4.5", "ip:0:8,ip:19:26"),
    ("4111 1111 1111 1111 and 4111 1111 1111 1112", "card:0:19"),
    ("+1 (415) 555-2671 x +1 2", "phone:0:17"),
    ("john [at] mail [dot] com", "email:0:24"), ("jo.do at mail dot com", "email:0:21"), ("see you at mail.com now", ""),
    ("wrіte jоhn@mail.com", "email:6:19,email:8:19"), ("call plus 1 four one five five five five two six seven one", "phone:5:58"),
    ("+1 (415) 555-2671 un an", "phone:0:17"), ("zero @ nothing", ""),
    ("thanks @jane.doe", ""), ("you at noon dot com", ""), ("jane.doe at example.com", "email:0:23"), ("mail me: jane at example dot com", "email:9:32"),
    ("see you at jo.do at mail dot com", "email:11:32"), ("jane @ example.com", "email:0:18"), ("jane@ example.com x @example.com", ""), ("a" * 70 + " [at] host dot org", "email:0:88"),
    (" dot ".join("abcdefgh") + " at h1.x.y.z.w.v.u", "email:0:61"), ("192[.]168[.]0[.]1", "ip:0:17"), ("192 dot 168 dot 0 dot 1", "ip:0:23"), ("10 dot 2 dot 300 dot 4", ""),
    ("arrive by 10 at example.com", ""), ("0" * 5000 + "1.2.3.4", "ip:0:5007"),
])
def test_identifiers(text, spans):
    plain, found = pii.all_spans(text)
    assert set(plain) <= set(found)
    assert pii.written(found) == spans or set(pii.written(found).split(",")) == set(spans.split(","))


def test_plain_emails_match_the_pattern():
    rng = random.Random(3)
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        t = "".join(rng.choice("ab.@@- é") for _ in range(25))
        assert [m.span() for m in pattern.finditer(t)] == list(pii.emails(t))


def plain_by_patterns(text):
    """Base spans straight from the patterns."""
    digits = lambda t: re.sub("[^0-9]", "", t)
    ok = {"email": lambda t: True, "ip": lambda t: all(int(x) <= 255 for x in t.split(".")), "phone": lambda t: 9 <= len(digits(t)) <= 15,
          "card": lambda t: 13 <= len(digits(t)) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(digits(t)[::-1])) % 10 == 0}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_base_spans_and_digests(spark, folder):
    rng = random.Random(9)
    made = ["".join(rng.choice(["4", "1", "11", "0", " ", "-", ".", "+", "(", ")", "@", "a", "é", "4111 1111 1111 1111", "10.0.0.2"]) for _ in range(60)) for _ in range(400)]
    given = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    long = ("x " * 50_000 + "jane@example.org ") * 2
    docs = spark.createDataFrame(list(enumerate([*made, *given, long, None])), "doc_id long, text string")
    for r in pii.find(docs, ["doc_id", "text"]).collect():
        base = plain_by_patterns(r.text or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_spans == text and r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, r.spans.split(",")))


def test_deobfuscation_takes_linear_time():
    for unit in ("a dot ", "1 dot ", "at ", "a at ", " ", "one ", "( at ", "a.b."):
        pii.all_spans("jane (at) host dot org " + unit * 100_000)


def test_rewritten_offsets():
    t = pii.homoglyphs(pii.Rewritten("ａ​b"))
    assert t.text == "ab" and t.source(0, 2) == (0, 3)


def test_best_stretch_against_all_stretches():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-2, -1, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = html.best_stretch(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


@pytest.mark.parametrize("wrapper, end", [
    ("<div class='wrapper no-sidebar'>", "</div>"), ("<div class='layout-sidebar-right'>", "</div>"), ("<div class='content overflow-hidden'>", "</div>"),
    ("<div aria-hidden='false'>", "</div>"), ("<form action='/x'>", "</form>"), ("<section class='search'>", "</section>"), ("<div id='elementor-widget-theme'>", "</div>"),
])
@pytest.mark.parametrize("mark", ["article", "main", "div"])
def test_wrappers_keep_the_article(wrapper, end, mark):
    body = "A line of words that stands here.<p class='social-history'>A story of people who met.</p><p>See <a href='/hidden/valley?id=share'>the valley</a> at last.</p>"
    page = f"<body><nav><a href=/>Menu</a></nav>{wrapper}<{mark}><h1>Head of it</h1><p>{body}</{mark}>{end}<footer>Foot</footer></body>"
    want = "Head of it\n\nA line of words that stands here.\n\nA story of people who met.\n\nSee the valley at last."
    assert html.Page(page).text({}) == want


def test_teasers_beside_an_article_stay_out():
    teaser = "<div>" + "Read this too, it is a long teaser. " * 4 + "</div>"
    page = f"<body>{teaser}<article><h1>Head</h1><p>One two three.</p><p>Four.</p></article>{teaser}<div class='site-footer'>All rights are reserved here.</div></body>"
    for weights in ({}, {"tag p": 4.0, "word p": 4.0}):
        assert html.Page(page).text(weights) == "Head\n\nOne two three.\n\nFour."


def test_names_in_classes_lower_scores():
    page = "<body><div><p>Some words of the article are here.</p><p>And some more of them.</p></div><div class='post-comments-list'><p>I like this very much.</p></div></body>"
    assert html.Page(page).text({}) == "Some words of the article are here.\n\nAnd some more of them."
    assert html.Page("<p>All of it is here.</p><aside>" + "<b>x</b>" * 300 + "</aside><p>And there it goes on.").text({}).endswith("goes on.")


def test_learned_tags_stay_bad(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    weights = html.learn(pages)
    assert weights and all(w < 0 for f, w in weights.items() if f.startswith("tag ")) and weights["word p"] > 0
    rows = pages.select("html").collect()
    for r, text in zip(rows, html.extract(pages, weights, ["page_id", "html"]).collect()):
        inside = re.search("<article>(.*?)</article>", text.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:h1|p)>", inside.replace("<br>", " "))]
        assert text.text == "\n\n".join(x for x in blocks if x)


def test_article_without_its_surroundings():
    page = ("<html><head><title>T</title><script>var t='</p>';</script></head><body><header>Top</header><nav><ul><li><a>One</a></ul></nav><div class=ad>Buy</div>"
            "<article><h1>Head</h1><p><b>First &eacute; part<br>more<p>Second</p><form>Name</form><aside>Side</aside></article><section id='comments'><p>Me too</p></section>"
            "<footer>&copy; x</footer>")
    assert html.Page(page).text({}) == "Head\n\nFirst é part more\n\nSecond"


def test_reparameterised_items(spark):
    items = spark.createDataFrame([(1, "Yesterday John had 12 apples and gave 5 of them to Mary before walking 3 km home with John.")], "item_id int, text string")
    docs = spark.createDataFrame([
        (1, "Well. Yesterday Peter had 30 apples and gave 7 of them to Anna Lee before walking 8 miles home with Peter. End"),
        (2, "Well. Yesterday Peter had 30 apples and gave 7 of them to Anna before walking 8 km home with Karl. End"),
        (3, "IT SAYS YESTERDAY JOHN HAD 12 APPLES"), (4, "Yesterday John had 12 apples and gave 5 of them to Mary before walking 3 km home with John.")], "doc_id int, text string")
    assert {(r.doc_id, r.kind) for r in decontaminate.contaminated(docs, items).collect()} == {(1, "reparameterised"), (4, "verbatim")}


def test_benchmark_in_blocks(spark, folder, monkeypatch):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in decontaminate.contaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 300)
    assert {tuple(r) for r in decontaminate.contaminated(docs, items).collect()} == whole


def test_poisson_counts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    table = mixing.rates(docs, {"a": 0.5, "b": 0.5}, epochs=2.0)
    assert {r.source: round(r.rate, 6) for r in table.collect()} == {"a": 4.0, "b": round(4 / 3, 6)}
    got = {r.source: r for r in mixing.replicate(docs, table, ["doc_id", "source"]).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("mix_copy") == 1, F.col("mix_copies") * F.col("mix_copies"))).alias("sq")).collect()}
    for source, n, rate in (("a", 5000, 4.0), ("b", 15_000, 4 / 3)):
        assert abs(got[source].n / n - rate) < 0.1 and abs(got[source].sq / n - rate - rate**2) < 0.7
    wide = mixing.rates(docs, {"a": 1.0}, epochs=30.0).filter("source = 'a'")
    assert abs(mixing.replicate(docs.filter("source = 'a'"), wide, ["doc_id"]).count() / 5000 - 120) < 1


def test_shards_are_even_and_edits_small(spark, tmp_path):
    sizes = spark.range(4096).select(F.col("id").cast("int").alias("vslot"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("bytes"), F.lit(1).cast("long").alias("n"))
    first = sharding.balanced(sizes, 24, str(tmp_path / "m")).cache()
    load = [r[0] for r in first.join(sizes, "vslot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert len(load) == 24 and max(load) / min(load) < 1.005
    assert sharding.load_map(spark, str(tmp_path / "m"), 1).count() == sharding.load_map(spark, str(tmp_path / "m")).count() == 4096
    more = sharding.edit_map(first, sizes, 25)
    moved = more.join(first.withColumnRenamed("shard", "old"), "vslot").filter("shard <> old").count()
    assert 4096 / 25 * 0.8 < moved < 4096 / 25 * 2


def test_opening_words_and_dense_numbers(spark):
    items = spark.createDataFrame([
        (1, "Tom has 12 apples. Mary has 5 apples. How many apples do Tom and Mary have together?"), (2, "Paris is the capital of which European country today"),
        (3, "Add 12 kg, 13 kg, 14 kg, 15 kg and 16 kg to 17 kg of sand"), (4, "What is the boiling point of water at sea level in degrees")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Ann has 7 apples. Joe has 9 apples. How many apples do Ann and Joe have together?"),
        (2, "As they say in class – Paris is the capital of which European country today, and more of that."),
        (3, "Now we read it out: add 12 kg, 13 kg, 14 kg, 15 kg and 16 kg to 17 kg of sand, they said."),
        (4, "They ask, what is the boiling point of water at sea level in degrees and go on."),
        (5, "Ann has 7 apples. Joe has 9 pears. How many plums do Ann and Sue have at home?"), (6, "Rome was the capital of which ancient empire then"),
        (7, "word " * 200_000 + "Ann has 7 apples. Joe has 9 apples. How many apples do Ann and Joe have together?"), (8, None), (9, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, "reparameterised"), (2, 2, "verbatim"), (3, 3, "verbatim"), (4, 4, "verbatim"), (7, 1, "reparameterised")}


def test_recall_of_reparameterised_problems(spark):
    rng = random.Random(12)
    names, things = ["Tom", "Mary", "Ann", "Joe", "Sue", "Omar", "Li", "Eva", "Jonas", "Nadia"], ["apples", "books", "stamps", "coins", "tickets", "marbles"]
    shapes = ["{0} has {4} {2}. {1} gives {0} {5} more {2} and keeps {6} for a friend. How many {2} does {0} have now?",
              "A train leaves at {4} and drives {5} km to the town of {0}. How long does {1} wait there if the train is {6} minutes late?",
              "If {0} buys {4} {2} for {5} dollars each and sells them to {1} for {6} dollars, what is the profit that {0} makes?",
              "{0} and {1} share {4} {2} so that {0} gets {5} more than {1} does. What share of the {2} is left for {1}?"]

    def problem(shape: str, thing: str) -> str:
        a, b = rng.sample(names, 2)
        return shape.format(a, b, thing, "", *rng.sample(range(2, 900), 3))

    kinds = [(s, t) for s in shapes for t in things]
    items = spark.createDataFrame([(i, problem(*k)) for i, k in enumerate(kinds)], "item_id long, text string")
    prose = lambda: " ".join(rng.choice(["the", "river", "runs", "past", "old", "mills", "while", "birds", "sing", "over", "green", "fields"]) for _ in range(60)) + ". "
    docs = [(i, prose() + problem(*k) + " " + prose()) for i, k in enumerate(kinds * 3)] + [(1000 + i, prose() + prose()) for i in range(50)]
    found = {r.doc_id for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert sum(i in found for i in range(3 * len(kinds))) >= 0.9 * 3 * len(kinds) and not any(i >= 1000 for i in found)
