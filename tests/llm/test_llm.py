"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netcask.llm import bm25, components, decontam, packing, quality, shards, simhash, substrings, units, urlfilter, wrappers
from netcask.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, same

DOCS = "doc_id long, text string, tid string, _nc_text string, b int, id int"


def docs_of(spark, rows):
    """Columns that operators might use for themselves are there, too."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], DOCS).repartition(3)


def edge_rows(seed=1):
    r = random.Random(seed)
    word = ["alpha", "Beta", "gamma", "delta,", "épsilon", "zeta."]

    def text(n):
        return " ".join(r.choice(word) for _ in range(n))

    rows = [(i, text(r.randrange(0, 120))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (None, text(30)), (63, rows[3][1]), (63, rows[3][1]), (64, text(20000)), (64, "another of that id"), (65, "x"), (66, rows[5][1] + " end")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return edge_rows()


def test_queries_with_sql(spark, sf):
    con = connect(sf)
    for name, sql in ORACLE_SQL.items():
        assert same(QUERIES[name](spark, sf), con, sql) > 0


# SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: list of (id, fingerprint); the smallest id reachable for each row."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash(spark, rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, plain_components(fps), strict=True)), key=repr)
    got = sorted(map(tuple, simhash.simhash_components(docs_of(spark, rows)).collect()), key=repr)
    assert got == want
    assert simhash.simhash_components(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [1024, 8])
def test_simhash_links_in_and_over_chunks(spark, chunk):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(30):
            x = b
            for k in r.sample(range(64), r.randrange(1, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(substrings.signed(x),) for x in fps], "fp long"), chunk=chunk)
    root = {r["node"]: r["root"] for r in components.components(edges).collect()}
    ids = [(substrings.signed(x), x) for x in fps]
    want = plain_components(ids)
    assert [root.get(i, i) for i, _ in ids] == want


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(0, 6))
def test_bit_sliced_comparison(seed, n, radius):
    r = np.random.default_rng(seed)
    fps = np.unique(r.integers(0, 2**8, n, dtype=np.uint64) | (r.integers(0, 2, n, dtype=np.uint64) << np.uint64(60)))
    bucket = np.sort(r.integers(0, 3, len(fps)))
    u, v = simhash.stars(fps, bucket, radius)
    want = 0
    for b in set(bucket.tolist()):
        mine = [(int(x), int(x)) for x in fps[bucket == b]]
        root = list(range(len(mine)))
        while True:
            new = [min(root[j] for j in range(len(mine)) if bin(mine[i][0] ^ mine[j][0]).count("1") <= radius) for i in range(len(mine))]
            if new == root:
                break
            root = new
        want += len(mine) - len(set(root))
    assert len(u) == want and len(v) == want


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_stays(spark, rows):
    kept = simhash.keep_one_of_each(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "tid", "_nc_text", "b", "id"]
    ids = [r["doc_id"] for r in kept.collect()]
    groups = plain_components([(k, plain_fingerprint(t)) for k, (_, t) in enumerate(rows)])  # by place: rows may share an id
    assert len(ids) == len(set(groups))
    for g in set(groups):
        mine = [rows[k][0] for k in range(len(rows)) if groups[k] == g]
        assert min((i for i in mine if i is not None), default=None) in ids


# packing


def test_packing(spark, rows):
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    out = packing.pack_documents(docs_of(spark, [*rows, (70, "don't <|endoftext|> é\u00a0x 'S")])).collect()
    docs = Counter()
    for i, t in [*rows, (70, "don't <|endoftext|> é\u00a0x 'S")]:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            docs[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == docs
    held = defaultdict(list)
    for r in out:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(held) <= math.ceil(sum(r["length"] for r in out) / 4096) + 1
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_sum_of_squares_choice(sizes):
    """Each placement has the least sum of squares of all there are."""
    bins = packing.Bins(50)
    for i, s in enumerate(sizes):
        best = bins.best_gap(s)

        def after(gap, s=s):
            n = bins.count.copy()
            if gap < 50:
                n[gap] -= 1
            if gap - s > 0:
                n[gap - s] += 1
            return int((n[1:] ** 2).sum())

        choices = [g for g in range(s, 50) if bins.count[g]] + [50]
        assert best in choices and after(best) == min(map(after, choices))
        bins.put(i, s, best)
    bin_of, _ = packing.pack(np.array(sizes), 50)
    assert np.bincount(bin_of, weights=sizes).max() <= 50


# URL filter


def test_url_shapes(spark):
    table = urlfilter.rule_table(spark, [*urlfilter.RULES, ("a.b.c/x", "block"), ("a.b.c/y", "allow"), ("nohost", "block")])
    assert urlfilter.shapes(table) == [(3, 2), (2, 5), (2, 4), (1, 4), (1, 1)]


def test_url_rules_from_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/x")], "page_id long, url string")
    rules = spark.createDataFrame([("a.org/", "block"), ("a.org/", "allow"), ("org/", "allow"), (None, "block")], "rule string, verdict string")
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules).collect()} == {(1, "a.org/", "block"), (2, "org/", "allow")}
    assert urlfilter.judge_urls(pages.limit(0)).collect() == []
    doubled = urlfilter.rule_table(spark, [("a.org/", "block"), ("a.org/", "allow")])
    assert doubled.collect()[0]["verdict"] == "allow"


def test_url_filter(spark):
    urls = ["http://Example.ORG/en/1x", "https://a.b.com/fr/x?y", "x://com/de/", "//nothing/", None, "", "http://xcom/fr/", "http://net/", "http://org", "http://a.org#/", "ftp://u@a.example.org/es/q", "http://a.com/fr", "http://example.org/es"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)] + [(0, urls[0], "z")], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(df).collect()}
    assert got[0] == ("example.org", "/en/1x", "example.org/en/1", "block")
    assert got[1] == ("a.b.com", "/fr/x", "com/fr/", "allow")
    assert got[2] == ("com", "/de/", "com/de/", "block")
    assert got[3] == got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2] is None and got[7] == ("net", "/", None, "allow") and got[8] == ("org", "", None, "allow") and got[9] == ("a.org", "", None, "allow")
    assert got[10][2] == "example.org/es/" and got[11] == ("a.com", "/fr", None, "allow") and got[12][2] == "org/"
    assert urlfilter.judge_urls(df).count() == len(urls) + 1
    assert {r["verdict"] for r in urlfilter.judge_urls(df, rules=[]).collect()} == {"allow"}


def test_digest_collisions_are_told_apart(spark):
    stem = urlfilter.write_list(spark, urlfilter.rule_table(spark, [("a.b/", "block"), ("c.d/", "allow"), ("e.f/", "block")]), "cast(length(text) as long)")
    table = urlfilter.DigestArray(stem)
    texts = [b"c.d/", b"x.y/", b"e.f/", b"long/one"]
    found = table.probe(texts, np.array([len(t) for t in texts], np.int64))
    assert [f >= 0 for f in found] == [True, False, True, False]


# sharding


def test_sharding(spark, rows):
    out = shards.shard_documents(docs_of(spark, rows), 5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    groups = defaultdict(set)
    slots = defaultdict(list)
    for r in out:
        groups[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.shard_documents(docs_of(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=120), st.integers(1, 9))
def test_differencing(sizes, n):
    part = shards.differ_sizes(np.array(sizes, np.int64), n)
    assert len(part) == len(sizes) and all(0 <= p < n for p in part)
    if len(sizes) > 20 * n and max(sizes) > 0:
        sums = np.bincount(part, weights=sizes, minlength=n)
        assert sums.max() - sums.min() <= max(sizes)


# repeated strings


def plain_removed(texts, span=200):
    at = defaultdict(list)
    for i, t in enumerate(texts):
        for s in range(len(t) - span + 1):
            at[t[s : s + span]].append((i, s))
    cover = [bytearray(len(t)) for t in texts]
    for v in at.values():
        if len(v) > 1:
            for i, s in v:
                cover[i][s : s + span] = b"\1" * span
    return [(len(t), sum(c), len(c.replace(b"\0", b" ").split()), hashlib.sha256(bytes(x for x, y in zip(t, c, strict=True) if not y)).hexdigest()) for t, c in zip(texts, cover, strict=True)]


def passages(seed):
    r = random.Random(seed)

    def text(n):
        return "".join(r.choice("abcdefgh é") for _ in range(n))

    shared = [text(r.randrange(180, 420)) for _ in range(5)]
    out = []
    for i in range(60):
        parts = [text(r.randrange(300)) for _ in range(3)]
        if r.random() < 0.7:
            parts.insert(1, r.choice(shared))
        if r.random() < 0.2:
            parts.append("ab" * r.randrange(50, 200))
        out.append((i, "".join(parts)))
    return [*out, (900, None), (901, ""), (902, "x" * 199), (903, "x" * 200), (904, "y" * 201), (None, shared[0]), (905, out[3][1]), (905, out[3][1])]


@pytest.mark.parametrize("group", [1000, 3])
def test_repeated_strings(spark, group):
    data = passages(3)
    got = substrings.remove_repeats(docs_of(spark, data), group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(i, *x) for (i, _), x in zip(data, plain_removed([(t or "").encode() for _, t in data]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_repeated_strings_of_nothing(spark):
    assert substrings.remove_repeats(docs_of(spark, [])).count() == 0


def test_cut_texts_stay_text(spark):
    data = passages(5)
    out = substrings.drop_repeats(docs_of(spark, data))
    assert out.columns == ["doc_id", "text", "tid", "_nc_text", "b", "id"] and out.count() == len(data)
    assert substrings.cut_text("aéé".encode(), [2], [4]) == "aé" or substrings.cut_text("aéé".encode(), [2], [4]) == "aéé"
    assert substrings.cut_text(b"abcdef", [1, 4], [2, 6]) == "acd"


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=200, max_size=900), st.integers(1, 4))
def test_anchors_cover_all_windows(data, alphabet):
    data = bytes(b % alphabet for b in data)
    place, count = substrings.window_anchors(np.frombuffer(data, np.uint8), 200, 40)
    assert count.sum() == len(data) - 199
    s = np.arange(len(data) - 199)
    p = np.repeat(place, count)
    assert ((p >= s) & (p <= s + 160)).all()


# decontamination


def plain_distance(p, t):
    col = list(range(len(p) + 1))
    best = len(p)
    for ch in t:
        new = [0]
        for i in range(1, len(p) + 1):
            new.append(min(col[i] + 1, new[-1] + 1, col[i - 1] + (p[i - 1] != ch)))
        col = new
        best = min(best, col[-1])
    return best


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
def test_myers(p, t):
    assert decontam.myers(p, t)[0] == plain_distance(p, t)


@pytest.mark.parametrize("seed", range(3))
def test_leaks(seed):
    r = random.Random(seed)
    items = [(i, decontam.normal("".join(r.choice("abcdefgh ") for _ in range(r.randrange(1, 150))))) for i in range(12)] + [(99, ""), (98, "x" * 90)]
    texts = ["", "a"]
    for _ in range(40):
        t = list(r.choice(items)[1])
        for _ in range(r.randrange(1 + int(0.14 * len(t)))):
            k = r.randrange(len(t)) if t else 0
            if t and r.random() < 0.6:
                t[k] = r.choice("abc")
            else:
                t.insert(k, r.choice("abc"))
        texts.append(decontam.normal("".join(r.choice("abcdefgh ") for _ in range(40)) + "".join(t) + " tail"))
    table = decontam.Items(items, 0.1)
    want = sorted((i, k, d) for i, t in enumerate(texts) for k, (_, p, e) in enumerate(table.items) if (d := plain_distance(p, t)) <= e)
    assert sorted(table.search(texts)) == want


def test_leak_frames(spark, rows):
    items = spark.createDataFrame([(1, "Alpha BETA gamma delta, zeta. alpha alpha alpha"), (2, None), (3, ""), (1, "one more")], "item_id long, text string")
    docs = docs_of(spark, [*rows, (80, "say alpha  beta\ngamma delta, zeta. alpho alpha alpha so"), (81, "clean")])
    found = decontam.find_leaks(docs, items)
    assert (80, 1, 1) in set(map(tuple, found.collect()))
    left = decontam.drop_leaked(docs, items)
    assert left.columns == docs.columns and left.where("doc_id = 80").count() == 0 and left.where("doc_id = 81").count() == 1
    assert decontam.find_leaks(docs, items.limit(0)).count() == 0 and decontam.find_leaks(docs.limit(0), items).count() == 0


def test_item_blocks(spark):
    items = spark.createDataFrame([(i, "word " * 10) for i in range(7)], "item_id long, text string")
    assert sum(len(b) for b in decontam.item_blocks(items, "item_id", "text", 100)) == 7


# wrappers

PAGE = """<html><head><title>t</title></head><body><header><p>Site</p></header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>{h} &amp; co</h1>{ps}<form><p>Sign up</p></form><div class="ad">Buy</div><div id="comments"><p>First!</p></div></article></main><aside>More</aside><footer>&copy;</footer></body></html>"""


def test_wrappers(spark):
    pages, want = [], {}
    for i in range(12):
        ps = "".join(f"<p>para {i}.{k}\n  with <b>bold</b><br>text" for k in range(i % 4 + 1))
        pages.append((i, f"http://h{i % 2}.org/x", PAGE.format(h=f"Title {i}", ps=ps)))
        want[i] = "\n".join([f"Title {i} & co", *[f"para {i}.{k} with bold text" for k in range(i % 4 + 1)]])
    pages += [(20, None, None), (21, "http://h0.org/y", ""), (22, "http://h0.org/z", "<p>odd one"), (23, "http://n.org/", "<body><nav>x</nav>")]
    want |= {20: "", 21: "", 22: "odd one", 23: ""}
    df = spark.createDataFrame([(*p, "c") for p in [*pages, pages[0]]], "page_id long, url string, html string, text string")
    out = wrappers.extract_text(df).collect()
    assert len(out) == len(pages) + 1
    for r in out:
        assert (r["text"], r["n_chars"]) == (want[r["page_id"]], len(want[r["page_id"]])), r["page_id"]
    assert wrappers.extract_text(df.limit(0)).count() == 0


def test_wrapper_expression():
    a, b = wrappers.page_wrapper("<div><p>x</p><p>y</p></div>"), wrappers.page_wrapper("<div><h2>q</h2><p>z</p></div>")
    wrappers.align(a, b)
    assert wrappers.expression(a) == '<div>(<p>(#)+ <h2>("q")?)'


@settings(max_examples=150, deadline=None)
@given(st.text("<>/pdivb =\"'&;!-a", max_size=60))
def test_any_markup_is_read(html):
    w = wrappers.page_wrapper(html)
    wrappers.extract(html, wrappers.article_path(w), set())
    depth = 0
    for ev in wrappers.events(html):
        depth += (ev[0] == "open") - (ev[0] == "close")
        assert depth >= 0
    assert depth == 0


def test_deep_nesting():
    assert wrappers.extract("<div>" * 5000 + "x" + "</div>" * 5000, [], set()) == "x"


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://{h}.org/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in wrappers.extract_text(df).orderBy("page_id").collect()]


def test_whole_texts_are_compared_and_copies_are_no_evidence(spark):
    same_start = "The same eighty characters stand at the start of every one of these paragraphs, and then they differ: "
    article = "<body><nav>Menu {i}</nav><article><h1>Head</h1><p>Only text</p></article>"
    pages = [("a", article.format(i=0))] * 4  # copies of one page
    pages += [("b", article.format(i=i)) for i in range(4)]  # equal articles of pages that differ
    pages += [("c", f"<body><div><p>{same_start}{i}</p><p>Legal line</p></div>") for i in range(4)]
    pages += [("d", "<body><div><p>A page without an article</p></div>")] * 4
    pages += [("e", f"<body><article>Promotion</article><div><p>A long enough text that has no article about it, number {i}</p></div>") for i in range(4)]
    want = ["Head\nOnly text"] * 8 + [f"{same_start}{i}\nLegal line" for i in range(4)]
    want += ["A page without an article"] * 4 + [f"Promotion\nA long enough text that has no article about it, number {i}" for i in range(4)]
    assert extracted(spark, pages) == want
    # what never changes still goes where no article is
    assert extracted(spark, [("f", f"<body><div>Legal line</div><p>text {i}</p>") for i in range(4)]) == [f"text {i}" for i in range(4)]


def test_names_alone_do_not_cut_an_article(spark):
    page = '<body><article><p>Lead {i}</p><div class="share-price"><p>body para {i}</p></div><section class="search-results">found {i}</section><div class="ad-slot">Buy {i}</div></article></body>'
    want = [f"Lead {i}\nbody para {i}\nfound {i}" for i in range(10)]
    assert extracted(spark, [("a", page.format(i=i)) for i in range(10)]) == want
    assert [extracted(spark, [("a", page.format(i=i))])[0] for i in range(2)] == want[:2]


def test_pages_of_a_host_show_what_is_template(spark):
    page = '<body><nav>Menu {i}</nav><article><h2>Report</h2><p>News {i} of the day</p><p class="cta">Join our list</p><div class="price-alert">Set one</div><p class="by">By {i}</p></article>'
    alone = extracted(spark, [("a", page.format(i=3))])[0]
    assert alone == "Report\nNews 3 of the day\nJoin our list\nSet one\nBy 3"
    assert extracted(spark, [("a", page.format(i=i)) for i in range(12)]) == [f"Report\nNews {i} of the day\nBy {i}" for i in range(12)]
    # copies in other surroundings show nothing
    copies = [("b", page.format(i=3).replace("Menu 3", f"Menu {k}")) for k in range(12)]
    assert extracted(spark, copies) == [alone] * 12
    # a name of noise about the main text, and comments that are longer than the text
    main = '<body><article><h1>T {i}</h1><div class="widget"><p>A long enough text, number {i}, which is the article</p></div></article>'
    chat = main.replace("</div>", '</div><div class="comments">{i}' + " and so on" * 50 + "</div>")
    assert extracted(spark, [("d", chat.format(i=i)) for i in range(3)]) == [f"T {i}\nA long enough text, number {i}, which is the article" for i in range(3)]
    assert extracted(spark, [("c", main.format(i=i)) for i in range(3)]) == [f"T {i}\nA long enough text, number {i}, which is the article" for i in range(3)]


def test_long_pages_and_clashing_names(spark):
    body = "".join(f"<p>paragraph {k}</p>" for k in range(20000))
    df = spark.createDataFrame([(1, "http://a.org/", f"<article>{body}</article>", "x", "y")], "page_id long, url string, html string, host string, place string")
    r = wrappers.extract_text(df).collect()[0]
    assert r["text"] == "\n".join(f"paragraph {k}" for k in range(20000)) and r["n_chars"] == len(r["text"])


def test_elements_beyond_depth_and_kinds(spark):
    deep, ends = "<div>" * 60, "</div>" * 60
    pages = [("a", f"<body><div><article><p>First {i}</p>{deep}Deep {i}<nav>Menu</nav>{ends}<p>Last {i}</p></article></div>") for i in range(4)]
    pages += [("b", f"<body>{deep}<p>Outside {i}</p><article><header>Head</header><p>Deep {i}</p></article>{ends}") for i in range(4)]
    others = "".join(f'<div class="{a}{b}z">Box</div>' for a in "abcdefgh" for b in "abcdefghijkl")
    pages += [("c", f'<body>{others}<article class="story">Story {i}</article>') for i in range(4)]
    pages += [("d", f'<body><article class="k{c}">Story {c}</article><div class="ad{c}">Box</div>') for c in "abcdefgh" for c in [c, c * 2, c * 3, c * 4, c * 5, c * 6, c * 7, c * 8, c * 9]]
    pages += [("e", '<body><div role="main"><p>One</p></main><p>Two</p></div><p>Three</p>')]
    want = [f"First {i}\nDeep {i}\nLast {i}" for i in range(4)] + [f"Head\nDeep {i}" for i in range(4)] + [f"Story {i}" for i in range(4)]
    want += [f"Story {c * n}" for c in "abcdefgh" for n in range(1, 10)] + ["One\nTwo\nThree"]
    assert extracted(spark, pages) == want
    assert wrappers.extract("<div>" * 3000 + "<article>x" + "</article>" + "</div>" * 3000, [], set()) == "x"


# line hashing


@pytest.mark.parametrize(("sentences", "min_run"), [(False, 1), (True, 1), (True, 6)])
def test_units(spark, sentences, min_run):
    r = random.Random(5)
    words = ["aa", "bb", "cc", "dd", "ee"]

    def sentence():
        return " ".join(r.choice(words) for _ in range(r.randrange(1, 8))) + r.choice([".", "!", "?", "\n", ". \n"])

    data = [(i % 70 if i % 9 else None, " ".join(sentence() for _ in range(r.randrange(13)))) for i in range(120)]
    data += [(5, None), (5, None), (6, ""), (1000, "x " * 50), (1001, "x " * 50), (1001, "x " * 50), (2**63 - 1, "x " * 50), (1002, "a line\n" * 30000), (1003, "x " * 300000)]
    df = docs_of(spark, data)
    digest = {t: h for t, h in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    cut, seen = {}, {}
    for i, t in data:
        cut[i is None, i or 0, digest[t or ""]] = list(units.units(t or "", sentences))
    for k in sorted(cut):
        for o, u in enumerate(cut[k]):
            seen.setdefault(u[2], (k, o))
    want = []
    for i, t in data:
        k = (i is None, i or 0, digest[t or ""])
        spans, n, run = [], 0, []
        for o, u in enumerate([*cut[k], None]):
            if u is not None and seen[u[2]] != (k, o):
                run.append(u)
            else:
                if run and sum(x[3] for x in run) >= min_run:
                    spans.append([run[0][0], run[-1][1]])
                    n += len(run)
                run = []
        want.append((i, len(t or ""), n, sum(b - a for a, b in spans), spans))
    got = [(*r[:4], [list(s) for s in r[4]]) for r in units.dedup_units(df, sentences=sentences, min_run=min_run).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert units.dedup_units(docs_of(spark, [])).count() == 0


def test_units_of_any_length_go(spark):
    lines = ["Read our terms.", "Go!", "two  Words", "a hot line of nine words, found all over", "-"]
    data = [(i, "".join(f"own text {i} {k} only here\n{line}\n" for k, line in enumerate(lines))) for i in range(40)]
    for r in units.dedup_units(docs_of(spark, data)).collect():
        text, kept, at = dict(data)[r[0]], [], 0
        for a, z in [*r["spans"], (None, None)]:
            kept.append(text[at:a])
            at = z
        assert "".join(kept) == (text if r[0] == 0 else "".join(f"own text {r[0]} {k} only here\n" for k in range(len(lines))))
        assert r["n_removed_units"] == (0 if r[0] == 0 else len(lines))


def test_passages_inside_lines_go(spark):
    """Runs of words that an earlier document has, against brute force: set into longer lines, over line breaks, in copies, in texts of one word."""
    r = random.Random(8)
    some = [" ".join(r.choice(["aa", "Bb", "cc", "dd"]) + r.choice(["", "."]) for _ in range(n)) for n in (12, 15, 40)]
    own = iter(range(10**6))
    data = []
    for i in range(90):
        parts = [" ".join(f"own{next(own)}" for _ in range(r.randrange(6))) for _ in range(4)]
        parts[r.randrange(4)] += r.choice(["", " ", "\n"]) + r.choice([*some, some[1][3:-4], some[2].replace(" ", "\n", 9)]).swapcase() + " "
        data.append((i % 80 if i % 11 else None, r.choice([" ", "\n", " \u2003"]).join(parts)))
    data += [(200, "x " * 40), (201, "y x " + "x " * 30), (202, "x"), (203, None), (204, ""), (205, some[0]), (205, some[0])]
    df, passage = docs_of(spark, data), 11
    digest = {t: h for t, h in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    docs = {(i is None, i or 0, digest[t or ""]): t or "" for i, t in data}
    seen, lines, want = {}, {}, {}
    for k in sorted(docs):
        text = docs[k]
        gone = [False] * len(text)
        place = [m.span() for m in re.finditer(r"\S+", text)]
        for o, u in enumerate(units.units(text)):
            if lines.setdefault(u[2], (k, o)) != (k, o):
                gone[u[0] : u[1]] = [True] * (u[1] - u[0])
        for w in range(len(place) - passage + 1):
            a, z = place[w][0], place[w + passage - 1][1]
            if seen.setdefault(tuple(text[a:z].lower().split()), k) != k:
                gone[a:z] = [True] * (z - a)
        want[k] = "".join(c for c, g in zip(text, gone, strict=True) if not g)
    rows = units.dedup_units(df, passage=passage).collect()
    assert len(rows) == len(data)
    left = Counter()
    for x in rows:
        # the row's own text is the one of its id with this length and these spans
        for k, text in docs.items():
            if (k[0], k[1]) == (x["doc_id"] is None, x["doc_id"] or 0) and len(text) == x["n_chars"]:
                kept, at = "", 0
                for a, z in [*x["spans"], (None, None)]:
                    kept, at = kept + text[at:a], z
                left[k] += kept == want[k]
        assert x["n_removed"] == sum(z - a for a, z in x["spans"])
    assert all(left[k] for k in docs)
    assert sum(want[k] != docs[k] for k in docs) > 50
    assert next(x for x in rows if x["doc_id"] == 202)["n_removed_units"] == 0
    assert units.dedup_units(docs_of(spark, []), passage=passage).count() == 0


# search


def test_search(spark, rows):
    table = [(i, t or "") for i, t in rows]
    bags = [(i, bm25.terms(t)) for i, t in table]
    n, mean = len(bags), sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    want = {}
    for (i, t), (_, bag) in zip(table, bags, strict=True):
        if i is None or i % 20 or not bag:
            continue
        scores = []
        for d, other in bags:
            size = sum(other.values())
            s = sum(q * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * other[w] * 2.2 / (other[w] + 1.2 * (0.25 + 0.75 * size / mean)) for w, q in bag.items() if w in other)
            if s > 0:
                scores.append((-round(s, 6), d is None, d or 0))
        want[i] = [(s, None if none else d) for s, none, d in sorted(scores)[:10]]
    got = defaultdict(list)
    for r in bm25.search(docs_of(spark, rows)).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["doc_id"]))
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort(key=lambda x: x[0])
        assert [x for x, _, _ in found] == list(range(1, len(found) + 1))
        assert [x for _, x, _ in found] == pytest.approx([-s for s, _ in want[q]], abs=2e-6)
        assert [x for _, _, x in found] == [d for _, d in want[q]]
    assert bm25.search(docs_of(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8))
def test_pruning_loses_nothing(seed, k):
    r = random.Random(seed)
    texts = [" ".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(0, 12))) for _ in range(400)]
    shard = bm25.Shard(bm25.build(list(range(400)), texts), 6.0)
    bag = bm25.terms(r.choice(texts) + " a b")
    term, weight = bm25.digests(bag), np.array([1.0 + x for x in bag.values()])
    order = np.argsort(term)
    got = shard.top(term[order], weight[order], k)
    if len(got) == k:  # what another shard found may be the same, or less
        assert shard.top(term[order], weight[order], k, got[-1][1]) == got
        assert shard.top(term[order], weight[order], k, 0.7 * got[-1][1]) == got
        assert [x for x in got if x[1] > got[-1][1]] == shard.top(term[order], weight[order], k, got[-1][1] + 1e-5)
    weights = dict(zip(bag, weight, strict=True))
    every = []
    for i, t in enumerate(texts):
        b = bm25.terms(t)
        s = sum(weights[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / 6.0)) for w in bag if w in b)
        if s > 0:
            every.append((-round(s, 6), i))
    assert [(-s, i) for i, s in got] == sorted(every)[:k]


def test_many_copies_rank_by_id(spark):
    """More copies than blocks hold, in many blocks and shards, with others of the same score between."""
    r = random.Random(4)
    word = [f"w{i}" for i in range(40)]
    rows = [(3 * i, "w1 w2 w2 w5") for i in range(700)] + [(3 * i + 1, " ".join(r.choice(word) for _ in range(6))) for i in range(900)] + [(2, "w5 w2 w1 w2")]
    r.shuffle(rows)
    out = defaultdict(list)
    for x in bm25.search(docs_of(spark, rows), k=12).collect():
        out[x["query_id"]].append((x["rank"], x["doc_id"]))
    best = [d for _, d in sorted(out[60])]
    assert best == sorted([2, *range(0, 33, 3)])


@pytest.mark.parametrize("opens", [True, False])
def test_texts_larger_than_a_shard(spark, monkeypatch, opens):
    monkeypatch.setattr(bm25, "can_open_shared", lambda spark: opens)
    rows = [(20 * i, f"w{i} " * 700 + "w0") for i in range(4)] + [(5, "w0 w1"), (6, "")]
    got = defaultdict(list)
    for x in bm25.search(docs_of(spark, rows), shard_bytes=1000).collect():
        got[x["query_id"]].append((x["rank"], x["doc_id"]))
    assert {q: sorted(v)[0][1] for q, v in got.items()} == {0: 0, 20: 20, 40: 40, 60: 60}


def test_indexes_pass_through_a_jvm_once(spark, monkeypatch):
    """Where Python opens the shared folder, every shard is a file, and no step after its writing scans or shuffles an index."""
    r = random.Random(6)
    rows = [(i, " ".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(1, 30)))) for i in range(300)]
    kept, write = {}, bm25.materialize

    def recorded(df, label, **more):
        kept[label] = df, write(df, label, **more)
        return kept[label][1]

    monkeypatch.setattr(bm25, "materialize", recorded)
    found = sorted(map(tuple, bm25.search(docs_of(spark, rows), shard_bytes=800).collect()))
    shards = kept["bm25-shards"][1]
    assert shards.count() > 8
    assert all(bm25.parquet.ParquetFile(f.removeprefix("file://")).metadata.num_rows <= 1 for f in shards.inputFiles())
    folder = re.search(r"bm25-shards-\w+", shards.inputFiles()[0])[0]
    for label in ("bm25-queries", "bm25-started", "bm25-found"):
        assert folder not in str(kept[label][0].inputFiles())
    assert "Exchange" not in kept["bm25-found"][0]._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(bm25, "can_open_shared", lambda spark: False)
    assert sorted(map(tuple, bm25.search(docs_of(spark, rows), shard_bytes=800).collect())) == found


@pytest.mark.parametrize("opens", [True, False])
def test_results_before_the_merge_grow_as_the_queries(spark, monkeypatch, opens):
    """Of the shards that hold copies of a text, a query gets its best from groups of them, however many there are; none is lost."""
    r = random.Random(8)
    rows = [(i, "w1 w2 w2 w5" if i % 2 else " ".join(r.choice(["w1", "w2", "w3", "w4", f"x{i}"]) for _ in range(9))) for i in range(600)] + [(2000, "w5 w2 w1 w2")]
    kept, write = {}, bm25.materialize

    def recorded(df, label, **more):
        kept[label] = write(df, label, **more)
        return kept[label]

    monkeypatch.setattr(bm25, "materialize", recorded)
    monkeypatch.setattr(bm25, "can_open_shared", lambda spark: opens)
    got = defaultdict(list)
    for x in bm25.search(docs_of(spark, rows), shard_bytes=400).collect():
        got[x["query_id"]].append((x["rank"], x["doc_id"]))
    assert kept["bm25-shards"].count() > 20
    assert kept["bm25-found"].count() <= 4 * 10 * 31
    assert [d for _, d in sorted(got[2000])] == list(range(1, 20, 2))
    assert all(len(x) == 10 for x in got.values())


def test_columns_and_postings_give_the_same(monkeypatch):
    """Common terms as columns of a band, or all terms as postings: over shards of several bands, what brute force finds."""
    r = random.Random(9)
    word = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(word, [1 / (j + 1) for j in range(60)], k=r.randrange(1, 40))) for _ in range(3000)]
    bags = [bm25.terms(t) for t in texts]
    asked = [bags[i] for i in range(0, 3000, 150)]
    term = [np.sort(bm25.digests(b)) for b in asked]
    weight = [np.array([{int(d): 1.0 + int(d) % 7 for d in bm25.digests(b)}[int(d)] for d in t]) for b, t in zip(asked, term, strict=True)]
    want = []
    for b in asked:
        scores = []
        for i, other in enumerate(bags):
            by = {w: 1.0 + int(bm25.digests([w])[0]) % 7 for w in b if w in other}
            s = sum(x * other[w] * 2.2 / (other[w] + 1.2 * (0.25 + 0.75 * sum(other.values()) / 20.0)) for w, x in by.items())
            if s > 0:
                scores.append((-round(s, 6), i))
        want.append([i for _, i in sorted(scores)[:10]])
    indexes = [bm25.build(list(range(a, a + 1500)), texts[a : a + 1500]) for a in (0, 1500)]
    for common in (0.0, bm25.COMMON, 0.3, 2.0):
        monkeypatch.setattr(bm25, "COMMON", common)
        block = bm25.Asked(np.zeros((len(asked), 32), np.uint8), np.cumsum([0, *map(len, term)]), np.concatenate(term), np.concatenate(weight), np.zeros(len(asked)))
        for x in indexes:
            bm25.Shard(x, 20.0).ask(block, 10)
        assert [[i for _, _, i in best] for best in block.best] == want


# quality


def test_quality_learns_and_holds_out(spark, rows):
    r = random.Random(3)
    good = [" ".join(r.choice(["the", "river", "ran", "over", "stones"]) for _ in range(60)) for _ in range(150)]
    junk = [" ".join(r.choice(["BUY!!", "$$$", "###", "NOW!!"]) for _ in range(60)) for _ in range(150)]
    data = [(i, t) for i, t in enumerate(good + junk)]
    docs = docs_of(spark, [*data, (900, None), (901, ""), (None, "the river"), (3, good[3])])
    labels = spark.createDataFrame([(i, int(i < 150)) for i, _ in data] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == len(data) + 4
    held = [x for x in out if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i in [*range(300), 900, 901] if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [x["predicted"] == int(x["doc_id"] < 150) for x in held if x["doc_id"] < 300]
    assert np.mean(right) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 100 < kept.count() < 220
    assert {x["score"] for x in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_gradients():
    r = np.random.default_rng(0)
    m = quality.Attention()
    x, first, y = r.random((9, quality.WIDTH)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        total = 0.0
        for a, b, t in zip(first, [*first[1:], 9], y, strict=True):
            h, e = m.encode(x[a:b])
            w = np.exp(e - e.max())
            p = quality.sigmoid((w / w.sum()) @ h @ m.p["o"] + m.p["b"][0])
            total -= t * np.log(p) + (1 - t) * np.log(1 - p)
        return total / 3

    g = m.gradients(x, first, y)
    for k, v in m.p.items():
        at = tuple(r.integers(0, n) for n in v.shape)
        old, step = v[at], 1e-5
        v[at] = old + step
        up = loss()
        v[at] = old - step
        down = loss()
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * step), abs=1e-6), k


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    joined = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert joined.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93


# pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(p.STAGES) == 5
    sizes = []
    for _, stage in p.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        docs = p.materialize(made, "test")
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * 200
    packed = p.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_quality_trains_on_all_passages(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (quality.PASSAGE * 60 - i)) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, bags, y: seen.append([len(b) for b in bags]))
    quality.train(docs, labels)
    quality.train(docs, labels, train_passages=60 * 5 + 59)
    assert set(seen[0]) == {60} and len(seen[0]) > 5
    assert seen[1] == [60] * 5
