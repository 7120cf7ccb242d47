"""The training-data operators against brute force, on the small tables and on edge cases."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from botledger.llm import bpe, embed_dedup, html_extract, language, licenses, mixing, quality, simhash, substring, token_store
from botledger.llm.common import connected_components, table, table_path
from botledger.llm.queries import ORACLE, QUERIES

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def docs_of(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def split(text):
    return (text or "").encode().split()


# ---------------------------------------------------------------- 1 substring dedup


def removed_by_brute_force(docs):
    """Distinct documents in order of (doc_id, hash of text); a window that also starts earlier loses its words."""
    key = lambda d: (d[0] is not None, d[0] or 0, substring.text_tag((d[1] or "").encode()))
    seen, out = set(), {}
    for doc in sorted(set(docs), key=key):
        words = split(doc[1])
        gone = [False] * len(words)
        for j in range(len(words) - 19):
            window = tuple(words[j : j + 20])
            if window in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(window)
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("which", ["table", "edge"])
def test_substring_dedup(spark, sf_dir, edge_docs, which):
    frame = table(spark, sf_dir, "documents") if which == "table" else edge_docs
    docs = docs_of(frame)
    want = removed_by_brute_force(docs)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.kept_digests(frame).collect())
    assert got == collections.Counter((d[0], *want[d]) for d in docs)


def test_substring_dedup_tells_texts_without_ids_apart(spark):
    """Texts of equal crc32 are still different documents."""
    passage, seen, pairs = " ".join(f"p{k}" for k in range(30)), {}, []
    for i in range(400_000):
        text = f"{passage} w{i} {passage}" if i % 2 else f"{passage} v{i}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            pairs += [other, text]
    docs = [(None, t) for t in pairs] + [(7, t) for t in pairs]
    assert pairs
    want = removed_by_brute_force(docs)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.kept_digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert got == collections.Counter((d[0], *want[d]) for d in docs)


def thue_morse(order, a="a", b="b"):
    """The word of 2^order letters and its complement: every sum of letters times powers of an odd base takes the same value modulo 2^64 on both."""
    bits = [bin(i).count("1") % 2 for i in range(1 << order)]
    return "".join(b if x else a for x in bits), "".join(a if x else b for x in bits)


def made_documents():
    """Words and word sequences of structure, a phrase with hundreds of surroundings, shifted and nested copies."""
    rng = np.random.default_rng(3)
    word = lambda k: " ".join(f"r{x}" for x in rng.integers(0, 50_000, k))
    x, y = thue_morse(10)
    base = word(60).split()
    docs = [(1, " ".join(base[:30] + [x] + base[30:])), (2, " ".join(base[:30] + [y] + base[30:]))]  # unlike in one word only
    p, q = thue_morse(12, "u ", "v ")
    docs += [(3, p), (4, q), (5, "z " * 300), (6, " ".join(base[10:45] * 3))]
    phrase = word(21)
    docs += [(10 + i, f"{word(25)} {phrase} {word(25)}") for i in range(400)]
    docs += [(500 + i, word(5) + " " + " ".join(base[i : i + 19 + i % 4]) + " " + word(5)) for i in range(30)]
    return docs + [(600, None), (None, " ".join(base)), (601, docs[0][1]), (602, docs[0][1] + " " + docs[0][1])]


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_dedup_of_structured_texts(spark, parts):
    docs = made_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    want = removed_by_brute_force(docs)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.kept_digests(frame).collect())
    assert got == collections.Counter((d[0], *want[d]) for d in docs)


def test_substring_factors_stand_where_they_say(spark):
    """Each factor's words stand earlier at its reference, factors don't overlap, and a whole copy is few long ones."""
    docs = made_documents()
    words = {i: split(t) for i, t in docs}
    null = substring.NULL_ID
    rows = substring.parse(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    longest = 0
    for r in rows:
        own, end = words[None if r["doc"] == null else r["doc"]], 0
        for f in r["factors"]:
            ref = words[None if f["ref_doc"] == null else f["ref_doc"]]
            a, n, b = f["start"], f["length"], f["ref_start"]
            assert a >= end and own[a : a + n] == ref[b : b + n] and (f["ref_doc"], b) < (r["doc"], a)
            end, longest = a + n, max(longest, n)
    assert longest >= 61 and all(len(r["factors"]) <= 3 for r in rows if r["doc"] == 601)  # before, across and after the odd word


def test_substring_removal_keeps_columns_and_clean_texts(spark, edge_docs, no_docs):
    out = substring.remove_repeats(edge_docs)
    assert out.columns == edge_docs.columns
    texts = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    want = {d: v for d, v in removed_by_brute_force(docs_of(edge_docs)).items()}
    for (doc_id, text), n in texts.items():
        before = [d for d in want if d[0] == doc_id and (d[1] == text or hashlib.sha256(b" ".join(split(text))).hexdigest() == want[d][2])]
        assert before and n >= 1
    assert substring.remove_repeats(no_docs).count() == 0 == substring.kept_digests(no_docs).count()


# ---------------------------------------------------------------- 2 HTML


def test_html_generated_pages_and_given_ones(spark, sf_dir):
    net = html_extract.trained()
    rng = np.random.default_rng(77)
    wrong = blocks = 0
    for _ in range(150):
        page, labels = html_extract._training_page(rng)
        found = html_extract.leaf_blocks(page)
        if len(found) == len(labels):
            wrong += int((net.label([found])[0] != np.array(labels, bool)).sum())
            blocks += len(labels)
    assert wrong <= 0.02 * blocks
    import html
    import re

    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", body))
        want = "\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_html_edge_cases(spark):
    rows = [
        (1, "u", None), (2, "u", ""), (None, None, "<article><p>a &amp;&nbsp;b<p>c</article>"), (3, "u", "<p>never <b>closed"), (3, "u", "<p>never <b>closed"), (4, "u", "<script>x"),
        (5, "u", "<!-- open"), (6, "u", "<article>" + "<p>word word word.</p>" * 3000 + "</article>"), (7, "u", "a < b <3 </nothing>"),
    ]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = collections.defaultdict(list)
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    assert got[1] == got[2] == got[4] == got[5] == [""] and got[None] == ["a & b\nc"]
    assert got[3][0] == got[3][1] and got[6][0].count("\n") == 2999
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_blocks_see_links_slashes_and_every_word():
    linked = lambda page: [(b.text, b.linked) for b in html_extract.leaf_blocks(page)]
    assert linked("<a href='x'><span><b><i><u>deep link</u></i></b></span></a>") == [("deep link", 9)]
    assert linked("<a href=/docs/>unquoted</a> then <a name=here>no link</a>") == [("unquoted then no link", 8)]
    assert linked('<p><a href="x"/>open<p>closed</p>')[0] == ("open", 4)
    words = [f"w{i}" for i in range(5000)]
    one, two = (html_extract.vectors(html_extract.leaf_blocks("<p>" + " ".join(x) + "</p>")) for x in (words, words[:1] + words[:1] + words[2:]))
    assert (one != two).any()  # one word in 5,000 counts
    nested = html_extract.leaf_blocks("<div class=a><b>" * 30_000 + "x" + "</div>y" * 30_000)
    assert len(nested) == 30_001 and all(len(b.path) == 3 for b in nested[:-1])


#: Pages of layouts that the generator doesn't make, and the main text as a reader would copy it.
LAYOUTS = {
    "blog": (
        """<html><head><title>Bread</title><style>p{}</style></head><body><div id="page"><div id="masthead"><a href="/">The Baker</a><ul id="primary-menu"><li><a href="/a">Home</a><li><a href="/b">Recipes</a></ul></div>
        <div id="content"><h1 class="entry-title">Slow bread</h1><div class="entry-content"><p>Flour, water and salt are all that a loaf needs. Time does the rest of the work.</p>
        <p>Leave the dough overnight in a cool place &mdash; it rises slowly and keeps its taste.</p><ul><li>500 g flour</li><li>350 g water</li></ul></div></div>
        <div id="secondary" class="widget-area sidebar"><h3>Recent posts</h3><ul><li><a href="/c">Rye</a></li><li><a href="/d">Spelt</a></li></ul></div>
        <div id="comments" class="comments-area"><p>Great recipe, thanks!</p><p>Mine did not rise.</p></div><div id="footer">Copyright 2020 The Baker</div></div></body></html>""",
        "Slow bread\nFlour, water and salt are all that a loaf needs. Time does the rest of the work.\nLeave the dough overnight in a cool place — it rises slowly and keeps its taste.\n500 g flour\n350 g water",
    ),
    "news": (
        """<body><div class="cookie-banner">We use cookies to improve this site. <button>Accept</button></div><nav><a href="/">World</a> <a href="/s">Sport</a></nav><main><h1>River rises again</h1>
        <p>The river reached its highest level in ten years on Monday, officials said.</p><div class="advertisement"><p>Buy our boats today!</p></div><p>Several roads near the old bridge were closed, and trains ran late.</p>
        <h2>What comes next</h2><p>Rain is expected to ease by Thursday.</p></main><aside><h3>Most read</h3><a href="/1">Storm</a></aside><footer><p>Contact us</p></footer></body>""",
        "River rises again\nThe river reached its highest level in ten years on Monday, officials said.\nSeveral roads near the old bridge were closed, and trains ran late.\nWhat comes next\nRain is expected to ease by Thursday.",
    ),
    "manual": (
        """<div class="wrapper"><div class="header"><a href="/">Docs</a></div><div class="sidebar"><ul><li><a href="/i">Install</a></li><li><a href="/u">Use</a></li></ul></div><div class="main"><h1>Install</h1>
        <p>Download the archive and unpack it where you like.</p><pre>tar xf tool.tar</pre><p>Then run the program once, so that it can write its settings.</p></div><div class="footer">Licence and privacy</div></div>""",
        "Install\nDownload the archive and unpack it where you like.\ntar xf tool.tar\nThen run the program once, so that it can write its settings.",
    ),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_html_layouts_without_an_article_element(name):
    page, want = LAYOUTS[name]
    assert html_extract.main_text([page], html_extract.trained()) == [want]


# ---------------------------------------------------------------- 3 licences


def base_by_brute_force(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("which", ["table", "edge"])
def test_license_scan(spark, sf_dir, edge_docs, which):
    frame = table(spark, sf_dir, "documents") if which == "table" else edge_docs
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_licences(frame).collect())
    assert got == collections.Counter((i, *base_by_brute_force(t)) for i, t in docs_of(frame))
    bad = licenses.scan_licences(frame).where("score < 0 or score > 1 or (base_labels <> '' and not array_contains(split(labels, ','), split(base_labels, ',')[0]))")
    assert bad.count() == 0


def test_license_matching_statistics():
    scan = licenses.LicenceScanner()
    rng = np.random.default_rng(3)
    words = [w.decode() for w in scan.ids] + ["zzz"]
    spans = [t for _, t in scan.templates] + [p.encode().split() for p in licenses.BASE]
    grams = {tuple(t[i:j]) for t in spans for i in range(len(t)) for j in range(i + 1, min(len(t), i + 41) + 1)}
    for _ in range(60):
        text = []
        while len(text) < 40:
            t = spans[rng.integers(len(spans))]
            a = int(rng.integers(len(t)))
            text += [w.decode() for w in t[a : a + int(rng.integers(1, 9))]] if rng.random() < 0.7 else [words[rng.integers(len(words))]]
        raw = [w.encode() for w in text]
        state = length = 0
        for i, w in enumerate(raw):
            state, length = scan.automaton.step(state, length, scan.ids.get(w, 0))
            want = max((k for k in range(0, i + 2) if k == 0 or tuple(raw[i + 1 - k : i + 1]) in grams), default=0)
            assert length == want
        assert scan.scan(" ".join(text))[:5] == base_by_brute_force(" ".join(text))
    assert scan.scan("This is licensed under  CC BY-NC 4.0, thanks")[5] == "cc-by-nc"
    assert scan.scan("permission is hereby granted, free of charge, to any person reading this")[5] == ""
    assert scan.scan("licensed under cc by something")[5] == "" == scan.scan("all rights are reserved")[5]


def test_licence_texts_are_found_with_edits():
    """Whole licence texts, rewrapped, among other words, with every 25th word changed or dropped, give their own label and span; every third word changed gives none."""
    scan = licenses.LicenceScanner()
    texts = [(label, t[0].split()) for label, t in licenses.TEMPLATES.items() if len(t[0].split()) > 20]
    assert len(texts) == 11
    for label, words in texts:
        for name, edit in (("exact", lambda i, w: w), ("changed", lambda i, w: "changed" if i % 25 == 7 else w), ("dropped", lambda i, w: "" if i % 25 == 9 else w)):
            own = [edit(i, w) for i, w in enumerate(words)]
            body = "preface about nothing at all\n" + "\n".join(" ".join(own[i : i + 9]) for i in range(0, len(own), 9)) + "\nand more prose after it"
            found = scan.scan(body)
            assert label in found[5].split(",") and set(found[5].split(",")) - {label} <= {"gpl"}, (label, name, found[5])
            spans = [x for x in found[7] if x[0] == label]
            assert len(spans) == 1 and spans[0][1] <= 13 and spans[0][2] >= found[0] - 15
        far = " ".join("other" if i % 3 == 0 else w for i, w in enumerate(words))
        assert set(filter(None, scan.scan(far)[5].split(","))) <= {"gpl"}
    both = " ".join(dict(texts)["bsd-2-clause"]) + " and then " + " ".join(dict(texts)["mit"])
    assert scan.scan(both)[5] == "bsd-2-clause,mit"


# ---------------------------------------------------------------- 4 token store


def test_perfect_hash():
    for n in (1, 2, 7, 1000, 20_000):
        h = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.int64).view("<u8")
        d = token_store.build_mph(h)
        assert sorted(token_store.mph_slots(h, d, n).tolist()) == list(range(n))


def test_token_store(spark, sf_dir, edge_docs, no_docs):
    path = bpe.vocabulary_path("word_bpe_49k.json")
    tok = bpe.load_tokenizer(path)
    for frame in (table(spark, sf_dir, "documents"), edge_docs):
        folder = table_path(spark, "store")
        token_store.write(frame, folder, path)
        got = [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in token_store.read(spark, folder).collect()]
        got.sort(key=lambda r: r[1])
        assert [r[0] for r in got] == sorted((i for i, _ in docs_of(frame)), key=lambda i: (i is not None, i or 0))
        assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()
        want = collections.Counter((i, *tok.encode(t or "", add_special_tokens=False).ids, 1) for i, t in docs_of(frame))
        assert collections.Counter((r[0], *r[3]) for r in got) == want
        one = next(r for r in got if r[0] is not None)
        assert token_store.get(spark, folder, [one[0], 10**12]) == {one[0]: one[3]}
        by_key = collections.defaultdict(list)
        for i, _, _, ids in got:
            by_key[i].append(ids)
        found = token_store.get(spark, folder, [i for i in by_key if i is not None] + [-5, 10**12])
        assert found.keys() == by_key.keys() - {None} and all(ids in by_key[i] for i, ids in found.items())
    folder = table_path(spark, "store")
    token_store.write(no_docs, folder, path)
    assert token_store.read(spark, folder).count() == 0


# ---------------------------------------------------------------- 5 mixing


def test_mixing(spark, sf_dir, edge_docs, no_docs):
    for frame in (table(spark, sf_dir, "documents"), edge_docs):
        rows = mixing.mix(frame).collect()
        assert len(rows) == frame.count()
        assert sorted(r["size"] for r in rows) == sorted(len(split(t)) for _, t in docs_of(frame))
        by = collections.defaultdict(list)
        for r in rows:
            assert 0 <= r["taken"] <= 2 * r["size"]
            by[r["source"]].append(r)
        total, order = sum(r["size"] for r in rows), sorted(by, key=lambda s: (s is None, (s or "").encode()))
        caps = {s: 2.0 * sum(r["size"] for r in by[s]) for s in order}
        weight, want, open_, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * total
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if caps[s] < level * weight[s]}
            for s in full or open_:
                want[s] = caps[s] if full else level * weight[s]
            left -= sum(caps[s] for s in full)
            open_ = open_ - full if full else set()
        for s in order:
            assert by[s][0]["target"] == pytest.approx(want[s])
            assert abs(sum(r["taken"] for r in by[s]) - want[s]) <= 3 * max(1, min(mixing.BLOCK_WORDS, int(sum(want.values())) // mixing.LEAST_SLOTS))
    assert mixing.mix(no_docs).count() == 0 == mixing.mix_documents(no_docs).count()
    assert mixing.mix_documents(edge_docs).columns == edge_docs.columns


def test_mixing_schedule_is_even(spark):
    sizes = spark.createDataFrame([("a", 90_000), ("b", 30_000), ("c", 5000), (None, 200_000)], "source string, size long")
    src = mixing.source_targets(sizes)
    quota = {r["sidx"]: r["quota"] for r in src.collect()}
    total, n = sum(quota.values()), 10_000
    plan = mixing.schedule(src, n).orderBy("slot").collect()
    assert [r["slot"] for r in plan] == list(range(n))
    edges = np.cumsum([0] + [quota[s] for s in sorted(quota)]) * (1 << mixing.RING_BITS) / total
    points = [k * mixing.STEP % (1 << mixing.RING_BITS) for k in range(n)]
    assert [r["sidx"] for r in plan] == (np.searchsorted(np.floor(edges), points, side="right") - 1).tolist()
    for s, k in quota.items():
        assert [r["block"] for r in plan if r["sidx"] == s] == list(range(sum(r["sidx"] == s for r in plan)))
        run = np.cumsum([r["sidx"] == s for r in plan])
        assert np.abs(run - np.arange(1, n + 1) * k / total).max() <= 3


def test_mixing_of_few_words_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g", f"s{i % 4}") for i in range(20)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    for s, target in {(r["doc_id"] % 4, r["target"]) for r in rows}:
        assert abs(sum(r["taken"] for r in rows if r["doc_id"] % 4 == s) - target) <= 2


def test_mixing_runs_without_python_workers(spark):
    docs = mixed_docs(spark)
    for frame in (mixing.mix(docs), mixing.mix_documents(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_mixing_point_does_not_overflow(spark):
    ids = [0, 1, 12345, (1 << 20) - 1, 1 << 20, (1 << 40) + 7, (1 << 45) + 99]
    got = spark.createDataFrame([(i,) for i in ids], "id long").selectExpr(mixing.point("id")).collect()
    assert [r[0] for r in got] == [i * mixing.STEP % (1 << mixing.RING_BITS) for i in ids]


def mixed_docs(spark):
    words = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    rows = [(i, words(i, 7 + i * 37 % 90), f"s{i % 3}", i % 2, f"x{i}") for i in range(120)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string, slot int, _key string")


def test_mixing_takes_what_the_schedule_draws(spark, monkeypatch):
    """Another schedule gives other words, and other documents in another order."""
    docs = mixed_docs(spark)
    taken = lambda: sorted((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())
    order = lambda: [r["doc_id"] for r in mixing.mix_documents(docs).collect()]
    was, listed = taken(), order()
    assert taken() == was and order() == listed and listed != sorted(listed)
    real = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda src, n: real(src, n // 2))
    assert sum(t for _, t in taken()) < 0.6 * sum(t for _, t in was)
    monkeypatch.setattr(mixing, "schedule", lambda src, n: real(src, n).withColumn("slot", n - F.col("slot")))
    assert taken() == was and order() != listed


def mixed_by_brute_force(rows):
    """doc_ids of (doc_id, source, size) in the order that a plain walk along the points gives, copies included."""
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, t, n in rows if t == s) for s in order}
    weight, want, open_, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2.0 * size[s] < level * weight[s]}
        want |= {s: 2.0 * size[s] if full else level * weight[s] for s in full or open_}
        left -= sum(2.0 * size[s] for s in full)
        open_ = open_ - full if full else set()
    quota = [int(want[s] + 0.5) for s in order]
    ring, total = 1 << mixing.RING_BITS, sum(quota)
    b = max(1, min(mixing.BLOCK_WORDS, total // mixing.LEAST_SLOTS))
    edges = np.floor(np.cumsum([0] + quota).astype(float) * ring / total)
    drawn = collections.defaultdict(list)
    for k in range((total + b // 2) // b):
        drawn[order[int(np.searchsorted(edges, k * mixing.STEP % ring, side="right")) - 1]].append(k)
    out = []
    for s in order:
        at = 0
        for _ in range(2):
            for _, k, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), n, i) for i, t, n in rows if t == s):
                words = sum(min(at + k, x * b + b) - max(at, x * b) for x in range(at // b, (at + k - 1) // b + 1) if x < len(drawn[s])) if k else 0
                if k and 2 * words >= k:
                    out.append((drawn[s][at // b], at, i))
                at += k
    return [i for _, _, i in sorted(out)]


def test_mixing_order_follows_the_slots(spark):
    docs = mixed_docs(spark)
    rows = [(r["doc_id"], r["source"], len(split(r["text"]))) for r in docs.collect()]
    assert [r["doc_id"] for r in mixing.mix_documents(docs).collect()] == mixed_by_brute_force(rows)


# ---------------------------------------------------------------- 6 quality


def counts_by_brute_force(text):
    words = split(text)
    windows = collections.Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
    cover = {k for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for k in range(j, j + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    n = len(words)
    return n, len(b"".join(words).decode()), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


@pytest.mark.parametrize("which", ["table", "edge"])
def test_quality_counts(spark, sf_dir, edge_docs, which):
    frame = table(spark, sf_dir, "documents") if which == "table" else edge_docs
    out = quality.judge(frame, quality.QualityModel((), 0.0))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert collections.Counter((r["doc_id"], *[r[c] for c in names], r["kept"]) for r in out.collect()) == collections.Counter(
        (i, *(c := counts_by_brute_force(t)), not c[-1]) for i, t in docs_of(frame)
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_quality_verdicts(spark, no_docs):
    good, bad = "alpha beta gamma delta epsilon zeta eta theta".split(), "buy$$$ now!!! win%%% cash&&& click### free***".split()
    rng = np.random.default_rng(5)
    make = lambda ws: " ".join(ws[i] for i in rng.integers(len(ws), size=60))
    rows = [(i, make(good) if i % 3 else make(bad)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in quality.apply_quality(docs, labels).collect()}
    assert [i for i, kept in out.items() if kept != (i % 3 > 0) and not counts_by_brute_force(rows[i][1])[-1]] == []
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {i for i, kept in out.items() if kept}
    assert quality.apply_quality(no_docs, labels).count() == 0
    assert quality.apply_quality(docs, labels.where("false")).where("kept = base_failed").count() == 0


def grams_by_brute_force(text):
    """Hash buckets of the words and word pairs of a text."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ws = split(text)
    one = [xxhash.xxh64_intdigest(w, 42) for w in ws]
    two = [xxhash.xxh64_intdigest(b, a) for a, b in zip(one, ws[1:])]
    return [signed(h) % quality.BUCKETS for h in one + two]


def quality_by_brute_force(docs, labels, limit=None):
    """{(doc_id, text): (llr or None, kept)} from plain counts over all documents."""
    import math

    order = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    good = {}
    for i, q in labels:
        if q in (0, 1) and i is not None:
            good[i] = min(q, good.get(i, 1))
    good = {i: q for c in (0, 1) for i, q in sorted(((i, q) for i, q in good.items() if q == c), key=lambda x: (order(x[0]), x[0]))[:limit]}
    target = {i for i, q in good.items() if q == 1 and int(order(i)[-1], 16) % 4 != 3}
    raw, own = collections.Counter(), collections.Counter()
    for i, t in docs:
        g = grams_by_brute_force(t)
        raw.update(g)
        if i in target:
            own.update(g)
    share = sum(own.values()) / sum(raw.values())
    weight = {b: round(quality.STEP * math.log((own[b] + quality.PRIOR) / (n * share + quality.PRIOR))) for b, n in raw.items()}
    out, held = {}, []
    for i, t in docs:
        g = grams_by_brute_force(t)
        llr = sum(weight[b] for b in g) / len(g) / quality.STEP if g else None
        failed = counts_by_brute_force(t)[-1]
        out[i, t] = llr, failed
        if i in good and i not in target and not failed:
            held.append((math.floor(llr * 500), good[i]))
    # the cut after the cell with the best gain; ties take the lowest, and the cut lies half way across empty cells
    cells = sorted({c for c, _ in held})
    gains = [sum((q == 0) - quality.TRUSTED_COST * (q == 1) for x, q in held if x <= c) for c in cells]
    best = max(range(len(cells)), key=lambda k: gains[k], default=None)
    if best is None:
        cut = -1e9
    elif gains[best] <= 0:
        cut = (cells[0] - 1) / 500
    else:
        after = cells[best + 1] if best + 1 < len(cells) else cells[best] + 1
        cut = (cells[best] + 1 + after) / 2 / 500
    return {k: (llr, not failed and (llr is None or llr >= cut)) for k, (llr, failed) in out.items()}


@pytest.mark.parametrize("limit", [quality.LABELLED_LIMIT, 12])
def test_quality_verdicts_by_brute_force(spark, sf_dir, monkeypatch, limit):
    monkeypatch.setattr(quality, "LABELLED_LIMIT", limit)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    want = quality_by_brute_force(docs_of(docs), [(r["doc_id"], r["quality"]) for r in labels.collect()], limit)
    rows = quality.apply_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        llr, kept = want[r["doc_id"], r["text"]]
        assert (r["llr"] is None) == (llr is None) and (llr is None or abs(r["llr"] - llr) < 1e-9) and r["kept"] == kept


# ---------------------------------------------------------------- 7 SimHash


def fingerprint_by_brute_force(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words)] if 0 < len(words) < 3 else [b" ".join(x) for x in zip(words, words[1:], words[2:])]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


@pytest.mark.parametrize("which", ["table", "edge"])
def test_simhash(spark, sf_dir, edge_docs, which):
    frame = (table(spark, sf_dir, "documents") if which == "table" else edge_docs).withColumn("text", F.substring("text", 1, 3000))
    docs = docs_of(frame)
    fps = np.array([fingerprint_by_brute_force(t) for _, t in docs], np.uint64)
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            root[find(max(i, j))] = find(min(i, j))
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        least[find(i)] += [d] if d is not None else []
    want = collections.Counter((d, int(fps[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(docs))
    got = collections.Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(frame).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and kept.count() == len({find(i) for i in range(len(docs))})


def test_simhash_links_all_near_pairs(spark, no_docs):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    fps = set(base.tolist())
    for b in base:
        for _ in range(30):
            bits = rng.choice(64, int(rng.integers(1, 6)), replace=False)
            fps.add(int(b) ^ sum(1 << int(k) for k in bits))
    fps = np.array(sorted(fps), np.uint64)
    rows = spark.createDataFrame([(i, 0, int(v)) for i, v in enumerate(fps.view(np.int64))], "doc_id long, text_hash long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.components(rows).collect()}
    seen = {}
    for i in range(len(fps)):
        if i not in seen:
            todo, seen[i] = [i], i
            while todo:
                x = todo.pop()
                for y in np.flatnonzero(np.bitwise_count(fps ^ fps[x]) <= 3).tolist():
                    if y not in seen:
                        seen[y] = i
                        todo.append(y)
    assert [got[int(v)] for v in fps.view(np.int64)] == [seen[i] for i in range(len(fps))]
    assert simhash.near_duplicates(no_docs).count() == 0


def components_by_brute_force(fps):
    """Index of the least member of each fingerprint's component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist():
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_splits_hot_segments(spark):
    """Hundreds of fingerprints with one half in common, and others a bit beside them, give the same components split or not."""
    rng = np.random.default_rng(4)
    fps = {(0xABCDEF01 << 32) | int(x) for x in rng.integers(0, 1 << 32, 600)} | {(0xABCDEF03 << 32) | int(x) for x in rng.integers(0, 1 << 32, 40)}
    fps |= {(int(x) << 32) | 0x12345678 for x in rng.integers(0, 1 << 32, 300)}
    for f in rng.choice(np.array(sorted(fps), np.uint64), 200):
        fps.add(int(f) ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(1, 5)), replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    rows = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    want = components_by_brute_force(fps)
    at = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    for split_at in (simhash.SPLIT, 50):
        found = simhash.links(rows, split_at).collect()
        root = list(range(len(fps)))

        def find(x):
            return x if root[x] == x else find(root[x])

        for r in found:
            assert (int(r["a"]) ^ int(r["b"])).bit_count() <= 3 or ((int(r["a"]) ^ int(r["b"])) % (1 << 64)).bit_count() <= 3
            a, b = sorted((find(at[r["a"]]), find(at[r["b"]])))
            root[b] = a
        assert [find(i) for i in range(len(fps))] == want
    spread = simhash._bucket_entries(rows.distinct(), 50).groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert spread < 60


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 400)] + [(5, 9), (9, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7} | {i: 7 for i in range(200, 400)} | {5: 5, 9: 5}


# ---------------------------------------------------------------- 8 BPE


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_equals_the_library(name):
    import random

    random.seed(5)
    path = bpe.vocabulary_path(name)
    tok, enc = bpe.load_tokenizer(path), bpe.TextEncoder(path)
    signs = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "22", "!", "<|endoftext|>", "\xa0", "　", "\x1c", "ß", "İ", "漢", "😀", "\r\n", "the", " the", "'ll", "'re", "_", "Σ", "Д", "½", "\x00", "é", "–"]
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    texts += [a + chr(c) + b for c in [*range(0x800), 0x2028, 0x3000, 0xFFFF] for a, b in (("a", "b"), (" ", " "))]
    for at in range(0, len(texts), 400):
        part = texts[at : at + 400]
        ids, n = enc.encode(part)
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bpe_tells_words_of_equal_hash_apart(name):
    path = bpe.vocabulary_path(name)
    tok, enc = bpe.load_tokenizer(path), bpe.TextEncoder(path)
    pairs = [thue_morse(order) for order in (10, 11, 12, 13)]
    batches = [[x for pair in pairs for x in pair], ["plain words", *[y for _, y in pairs]], [x + " and " + y for x, y in pairs]]
    for fresh in (True, False):  # in one batch, and against what earlier batches left
        for part in batches:
            enc = bpe.TextEncoder(path) if fresh else enc
            ids, n = enc.encode(part)
            assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]


def test_lexicon_counts_every_word(spark):
    """A word is found however thinly it is spread over partitions."""
    rows = [(i, "wonder " + f"only{i}") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    lex = bpe.Lexicon(bpe.fit_lexicon(docs, bpe.vocabulary_path("byte_bpe_50k.json")))
    assert (lex.look([b" wonder", b" unseen"]) >= 0).tolist() == [True, False]


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["", "a", "tap", "taps", "top", "tops", "stop", "stops"])}
    lex = bpe.Lexicon(bpe.build_lexicon(words))
    found = lex.look([*words, b"to", b"tapsx", b"z"])
    assert [lex.ids[lex.offsets[k] : lex.offsets[k + 1]].tolist() for k in found[: len(words)]] == list(words.values())
    assert found[len(words) :].tolist() == [-1, -1, -1]
    assert len(lex.final) < 1 + sum(map(len, words))  # suffixes are shared


def test_bpe_query(spark, sf_dir, edge_docs, no_docs):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    tok = bpe.load_tokenizer(path)
    for frame in (table(spark, sf_dir, "documents"), edge_docs):
        want = collections.Counter()
        for i, t in docs_of(frame):
            ids = tok.encode(t or "", add_special_tokens=False).ids
            text = tok.decode(ids, skip_special_tokens=False)
            want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
        assert collections.Counter(tuple(r) for r in bpe.digests(frame, path).collect()) == want
    assert bpe.digests(no_docs, path).count() == 0
    assert [r["decoded"] for r in bpe.encode_and_decode(edge_docs.where("doc_id = 11"), path).collect()] == ["Released under the MIT License."]


# ---------------------------------------------------------------- 9 language


def test_language(spark, sf_dir, edge_docs, no_docs):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang").join(language.identify(docs), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    out = collections.defaultdict(list)
    for r in language.identify(edge_docs).collect():
        out[r["doc_id"]].append((r["lang_pred"], r["score"]))
        assert 0 <= r["score"] <= 1
    assert out[3] == out[4] == out[5] == [("und", 0.0)] and out[2][0] == out[2][1]
    assert language.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_sample_is_the_first_of_each_language(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_PER_LANG", 9)
    docs = table(spark, sf_dir, "documents")
    got = [(r["lang"], r["text"]) for r in language.sample(docs).collect()]
    twice = [(r["lang"], r["text"]) for r in language.sample(docs.unionByName(docs)).collect()]
    assert len(set(twice)) == len(twice) and set(twice) <= set(got)
    rows = {(r["lang"], hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["text"]) for r in docs.collect() if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    want = [(x, t) for lang in sorted({x for x, _, _ in rows}) for x, _, t in sorted(r for r in rows if r[0] == lang)[:9]]
    assert got == want


def test_language_marginals_by_brute_force():
    import itertools

    rng = np.random.default_rng(1)
    model = language.Crf(["x", "y", "z"])
    model.transitions = rng.normal(size=(3, 3))
    lens = np.array([1, 4, 3])
    pot = rng.normal(size=(8, 3))
    got = model.marginals(pot, lens)
    at = 0
    for n in lens:
        total, own = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(pot[at + i, k] for i, k in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:])))
            total += p
            for i, k in enumerate(path):
                own[i, k] += p
        assert np.allclose(got[at : at + n], own / total)
        at += n


def test_language_follows_a_switch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) > 600")
    model = language.fit(table(spark, sf_dir, "documents"))
    first = {r["lang"]: r["text"] for r in docs.select("lang", "text").collect()}
    a, b = sorted(first)[:2]
    words = language.split_words(first[a])[:30] + language.split_words(first[b])[:30]
    best = model.marginals(model.potentials(words), np.array([len(words)])).argmax(axis=1)
    assert (best[:30] == model.labels.index(a)).mean() > 0.8 and (best[30:] == model.labels.index(b)).mean() > 0.8


# ---------------------------------------------------------------- 10 embeddings


def links_by_brute_force(rows):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, float)).all() and any(v) for _, v in rows]
    n = len(rows)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for y in near[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), comp, rows[i][0] is not None and rows[i][0] == comp))
    return collections.Counter(out)


def test_embedding_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (None, [2.0, 4.0, 6.1]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [-1.0, -2.0, -3.0]), (None, None)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string")
    want = links_by_brute_force([(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x]) for i, x in rows])
    assert collections.Counter(tuple(r) for r in embed_dedup.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()) == want
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_dense_groups(spark):
    """Groups far larger than a neighbour list, among scattered vectors: links counted in full."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(3, 16))
    rows = [c + rng.normal(size=16) * 0.15 for c, n in zip(centre, (700, 60, 5)) for _ in range(n)] + list(rng.normal(size=(400, 16)))
    x = np.array(rows, np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    truth = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = np.array([r["n_links"] for r in embed_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= truth).all() and got.sum() >= 0.98 * truth.sum()


def test_embedding_groups_that_fill_each_others_lists(spark):
    """Two groups larger than any list, nearer to themselves than to each other, all at or above the threshold; a third one apart."""
    rng = np.random.default_rng(3)
    centre = np.zeros((3, 16))
    centre[0, 0], centre[1, :2], centre[2, 2] = 1, (0.93, np.sqrt(1 - 0.93**2)), 1
    x = np.array([c + rng.normal(size=16) * 0.003 for c, n in zip(centre, (700, 60, 50)) for _ in range(n)], np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(df).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == [759] * 760 + [49] * 50
    assert [r["component_id"] for r in got] == [0] * 760 + [760] * 50 and [r["vec_id"] for r in got if r["kept"]] == [0, 760]


def test_embedding_blocks_are_dealt_in_proportion(spark, monkeypatch):
    """Blocks of ever more components, and one component with a third of them, don't all meet: no root meets itself, near ones of other roots do meet."""
    monkeypatch.setattr(embed_dedup, "CENTRES", 16)
    dealt = {}
    for n in (500, 2000):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 24))
        near = x[: n // 10] / np.linalg.norm(x[: n // 10], axis=1)[:, None]
        near = near + rng.normal(size=near.shape) * 0.05  # about 14 degrees away, in another component
        hot = rng.normal(size=24) + rng.normal(size=(n // 2, 24)) * 0.01
        rows = np.concatenate((x, near, hot))
        root = [*range(n + n // 10), *[-1] * (n // 2)]
        balls = spark.createDataFrame([(i, r, v.astype("<f8").tobytes(), 0.05, 1) for i, (r, v) in enumerate(zip(root, rows))], "block long, root long, centre binary, wide double, copies long")
        cells = embed_dedup._deal_balls(balls).select("cell", "block", "root", "side").collect()
        dealt[n] = len(cells)
        held = collections.defaultdict(list)
        for c in cells:
            held[c["cell"]].append(c)
        met = set()
        for group in held.values():
            assert len(group) < 12 * 16 and not ({c["root"] for c in group if c["side"] == 1} & {c["root"] for c in group if c["side"] == 2} & {-1})
            for c in group:
                met.update((c["block"], o["block"]) for o in group if (c["side"], o["side"]) in ((0, 0), (1, 2), (2, 1)))
        assert sum((i, n + i) in met for i in range(n // 10)) >= 0.9 * (n // 10)
    assert dealt[2000] < 4 * 2.5 * dealt[500]  # all pairs would be 16 times as many


def test_embedding_many_groups_that_touch(spark, monkeypatch):
    """Many saturated groups in pairs whose lists hold only their own: found across buckets of codes."""
    monkeypatch.setattr(embed_dedup, "CENTRES", 8)
    rng = np.random.default_rng(12)
    a = rng.normal(size=(60, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(60, 32))
    b -= (b * a).sum(axis=1)[:, None] * a
    b = 0.94 * a + np.sqrt(1 - 0.94**2) * b / np.linalg.norm(b, axis=1)[:, None]
    x = np.array([c + rng.normal(size=32) * 0.002 for pair in zip(a, b) for c in pair for _ in range(24)], np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(df).orderBy("vec_id").collect()
    assert sum(r["n_links"] == 47 and r["component_id"] == r["vec_id"] // 48 * 48 for r in got) >= 0.95 * len(got)


def test_embedding_table_by_brute_force(spark, sf_dir):
    """All four columns on the given table."""
    frame = table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], None if r["embedding"] is None else list(r["embedding"])) for r in frame.collect()]
    got = collections.Counter(tuple(r) for r in QUERIES["op10_embedding_near_dedup"](spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == links_by_brute_force(rows)


def test_embedding_rare_links(spark, monkeypatch):
    """Few pairs among thousands of scattered vectors, too rare for the audit: builds go on until one finds no more, and find all."""
    monkeypatch.setattr(embed_dedup, "AUDIT_FIRST", 64)
    monkeypatch.setattr(embed_dedup, "AUDIT_MOST", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    x = np.concatenate((x, x[:6] + rng.normal(size=(6, 24)) * 0.3)).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    truth = (u @ u.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = np.array([r["n_links"] for r in embed_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    assert truth.sum() >= 8 and (got == truth).all()


def test_embedding_blocks_that_link_in_part(spark, monkeypatch):
    """A long component in small blocks: near blocks are added unseen, far ones passed over, the rest compared, and all counts are exact."""
    monkeypatch.setattr(embed_dedup, "WHOLE_BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "CENTRES", 8)
    rng = np.random.default_rng(6)
    turn = np.linspace(0, 2.5, 700)
    x = np.stack([np.cos(turn), np.sin(turn), *(rng.normal(size=(6, 700)) * 0.01)], axis=1)
    x = np.concatenate((x, x[:100])).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    truth = (u @ u.T >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(df).orderBy("vec_id").collect()
    assert [r["n_links"] for r in got] == truth.tolist() and {r["component_id"] for r in got} == {0}


def test_embedding_first_codes_do_not_thin_with_size():
    for n in (1_000, 51_000, 3_000_000, 10**9, 10**12):
        bits = embed_dedup.code_bits(n)
        same = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - same) ** embed_dedup.tables_for(bits) >= 0.5


def test_embedding_recall_audit(spark, monkeypatch):
    """100 pairs beside a large group: an audit without the pairs' links is low by node, and a low recall raises an error."""
    rng = np.random.default_rng(4)
    pair = rng.normal(size=(100, 32))
    x = np.concatenate((pair, pair + rng.normal(size=(100, 32)) * 0.01, rng.normal(size=32) + rng.normal(size=(1000, 32)) * 0.01))
    nodes = spark.createDataFrame([(i, r.astype("<f8").tobytes(), 1) for i, r in enumerate(x)], "id long, vec binary, copies long")
    missed = spark.createDataFrame([(i, 999) for i in range(200, 1200)], "id long, links long")
    assert 0.8 < embed_dedup._audit(nodes, missed, 1200) < 0.9
    monkeypatch.setattr(embed_dedup, "_audit", lambda *_: 0.85)
    monkeypatch.setattr(embed_dedup, "BUILDS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        embed_dedup.link_nodes(nodes)


# ---------------------------------------------------------------- queries and pipeline


def test_queries_and_oracles(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    for name, sql in ORACLE.items():
        got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        cell = lambda v: "" if pd.isna(v) else v if isinstance(v, str) else f"{float(v):.6f}"
        key = lambda f: sorted(tuple(map(cell, r)) for r in f[cols].itertuples(index=False))
        assert key(got) == key(want)


def test_pipeline(spark, sf_dir, edge_docs, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "substrings", "mix", "tokens"]
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    kept = cp.STAGES[0][1](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.judge(docs, model).where("kept").collect()}
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, docs.where("false"), sf_dir).columns == docs.columns, name
        assert stage(spark, edge_docs, sf_dir).columns == edge_docs.columns, name
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in kept.collect()}


def test_pipeline_stages_by_brute_force(spark, sf_dir):
    """Each stage on what the one before it kept, against plain Python on the same rows."""
    import corpus_pipeline as cp

    docs = table(spark, sf_dir, "documents").where("length(text) < 20000 or text is null")
    stage = dict(cp.STAGES)
    step = lambda name, df: [r.asDict() for r in stage[name](spark, df, sf_dir).collect()]
    frame = lambda rows: spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    judged = quality_by_brute_force(docs_of(docs), [(r["doc_id"], r["quality"]) for r in table(spark, sf_dir, "labels").collect()])
    rows = step("quality", docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for (i, _), (_, kept) in judged.items() if kept)

    before, rows = sorted(rows, key=lambda r: r["doc_id"]), step("near_duplicates", frame(rows))
    root = components_by_brute_force(np.array([fingerprint_by_brute_force(r["text"]) for r in before], np.uint64))
    assert sorted(r["doc_id"] for r in rows) == [before[i]["doc_id"] for i in sorted(set(root))]

    before, rows = rows, step("substrings", frame(rows))
    cut = removed_by_brute_force([(r["doc_id"], r["text"]) for r in before])
    digest = {i: sha for (i, _), (_, _, sha) in cut.items()}
    assert {r["doc_id"]: hashlib.sha256(b" ".join(split(r["text"]))).hexdigest() for r in rows} == digest and len(rows) == len(before)

    before, rows = rows, step("mix", frame(rows))
    assert [r["doc_id"] for r in rows] == mixed_by_brute_force([(r["doc_id"], r["source"], len(split(r["text"]))) for r in before])

    tok = bpe.load_tokenizer(bpe.vocabulary_path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(tuple(r.values()) for r in step("tokens", frame(rows))) == sorted(want)


def test_stages_keep_columns_that_clash_with_their_own(spark):
    """Input columns named like a stage's helpers come out as they went in."""
    import corpus_pipeline as cp

    names = ["_h", "_d", "_s", "_t", "_copies", "_copy", "_doc", "_tag", "_spans", "_th", "_key", "_slot", "_at", "_number", "keep_id", "factors", "llr", "m", "_w", "n", "sidx", "block"]
    words = lambda i: " ".join(f"w{(i * 31 + k * 7) % 97}" for k in range(60))
    rows = [(i, words(i % 5), f"s{i % 2}", *[f"{c}{i}" for c in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    for name, f in cp.STAGES[1:4]:
        out = f(spark, docs, "").collect()
        assert out and out[0].__fields__ == docs.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out for c in names), name
