"""The training-data operators against brute force, libraries, round trips and held-out labels, and on odd rows."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstone.llm import decontam, html, langid, lattice, media, mixing, quality, queries, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string"
ODD = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (3, "a b " * 30000, "en", "s", 1, None, None), (4, "same words here twice", "en", "s", 1, None, None), (4, "same words here twice", "en", "s", 1, None, None), (None, "no id at all", "de", None, 1, None, None), (7, "Ünïcode ☃ <|endoftext|> 日本", "de", "t", 1, None, None)]
VOCABULARY, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "words here"), (2, None), (None, "no id at all"), (3, "")], "item_id long, text string")


def test_token_counts_match_the_library():
    lib, c, r = Tokenizer.from_file(VOCABULARY), tokens.PrefixCounter(VOCABULARY), random.Random(1)
    n = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    pool = [" ", "  ", "\n", "a", "the", "'s", "'re", "'", "Hello", "!!!", "é", "ß", "日本", "12", "<|endoftext|>", "<|endof", "\x1c", "\x85", "🙂", "ing", "----"]
    for _ in range(300):
        s = "".join(r.choice(pool) for _ in range(r.randint(0, 9)))
        assert c.prefixes(s).tolist() == [n(s[:j]) for j in range(len(s) + 1)], s
        total, fit = c.count_and_fit(s, 3)
        assert total == n(s) and fit == max(j for j in range(len(s) + 1) if n(s[:j]) <= 3)


def test_token_query(docs, spark, sf, odd):
    lib = Tokenizer.from_file(VOCABULARY)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op1_token_counts(spark, sf).collect():
        assert r["n_tokens"] == len(lib.encode(text[r["doc_id"]], add_special_tokens=False).ids) and r["over_limit"] == (r["n_tokens"] > 512)
    table = tokens.prefix_table(odd.where("doc_id = 4"), VOCABULARY).select(tokens.truncate_to("counts", 2).alias("n")).first()
    assert table["n"] == len("same words")


def test_media_round_trip(docs, spark, sf):
    rng = np.random.default_rng(1)
    grey, rgb = rng.integers(0, 256, (37, 53), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for write, image in ((media.write_pgm, grey), (media.write_bmp, grey), (media.write_bmp, rgb), (media.write_ppm, rgb)):
        assert (media.decode(write(image)) == image).all()
    assert media.decode(b"P1 2 2 1 0 0 1").tolist() == [[0, 255], [255, 0]] and media.decode(b"P5 9 9") is None and media.decode(None) is None
    assert np.allclose(media.area_resize(np.arange(16.0).reshape(4, 4), 2, 2), [[2.5, 4.5], [10.5, 12.5]])
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in queries.op2_media_columns(spark, sf).collect():
        raw = text[r["doc_id"]]
        padded = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    for broken in (b"P5 0 0 255\n", b"P5 99999999999999999999 9 255\n", b"P2 1 1 255\n" + b"9" * 400, b"P2 2 1 100 100 255", b"P5 1 1 100\n\xff", b"P5 2 2 255\n\x00", b"P3 1 1 255 1 2", b"P6 1 1 255\n\x00", b"BM", media.write_bmp(grey)[:-1]):
        assert media.decode(broken) is None, broken[:30]
    for r in queries.op2_media_columns(spark, sf).collect():
        image, _ = media.payload_image(text[r["doc_id"]].decode())
        stored, side = media.write_pgm(image), 16
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        tile = np.load(io.BytesIO(r["tile"]))
        exact = np.repeat(np.repeat(image.astype(float), side, 0), side, 1).reshape(side, image.shape[0], side, image.shape[1]).mean((1, 3))
        assert np.abs(tile - exact).max() <= 0.5 + 1e-6 and r["feature"].split("-")[1:] == [f"64x{len(image)}", f"{zlib.crc32(r['tile']):08x}"]
    made = media.media_features(media.text_media(docs.limit(5), "bmp"), ["doc_id"])
    assert all(bytes(r["payload"]).rstrip(b"\0") == text[r["doc_id"]] and r["tile"][:6] == b"\x93NUMPY" for r in made.collect())


def test_main_text():
    page = "<html><head><title>t</title><script>x<p></script></head><body><nav><a href=/>Menu</a></nav><header>Top</header><div class='cookie-notice'>We use cookies.</div><article><h1>Head &amp; tail</h1><p>First,  long\nparagraph of the text, with marks.<p><b>Second</b> one.<!-- c --><div class=comments><p>I agree!</div></article><aside>More</aside><form>Mail</form><footer>&copy;</footer></body></html>"
    assert html.main_text(page) == "Head & tail\nFirst, long paragraph of the text, with marks.\nSecond one."
    plain = "<div id=menu><a href=1>Home</a> <a href=2>News</a></div><div><p>One long sentence, with many words in it.</p><p>Another long sentence, also with words.</p><p>Short.</p></div><div id=footer>All rights</div>"
    assert html.main_text(plain) == "One long sentence, with many words in it.\nAnother long sentence, also with words.\nShort."
    assert html.main_text("") == "" and html.main_text("<p>") == "" and html.main_text("<<< a < b") != None  # noqa: E711


def test_main_text_keeps_every_content_block():
    say = lambda n, word: " ".join(f"Sentence {k} of the {word}, which goes on for a while, has marks." for k in range(n))
    menu, foot = "<nav><a href=1>Home</a> <a href=2>News</a></nav>", "<footer>All rights reserved, every one.</footer>"
    p = lambda n, word: (f"<p>{say(n, word)}</p>", say(n, word))
    (a, ta), (b, tb), (c, tc) = p(6, "first"), p(5, "second"), p(40, "third")
    for body, want in {
        f"<article><h2>One</h2>{a}</article><article><h2>Two</h2>{b}</article>": ["One", ta, "Two", tb],
        f"<main><article>{a}</article><section><h2>More</h2><p>{tb[:190]}</p></section><section><p>{tb[:200]}</p></section></main>": [ta, "More", tb[:190], tb[:200]],
        f"<h1>Title</h1><p>{ta[:90]}</p><div class=body>{c}</div>": ["Title", ta[:90], tc],
        f"<h1>Title</h1><p>{ta[:90]}</p><div class=body>{a}</div>": ["Title", ta[:90], ta],
        f"<article>{a}<ul><li><a href=x>A source</a></li><li><a href=y>Another one</a></li></ul></article>": [ta, "A source", "Another one"],
    }.items():
        assert html.main_text(f"<html><body>{menu}{body}{foot}</body></html>").split("\n") == want, body[:60]


def test_scores_select_the_text(monkeypatch, spark):
    """Each path with another one's true score changes most pages; pages without any name of furniture change little."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()]
    whole, true, rng = [html.main_text(p) for p in pages], html.tag_path_scores, np.random.default_rng(4)

    def nameless(page):
        page = re.sub(r"<(/?)(nav|footer|aside|header|article|main|section|form|menu|button|dialog)\b", r"<\1div", page)
        return re.sub(r"(<\w+)\s+(?:class|id|role)=(\"[^\"]*\"|\S+?)(?=[\s>])", r"\1", page)

    assert sum(html.main_text(nameless(p)) != a for a, p in zip(whole, pages)) < 0.1 * len(pages)

    def moved(paths, texts):
        _, path = np.unique(paths, return_inverse=True)
        score = np.zeros(path.max() + 1)
        score[path] = true(paths, texts)
        order, out = rng.permutation(len(score)), score.copy()
        out[order] = score[np.roll(order, 1)]
        return out[path]

    monkeypatch.setattr(html, "tag_path_scores", moved)
    assert sum(html.main_text(p) != a for a, p in zip(whole, pages)) > 0.8 * len(pages)


def test_comments_without_a_known_name_go_where_they_hold_less():
    say = lambda n: " ".join(f"Sentence {k}, which goes on for a while, has marks." for k in range(n))
    post = "".join(f"<p>{say(4)}</p>" for _ in range(3))
    for name, count in (("discussion", 6), ("zone", 2)):
        page = f"<body><div class=post>{post}</div><div class={name}>" + "".join(f"<div class=c><p>{say(2)}</p></div>" for _ in range(count)) + "</div></body>"
        assert html.main_text(page) == "\n".join([say(4)] * 3)


def test_unended_raw_elements_take_linear_time():
    import time

    for tag in ("iframe", "xmp", "noembed", "textarea", "title"):
        began = time.time()
        html.main_text(f"<p>One, two.</p>{f'<{tag}>' * 60_000}")
        assert time.time() - began < 5


def test_tag_path_scores_by_plain_sums():
    r = random.Random(5)
    for _ in range(50):
        n = r.randint(1, 12)
        paths, texts = [r.randint(0, 4) for _ in range(n)], ["a, b. " * r.randint(1, 30) for _ in range(n)]
        of = lambda p, f: [f(t) for q, t in zip(paths, texts) if q == p]
        mean = lambda x: sum(x) / len(x)
        length, marks = [mean(of(p, len)) for p in paths], [mean(of(p, lambda t: sum(c in ".,;:!?" for c in t))) for p in paths]
        w = [np.exp(-0.5 * k * k) for k in range(-2, 3)]
        smooth = lambda x: [sum(g * x[min(n - 1, max(0, i + k - 2))] for k, g in enumerate(w)) / sum(w) for i in range(n)]
        a, b = smooth(length), smooth(marks)
        fused = [min(a[i] * (1 + b[i]), length[i] * (1 + marks[i])) ** 0.5 for i in range(n)]
        want = [mean([f for q, f in zip(paths, fused) if q == p]) * sum(of(p, len)) for p in paths]
        assert np.allclose(html.tag_path_scores(paths, texts), want)


def test_odd_pages():
    text = "Some text here, and more of it, indeed."
    for page in (
        "<script>for(i=0;i<n;i++){}</script><article><p>{}", "<script>if (a<b) x('<p>')</SCRIPT ><p>{}", "<script>if(a</b/.test(c)){}</script><p>{}", "<style>a<b{}</style><p>{}", "<head><title>t</title><p>{}", "<p title='it>{}</p>",
        "<textarea>a <b> c</textarea><p>{}</p>", "<!--><p>{}</p>", "<!-- <p>no</p> --!><p>{}", "<svg><text>no</text></svg><p>{}", "<select><option>no</select><p>{}", "<p data-class=nav title='class=menu'>{}",
    ):
        assert html.main_text(page.replace("{}", text)) == text, page
    assert html.main_text("<p>Let <math><mi>x</mi></math> be a number, which is so.") == "Let x be a number, which is so."
    a, b, c = (" ".join([f"Words of the {k} part, which go on."] * 6) for k in ("first", "second", "third"))
    assert html.main_text(f"<article><p>{a}<p class=notice-of-award>{b}<div class=legal>{c}</div><div class=comments><p>{a}</div></article>") == "\n".join([a, b, c])
    assert html.main_text("<div>" * 100_000 + text + "</div>" * 100_000) == text
    assert html.main_text("<b>" * 50_000 + text + "</i>" * 50_000) == text


def test_names_are_only_signs_of_furniture():
    say = lambda n, word: " ".join(f"Sentence {k} of the {word}, which goes on for a while, has marks." for k in range(n))
    menu, foot = "<nav><a href=1>Home</a> <a href=2>News</a></nav>", "<footer>All rights reserved, every one.</footer>"
    ta, tb = say(6, "first"), say(5, "second")
    a, b = f"<p>{ta}</p>", f"<p>{tb}</p>"
    for body, want in {
        f"<article>{a}<h2 id=legal-status>Status</h2>{b}<section id=social-effects><h2>Effects</h2>{a}</section></article>": [ta, "Status", tb, "Effects", ta],
        f"<div class=popular-science><h2>Science</h2>{a}</div>": ["Science", ta],
        f"<form>{a}{b}</form>": [ta, tb],
        f"<div class=top-box>Buy our fine things now.</div><article>{a}<div class=share-this>Share it</div></article>": [ta],
    }.items():
        assert html.main_text(f"<html><body>{menu}{body}{foot}</body></html>").split("\n") == want, body[:60]
    assert html.main_text(menu + foot) == "" and html.main_text(f"<div hidden>{a}</div>") == ""


def test_words_of_a_mix_are_those_of_the_pattern(spark):
    texts = ["lazy y z", "x20 x09 D x0D", " \t\n\x0b\x0c\r", "a\x1cb\x85c\xa0d\u3000e f", "𝒳 \x00 中", "lone", "", None]
    rows = [(k, t, ["b", "a", None][k % 3]) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t, _ in rows}
    assert {k: r["size"] for k, r in got.items()} == sizes
    assert all(r["source_size"] == sum(n for k, n in sizes.items() if rows[k][2] == r["source"]) for r in got.values())


def test_mix(spark, docs, odd):
    rows = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    capped, total = set(), sum(sizes.values())
    while True:
        share = (total - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        over = {s for s in sizes if s not in capped and share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        want = 3 * sizes[s] if s in capped else share * weight[s]
        assert abs(taken[s] - want) <= 1 and abs(next(r["target"] for r in rows if r["source"] == s) - want) < 1e-6 * want
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(odd.limit(0)).count() == 0


def auc(rows):
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_classifiers_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least in ((queries.op5_quality, "quality", 0.97), (queries.op6_toxicity, "toxic", 0.85)):
        rows = query(spark, sf).collect()
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
        assert auc([(r["score"], labels[r["doc_id"]][label]) for r in rows if r["held_out"] and r["doc_id"] in labels]) > least


def test_attention_gradients():
    m, r = quality.AttentionMIL(4, 3, 2), np.random.default_rng(0)
    x, starts, y = r.normal(size=(7, 4)), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean(y * np.log(o := m.forward(x, starts)[-1]) + (1 - y) * np.log(1 - o))
    for k, g in m.gradients(x, starts, y).items():
        for at in list(np.ndindex(m.p[k].shape))[:6]:
            m.p[k][at] += 1e-6
            up = loss()
            m.p[k][at] -= 2e-6
            assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5
            m.p[k][at] += 1e-6


def test_attention_finds_the_bad_passage():
    r = random.Random(7)
    good = lambda: " ".join(r.choice(["the", "sea", "and", "its", "calm", "weather", "of", "old"]) for _ in range(quality.PASSAGE))
    bad = lambda: " ".join(r.choice(["$$%", "&&&", "!!", "#a#", "%%"]) for _ in range(quality.PASSAGE))
    rows = []
    for _ in range(150):
        passages = [good() for _ in range(r.randint(3, 8))]
        rows.append((" ".join(passages), 1))
        passages[r.randrange(len(passages))] = bad()
        rows.append((" ".join(passages), 0))
    m = quality.AttentionMIL().fit(rows[:200])
    found = 0
    for text, y in rows[200:]:
        score, most, at = (x[0] for x in m.score([text]))
        assert (score >= 0.5) == bool(y)
        if not y:
            words = text.split(" ")
            n = len(words) / quality.PASSAGE
            found += "&&&" in words[at * quality.PASSAGE : (at + 1) * quality.PASSAGE] and most > 1.5 / n
    assert found >= 45  # of 50


def test_passages():
    assert [len(quality.encode([t])[0]) for t in ("", "a\nb " * 64, "\n".join("a" * 130), "x" * 200_000)] == [1, 3, 3, 4]
    texts = ["one two", "a b c " * 500, "", "é" * 5000]
    x, starts = quality.encode(texts)
    for k, t in enumerate(texts):
        assert np.allclose(quality.encode([t])[0], x[starts[k] : (list(starts) + [len(x)])[k + 1]])


def test_lexicon_automaton():
    def osa(a, b):
        d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
        for i in range(len(a)):
            for j in range(len(b)):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
                if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    terms, r = ["stupid", "idiot", "disgusting", "scum"], random.Random(2)
    lexicon = toxicity.Lexicon(terms, ["lowe", "vequa"])
    assert lexicon.match("loweall") == ("lowe*", 0) and lexicon.match("loewall") is None
    assert lexicon.match("vequall") == ("vequa*", 0) and lexicon.match("vequuall") == ("vequa*", 1) and lexicon.match("veuqall") == ("vequa*", 1)
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 2)] = r.choice(["x", "", "ab", w[at]])
            w = w or ["x"]
        w = "".join(w)
        fits = [(osa(w, t), t) for t in terms if osa(w, t) <= toxicity.edits_for(t)]
        assert lexicon.match(w) == ((min(fits)[1], min(fits)[0]) if fits else None), w


def test_each_part_of_toxicity_changes_predictions(monkeypatch):
    toxic = [f"you are an idiot {i}" for i in range(30)] + [f"such scum again {i}" for i in range(30)] + [f"all vequ{a}{b} here" for a in "abcdef" for b in "uvwxyz"]
    clean = [f"a fine day {i}, all here" for i in range(60)] + [f"such weather again, said the sea {i}" for i in range(60)]
    rows = [(t, 1) for t in toxic] + [(t, 0) for t in clean]
    m = toxicity.ToxicityModel(rows)
    assert m.terms == ["idiot", "scum"] and m.stems == ["vequ"]  # no accidental words
    flagged = lambda t: m.score(t)[0] >= 0.7
    quoted = ["she said: “idiot” is a word", 'the word "scum" has four letters']
    misspelt = ["you idoit", "an idiiot he is", "you sccum", "you scm"]
    assert all(map(flagged, ["what an idiot", "vequzz", *misspelt])) and not any(map(flagged, [*quoted, "", "the sum of it", "some clean words"]))
    assert all(flagged(t.replace("“", "").replace("”", "").replace('"', "").replace("said", "").replace("the word", "")) for t in quoted)  # quotation marks decide
    assert not flagged("a scm file") and flagged("you scm")  # who is addressed decides
    monkeypatch.setattr(toxicity, "edits_for", lambda term: 0)
    m = toxicity.ToxicityModel(rows)
    assert not any(map(flagged, misspelt)) and flagged("what an idiot")  # edits decide


def plain_language(text, profiles):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return "und", None
    line = " " + " ".join(words) + " "
    grams = Counter(c for c in line if c != " ") + Counter(line[i : i + 2] for i in range(len(line) - 1)) + Counter(g for i in range(len(line) - 2) if (g := line[i : i + 3])[1] != " ")
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    top = sorted((-n, code(g)) for g, n in grams.items())[: langid.TOP]
    far = {}
    for lang, profile in profiles.items():
        rank = {g: k for k, g in enumerate(profile)}
        far[lang] = sum(min(abs(rank[g] - k), langid.PROFILE) if g in rank else langid.PROFILE for k, (_, g) in enumerate(top))
    return min(far, key=lambda x: (far[x], x)), far


def test_language_by_plain_ranks_and_distances(docs):
    profiles = langid.fit_profiles(docs)
    ranks = {lang: [int(c) for _, c in sorted((k, c) for c, k in zip(profiles.codes, profiles.ranks[:, i]) if k >= 0)] for i, lang in enumerate(profiles.langs)}
    texts = [r["text"] or "" for r in docs.collect()] + ["", "12 !?", "呡" * 50, "a呡b שלום мир", "é" * 9]
    assert all(profiles.identify(t)[0] == plain_language(t, ranks)[0] for t in texts)
    train: dict = {}
    for r in docs.where("lang is not null").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            code, n = langid.ngrams(r["text"] or "")
            train.setdefault(r["lang"], Counter()).update(dict(zip(code.tolist(), n.tolist())))
    assert ranks == {lang: [c for _, c in sorted((-n, c) for c, n in count.items())[: langid.PROFILE]] for lang, count in train.items()}


def test_scripts_do_not_collide():
    code = lambda t: set(langid.ngrams(t)[0].tolist())
    for a, b in (("a", "呡"), ("ab", "呡呢"), ("ы", "K"), ("a", "𐑡")):
        assert not code(a) & code(b)
    assert langid.RankProfiles({"en": sorted(code("a"))}).identify("呡")[1] < 0.2


def test_language(spark, odd):
    rows = queries.op7_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert sum(held) / len(held) > 0.95
    found = {r["doc_id"]: r for r in langid.identify_language(odd, langid.fit_profiles(odd)).collect()}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == "und" and found[1]["score"] == 0.0


def test_fingerprint():
    for text in ("", "one", "Ä B c", "the cat sat on the mat the cat sat on the mat"):
        w = text.encode().lower().split()
        parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay_keys_meet():
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 23, 400)
    for flips in (1, 2):
        y = x.copy()
        for k in range(len(y)):
            for b in r.choice(23, flips, replace=False):
                y[k] ^= 1 << int(b)
        (own_x, kx), (own_y, ky) = simhash.golay_keys(x), simhash.golay_keys(y)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(kx, ky))
        if flips == 1:
            assert all(o in b for o, b in zip(own_x, ky))


def test_links_are_complete(spark):
    r = np.random.default_rng(2)
    base = r.integers(-(2**63), 2**63 - 1, 150)
    every = base.tolist()
    flip = lambda x, n: int(np.uint64(x & (2**64 - 1)) ^ np.uint64(sum(1 << int(b) for b in r.choice(64, n, replace=False))))
    signed = lambda u: u - (1 << 64) if u >> 63 else u
    for b in base.tolist():
        every.append(signed(flip(b, int(r.integers(1, 6)))))
    every += [signed(flip(int(base[0]), int(r.integers(1, 4)))) for _ in range(200)]  # one large group
    fps = sorted(set(every))
    a, parent = np.array(fps).view(np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4) + i + 1:
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    want = {f: fps[find(i)] for i, f in enumerate(fps)}
    got = {x["fp"]: x["root"] for x in simhash.link_components(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_near_duplicates_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["component_id"] == of[2]["component_id"] == 1 and of[1]["fingerprint"] == "0" * 16 and of[4]["component_id"] == 4
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


LOGP = {"▁": -1.0, "a": -1.2, "b": -1.5, "ab": -2.0, "▁a": -1.7}


def test_lattice_sums_all_segmentations():
    def brute(s):
        return 1.0 if not s else sum(np.exp(p) * brute(s[len(t) :]) for t, p in LOGP.items() if s.startswith(t))

    m = lattice.Lattice(LOGP)
    for w in ("a", "ab", "abab", "bb"):
        assert np.isclose(np.exp(m.word(w)), brute("▁" + w))
    assert np.isfinite(m.word("ab" * 500_000))  # memory grows with the length of a word only


def test_lm_scores_by_brute_force(docs, monkeypatch):
    logp = lattice.vocabulary(PIECES)
    assert np.isclose(sum(map(np.exp, logp.values())), 1)
    longest = max(map(len, logp))
    floor = min(logp.values()) - 5

    def marginal(w):  # backward, over plain probabilities scaled by their logs
        s = "▁" + w
        b = {len(s): 0.0}
        for i in reversed(range(len(s))):
            found = [logp[s[i:j]] + b[j] for j in range(i + 1, min(len(s), i + longest) + 1) if s[i:j] in logp]
            if s[i] not in logp:
                found.append(sum(logp.get(f"<0x{x:02X}>", floor) for x in s[i].encode()) + b[i + 1])
            b[i] = np.logaddexp.reduce(found)
        return b[0]

    few = docs.where("doc_id < 60")
    text = {r["doc_id"]: lattice.words_of(r["text"] or "") for r in few.collect()}
    train = Counter(w for i, ws in text.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    ends = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in text)
    n, v, end = sum(train.values()) + ends, len(train) + 1, np.log(1 / (1 + len(logp)))
    lp = {w: marginal(w) + np.log1p(-np.exp(end)) for w in {w for ws in text.values() for w in ws}}
    n1, n2, n3, n4 = (sum(c == k for c in train.values()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    off = lambda c: d[min(c, 3)]
    assert v > 100 and lattice.discounts(n1, n2, n3, n4) == tuple(d[1:]) and 0 < d[1] < d[3]
    given = sum(map(off, [*train.values(), ends])) / n
    p = lambda c, base: max(c - off(c), 0) / n + given * np.exp(base)
    read = lambda: {r["doc_id"]: r for r in lattice.lattice_scores(few, PIECES).collect()}
    whole = read()
    for i, r in whole.items():
        assert np.isclose(r["lattice_score"], (sum(lp[w] for w in text[i]) + end) / np.log(10), rtol=1e-9)
        assert np.isclose(r["score"], (sum(np.log(p(train[w], lp[w])) for w in text[i]) + np.log(p(ends, end))) / np.log(10), rtol=1e-9)
    for above in (3, 10**9):  # the bound of what is broadcast is no part of the model
        monkeypatch.setattr(lattice, "frequent_above", lambda counts: above)
        again = read()
        assert whole.keys() == again.keys() and all(np.isclose(whole[k]["score"], again[k]["score"], rtol=1e-9) for k in whole)


def test_discounts_of_odd_counts():
    for counts in ((0, 0, 0, 0), (5, 0, 0, 0), (3, 9, 40, 200), (100, 1, 0, 7), (0, 4, 4, 4)):
        assert all(0 < d < k for k, d in zip((1, 2, 3), lattice.discounts(*counts)))


def test_lm_base_score(docs, spark, sf):
    text = {r["doc_id"]: lattice.words_of(r["text"] or "") for r in docs.collect()}
    train = Counter(w for i, ws in text.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*ws, ("end",)])
    n, v = sum(train.values()), len(train)
    for r in queries.op9_lm_scores(spark, sf).collect():
        ws = [*text[r["doc_id"]], ("end",)]
        assert (r["n_tokens"], r["train_tokens"], r["n_known"]) == (len(ws), n, sum(train[w] > 0 for w in ws))
        assert np.isclose(r["base_score"], sum(np.log10((train[w] + 1) / (n + v + 1)) for w in ws)) and r["score"] < 0


def brute_leaks(texts, items, width=10):
    windows = {}
    for i, t in items:
        w = decontam.words_of(t)
        for a in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[a : a + width]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = decontam.words_of(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_fm_index_against_brute_force():
    r = random.Random(3)
    for k in range(150):
        items = [(str(i), " ".join(r.choice("abcde") for _ in range(r.randint(0, 14)))) for i in range(r.randint(0, 6))]
        texts = [" ".join(r.choice(["a", "b", "c", "d", *["zz"] * (k % 2)]) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
        if k % 5 == 0:
            texts.append("a " * 300)
            items.append(("99", "a " * 11))
        got = decontam.hits(texts, decontam.Phrases(items))
        assert [(n, sum(b - a for a, b in s), sorted(i)) for n, s, i in got] == brute_leaks(texts, items)


def test_leaks_in_blocks_and_removal(spark, odd, bench):
    digest = lambda df: sorted(map(str, decontam.leak_digest(df).collect()))
    whole = decontam.find_leaks(odd, bench)
    assert digest(whole) == digest(decontam.find_leaks(odd, bench, block_words=1))
    of = {r["doc_id"]: r for r in decontam.leak_digest(whole).collect()}
    assert (of[4]["n_hit"], of[4]["n_items"]) == (2, 1) and of[None]["n_hit"] == 4 and of[None]["n_items"] == 0 and of[1]["n_words"] == 0
    clean = {r["doc_id"]: r for r in decontam.remove_leaks(odd, bench).collect()}
    assert clean[4]["text"] == "same  twice" and clean[1]["text"] is None and clean[4]["source"] == "s"
    assert decontam.find_leaks(odd.limit(0), bench).count() == 0 and decontam.find_leaks(odd, bench.limit(0)).where("n_words = 4 and size(items) = 0").count() == 4
    clash = odd.withColumnsRenamed({"score": "n_words", "size": "spans", "source": "items"}).withColumn("row", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("__loom_text", F.lit(3))
    clean = decontam.remove_leaks(clash, bench)
    assert clean.columns == clash.columns and {(r["doc_id"], r["n_words"], r["text"]) for r in clean.collect() if r["doc_id"] == 4} == {(4, None, "same  twice")}
    assert decontam.remove_leaks(odd.select("text"), bench, block_words=1).count() == len(ODD)
    with pytest.raises(ValueError):
        decontam.find_leaks(clash, bench, keep=("doc_id", "n_words"))


@pytest.mark.parametrize("run", [lambda d: tokens.token_counts(d, VOCABULARY), media.media_digests, lambda d: html.extract_main_text(d, ("doc_id",), "text"), lambda d: quality.score_quality(d, quality.AttentionMIL()), lambda d: toxicity.score_toxicity(d, toxicity.ToxicityModel([])), lambda d: lattice.lattice_scores(d, PIECES)])
def test_odd_and_empty_tables(odd, run):
    assert run(odd).count() == len(ODD)
    assert run(odd.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_pipeline_by_brute_force(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = quality.fit_quality(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if model.score([r["text"] or ""])[0][0] >= P.QUALITY_FROM]
    kept = spark.createDataFrame([tuple(r[c] for c in P.COLUMNS) for r in rows], docs.schema)
    profiles = langid.fit_profiles(kept)
    rows = [r for r in rows if (f := profiles.identify(r["text"] or ""))[0] != "und" and f[1] >= P.LANGUAGE_FROM]
    fps = [simhash.fingerprint(r["text"] or "") for r in rows]
    root = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least: dict = {}
    for r, k in zip(rows, root):
        if k not in least or r["doc_id"] < least[k]["doc_id"]:
            least[k] = r
    rows = list(least.values())
    for r, (_, n_hit, _) in zip(rows, brute_leaks([r["text"] for r in rows], bench)):
        if n_hit:
            w, windows = decontam.words_of(r["text"]), set()
            for _, t in bench:
                b = decontam.words_of(t)
                windows |= {tuple(b[a : a + 10]) for a in range(max(1, len(b) - 9))} if b else set()
            hit = {q for n in {len(x) for x in windows} for a in range(len(w) - n + 1) if tuple(w[a : a + n]) in windows for q in range(a, a + n)}
            left = [x for q, x in enumerate(w) if q not in hit]
            r["words"] = left
    want = {r["doc_id"]: r.get("words") for r in rows}
    got = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, got, sf)
    found = got.collect()
    assert sorted(r["doc_id"] for r in found) == sorted(want)
    assert all(want[r["doc_id"]] is None or decontam.words_of(r["text"]) == want[r["doc_id"]] for r in found)
    keys = {r["doc_id"]: r["key"] for r in got.select("doc_id", mixing.exponential_key(mixing.text_quality("text"), "doc_id", "text").alias("key")).collect()}
    mixed = {r["doc_id"]: r for r in mixing.mix(got).collect()}
    for source in {r["source"] for r in mixed.values()}:
        mine = sorted((r for r in mixed.values() if r["source"] == source), key=lambda r: keys[r["doc_id"]])
        size, words = sum(r["size"] for r in mine), round(mine[0]["target"])
        epochs, rest = divmod(words, size) if size else (0, 0)
        for r in mine:
            assert r["taken"] == epochs * r["size"] + min(r["size"], rest)
            rest -= min(r["size"], rest)
    assert {r["doc_id"]: r["taken"] for r in P.run(spark, sf).collect()} == {k: r["taken"] for k, r in mixed.items() if r["taken"] > 0}


def test_dedup_stage_tells_rows_apart(spark, sf):
    import corpus_pipeline

    say = lambda seed: " ".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=60))
    a, b, c, d, e = map(say, range(5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, d), (4, d), (5, b), (None, e), (None, e), (None, a), (6, say(10)), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, docs, sf).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (None, e), (6, say(10)), (7, None)], key=str)
    clash = docs.withColumns({"fp": F.lit(1), "row": F.lit(2), "number": F.lit(3), "least": F.lit(4)})
    one = simhash.keep_one(clash)
    assert one.columns == clash.columns and one.count() == 7 and simhash.keep_one(clash.limit(0)).count() == 0
