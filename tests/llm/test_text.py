"""Text operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from conftest import SMALL
from sparkloom.llm import html as H
from sparkloom.llm import langid as L
from sparkloom.llm import licenses as R
from sparkloom.llm import quality as Q
from sparkloom.llm import tokens as T
from sparkloom.llm import urls as U
from sparkloom.llm.common import SharedTable, held_out
from sparkloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

TENTH = "/root/testdata/sf0.1"
ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "1234 !!"), (5, "The thin and that of the heing."), (5, "The thin and that of the heing."), (6, "word " * 60_000)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"lang": F.lit("en"), "score": F.lit("x"), "held_out": F.lit(3), "words": F.lit(1), "features": F.lit(2), "labels": F.lit(0)})


# --- tokens


def reference_digest(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_tokens_of_hostile_texts(tokenizer):
    rng, own = random.Random(1), T.ChunkEncoder(tokenizer_path())
    pieces = [" ", "\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", " ", "a", "b", "E", "É", "é", "́", "'s", "'", "<|endoftext|>", "<|startoftext|>", ".", ",", "1", "Σ", "ß", "İ", "中", "😀", "‍", "|", "<", "the", "̸", "=", "\x00", "יִ"]
    texts = [None, "", " ", *("".join(rng.choices(pieces, k=rng.choice([1, 3, 10, 40]))) for _ in range(1500))]
    texts += ["".join(rng.choices(pieces[8:], k=6000)) for _ in range(6)] + ["x" * 20_000, "ab" * 9000 + " c", "word " * 9000]
    assert [t for t in texts if own.digest(t) != reference_digest(tokenizer, t)] == []


def test_other_tokenizers_encode_whole_texts():
    """Any tokenizer file gives the library's ids; only one with known parts reuses chunks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, checked = Path(public_tokenizers.path("word_bpe_49k.json")).parent, 0
    texts = ["Hello  wide\nWorld. " * 200, "x", "", None, " a\tb ", "É é 中文 😀 " * 50]
    for path in sorted(folder.glob("*.json")):
        try:
            plain = Tokenizer.from_file(str(path))
        except Exception:  # noqa: BLE001, S112  not a tokenizer
            continue
        plain.no_truncation()
        plain.no_padding()
        own = T.ChunkEncoder(str(path))
        assert own.chunked == (path.name == "word_bpe_49k.json")
        assert [own.encode(t).tolist() for t in texts] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
        checked += 1
    assert checked


def test_a_join_that_disagrees_encodes_the_whole_text(tokenizer):
    text = " ".join(random.Random(5).choices([f"word{chr(97 + i)}s" for i in range(26)], k=6000))
    own = T.ChunkEncoder(tokenizer_path())
    assert own.chunked and None not in list(own.pieces(text.encode()))
    own.agrees = lambda *args: False
    assert None in list(own.pieces(text.encode()))
    assert own.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_shared_chunks_are_encoded_once():
    rng = random.Random(2)
    passage = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(6000))
    own = T.ChunkEncoder(tokenizer_path())
    own.encode(f"one beginning {passage}")
    own.encode(f"quite another, longer beginning {passage}")
    assert own.reused > 0.4 * own.seen


def test_chunks_follow_content():
    rng = random.Random(2)
    passage = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)).encode()
    chunks = lambda data: {data[a:b] for a, b in zip([0, *T.cuts(data)], T.cuts(data))}
    assert len(chunks(passage) & chunks(b"another beginning " + passage)) >= len(chunks(passage)) - 2


def test_token_query_and_round_trip(spark, odd, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: reference_digest(tokenizer, r["text"]) for r in docs.collect()}
    found = {r[0]: tuple(r)[1:] for r in T.token_digests(docs, tokenizer_path()).collect()}
    assert found == want
    assert sorted(map(repr, (tuple(r) for r in T.token_digests(odd, tokenizer_path()).collect()))) == sorted(repr((i, *reference_digest(tokenizer, t))) for i, t in ODD)
    encoded = T.encode_documents(docs, tokenizer_path())
    assert encoded.columns == [*docs.columns, "token_ids"]
    for r in encoded.limit(20).select("text", "token_ids", T.decode_column(encoded["token_ids"], tokenizer_path()).alias("back")).collect():
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["back"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert T.token_digests(docs.limit(0), tokenizer_path()).count() == 0


# --- quality


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    make = lambda n, good: np.where(rng.random((n, 1)) < good, rng.normal(1, 1, (n, Q.FEATURES)), rng.normal(-1, 1, (n, Q.FEATURES)))
    model = Q.train(make(1500, 1.0), make(1500, 0.7))
    assert abs(model.prior - 0.7) < 0.08
    assert model.score(make(500, 1.0)).mean() > 0.9 > 0.1 > model.score(make(500, 0.0)).mean()


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{TENTH}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in Q.quality_scores(docs, labels).where("held_out").collect()}
    pairs = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in found]
    assert all((r["score"] >= 0.7) == r["predicted"] and 0 <= r["score"] <= 1 for r, _ in pairs)
    assert np.mean([r["predicted"] for r, q in pairs if q == 1]) > 0.98
    assert np.mean([1 - r["predicted"] for r, q in pairs if q == 0]) > 0.93


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (None, 1), (2, None), (6, 1)], "doc_id long, quality int")
    assert Q.quality_scores(odd, labels).count() == len(ODD)
    assert Q.quality_scores(odd, labels.limit(0)).where("predicted = 1").count() == len(ODD)
    assert Q.quality_scores(odd.limit(0), labels).count() == 0
    assert Q.keep_good(odd, labels).columns == odd.columns
    assert np.allclose(Q.features("a b " * 10), Q.features("a b " * 10)) and Q.features(None).shape == (Q.FEATURES,)


def test_features_of_slices(monkeypatch):
    text = "Some words, more WORDS!! and | signs ### " * 40
    want = Q.features(text)
    monkeypatch.setattr(Q, "SLICE", 64)
    assert np.allclose(Q.features(text), want, atol=1e-6)


# --- languages


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{TENTH}/documents.parquet")
    found = L.language_scores(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.995
    assert np.mean([r["rejected"] for r in found]) < 0.01


def test_foreign_texts_and_noise_go(spark):
    docs = spark.read.parquet(f"{TENTH}/documents.parquet")
    rng = random.Random(5)
    strange = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar",
        *(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) for n in (20, 60, 200, 2000)),
    ]
    clean = [" ".join(r["text"].split()[5:20]) for r in docs.where(held_out(docs["doc_id"])).select("text").orderBy("doc_id").limit(600).collect()]
    for names in (["de", "en", "es", "fr"], ["en", "fr"]):
        model = L.fit(docs.where(docs["lang"].isin(names)))
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(strange)], "doc_id long, text string")
        assert L.language_scores(rows, model).where("not rejected").collect() == []
        if len(names) == 4:
            kept = L.language_scores(spark.createDataFrame(list(enumerate(clean)), "doc_id long, text string"), model).where("not rejected").count()
            assert kept > 0.97 * len(clean)


def test_languages_of_odd_rows(spark, odd):
    found = L.language_scores(odd).collect()
    assert len(found) == len(ODD)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (None, 1, 2, 3, 4)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in found)
    assert L.language_scores(odd.limit(0)).count() == 0
    assert L.keep_identified(odd).columns == odd.columns


def test_subwords_by_brute_force():
    def brute(text):
        out = np.zeros(L.BUCKETS, np.int64)
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            marked = [0, *map(ord, word), 0]
            for n in (1, 2, 3):
                for i in range(len(marked) - n + 1):
                    gram = marked[i : i + n]
                    if n == 1 and gram == [0]:
                        continue
                    h = 0
                    for k, c in enumerate(gram, 1):
                        h = (h * 0x01000193 + c + k) & 0xFFFFFFFF
                    out[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 19] += 1
        return out

    for text in ("", "a", "Hello  wörld, x9y", "été"):
        assert (L.subwords(text) == brute(text)).all()


# --- pages


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/x'>Menu</a></nav><div class='cookie-notice'>Cookies</div><%s><h1>Head</h1><p>One &amp; <b>t</b>wo<p>Three<script>var x='</p>';</script><div class='comments'><p>Nice</p></div></%s><footer>&copy; F</footer></body></html>"


def test_extraction():
    assert H.main_text(PAGE % ("article", "article")) == "Head One & two Three"
    assert H.main_text(PAGE % ("div class='post-content'", "div")) == "Head One & two Three"
    assert H.main_text("<body class='post menu-open'><div class='layout-sidebar'><div id=content><div>Teaser</div><article><p>A</p></article><aside>x</aside></div></div>") == "A"
    assert H.main_text("<div class=content-wrapper><form>f</form><main><p>B</p><section id=comments><article>c</article></section></main></div>") == "B"
    assert H.main_text(None) == H.main_text("") == H.main_text("<p></p>") == ""
    assert H.main_text("plain   text") == "plain text"
    assert H.main_text("<article>a<p>b<br>c</p><!-- x --><img alt='y'>d &lt;e&gt; &am</article>") == "a b c d <e> &am"
    assert H.main_text("<article><p title='a>b'>x<article><p>" * 300)


def test_templates_leave_the_slots(spark):
    page = "<html><body><div><p>Always here</p><p>Site name</p></div><div><p>Text %d of its own</p></div><div><span>End</span></div></body></html>"
    rows = [(i, "http://h.example/%d" % i, page % i) for i in range(6)] + [(9, None, None), (10, "no scheme", ""), (11, "http://one.example/", "<p>Alone</p>"), (11, "http://one.example/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    found = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in H.extract_pages(df.withColumns({"host": F.lit(1), "tokens": F.lit(2), "n": F.lit(3)})).collect()}
    want = {(i, f"http://h.example/{i}", f"Text {i} of its own") for i in range(6)} | {(9, None, ""), (10, "no scheme", ""), (11, "http://one.example/", "Alone"), (11, "http://one.example/", "")}
    assert found == {(*w, len(w[2])) for w in want}
    assert H.extract_pages(df.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/%s" % i, page) for i, page in pages], "page_id long, url string, html string")
    return [r["text"] for r in H.extract_pages(df).orderBy("page_id").collect()]


def test_templates_decide_within_articles(spark):
    page = "<html><body><nav>Menu</nav><article><h1>Head %d</h1><div class=promise><p>We value your trust</p></div><p>Text %d of its own</p><p>Written by staff</p></article></body></html>"
    assert extracted(spark, [(i, page % (i, i)) for i in range(5)]) == [f"Head {i} Text {i} of its own" for i in range(5)]
    assert extracted(spark, [(1, page % (1, 1))] * 2) == ["Head 1 We value your trust Text 1 of its own Written by staff"] * 2
    assert extracted(spark, [(i, page % (7, 7)) for i in range(2)]) == ["Head 7 We value your trust Text 7 of its own Written by staff"] * 2


WRAPS = {"article": ("<nav>Menu</nav><article><h1>Head</h1>", "</article><footer>End of it</footer>"), "div": ("<div><p>Site</p></div><div><h1>Head</h1>", "</div><div><p>End</p></div>"), "plain": ("", "")}


@pytest.mark.parametrize("wrap", list(WRAPS))
@pytest.mark.parametrize("pages", [2, 3, 8])
def test_near_copies_keep_their_text(spark, wrap, pages):
    before, after = WRAPS[wrap]
    shared = [f"Paragraph number {k} that all the copies have" for k in range(7)]
    rows = [(i, before + "".join(f"<p>{t}</p>" for t in [*shared[:4], f"Wording {i} is here", *shared[4:]]) + after) for i in range(pages)]
    for i, text in enumerate(extracted(spark, rows)):
        assert " ".join([*shared[:4], f"Wording {i} is here", *shared[4:]]) in text and "Menu" not in text


@pytest.mark.parametrize("wrap", ["article", "div"])
def test_refrains_stay(spark, wrap):
    before, after = WRAPS[wrap]
    verse = "<p>Verse one of song %d, which is its own</p><p>And so we sing</p><p>Verse two of song %d, its own too</p><p>And so we sing</p>"
    for i, text in enumerate(extracted(spark, [(i, before + verse % (i, i) + after) for i in range(4)])):
        assert f"Verse one of song {i}, which is its own And so we sing Verse two of song {i}, its own too And so we sing" in text


def test_frames_of_two_pages_go(spark):
    page = "<body><div><p>Site name</p><ul><li>News</li></ul></div><div><h1>Head of %d</h1><p>A text of its own, number %d, long enough</p></div><div><p>All rights reserved</p></div></body>"
    assert extracted(spark, [(i, page % (i, i)) for i in range(2)]) == [f"Head of {i} A text of its own, number {i}, long enough" for i in range(2)]


def test_classes_by_brute_force(spark):
    import random

    rng = random.Random(4)
    frame = ["<div class=top><p>Site</p></div>", "<div><p>More</p></div>", "<ul><li>One</li><li>One</li></ul>", "<div class=end><p>End</p></div>"]
    pages = ["".join(f for f in frame if rng.random() < 0.9) + "".join(f"<p>{rng.choice('abcdef')}</p>" for _ in range(rng.randint(0, 4))) for _ in range(12)]
    df = spark.createDataFrame([(i, "http://h.example/%d" % i, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    (row,) = H.host_templates(df).collect()
    counts = [Counter(H.token(x) for x in H.parse(p)) for p in dict.fromkeys(pages)]
    vectors = {t: tuple(c[t] for c in counts) for t in set().union(*counts)}
    frequent = {t: v for t, v in vectors.items() if sum(x > 0 for x in v) >= max(2, H.SUPPORT * len(counts))}
    assert {t["token"] for t in row["tokens"]} == set(frequent)
    assert {t["token"] for t in row["tokens"] if t["many"]} == {t for t, v in frequent.items() if sum(x > 0 for x in v) >= max(H.MANY, H.NEARLY_ALL * len(counts))}
    classes = {t["token"]: t["class"] for t in row["tokens"]}
    assert all((classes[a] == classes[b]) == (frequent[a] == frequent[b]) for a in frequent for b in frequent)


def test_repeated_pages_keep_their_template(spark):
    page = "<html><body><div><p>Always here</p><p>Site name</p></div><div><p>Text %d of its own</p></div></body></html>"
    assert extracted(spark, [(i // 2, page % (i // 2)) for i in range(8)]) == [f"Text {i // 2} of its own" for i in range(8)]


@pytest.mark.parametrize("pages", [1, 4])
def test_teasers_do_not_replace_the_body(spark, pages):
    page = "<html><body><main><h1>Head %d</h1><p>This body %d is much longer than any of the teasers on the page</p></main><div><article class=card>Tease %d</article><article class=card>More %d</article></div></body></html>"
    assert extracted(spark, [(i, page % ((i,) * 4)) for i in range(pages)]) == [f"Head {i} This body {i} is much longer than any of the teasers on the page" for i in range(pages)]


def test_classes_nest():
    a, b, c = [1, 2, 3], [10, 11], [20, 21]
    classes = {t: 100 for t in a} | {t: 200 for t in b} | {t: 300 for t in c}
    good, slots = H.nested_template([1, 10, 0, 11, 10, 0, 11, 2, 0, 3], classes)
    assert good == {*a, *b} and slots[2] == slots[5] == (200, 1) and slots[8] == (100, 2)
    assert H.nested_template([1, 10, 2, 11, 3], classes)[0] == set(a)  # overlap
    assert H.nested_template([1, 10, 11, 2, 10, 11, 3], classes)[0] == set(a)  # two slots


def test_pages_of_the_small_table(spark):
    import html

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = {r["page_id"]: r["text"] for r in H.extract_pages(pages).collect()}
    for r in pages.collect():
        inner = r["html"].partition("<article>")[2].partition("</article>")[0]
        assert found[r["page_id"]] == " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", inner))).split())


# --- URLs


def test_url_parts():
    cases = {None: ("", ""), "": ("", ""), "x/y": ("", ""), "http://A.Org": ("a.org", ""), "http://a.org/B?c": ("a.org", "/B"), "http://a?x=://b/": ("a", ""), "://h/p#q": ("h", "/p"), "a://É.org/é": ("É.org", "/é")}
    assert {u: U.split_url(u) for u in cases} == cases


def test_rules_and_terms():
    judge = U.UrlJudge(U.RULES, U.STRICT, U.SOFT, U.SOFT_WEIGHT)
    verdict = lambda u: judge.judge(u)[2:4]
    assert verdict("http://example.org/es/1") == ("example.org/es/", "block")
    assert verdict("http://www.example.org/en/12") == ("example.org/en/1", "block")
    assert verdict("http://notexample.org/es/1") == ("org/", "allow")
    assert verdict("http://x.com/fr/casino") == ("com/fr/", "allow")
    assert verdict("http://x.org") == (None, "allow")
    assert verdict("http://casino-win.net/a") == (None, "block")
    assert verdict("http://casinos.net/a") == (None, "allow")
    assert verdict("http://free.net/free") == (None, "allow")
    assert verdict("http://FREE.net/bets") == (None, "block")
    assert verdict(None) == (None, "allow")


def test_url_vocabulary_from_a_table_and_odd_tables(spark):
    from pyspark.sql import functions as F

    strict, soft = U.vocabulary_of(spark.createDataFrame([("Bad", None), ("bad", 1.0), ("so", 1.0), ("so", 2.0), ("", 1.0), (None, 1.0)], "term string, weight double"))
    assert strict == ("bad",) and soft == {"so": 2.0}
    with pytest.raises(ValueError):
        U.vocabulary_of(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "term string, weight double"), most=1)
    pages = spark.createDataFrame([(1, "http://x.net/bad"), (1, "http://x.net/bad"), (2, "http://x.net/so-it-is"), (None, None), (3, "no scheme"), (4, "http://x.net/" + "sobad" * 50_000)], "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2), "rule": F.lit("x")})
    found = sorted(((r["page_id"], r["verdict"]) for r in U.judge_urls(pages, strict=strict, soft=soft).collect()), key=repr)
    assert found == sorted([(1, "block"), (1, "block"), (2, "block"), (None, "allow"), (3, "allow"), (4, "allow")], key=repr)
    assert U.judge_urls(pages.limit(0)).count() == 0


def test_url_sql(spark, duck, same):
    same(QUERIES["op4_url_vocabulary"](spark, SMALL), duck.sql(ORACLE_SQL["op4_url_vocabulary"]))


# --- licenses


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in R.BASE.items()}
    line, found = " " + " ".join(words) + " ", []
    for rank, r in enumerate(R.rules()):
        if f" {r.keyword} " in line:
            found += [(m.start(), -m.end(), r.priority, rank, r.label, r.confidence) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line)]
    found.sort()
    kept = [d for k, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:k])]
    every = [i for p in places.values() for i in p]
    base = sorted(label for label, p in places.items() if p)
    score = 1.0 if base else max((d[5] for d in kept), default=0.0)
    return len(words), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(sorted({*base, *(d[4] for d in kept)})), score


def test_rules_match_their_keywords():
    assert 200 <= len(R.rules())
    assert all(r.keyword == r.keyword.strip() and r.priority in (1, 2, 3) for r in R.rules())


def shortest(pattern):
    """Every text a rule's pattern can match, its repeats at their least: the pattern's tree, branch by branch."""
    def texts(tree):
        out = [""]
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                more = [chr(arg)]
            elif op == "IN":
                more = ["7" if any(str(a) == "CATEGORY_DIGIT" for _, a in arg) else "q" if any(str(k) == "CATEGORY" for k, _ in arg) else chr(arg[0][1])]
            elif op == "SUBPATTERN":
                more = texts(arg[3])
            elif op == "BRANCH":
                more = [t for branch in arg[1] for t in texts(branch)]
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                more = [t * arg[0] for t in texts(arg[2])] if arg[0] else [""]
            else:
                raise ValueError(op)
            out = sorted({a + b for a in out for b in more})
        return out

    return texts(re._parser.parse(pattern))


def test_shortest_matches_hold_their_keywords():
    wrong = []
    for r in R.rules():
        for t in shortest(r.pattern):
            assert re.fullmatch(r.pattern, t)
            if f" {r.keyword} " not in f" {t} ":
                wrong.append((r.label, r.keyword, t))
    assert wrong == []


def test_freebsd_and_simplified_licenses(spark):
    rows = [(1, "FreeBSD License"), (2, "the Simplified License."), (3, "Simplified BSD License"), (4, "FreeBSD BSD license")]
    found = R.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found if "bsd-2-clause" in r["labels"].split(",")} == {1, 2, 3, 4}


def test_license_scan(spark, odd):
    phrases = ["Licensed under CC BY-NC 4.0.", "cc by", "CC,by cc by", "This work is licensed under the GNU General Public License, version 3 or any later version", "all rights reserved", "All rights are reserved", "Apache License, Version 2.0", "MIT License", "GPLv2", "(c) Copyright 2020, 2021", "creative commons attribution share alike 3.0 unported", "public domain", "é", "İcc by", "words", "no part of this work may be", "3-clause BSD license", "mozilla public license 2.0", "permission is hereby granted free of charge"]
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "; "]).join(rng.choices(phrases, k=rng.randint(0, 8)))) for i in range(250)] + [(1000 + i, p) for i, p in enumerate(phrases)] + [(2000, "cc by " * 3000)]
    found = {r[0]: tuple(r)[1:] for r in R.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert found[i] == brute_scan(text), text[:200]
    assert sorted(repr(tuple(r)) for r in R.license_scan(odd).collect()) == sorted(repr((i, *brute_scan(t))) for i, t in ODD)
    assert R.license_scan(odd.limit(0)).count() == 0


def test_license_scan_stays_native(spark, odd):
    plan = R.license_scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- pipeline


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = SharedTable(stage(spark, seen, SMALL), "stage").df
        assert kept.columns == docs.columns, name
        assert set(map(tuple, kept.collect())) <= set(map(tuple, seen.collect())), name
        assert kept.count() == seen.count() if name == "mixing" else kept.count() > 0.5 * seen.count(), name
        seen = kept
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() <= docs.count() and out.columns == [*docs.columns, "token_ids"]
    assert out.select("doc_id").distinct().count() == out.count()


def test_last_stage_restores_the_order(spark, tmp_path):
    """Whatever files the mixed documents were in, the encoded ones come in the order of the schedule."""
    import corpus_pipeline
    from sparkloom.llm import mixing as M

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").dropDuplicates(["doc_id"])
    docs.repartition(7, "text").write.parquet(str(tmp_path / "mixed"))
    found, (_, slot, place) = M.schedule(docs)
    want = [r["doc_id"] for r in found.orderBy(slot, place).select("doc_id").collect()]
    out = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / "mixed")), SMALL)
    rows = out.select("doc_id", "source").collect()
    assert [r["doc_id"] for r in rows] == want
    sizes = {s: sum(r["source"] == s for r in rows) for s in {r["source"] for r in rows}}
    counts = spark.createDataFrame([(f"s:{s}" if s is not None else "null", n) for s, n in sizes.items()], "key string, count long")
    weights = {r["key"]: r["weight"] for r in M.source_weights(counts, None, M.BLOCK).collect()}
    blocks = {s: -(-n // M.BLOCK) for s, n in sizes.items()}
    own = {s: min(weights[f"s:{s}" if s is not None else "null"], blocks[s]) for s in sizes}
    times, period = min(blocks[s] // own[s] for s in sizes), sum(own.values())
    starts = [r for i, r in enumerate(found.select("source", slot).distinct().orderBy(slot).collect()) if i < times * period]
    done = dict.fromkeys(own, 0)
    for t, r in enumerate(starts, 1):
        done[r["source"]] += 1
        assert all(abs(done[s] * period - own[s] * t) < period for s in own)


def test_held_out_rows(spark):
    import zlib

    from pyspark.sql import functions as F

    rows = spark.range(100).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
