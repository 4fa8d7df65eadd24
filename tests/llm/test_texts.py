import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import fingerprints, html, jaccard, langid, licenses, queries, shingles, toxicity
from lamella.llm.common import held_out

SF = "/root/testdata/sf0.01"


# -- n-gram Jaccard join ---------------------------------------------------------------------------


def word_sets(rows, width):
    out = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    return out


def brute_classes(rows, width, num, den):
    sets = word_sets(rows, width)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and den * both >= num * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, odd_docs, width, num):
    import random

    r = random.Random(width)
    rows, doc_id = [], 100
    for _ in range(25):  # families of edited copies around the threshold, and many small sets
        base = [f"w{r.randint(0, 9999)}" for _ in range(r.choice([2, 5, 7, 12, 40, 90, 200]))]
        for _ in range(r.randint(1, 9)):
            words = [w if r.random() > 0.02 else f"x{r.randint(0, 99)}" for w in base]
            rows.append((doc_id, " ".join(words[r.choice([0, 0, 1]) :]), None, None, None, None, None, None, None))
            doc_id += 1
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    got = jaccard.jaccard_classes(docs, width, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_classes(docs.collect(), width, num, 100)


def test_jaccard_of_sets_that_only_rows_without_id_hold(spark):
    """A null-id set leads all lists that two others share; joins two that aren't linked; has copies; has no partner with an id."""
    import random

    def sid(text):
        return shingles.set_id(next(shingles.shingle_sets([text], 5)))

    r, rows = random.Random(3), []
    while len(rows) < 9:
        base = " ".join(f"w{r.randint(0, 9999)}" for _ in range(60))
        if sid(base) < min(sid(base + " x"), sid(base + " y")):
            rows += [(None, base), (100 + len(rows), base + " x"), (100 + len(rows), base + " y")]
    base = [f"v{i}" for i in range(64)]
    rows += [(50, " ".join(base[9:])), (51, " ".join(base[:-9])), *[(None, " ".join(base))] * 3]
    rows += [(None, " ".join(f"u{i}" for i in range(n))) for n in (40, 41, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(docs.collect(), 5, 80, 100)
    assert want[51, 51, 50] == 1 and want[None, 60, 50] == 3
    got = jaccard.jaccard_classes(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    found = jaccard.jaccard_classes(named).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_classes(named.collect(), 5, 80, 100)


def test_jaccard_of_nothing_and_keep_one(odd_docs, no_docs):
    assert jaccard.jaccard_classes(no_docs).count() == 0
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 7, 7, None, 9, 10])


def test_linked_pairs_have_more_lists_in_common_than_they_skip():
    r = np.random.default_rng(1)
    for num in (80, 85):
        for _ in range(600):
            n = int(r.integers(1, 300))
            a = np.unique(r.integers(0, 1 << 63, n, np.uint64))
            drop, add = (int(r.integers(0, max(1, len(a) // 8) + 1)) for _ in range(2))
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 1 << 63, add, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= num * (len(a) + len(b) - both):
                (keys, skips), (others, other_skips) = jaccard.block_keys(a, num, 100), jaccard.block_keys(b, num, 100)
                held: dict[int, int] = {}
                for k, s in zip([*keys.tolist(), *others.tolist()], [*skips.tolist(), *other_skips.tolist()], strict=True):
                    held[k % jaccard.SCHEMES] = max(s, held.get(k % jaccard.SCHEMES, 0))
                common = Counter(k % jaccard.SCHEMES for k in np.intersect1d(keys, others).tolist())
                assert any(common[scheme] > most for scheme, most in held.items())


def test_shingle_sets_count_distinct_runs():
    texts = ["", "one", "one two three four five", "a b a b a b a b", "A\x0bB c\x1cd  e", "é É é É é É é É"]
    found = list(shingles.shingle_sets(texts, 4))

    class Row:
        def __init__(self, text):
            self.text = text

    assert [len(s) for s in found] == [len(s) for s in word_sets([Row(t) for t in texts], 4)]


# -- html --------------------------------------------------------------------------------------------


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    from html import unescape

    parts = re.split(r"</?(?:p|h1)>", inside.replace("<br>", " "))
    texts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", p))).strip() for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages_equal_their_articles(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.QUERIES["op4_html_text"](spark, SF).collect()
    assert len(got) == len(pages)
    wrong = [r.page_id for r in got if r.text != article(pages[r.page_id]) or r.n_chars != len(r.text)]
    assert not wrong


def test_field_on_unseen_labelled_pages():
    model, right, total = html.trained(), 0, 0
    for seed in range(9_000_000, 9_000_150):
        page, labels = html.labelled_page(seed)
        got = model.decode(html.features(html.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_hostile_pages_take_linear_time():
    import time

    for page in ("<a " * 350_000, '<p "' * 250_000, "<p '" * 250_000, "<div><p>x" * 60_000, "<div>" * 150_000 + "x", "<li>x" * 150_000, "<!--" * 250_000, "<script>" * 120_000, "</div>" * 150_000, "&" * 1_000_000):
        at = time.perf_counter()
        blocks = html.leaf_blocks(page)
        html.features(blocks)
        assert time.perf_counter() - at < 4, (page[:20], time.perf_counter() - at)


def test_viterbi_is_the_best_labelling():
    from itertools import product

    model = html.Crf({"a": 0.7, "b": -1.1, "c": 0.2}, ((0.5, -0.3), (-0.9, 0.6)), 0.1)
    for rows in ([["a"]], [["a"], ["b"], ["c", "a"]], [["b"], ["b"], ["a", "c"], ["b"], ["a"]]):
        def worth(ys, rows=rows):
            out = model.start * ys[0]
            for i, y in enumerate(ys):
                out += sum(model.weights[f] for f in rows[i]) * y + (model.pairs[ys[i - 1]][y] if i else 0)
            return out

        assert worth(model.decode(rows)) == max(worth(ys) for ys in product((0, 1), repeat=len(rows)))


def test_odd_pages(spark):
    rows = [
        (1, "u", None, "x"), (2, None, "", "x"), (None, "u", "plain text", "x"), (4, "u", "<p>a &amp b &am <b>c</b>\n d<!-- <p>no</p> --><script>if (a < b) '</p>'</script>", "x"),
        (5, "u", "<article><p>One sentence here, long enough to be read.<p>Another one &copy; two.", "x"), (5, "u", "<" * 500 + "<script>never closed <p>x", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages, html.trained()).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [b.text for b in html.leaf_blocks(rows[3][2])] == ["a & b &am c d"]
    assert [r.text for r in got if r.page_id == 5][0].startswith("One sentence here")
    assert html.extract(pages.limit(0), html.trained()).count() == 0


# -- fingerprints --------------------------------------------------------------------------------------


def brute_winnow(text, k, window):
    h = fingerprints.kgram_hashes(np.array([ord(c) for c in text], np.uint32), k).tolist()
    w, found = min(window, len(h)), []
    for i in range(len(h) - w + 1 if h else 0):
        least = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == least)
        if not found or found[-1] != (least, at):
            found.append((least, at))
    return found


def test_winnowing_equals_brute_force():
    for text in ["", "a", "short", "aaaaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog " * 9, "🙂é" * 60]:
        for k, window in ((1, 1), (5, 4), (8, 16)):
            h, p = fingerprints.winnow(np.array([ord(c) for c in text], np.uint32), k, window)
            assert list(zip(h.tolist(), p.tolist(), strict=True)) == brute_winnow(text, k, window)


def test_common_runs_leave_common_hashes():
    run = "a shared passage of sufficient length to be found again"
    a, b = (np.array([ord(c) for c in t], np.uint32) for t in ("xx yy zz " * 7 + run + " end", "another " * 3 + run + " different tail"))
    assert np.intersect1d(fingerprints.winnow(a, 8, 16)[0], fingerprints.winnow(b, 8, 16)[0]).size


def spelt(text, k, window):
    return " ".join(f"{h:08x}@{p}" for h, p in brute_winnow(text, k, window))


def brute_likeness(a, b):
    a, b = ({e.split("@")[0] for e in s.split()} for s in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_hashes_depend_on_the_run_alone():
    points = np.array([ord(c) for c in "abcdefgh" * 5 + "é🙂xyz" + "abcdefgh" * 5], np.uint32)
    h = fingerprints.kgram_hashes(points, 6)
    want = [int(fingerprints.kgram_hashes(points[i : i + 6], 6)[0]) for i in range(len(points) - 5)]
    assert h.tolist() == want and len(set(want)) == len({tuple(points[i : i + 6]) for i in range(len(points) - 5)})


def test_edit_check_equals_brute_force(spark, odd_docs, no_docs):
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = fingerprints.edit_check(odd_docs, 5, 4).collect()
    want = Counter()
    for i, (doc_id, text) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, following = (spelt(t, 5, 4) for t in (text, edited, after))
        near = (round(brute_likeness(own, changed), 9), round(brute_likeness(own, following), 9))
        want[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, *near] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edit_check(no_docs, 5, 4).count() == 0 and fingerprints.fingerprints(no_docs).count() == 0
    one = odd_docs.where("doc_id = 1")
    assert fingerprints.edit_check(one, 5, 4).count() == 1
    assert fingerprints.fingerprints(odd_docs).count() == len(rows)


# -- licenses --------------------------------------------------------------------------------------------


def brute_licenses(text, least=0.8, width=5):
    words, out = re.findall("[a-z0-9]+", text.lower()), {}
    for name, template in licenses.TEMPLATES.items():
        t = re.findall("[a-z0-9]+", template.lower())
        k = min(width, len(t))
        want = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
        for s in range(max(1, len(words) - len(t) + 1)):
            window = words[max(0, s - len(t)) : s + 2 * len(t)]
            share = len(want & {tuple(window[i : i + k]) for i in range(len(window) - k + 1)}) / len(want)
            if share >= least:
                out[name] = max(out.get(name, 0), share)
    return out


def test_license_scan_equals_brute_force(spark, odd_docs, no_docs):
    notices = list(licenses.TEMPLATES.values())
    edited = notices[12].split()
    rows = [(i, f"Words before {n.upper() if i % 3 == 0 else n} and words after", None, None, None, None, None, None, None) for i, n in enumerate(notices)]
    rows += [(100, " ".join(edited[:1] + edited[2:]), *[None] * 7), (101, "licensed reserved released warranty", *[None] * 7), (102, "Released\nunder the\tMIT-License", *[None] * 7), (102, "none here", *[None] * 7)]
    words = notices[8].split()
    rows += [(103, " ".join([*words[:14], "so", "called", *words[14:]]), *[None] * 7), (104, f"{notices[12][:400]} some words of ours {notices[12][400:]}", *[None] * 7)]
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    got = {(r.doc_id, r.license): round(r.containment, 9) for r in licenses.scan(docs).collect()}
    want = {(r.doc_id, n): round(s, 9) for r in docs.collect() for n, s in brute_licenses(r.text or "").items()}
    assert got == want and licenses.scan(no_docs).count() == 0
    assert (103, "gpl-notice") in got and (104, "mit-text") in got


def test_words_that_licenses_use_cost_little(spark):
    """A long text full of anchor words, and a license in it, within seconds."""
    rnd = np.random.default_rng(1)
    pool = [*licenses.anchors(licenses.TEMPLATES, 5, 0.8), "of", "the", "and", "to"]
    long = " ".join(rnd.choice(pool, 16_000))
    schema = "doc_id long, text string"
    licenses.scan(spark.createDataFrame([(0, "MIT License")], schema)).count()
    began = time.time()
    got = licenses.scan(spark.createDataFrame([(1, f"{long} {licenses.TEMPLATES['mit-text']} {long}"), (2, long)], schema)).collect()
    assert time.time() - began < 15
    assert {(r.doc_id, r.license) for r in got} >= {(1, "mit-text"), (1, "mit-grant")} and all(r.containment == 1.0 and 15_800 < r.start_word <= 16_000 for r in got if r.license == "mit-text")


# -- toxicity ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    return toxicity.learn(docs.where(~held_out("doc_id", 5, 0)), labels)


def test_toxicity_learns_and_generalises(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = queries.QUERIES["op8_toxicity"](spark, SF).join(labels, "doc_id").collect()
    away = [r for r in got if r.held_out]
    assert sum(r.predicted == r.toxic for r in away) / len(away) > 0.95
    assert sum(r.predicted and r.toxic for r in got) >= 0.88 * sum(r.toxic for r in got)
    assert sum(r.predicted and not r.toxic for r in got) <= 0.02 * sum(r.toxic for r in got)
    assert queries.QUERIES["op8_toxicity"](spark, SF).count() == docs.count()


def test_toxicity_of_held_out_rows_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = queries.QUERIES["op8_toxicity"](spark, sf).where("held_out").join(labels.where("toxic is not null"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    caught = [r for r in got if r.predicted]
    assert sum(r.toxic for r in caught) >= 0.98 * len(caught)
    for lang in ("en", "de", "fr", "es"):
        mine = [r.predicted for r in got if r.toxic and r.lang == lang]
        assert len(mine) > 5 and sum(mine) >= 0.9 * len(mine), lang


def test_learned_weights_and_the_grammar_decide(learned):
    judge = toxicity.Scorer(learned)
    worst = max(learned.words, key=learned.words.get)
    said = {t: judge.weigh(t)[0] for t in [
        f"You are a {worst}.", f"What a {worst}.", f"He is not a {worst}.", f"The paper said you are a {worst}.", f"They were never {worst}.",
        "I beat you at chess yesterday.", "They destroy old buildings.", "I will kill the process.", "He will kill you.", "Go and kill yourself.", "The report said he will kill you.", "",
    ]}
    bad = {f"You are a {worst}.", f"What a {worst}.", "He will kill you.", "Go and kill yourself."}
    assert {t for t, s in said.items() if s >= 0.5} == bad
    assert said[f"You are a {worst}."] > said[f"What a {worst}."] and judge.weigh(f"He is not a {worst}.")[1] == 1


def test_scopes_of_denial_and_report_with_learned_weights(learned):
    judge = toxicity.Scorer(learned)
    a, b = sorted(learned.words, key=lambda w: (-learned.words[w], w))[:2]
    toxic = [
        f"You are a {a}.", f"You are not a {a}. You are a {a}.", f"You are a {a}. You are not a {a}.", f"You are not a {a} but a {b}", f"no {a} should get away, you {b}", f"You {a} wrote him again",
        f"As I said, you are a {a}.", f"No, {a}!", f"You are not only a {a}, you are boring", f"He said hello but you are a {a}", f"He said you are a {b}. You are a {a}.", f"Du bist kein {a}, sondern ein {b}", f"Tu n'es pas seulement un {a}",
    ]
    clean = [f"You are not a {a}.", f"Don't be a {a}", f"You aren’t a {a} or a {b}.", f"He said you are a {a}.", f"He called her a {a} and a {b}", f"This is not a {a}", f"Du bist kein {a}", f"Tu n'es pas un {a}", "I will not kill you.", "He said he will kill you."]
    wrong = [t for t in toxic if judge.weigh(t)[0] < 0.5] + [t for t in clean if judge.weigh(t)[0] >= 0.5]
    assert not wrong, wrong


def test_order_of_sentences_does_not_matter(learned):
    judge, r = toxicity.Scorer(learned), np.random.default_rng(2)
    a, b = sorted(learned.words, key=lambda w: (-learned.words[w], w))[:2]
    pool = [f"You are a {a}.", f"You are not a {a}.", f"He said that {b} is here.", f"What a {b}!", "I will kill you.", "I will not kill you.", "Hello there.", f"They never met a {b}."]
    for _ in range(100):
        some = list(r.choice(pool, 4))
        scores = {round(judge.weigh(" ".join(r.permutation(some)))[0], 12) for _ in range(6)}
        assert len(scores) == 1, some


def test_score_is_the_sum_of_weights_along_clauses():
    """Brute force: split, classify every word anew, keep scopes in plain variables."""
    model = toxicity.Model({"moron": 4.0, "scum": 3.0}, frozenset({"bad"}), frozenset({"badge"}), (-1.5, 2.0, -0.5), -2.0)

    def brute(text):
        best, total = {}, 0
        for clause in re.split(r"[.!?;:\n]+(?:\s|$)|\n", text.lower()):
            words = re.findall(r"[a-zà-ü]+n't\b|[a-zà-ü]+|,", clause)
            denies, told, speaker, intent, threat, said, aimed = 0, 0, -9, 0, None, [], False
            behind = False  # just behind something denied
            for i, w in enumerate(words):
                insult = w in model.words or w.startswith("bad") and w not in ("bad", "badge")
                heavy = insult or w in toxicity.THREATS
                role = "plain"
                if heavy and denies:
                    role = "denied"
                if w in toxicity.NEGATIONS or w.endswith("n't") or behind and w in toxicity.LINKS:
                    denies = 3
                elif heavy and denies or w == "," or w in toxicity.CONTRASTS or behind or denies == 3 and w in toxicity.ONLYS:
                    denies = 0
                else:
                    denies = max(0, denies - 1)
                behind = heavy and role == "denied"
                if told:
                    told = 0 if w in toxicity.CONTRASTS else 8 if w in toxicity.REPORTS else told - 1
                    if heavy and role == "plain":
                        role = "told"
                elif w in toxicity.SPEAKERS:
                    speaker = i
                elif w in toxicity.REPORTS:
                    told, speaker = (0, -9) if i - speaker <= 2 else (8, -9)
                aimed = aimed or w in toxicity.TARGETS
                if w == ",":
                    continue
                if w in toxicity.THREATS:
                    threat = (role, intent > 0, 3)
                elif threat and (w in toxicity.TARGETS and threat[1] or w in toxicity.SELVES and threat[2] == 3):
                    said.append(("", threat[0]))
                    threat, aimed = None, True
                elif threat:
                    threat = (*threat[:2], threat[2] - 1) if threat[2] > 1 else None
                intent = 3 if w in toxicity.INTENTS else max(0, intent - 1)
                if insult:
                    said.append((w, role))
            total += bool(said)
            for w, role in said:
                plain = 1.25 if aimed or ("", "plain") in said else 1.0
                best[w] = max(best.get(w, -1.0), plain if role == "plain" else -0.25)
        z = -2.0 + sum(f * model.words.get(w, 4.0) for w, f in best.items() if w in model.words or not w)
        begun = {w: f for w, f in best.items() if w and w not in model.words}
        z += sum(-0.25 * 2.0 for f in begun.values() if f < 0)
        used = [f for f in begun.values() if f > 0]
        if used:
            more = -1.5 + 2.0 * len(used) - 0.5 * len(re.findall(r"[a-zà-ü]+", text.lower().replace("n't", "n t"))) / 100 + 2.0
            z += more * (max(used) if more > 0 else 1)
        return total, 1 / (1 + np.exp(-z))

    r = np.random.default_rng(5)
    pool = ["you", "moron", "scum", "bader", "badly", "badge", "bad", "not", "said", "kill", "will", "yourself", "a", "b", "c", "or", "but", ",", "i", "only", "don't", ".", ";", "\n"]
    judge = toxicity.Scorer(model)
    for _ in range(5000):
        text = " ".join(r.choice(pool, int(r.integers(0, 14))))
        score, clauses = judge.weigh(text)
        assert (clauses, pytest.approx(score)) == brute(text), text


def test_grammar_tells_kinds_of_clauses():
    model = toxicity.Model({"moron": 3.0}, frozenset({"scum"}), frozenset(), (3.0, 4.0, -1.0), -2.0)
    kinds = lambda t: [k for clause in toxicity.Scorer(model).clauses(t) for _, k in clause]
    assert kinds("what a moron that was") == [toxicity.PLAIN]
    assert kinds("You are SCUMBAGS. Fine otherwise.") == [toxicity.AIMED]
    assert kinds("not a moron") == [toxicity.NEGATED]
    assert kinds("the report said you moron") == [toxicity.REPORTED]
    assert kinds("i will kill you") == kinds("kill yourself") == [toxicity.MENACE]
    assert kinds("oxymoron, and kill the process. i beat you at chess") == []
    assert kinds("not a moron, scumbag") == [toxicity.NEGATED, toxicity.PLAIN]


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (5, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd_docs, labels)
    assert toxicity.score(odd_docs, model).count() == odd_docs.count() and toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.learn(no_docs, labels.limit(0))
    assert toxicity.keep_clean(odd_docs, nothing).count() == odd_docs.count()
    assert toxicity.keep_clean(odd_docs, model).columns == odd_docs.columns
    assert toxicity.keep_clean(no_docs, model).count() == 0


# -- language --------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op9_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_equals_brute_force(spark):
    """Sizes summed text by text with the library, without the judge."""
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs, ~held_out("doc_id", 4, 2), per_lang=8)
    how = zstandard.ZstdCompressionParameters.from_level(6, min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)
    tools = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in model.values()]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        text = re.sub(r"[\W\d_]+", " ", (r.text or "").lower())
        if not text.strip():
            assert got[r.doc_id].lang_pred == "und" and not got[r.doc_id].confident
            continue
        sizes = [sum(len(t.compress(text[a : a + 2000].encode())) for a in range(0, len(text), 2000)) for t in tools]
        best, second = sorted(sizes)[:2]
        assert got[r.doc_id].lang_pred == list(model)[sizes.index(best)]
        assert got[r.doc_id].confident == ((second - best) / best >= langid.MARGIN)


def test_short_texts_need_a_margin_too(spark):
    docs = spark.createDataFrame([(1, "De."), (2, "Und das ist nicht mit der Einung auf die Keitung von sich in den")], "doc_id long, text string")
    known = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(known, F.lit(True))).collect()}
    assert not got[1].confident and got[2].confident and got[2].lang_pred == "de"


def test_language_of_odd_rows(odd_docs, no_docs):
    model = langid.learn(odd_docs, ~held_out("doc_id", 4, 2))
    got = {r.doc_id: r for r in langid.identify(odd_docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 9, 10))
    assert all(r.lang_pred in [*model, "und"] and 0 <= r.score <= 1 for r in got.values())
    assert langid.identify(no_docs, model).count() == 0 and langid.learn(no_docs, F.lit(True)) == {}
    assert {r.lang_pred for r in langid.identify(odd_docs, {}).collect()} == {"und"}
    assert langid.keep_identified(odd_docs, model).columns == odd_docs.columns
