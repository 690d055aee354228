"""Each query against its plain version, on a table of odd cases, on empty tables and on the smallest supplied ones."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from panelspark.llm.queries import QUERIES
from tests.llm import brute, fixtures

SUPPLIED = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return fixtures.tables(str(tmp_path_factory.mktemp("odd")), True)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return fixtures.tables(str(tmp_path_factory.mktemp("empty")), False)


@pytest.fixture(params=["odd", "supplied"])
def place(request, odd):
    if request.param == "supplied" and not os.path.isdir(SUPPLIED):
        pytest.skip("no supplied tables")
    return odd if request.param == "odd" else SUPPLIED


def table(path, name, *columns):
    t = pq.read_table(f"{path}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns), strict=True))


def result(spark, name, path, *columns):
    return [tuple(r) for r in QUERIES[name](spark, path).select(*columns).collect()]


@pytest.mark.parametrize("name", [q for q in QUERIES if q != "op5_chat_format"])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_fingerprint(spark, place):
    docs = table(place, "documents", "doc_id", "text")
    rows = QUERIES["op1_fingerprint"](spark, place).collect()
    assert ordered((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == ordered(brute.edited(docs))
    text = dict(docs)
    after = {d: e for d, e in zip(sorted(text, key=brute.key), [*sorted(text, key=brute.key)[1:], min(text, key=brute.key)], strict=True)}
    prints = {}
    for r in rows:
        assert prints.setdefault(text[r.doc_id] or "", r.fingerprint) == r.fingerprint
        a, b = brute.shingle_set(text[r.doc_id]), brute.shingle_set(text[after[r.doc_id]])
        if min(len(a), len(b)) > 400:
            assert abs(r.near_next - len(a & b) / len(a | b)) < 0.15
        assert 0 <= r.near_edited <= 1


def test_fingerprint_of_everything_is_exact():
    import pyarrow as pa

    from panelspark.llm import fingerprint

    some = [t or "" for t in fixtures.texts()]
    found = fingerprint.sketches(pa.array(some, pa.large_string()), scale=1)
    for i in range(9, 60):
        a, b = brute.shingle_set(some[i]), brute.shingle_set(some[i - 1])
        assert fingerprint.likeness(found[i], found[i - 1]) == pytest.approx(len(a & b) / len(a | b))
        assert fingerprint.containment(found[i], found[i - 1]) == pytest.approx(len(a & b) / len(a))
    assert (fingerprint.from_text(fingerprint.as_text(found[20])) == found[20]).all()


def test_fingerprint_of_short_texts(spark, tmp_path):
    import pyarrow as pa

    from panelspark.llm import fingerprint

    some = [None, "", *(f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}"[: 3 + 3 * (i % 8)].strip() for i in range(10, 90))]
    fixtures.documents(str(tmp_path), list(enumerate(some)))
    rows = sorted(QUERIES["op1_fingerprint"](spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    assert [r.fingerprint == "" for r in rows] == [True, True] + [False] * 80
    assert len({r.fingerprint for r in rows[2:]}) == 80
    assert [r.near_next for r in rows] == [1] + [0] * 81
    for i in range(2, 80):
        whole = fingerprint.sketches(pa.array([some[i] + " " + some[i + 1]], pa.large_string()), k=1)
        parts = fingerprint.sketches(pa.array(some[i : i + 2], pa.large_string()), k=1)
        assert (fingerprint.merge(*parts) == whole[0]).all()


def test_fingerprint_where_one_id_has_most_rows(spark, tmp_path):
    """Ten thousand null ids and as many of one id, spread over groups, in the order of the plain version."""
    import pyarrow as pa

    from panelspark.llm import blocks, fingerprint

    rows = [(None, f"text {i} of nobody") for i in range(10_000)] + [(7, f"text {i} of seven") for i in range(10_000)] + [(i, f"text of {i}") for i in range(100)] + [(None, "same")] * 50
    fixtures.documents(str(tmp_path), rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    bounds = fingerprint._bounds(docs, 32)
    texts = [t.encode() for _, t in rows]
    groups = fingerprint._ranges(bounds)(blocks.ids_of(pa.array([d for d, _ in rows], pa.int64())), fingerprint.place(texts))
    assert np.bincount(groups).max() < 1_500
    got = [tuple(r) for r in QUERIES["op1_fingerprint"](spark, str(tmp_path)).select("doc_id", "n_chars", "edited_sha256").collect()]
    assert ordered(got) == ordered(brute.edited(rows))


def test_substrings(spark, place):
    got = result(spark, "op2_substrings", place, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert ordered(got) == ordered(brute.repeats(table(place, "documents", "doc_id", "text")))


@pytest.mark.parametrize("window, shortest, lengths", [(30, 4, [4, 8, 15, 30]), (25, 7, [7, 13, 25]), (50, 7, [7, 13, 25, 50]), (13, 4, [4, 7, 13])])
def test_substrings_over_more_levels(spark, odd, window, shortest, lengths):
    from panelspark.llm import substrings

    assert substrings.levels(window, shortest) == lengths
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    got = substrings.remove_repeats(docs, window=window, shortest=shortest)
    rows = [tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert ordered(rows) == ordered(brute.repeats(table(odd, "documents", "doc_id", "text"), window))
    assert all(brute.sha(r.kept) == r.kept_sha256 for r in got.collect())


def test_substrings_keep_candidates_of_copies_packed():
    """A whole text of candidates takes next to nothing in the state, and comes back as it was."""
    import numpy as np
    import pyarrow as pa

    from panelspark.llm import substrings
    from panelspark.llm.hashing import PLAIN, batches, encoded

    text = " ".join(f"w{i}" for i in range(20_000))
    (_, words), *_ = batches(encoded([text]), PLAIN, 1 << 20)
    rows = substrings._Rows(0)
    for doc in (5, 6):
        rows.open(doc, words, 0, text.encode(), np.arange(19_988))
    state = rows.table()
    assert max(len(x.as_py()) for x in state.column("candidates")) < 1_000
    back = list(substrings._read_state(pa.table(state)))
    assert np.concatenate([ids for ids, _, _ in back]).tolist() == [5, 6]
    assert sum(len(at) for _, _, at in back) == 2 * 19_988 and (np.diff(back[0][2][:19_988]) == 1).all()
    assert list(substrings._lots(np.array([1 << 21, 1 << 21, 1, 1 << 30, 3]))) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_decontaminate(spark, place):
    got = result(spark, "op3_decontaminate", place, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = [("" if n is None else n, t) for n, t in table(place, "benchmark", "item_id", "text")]
    assert ordered(got) == ordered(brute.contaminated(table(place, "documents", "doc_id", "text"), items))


def test_decontaminate_in_blocks_and_offsets(spark, odd):
    from panelspark.llm import decontam

    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontam.decontaminate(docs, items)
    parts = decontam.decontaminate(docs, items, block_words=20_000)
    key = lambda df: ordered((r.doc_id, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.collect())
    assert key(whole) == key(parts)
    assert whole.where("n_hit > 0").count()
    for r in [*whole.where("n_hit > 0").collect(), *parts.where("n_hit > 0").collect()]:
        hit = [w for s in r.spans for w in brute.ALNUM.findall(r.text[s.start : s.end].translate(brute.LOWER))]
        assert len(hit) == r.n_hit


def test_near_duplicates(spark, place):
    got = result(spark, "op4_near_duplicates", place, "doc_id", "n_shingles", "component_id")
    assert ordered(got) == ordered(brute.alike(table(place, "documents", "doc_id", "text")))


@pytest.mark.parametrize("seed", range(4))
def test_near_duplicates_of_frequent_tokens(spark, tmp_path, monkeypatch, seed):
    """Few words, so that tokens are in many documents: combinations, hot keys and lots begin early."""
    from random import Random

    from panelspark.llm import jaccard

    r = Random(seed)
    rows, base = [], [f"v{r.randrange(9)}" for _ in range(80)]
    for i in range(160):
        if seed % 2:  # edits of one text, by words that edits have in common
            some = list(base)
            for _ in range(r.randrange(7)):
                some[r.randrange(80)] = f"e{r.randrange(3)}"
            rows.append((i, " ".join(some[: r.choice([74, 76, 80, 80, 80])])))
        else:  # one text that drifts
            some = [f"v{r.randrange(9)}" if r.random() < 0.045 else w for w in base]
            rows.append((i, " ".join(some[: r.randrange(40, 80)])))
            if r.random() < 0.1:
                base = [f"v{r.randrange(9)}" if r.random() < 0.3 else w for w in base]
    fixtures.documents(str(tmp_path), rows)
    for name, value in (("SLICE", 7), ("HOT", 5), ("MANY", 3)):
        monkeypatch.setattr(jaccard, name, value)
    found = jaccard.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet"), frequent=(3, 12))
    assert ordered(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()) == ordered(brute.alike(rows))


def test_signatures_lose_no_link():
    """Any two sets over the threshold have a signature in common whose bounds allow it."""
    from panelspark.llm import jaccard

    r = np.random.default_rng(3)
    bounds = jaccard.class_bounds(75)
    checked = 0
    for _ in range(600):
        n = int(r.integers(1, 320))
        pool = r.choice(1 << 40, 800, replace=False).astype(np.uint64)
        a = set(pool[:n].tolist())
        out = int(r.integers(0, n // 5 + 1))
        b = set(pool[out:n].tolist()) | set(pool[n : n + int(r.integers(0, n // 6 + 1))].tolist())
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        some = np.array(sorted(a & b | set(r.choice(sorted(a | b), len(a | b) // 2).tolist())), np.uint64)
        df = dict(zip(some.tolist(), r.choice([2, 9, 40, 300, 5000], len(some)).tolist(), strict=True))
        sides = []
        for s in (a, b):
            shared = np.array([x for x in sorted(s) if x in df], np.uint64)
            sides.append(dict(jaccard.signatures(shared, np.array([df[x] for x in shared.tolist()]), len(s), 75, bounds)))
        assert max(min(sides[0][x], sides[1][x]) for x in sides[0].keys() & sides[1].keys()) >= len(a & b)
        checked += 1
    assert checked > 100


def chats(path):
    turns = defaultdict(list)
    for conv, turn, role, text in table(path, "conversations", "conv_id", "turn", "role", "text"):
        turns[conv].append((turn, role or "", text or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    return turns


def test_chat(spark, place):
    got = {r.conv_id: r for r in QUERIES["op5_chat_format"](spark, place).collect()}
    want = chats(place)
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), brute.sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
        assert r.formatted_chars >= sum(len(t) for _, _, t in turns)


def test_chat_turn_order(spark, odd):
    valid = {r.conv_id: r.valid for r in QUERIES["op5_chat_format"](spark, odd).collect()}
    assert valid[1] and valid[-7] and not valid[2] and not valid[3] and not valid[5]


def test_main_text_of_odd_pages(spark, odd):
    got = {(r.page_id, r.url): r for r in QUERIES["op6_main_text"](spark, odd).collect()}
    assert got[0, "http://h/0"].text == "" and got[None, "http://h/1"].text == ""
    article = got[4, "http://h/4"].text
    assert "fresh water that flows on land & ends in a sea." in article and "flow into lakes" in article
    assert "Home" not in article and "Copyright" not in article
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_main_text_learns_composed_pages():
    from random import Random

    from panelspark.llm import html_text
    from panelspark.llm.html_pages import composed

    model = html_text.trained()
    r = Random(99)
    pages = [x for x in (html_text.labelled(composed(r)) for _ in range(150)) if x[0]]
    hit = [np.mean((kept > 0) == (y > 0)) for kept, (_, y) in zip(model.is_article([p for p, _ in pages]), pages, strict=True)]
    assert np.mean(hit) > 0.97


def test_main_text_of_pages_written_by_hand():
    """Pages unlike the composed ones, judged block by block."""
    from collections import Counter

    from panelspark.llm import html_text
    from tests.llm.pages import PAGES

    model = html_text.trained()
    both = got = want = 0
    for page, blocks in PAGES:
        found = html_text.main_texts(model, [page])[0]
        found, right = Counter(found.split("\n\n") if found else []), Counter(blocks)
        both, got, want = both + (found & right).total(), got + found.total(), want + right.total()
    assert 2 * both / (got + want) > 0.9


def test_leaves_of_broken_pages():
    """In time in proportion to the length, however deep or broken a page is."""
    from time import time

    from panelspark.llm import html_text

    n = 100_000
    began = time()
    for page in ("<div>x" * n, "<a " * n, '<a "' * n, '<a x="' * n, "<div>" * n + "</p>" * n, "</section>" * n + "<div>" * n, "<!--" * n, "<script>" * n, "<a ====\'" * n, "<" * 5 * n, "&" * 5 * n, "<div class=\'" + "a " * n + "\'>x", "<div " + "id=x " * n + ">x"):
        html_text.leaves(page)
    assert time() - began < 20
    texts = lambda page: [t for _, t, _ in html_text.leaves(page)]
    assert texts("<!-->a<p title='a>b'>hi <b>x</b> 1 < 2 <3<!-- c --><svg/>q<SCRIPT>no</ScRiPt >yes<textarea>k") == ["a", "hi x 1 < 2 <3qyes"]
    assert texts("<p>a<p>b</div>c<li>d<li>e<br>f &amp g") == ["a", "b", "c", "d", "e f & g"]
    assert texts("<title>no</title><style>p{}</style>t<p>u<template><p>v</template>w") == ["t", "uw"]
    assert texts("a<p b=\"c") == ["a"]


def test_clashing_columns(spark, tmp_path):
    """Columns of the input that have the names of an operator's own."""
    from panelspark.llm import html_text, langid, pii, quality

    rows = [(i, f"text {i} of words a@b.org", "x") for i in range(3)]
    names = ("tails", "keep", "p_good", "html", "url", "held_out", "lang_pred", "telling", "_telling", "term", "row", "text_hash")
    docs = spark.createDataFrame([(*r, *(["z"] * len(names))) for r in rows], ", ".join(["doc_id long", "text string", "lang string", *(f"{n} string" for n in names)]))
    scored = quality.score(docs, None)
    assert scored.columns.count("keep") == 1 and all(r.keep is True and r.tails == "z" for r in scored.collect())
    assert langid.predict(docs, langid.train(docs)).count() == 3
    assert pii.sanitise(docs).count() == 3 and pii.sanitise(docs, most_terms=0, carry=("lang",)).count() == 3
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumn("n_chars", docs.text)
    assert html_text.extract(pages).count() == 3


def test_quality_gradient_and_a_fit_by_hand():
    """The fit's minimum, by finite differences of the likelihood written out."""
    from panelspark.llm import quality

    r = np.random.default_rng(5)
    n, d = 60, 4
    x = r.random((n, d)) * (r.random((n, d)) < 0.7)
    grades = np.clip((x @ [2.0, -1, 0, 1] + r.normal(0, 0.4, n)).round().astype(int), 0, 2)
    row, col = np.nonzero(x)
    model = quality.fit((row, col, x[row, col]), grades, steps=4000, l2=0.01, least_texts=1, rate=0.02)
    part = np.array(quality.GRADE_WEIGHTS)[grades]

    def loss(w, theta):
        s = x @ w
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(s[:, None] - theta[None])), np.ones((n, 1))], 1)
        return -(part / part.sum() * np.log(below[np.arange(n), grades + 1] - below[np.arange(n), grades])).sum() + 0.005 * (w**2).sum()

    w, theta = model.weights[:d].astype(float), model.thresholds
    best = loss(w, theta)
    for k in range(d + 2):
        for step in (-1e-3, 1e-3):
            move = np.eye(d + 2)[k] * step
            assert loss(w + move[:d], theta + move[d:]) > best - 1e-7


def test_personal_data(spark, place):
    got = {r.doc_id: r for r in QUERIES["op7_sanitise"](spark, place).collect()}
    docs = dict(table(place, "documents", "doc_id", "text"))
    assert set(got) == set(docs)
    for d, text in docs.items():
        spans = brute.personal(text)
        base = [f"{k}:{a}:{b}" for a, _, k, b in spans]
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in spans) for k in brute.KINDS)
        assert r.base_sha256 == brute.sha(",".join(base))
        assert set(base) <= set(filter(None, r.spans.split(",")))


def test_terms_that_disclose(spark, tmp_path):
    from panelspark.llm import pii

    name = lambda i: "".join(chr(97 + int(c)) for c in str(100 + i))
    rows = [(i, f"filler{name(i)} wrote zebrafish a@b.org plain{name(i)}") for i in range(5)] + [(100 + i, f"other{name(i)} wrote common c{i}@d.org word{name(i)}") for i in range(40)]
    fixtures.documents(str(tmp_path), rows)
    out = {r.doc_id: r for r in pii.sanitise(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    for i in range(5):
        assert "zebrafish" not in out[i].text and "[EMAIL]" in out[i].text and f"plain{name(i)}" in out[i].text and "term:" in out[i].spans
    assert "common" in out[103].text and "wrote" in out[0].text and "term:" not in out[103].spans


@pytest.mark.parametrize("most_terms", [0, 1000])
def test_disclosures_against_plain_counts(spark, tmp_path, most_terms):
    """Shares at the shipped thresholds, what is replaced and by what, in documents without the entity too; terms broadcast or joined."""
    from random import Random

    from panelspark.llm import pii

    r = Random(8)
    letters = lambda: "".join(r.choices("abcdefgh", k=4))
    common = [letters() for _ in range(30)]
    texts = []
    entities = (("x@y.org", ("Zébre", "OKAPI", "quagga")), ("10.1.2.3", ("ibex",)), ("q@y.org", ()), ("+1 (743) 555-3824", ("gnu",)), ("4111 1111 1111 1111", ("Tapir",)))
    for i in range(400):
        some = r.choices(common, k=r.randrange(60))
        for who, tells in entities:
            if r.random() < 0.06:
                at = r.randrange(len(some) + 1)
                some[at:at] = [*(t for t in tells if r.random() < 0.9), who if who[0] != "x" else f"x{r.randrange(400)}@y.org", letters()]
        some += ["Zébre"] * (i % 120 == 7) + ["ibex"] * (i % 10 == 7) + ["quagga"] * (i % 130 == 7) + ["Tapir"] * (i % 120 == 9)
        texts.append(" ".join(some))
    texts += [texts[0]] * 10 + ["", "x@y.org", None]
    fixtures.documents(str(tmp_path), list(enumerate(texts)))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {t: s for t, s in brute.disclosures([t or "" for t in texts], pii.WINDOW, pii.SUPPORT).items() if s >= pii.GENERALISE}
    got = sorted(x.share for x in pii.disclosures(docs).collect())
    assert got == pytest.approx(sorted(want.values())) and {"okapi", "quagga", "zébre", "gnu", "tapir"} <= want.keys() and "ibex" not in want
    assert min(want.values()) < pii.REMOVE < max(want.values())
    for row in pii.sanitise(docs, most_terms=most_terms).collect():
        text = texts[row.doc_id] or ""
        told = [(a, b, t) for a, b, t in brute.terms_apart(text) if t in want]
        assert sorted(x for x in row.spans.split(",") if x[:4] == "term") == sorted(f"term:{a}:{b}" for a, b, _ in told)
        out = text
        kind_of_word = lambda w: "[ACRONYM]" if len(w) > 1 and w.isupper() else "[NAME]" if w[:1].isupper() else "[WORD]"
        changes = [(a, b, f"[{k.upper()}]") for a, _, k, b in brute.personal(text)] + [(a, b, "" if want[t] >= pii.REMOVE else kind_of_word(text[a:b])) for a, b, t in told]
        for a, b, new in sorted(changes, reverse=True):
            out = out[:a] + new + out[b:]
        assert row.text == out


def test_share_of_planted_disclosures_caught(spark, tmp_path):
    """At the shipped thresholds, on texts of frequent and rare words: terms that mostly stand beside an identifier, or beside any of a domain, network, issuer or area, and words that don't."""
    from random import Random

    from panelspark.llm import pii

    r = Random(21)
    word = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    vocabulary = [word(r.randrange(3, 9)) for _ in range(20_000)]
    weights = [1 / (i + 5) for i in range(len(vocabulary))]
    luhn = lambda digits: next(digits + str(c) for c in range(10) if brute.luhn(digits + str(c)))
    tells: dict[str, str] = {}  # term: its entity
    docs = [r.choices(vocabulary, weights, k=r.randrange(30, 200)) for _ in range(6_000)]
    for k in range(80):
        kind, shared = k % 4, k % 8 >= 4  # every other group of four: no identifier occurs twice, only what they have in common does
        place, area, net, issuer = word(8), 200 + k, f"{11 + k}.{7 + k}", str(410_000 + k)
        fixed = [f"{word(6)}@{place}.org", f"{net}.3.4", luhn(issuer + "00012345678"[: 9]), f"+1 ({area}) 555-{1000 + k}"][kind]
        terms = [word(9) for _ in range(3)]
        tells |= dict.fromkeys(terms)
        for _ in range(r.randrange(8, 14)):
            who = [f"{word(6)}@{place}.org", f"{net}.{r.randrange(250)}.{r.randrange(250)}", luhn(issuer + "".join(r.choices("0123456789", k=9))), f"+1 ({area}) 555-{r.randrange(1000, 9999)}"][kind] if shared else fixed
            some = r.choice(docs)
            at = r.randrange(len(some) + 1)
            some[at:at] = [*(t for t in terms if r.random() < 0.8), who]
        for t in terms:  # each now and then without the identifier: that is where it gives it away
            for _ in range(2):
                some = r.choice(docs)
                some.insert(r.randrange(len(some) + 1), t)
    texts = [" ".join(x) for x in docs]
    fixtures.documents(str(tmp_path), list(enumerate(texts)))
    caught = missed = wrong = others = 0
    for row in pii.sanitise(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect():
        text = texts[row.doc_id]
        marked = {tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",") if x.startswith("term:")}
        for a, b, t in brute.terms_apart(text):
            hit = (a, b) in marked
            caught, missed = caught + (t in tells and hit), missed + (t in tells and not hit)
            wrong, others = wrong + (t not in tells and hit), others + (t not in tells)
    print(f"caught {caught} of {caught + missed}, of other terms changed {wrong} of {others}")
    assert caught >= 0.9 * (caught + missed)
    assert wrong <= 0.001 * others


def test_personal_data_in_long_runs():
    """In time in proportion to the length."""
    from time import time

    from panelspark.llm import pii

    n = 1_000_000
    began = time()
    for text in ("1" * n, "1." * (n // 2), ("1" * 1000 + "..") * 1000, "+1" + " " * n, "+1" * (n // 2), "a" * n + "@", "a@" * (n // 2), "1 " * (n // 2), "1-" * (n // 2)):
        assert not [s for s in pii.base_spans(text) if s[1] != 1]
    assert time() - began < 20
    short = ["1.2.3.4.5.6.7.8.9", "..1.2.3.4..", "01.002.0003.4 1.2.3.256.1.1.1.1", "1.2.3", "a1.2.3.4b", "1..2.3.4.5", "1" * 50 + ".2.3.4.5"]
    for text in short:
        assert [(a, k, b) for a, k, b in pii.base_spans(text) if k == 1] == [(a, k, b) for a, k, _, b in brute.personal(text) if k == 1]


def test_quality_on_ratings_held_out(spark):
    """About one rating in twenty is noise, so toxic texts are judged by words that only rated-toxic texts hold."""
    from panelspark.llm import quality

    path = SUPPLIED.replace("0.001", "0.1")
    if not os.path.isdir(path):
        pytest.skip("no supplied tables")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 4 <> 1"))
    found = quality.score(docs.join(quality.graded(labels.where("doc_id % 4 = 1")), "doc_id").select("doc_id", "text", "grade"), model).toPandas()
    assert ((found.grade == 2) == found.keep).mean() > 0.88
    insults = found[found.text.str.contains("idiot|moron|trash|pathetic|worthless")]
    assert len(insults) and (~insults.keep).mean() > 0.9
    assert found[found.grade == 2].keep.mean() > 0.95
    assert np.diff(model.thresholds).min() > 0 and (found.p_fair >= found.p_good).all()


def test_quality_of_odd_rows(spark, odd):
    rows = QUERIES["op8_quality"](spark, odd).collect()
    docs = table(odd, "documents", "doc_id", "text")
    assert ordered((r.doc_id,) for r in rows) == ordered((d,) for d, _ in docs)
    assert all(abs(r.expected_grade - r.p_fair - r.p_good) < 1e-9 for r in rows)


def test_packing(spark, place):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op9_pack"](spark, place).collect()
    docs = dict(table(place, "documents", "doc_id", "text"))
    of, lanes = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
        lanes[r.sequence_id].append((r.offset, r.length))
    assert set(of) == set(docs)
    for d, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(of[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in lanes.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    padded = sum(1024 for _ in lanes) - sum(r.length for r in rows)
    assert padded < 0.03 * 1024 * len(lanes) + 4096


def test_packing_ids_of_the_tokenizers_file_as_it_is(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    some = [mark, f"one {mark} two  {mark}  three{mark}{mark}", f"{mark[:-1]} |{mark}>", f"É {mark}\n漢字", "x" * 300_000, "la " * 100_000, f"ab {mark} " * 30_000, *fixtures.texts()]
    some += [f"a{c * (2_000_000 // len(c))}{mark}b" for c in ("\n", " ", "\t", "\r\n", "\u3000", " x")]
    fixtures.documents(str(tmp_path), list(enumerate(some)))
    of = defaultdict(list)
    for r in QUERIES["op9_pack"](spark, str(tmp_path)).collect():
        of[r.doc_id].append(r)
    for d, text in enumerate(some):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(of[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_language_on_documents_held_out(spark):
    if not os.path.isdir(SUPPLIED):
        pytest.skip("no supplied tables")
    lang = dict(table(SUPPLIED, "documents", "doc_id", "lang"))
    rows = QUERIES["op10_language"](spark, SUPPLIED).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    sure = [r for r in held if lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in sure]) > 0.9


def test_language_sample_is_bounded_where_ids_are_null(spark):
    from panelspark.llm import langid

    docs = spark.range(4000).selectExpr("cast(null as long) doc_id", "concat('wort', if(id < 3000, 'x', cast(id as string))) text", "'de' lang")
    seen = []
    learn = langid.learn
    langid.learn = lambda counts, *a, **b: seen.append(sum(counts["de"].values())) or learn(counts, *a, **b)
    try:
        langid.train(docs, rows_a_language=200)
    finally:
        langid.learn = learn
    assert 1 <= seen[0] < 300


def test_language_of_odd_rows(spark, odd):
    text = dict(table(odd, "documents", "doc_id", "text"))
    for r in QUERIES["op10_language"](spark, odd).collect():
        lettered = any(c.isalpha() for c in text[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1


def segmentations(word, pieces):
    """Every way to cut a word into pieces; a character that is no piece is None."""
    if not word:
        return [[]]
    out = [[None, *rest] for rest in segmentations(word[1:], pieces)] if word[0] not in pieces else []
    return out + [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in pieces for rest in segmentations(word[n:], pieces)]


def test_sums_and_learning_over_all_segmentations():
    from collections import Counter
    from math import prod

    from panelspark.llm import langid

    pieces = ["a", "b", "ab", "▁", "▁a", "ba", "abbabba"]
    p = np.concatenate([np.random.default_rng(1).dirichlet(np.ones(7), 2).T, np.zeros((1, 2))])
    chance = lambda k: {x: p[i, k] for i, x in enumerate(pieces)} | {None: langid.UNKNOWN}
    model = langid.Model(["x", "y"], pieces, p)
    for word in ("a", "abba", "babab", "abbabba", "acb", "abbabbabab"):
        want = [sum(prod(chance(k)[x] for x in cut) for cut in segmentations("▁" + word, pieces)) for k in (0, 1)]
        assert np.exp(model.scorer().score([word])[0][:2]) == pytest.approx(want)
    once, often = model.scorer().score(["ab" * 20])[0], model.scorer().score(["ab" * 40])[0]
    assert np.isfinite(often).all() and (often[:2] < once[:2]).all()

    counts = {"x": {"ab": 3, "abba": 1, "bac": 2, "ab" * 9: 1, "abbabba" * 7: 1}}
    q = Counter({x: 0.0 for x in pieces})
    for word, n in counts["x"].items():  # to begin with: how often a piece occurs anywhere
        for x in pieces:
            q[x] += n * sum(("▁" + word)[i : i + len(x)] == x for i in range(len(word) + 1))
    smoothed = lambda c: {x: (c[x] + 0.1) / (sum(c.values()) + 0.1 * len(pieces)) for x in pieces}
    now = smoothed(q) | {None: langid.UNKNOWN}
    expected = Counter({x: 0.0 for x in pieces})
    for word, n in counts["x"].items():
        # the same sums place by place: all ways before, over and after a piece
        whole = "▁" + word
        ahead, after = [1.0] + [0.0] * len(whole), [0.0] * len(whole) + [1.0]
        fits = [(i, i + len(x), x) for i in range(len(whole)) for x in pieces if whole.startswith(x, i)] + [(i, i + 1, None) for i in range(len(whole)) if whole[i] not in pieces]
        for i, j, x in sorted(fits, key=lambda f: f[:2]):
            ahead[j] += ahead[i] * now[x]
        for i, j, x in sorted(fits, key=lambda f: -f[0]):
            after[i] += now[x] * after[j]
        for i, j, x in fits:
            if x:
                expected[x] += n * ahead[i] * now[x] * after[j] / ahead[-1]
    got = langid.learn(counts, pieces, rounds=1).p[:-1, 0]
    assert got == pytest.approx([smoothed(expected)[x] for x in pieces], rel=1e-6)


def test_language_against_plain_sums(spark, tmp_path):
    """The query's answers are those of sums place by place, with pieces and words of any length."""
    from math import exp, log

    from panelspark.llm import langid

    table_ = pq.read_table(f"{SUPPLIED}/documents.parquet", columns=["doc_id", "text", "lang"]).slice(0, 60).to_pylist() if os.path.isdir(SUPPLIED) else []
    rows = [(x["doc_id"], (x["text"] or "")[:400], x["lang"]) for x in table_] + [(10_000 + i, t, "en") for i, t in enumerate(["internationalisation " * 3, "x" * 200, "", None, "12 34", "Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen"])]
    fixtures.documents(str(tmp_path), rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs)
    assert max(map(len, model.pieces)) > 8
    number = {x: i for i, x in enumerate(model.pieces)}
    longest = max(map(len, model.pieces))

    def total(word: str, k: int) -> float:
        whole, logs = "▁" + word, [0.0]
        for j in range(1, len(whole) + 1):
            terms = [logs[j - n] + log(model.p[number[whole[j - n : j]], k]) for n in range(1, min(longest, j) + 1) if whole[j - n : j] in number]
            if whole[j - 1] not in number:
                terms.append(logs[j - 1] + log(langid.UNKNOWN))
            top = max(terms)
            logs.append(top + log(sum(exp(t - top) for t in terms)))
        return logs[-1]

    text = {d: t for d, t, _ in rows}
    for r in langid.predict(docs, model).collect():
        words = langid.words_of(text[r.doc_id])
        if not words:
            assert r.lang_pred == "und"
            continue
        sums = [sum(total(w, k) for w in words) for k in range(len(model.langs))]
        best = max(range(len(sums)), key=sums.__getitem__)
        assert r.lang_pred == model.langs[best] and r.score == pytest.approx(1 / sum(exp(x - sums[best]) for x in sums), rel=1e-6)


@pytest.mark.parametrize("name", ["op2_substrings", "op3_decontaminate", "op4_near_duplicates", "op5_chat_format"])
def test_query_equals_its_sql(spark, place, name):
    import duckdb

    from panelspark.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{place}/{t}.parquet')")
    if name in ("op2_substrings", "op4_near_duplicates") and place != SUPPLIED:
        pytest.skip("SQL of this one takes distinct ids that aren't null")
    want = con.sql(ORACLES[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    df = QUERIES[name](spark, place)
    assert sorted(df.columns) == sorted(want.columns)
    assert ordered(tuple(r[i] for i in at) for r in want.fetchall()) == ordered(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
