"""Page extraction, spelling variants and fill-in-middle frames against plain Python."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidex.llm import frames, html_text, queries, spelling

# ---- pages


def test_op11_equals_the_articles_of_all_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op11_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for row in got:
        page = pages[row.page_id]
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        plain = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in parts]
        assert row.text == "\n\n".join(x for x in plain if x)
        assert row.n_chars == len(row.text) and row.url == page.url


ARTICLE = "<p>First paragraph, long enough, with commas, that says <a href=x>something</a> here.</p><p>Short.</p><p>Another one, again, long enough to be kept.</p>"
TEXT = "First paragraph, long enough, with commas, that says something here.\n\nShort.\n\nAnother one, again, long enough to be kept."
NOISE = "<p>Some words, with many, many, commas, so that this, too, could win, if it were, by chance, counted.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='wrap'><div id=story>{ARTICLE}</div></div></body>",
        f"<body><header><h1>Site</h1>{NOISE}</header><main>{ARTICLE}</main><footer>{NOISE}</footer>",
        f"<nav><ul><li><a href=a>one</a><li><a href=b>two</a></ul></nav><article>{ARTICLE}</article><aside>{NOISE}</aside>",
        f"<div class='cookie-notice'>{NOISE}</div><div class=post>{ARTICLE}</div><div id=comments><article class=comment>{NOISE}{NOISE}{NOISE}</article></div>",
        f"<article>{ARTICLE}<form>{NOISE}<input></form><div class='ad-slot'>{NOISE}</div><script>'<p>x</p>'</script><style>p {{}}</style></article>",
        f"<div class='sidebar-layout'><main>{ARTICLE}</main></div>",
        f"<form id=page><div><article>{ARTICLE}</article></div></form>",
        f"<table><tr><td><a href=1>a</a><td>{ARTICLE}<td><a href=2>b</a></table>",
        f"<div class=ad>{NOISE}<article>{ARTICLE}{ARTICLE}</article>".replace(ARTICLE * 2, ARTICLE),
        f"<article><div>{ARTICLE}</div><ul><li><a href=1>Read this</a><li><a href=2>Read that</a><li><a href=3>And this</a></ul></article>",
        f"<article>{ARTICLE}",
        f"<article>{ARTICLE}<p class='cut",
        f"<article>{ARTICLE}<!-- <p>never closed</p>",
        f"<div>{ARTICLE}</div><div hidden>{NOISE}</div><noscript>{NOISE}</noscript>",
    ],
)
def test_article_without_the_rest(page):
    assert html_text.main_text(page) == TEXT


def test_blocks_references_and_white_space():
    page = "<article><h2>A &amp; B&nbsp;&lt;c&gt;</h2>one\n  two<br>three <b>fo</b>ur<p>&copy &eacute; &#x41;&#66; &am &ampx</article>"
    assert html_text.main_text(page) == "A & B <c>\n\none two three four\n\n© é AB &am &x"


def test_sections_and_siblings_of_the_best_container_stay():
    long = "<p>A sentence, and another, that fills the line well enough to count as text.</p>"
    sections = "".join(f"<section><h2>Part {i}</h2>{long * 4}</section>" for i in range(3))
    got = html_text.main_text(f"<div id=w><div class=links><a href=1>x</a> <a href=2>y</a> <a href=3>z</a></div>{sections}</div>").split("\n\n")
    assert len(got) == 15 and got[0] == "Part 0" and got[10] == "Part 2"


@pytest.mark.parametrize("page", ["", None, "<", "<a", "<p>", "<!--", "</div>", "<div>" * 3000, "<a href='x" * 2000, "<b>" * 5000, "<ul>" + "<li>" * 3000, "<table>" * 2000, "&" * 5000, "<style>", "= <p x=" * 2000])
def test_broken_pages_give_text_or_none(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = [(None, None, None, "t"), (1, "u", "", "t"), (2, "u", "<p>" + "word, " * 100_000, "t"), (2, "u", "plain", "t"), (2, "u", "plain", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_text.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.n_chars) for r in got.collect()) == {(None, 0): 1, (1, 0): 1, (2, 599_999): 1, (2, 5): 2}
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# ---- spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=10):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def told(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@given(st.lists(st.text("ab", min_size=1, max_size=9), max_size=30) | st.lists(st.text("abcé", min_size=1, max_size=6), max_size=30))
@settings(max_examples=300, deadline=None)
def test_scan_finds_all_pairs_one_edit_apart(words):
    words = sorted(set(words))
    got = list(spelling.near_pairs(words)) if words else []
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j])}


@pytest.mark.parametrize("block", [2, 5, 2000])
def test_variants_equal_brute_force_whatever_the_lists_length(spark, block):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))): 2 * 4 ** rng.randint(0, 6) for _ in range(400)}
    words |= {"prefixed" + "".join(rng.choice("ab") for _ in range(6)): rng.choice([2, 50, 900, 20_000]) for _ in range(80)}
    words |= {"x" * n: 10**n for n in range(7, 12)}
    got = told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), block=block))
    assert got == brute(words)
    assert got["x" * 7][1] == "x" * 11


def test_op12_equals_brute_force_on_whole_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    found = Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    assert told(queries.op12_spelling(spark, sf)) == brute_by_rests({w: n for w, n in found.items() if n > 1})


def brute_by_rests(words, ratio=10):
    """As `brute`, by looking up every word without one code point."""
    by_place, near = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by_place.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    for (_, rest), group in by_place.items():
        for w in group:
            near[w] |= set(group) - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_spelling_of_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "short words only"), (3, "spelling " * 30_000), (4, "speling"), (4, "speling"), (None, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ x×÷ya÷×b")]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    got = told(spelling.spelling_variants(docs, damage=None))
    assert got == {"spelling": (None, "spelling", 30_000, 1, None), "speling": ("spelling", "spelling", 2, 1, 30_000), "ÀÉÎÕÜßÿ": (None, "ÀÉÎÕÜßÿ", 2, 0, None)}
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


# ---- fill in middle

TEXTS = st.text("ab<PSM>é𝄞\n", max_size=60)


@given(TEXTS, st.integers(1, 7), st.data())
@settings(max_examples=300, deadline=None)
def test_frames_read_any_range_and_restore_the_text(text, size, data):
    out = frames.Writer(size)
    out.text(text)
    store = frames.Store(*out.stored())
    a, b = sorted(data.draw(st.integers(0, len(text))) for _ in range(2))
    assert store.size == len(text) and "".join(store.pieces(a, b)) == text[a:b]
    if re.search("<[PSM]>", text):
        return
    want = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}
    for form, whole in want.items():
        result = frames.Store(*frames.rearranged(store, form, a, b).stored())
        assert "".join(result.pieces(0, result.size)) == whole
        assert "".join(frames.restored(result, form)) == text


def test_whole_frames_are_copied_and_a_range_opens_its_frames_alone(monkeypatch):
    out = frames.Writer(10)
    out.text("0123456789" * 20)
    store = frames.Store(*out.stored())
    opened = []
    read = frames.Store.read
    monkeypatch.setattr(frames.Store, "read", lambda self, k: opened.append(k) or read(self, k))
    assert "".join(store.pieces(95, 105)) == "5678901234" and opened == [9, 10]
    opened.clear()
    frames.rearranged(store, "psm", 35, 150)
    assert opened == [3, 3]  # the only frame with a cut inside, for each side of it


def test_op13_equals_plain_python(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_fill_in_middle(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id]
        digits = hashlib.sha256(f"1:{r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        whole = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
        cut = (a, b - a) if form != "plain" else (None, None)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (len(text), form, *cut)
        assert r.output_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle_of_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (2, "a <S> b", 1), (3, "long, ünd 𝄞 " * 20_000, 1), (4, "same", 1), (4, "same", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form int")
    out = frames.fill_in_middle(docs, plain_from=100)
    got = out.select("doc_id", "n", "form", frames.text_of(out["output"]).alias("text")).collect()
    assert Counter((r.doc_id, r.n, r.form == "plain") for r in got) == {(None, 0, True): 1, (1, 0, True): 1, (2, 7, True): 1, (3, 240_000, False): 1, (4, 4, False): 2}
    long = next(r.text for r in got if r.doc_id == 3)
    assert sorted(re.sub("<[PSM]>", "", long)) == sorted("long, ünd 𝄞 " * 20_000)
    assert frames.fill_in_middle_digests(docs.limit(0)).count() == 0
