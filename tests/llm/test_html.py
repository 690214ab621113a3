"""The extractor decides by scores: pages whose class words mislead, what the scan does, and a plain version of the whole."""

import random

import pytest

from quarry.llm import html as H

SCORES = H.Scores(H.LABELLED)
PROSE = "<p>" + "Some words of a long text. " * 20 + "</p>"
TEXT = " ".join(["Some words of a long text."] * 20)


@pytest.mark.parametrize("page, want", [
    ('<body><div class="search-page"><article><h1>T</h1>{p}</article></div>', "T\n\n{t}"), ('<div class="site header-fixed"><article><h1>T</h1>{p}</article></div>', "T\n\n{t}"),
    ('<article><h1>T</h1>{p}<div class="legal-news"><p>Legal words of the text.</p></div>{p}</article>', "T\n\n{t}\n\nLegal words of the text.\n\n{t}"),
    ('<form id="aspnetForm"><nav><a href=/x>Menu</a></nav><article><h1>T</h1>{p}</article></form>', "T\n\n{t}"), ('<form id="aspnetForm"><div class=menu><a href=/x>Menu</a></div><div><h1>T</h1>{p}</div></form>', "T\n\n{t}"),
    ("<article><header><h1>Head line</h1></header>{p}</article>", "Head line\n\n{t}"), ("<article><h1>T</h1>{p}<h3>3 Comments</h3><p>Bob said so.</p><p>Al did not.</p></article>", "T\n\n{t}"),
    ("<article><h1>T</h1>{p}<section><h2>Comments</h2><ol><li>Bob said so.</li></ol></section></article>", "T\n\n{t}"), ("<article><h1>T</h1>{p}<h3>Comments on the new law of the land</h3>{p}</article>", "T\n\n{t}\n\nComments on the new law of the land\n\n{t}"),
    ('<body><nav>a b</nav><div id=main><h1>T</h1>{p}<div class=ad>Buy this now</div>{p}</div><div class=comments><p>Bob said so and so.</p></div></body>', "T\n\n{t}\n\n{t}"),
    ("<body><header>Site</header><div>Its name</div><article>{p}<aside>Side</aside>{p}</article><div>Words below</div><footer>Foot</footer></body>", "{t}\n\n{t}"),
])
def test_class_words_are_scored_with_all_else(page, want):
    assert H.extract(page.format(p=PROSE), SCORES) == want.format(t=TEXT)


def test_nothing_shown():
    for page in (None, "", "<nav>Menu of words</nav>", "<script>x</script>", "<div hidden>Words</div>", "<p style='display: none'>Words</p>", "<div class=cookie-notice>We use cookies</div>"):
        assert H.extract(page, SCORES) == ""


def test_without_the_scan_menus_stay(spark, monkeypatch):
    """On most pages of the table the text is another one if the region is the whole row of tokens."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    texts = [H.extract(p, SCORES) for p in pages]
    monkeypatch.setattr(H, "region", lambda seq, scores: (0, len(seq)))
    assert sum(H.extract(p, SCORES) != t for p, t in zip(pages, texts, strict=True)) > 0.9 * len(pages) > 0


def plain(page):
    """Every pair of ends for the region, every element found by counting tags, features from the list of ancestors."""
    seq = H.tokens(page)
    beside = any(k == "text" and H._inside(v) for k, v in seq)
    value, link, first = [], False, None
    for kind, v in seq:
        s = 0.0
        if kind == "text" and v.split():
            of = [*v.of, *(["beside"] if beside and not H._inside(v) else [])]
            s = len(v.split()) * (SCORES.word + sum(SCORES.features.get(f, SCORES.unknown if f.startswith("class:") else SCORES.features.get(f.replace(" in article", ""), 0)) for f in of))
            if link:
                if first is None:
                    first, s = len(value), s + SCORES.of.get("a", SCORES.other)
                else:
                    value[first], s = value[first] + s, 0.0
        elif v == "a" and kind != "text":
            link, first = kind == "tag", None
        elif kind == "tag" and v not in H.INLINE:
            s = SCORES.of.get(v, SCORES.other)
        value.append(s)
    best = max(((sum(value[i:j]), j - i, -i) for i in range(len(seq)) for j in range(i + 1, len(seq) + 1)), default=(0, 0, 0))
    return seq, value, ((-best[2], -best[2] + best[1]) if best[0] > 1e-12 else (0, 0))


def test_region_of_random_pages_against_all_spans():
    rng = random.Random(9)
    for _ in range(120):
        page = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<article>", "</article>", "<div class=ad>", "<nav>", "</nav>", "<a href=x>", "</a>", "word ", "two words ", "<form>", "</form>", "<h2>Comments</h2>", "<header>", "</header>"]) for _ in range(rng.randrange(0, 30)))
        seq, value, (lo, hi) = plain(page)
        got = H.values(seq, SCORES)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, value, strict=True)), page
        a, b = H.region(seq, SCORES)
        assert abs(sum(got[a:b]) - sum(value[lo:hi])) < 1e-9, page
        text = H.extract(page, SCORES)
        if lo < hi:
            for k in range(lo, hi):  # what the region holds and scores above zero is in the text
                if seq[k][0] == "text" and SCORES.of_word(seq[k][1], any(x == "text" and H._inside(v) for x, v in seq)) > 0:
                    assert all(w in text for w in seq[k][1].split() if w != "Comments"), page
        else:
            assert text == "", page
