import hashlib
import html as H
import re

import pytest
from pyspark.sql import types as T

from quarrylens.llm import html_text, html_training, warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("top", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


ROWS = [(1, "http://a/1", "é" * 600), (2, "http://a/2", "é" * 600), (9, None, "é" * 600), (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://a/5", "small"), (6, "http://a/6", "small"), (7, "http://a\r\n b", "a\r\n\r\nWARC/1.1\r\n\r\n" * 99), (8, "u", "😀" * 40000), (8, "u", "😀" * 40000), (None, "n", "z" * 2000), (10, "m", "z" * 2000)]


def test_archives_round_trip(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(warc.round_trip(pages(spark, ROWS))).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        same = [j for j, _, g in ROWS if (g or "") == (h or "") and j is not None]
        copy = len(data) >= 1000 and i != max(same)
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if copy else "response", max(same) if copy else None))
    assert got == sorted(want, key=str)


def test_captures_are_whole_transactions(spark):
    rows = warc.round_trip(pages(spark, ROWS[:6])).collect()
    assert len(rows) == 6 and all(r.request is not None and r.metadata is not None for r in rows)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_urls_come_back_as_they_were(spark):
    urls = [None, "", "http://a/b c", "http://a\r\n%20\tb", 'q"\\u0041', "é😀\u2028\u0085x", "{"]
    got = warc.digest(warc.round_trip(pages(spark, [(i, u, "x") for i, u in enumerate(urls)]))).collect()
    assert [r.url for r in sorted(got, key=lambda r: r.page_id)] == urls


@pytest.mark.parametrize("members", [None, 60, 61, 119])
def test_cut_archives_are_errors(spark, tmp_path, members):
    """Cut within a member, after a whole capture, between two records of one, and before the last record."""
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, [(i, "u", f"text {i}") for i in range(40)]).coalesce(1), folder)
    assert warc.read_records(spark, folder).count() == 120
    (path,) = (tmp_path / "w").glob("*.warc.gz")
    data = path.read_bytes()
    heads = [m.start() for m in re.finditer(re.escape(data[:10]), data)]
    assert len(heads) == 120
    path.write_bytes(data[: heads[members] if members else heads[60] + 40])
    with pytest.raises(Exception, match="ends within|captures"):
        warc.read_records(spark, folder).collect()


def test_parse_over_any_cuts():
    data = warc._record("response", [("WARC-Record-ID", "<a>")], b"x" * 10) + warc._record("metadata", [("WARC-Record-ID", "<b>")], b"")
    for step in (1, 3, 1000):
        got = list(warc.parse(data[i : i + step] for i in range(0, len(data), step)))
        assert [(h["warc-record-id"], b) for h, b in got] == [("<a>", b"x" * 10), ("<b>", b"")]
    whole = {0, len(warc._record("response", [("WARC-Record-ID", "<a>")], b"x" * 10)), len(data)}
    for end in set(range(len(data))) - whole:
        with pytest.raises(EOFError):
            list(warc.parse([data[:end]]))


@pytest.mark.parametrize("seed", [11, 12])
def test_held_out_pages(seed):
    """Accuracy on labelled pages that the model has not seen."""
    model = html_text.default_model()
    right = 0
    held = html_training.labelled_pages(200, seed)
    for page in held:
        elements, blocks = html_text.parse(page)
        want = " ".join(t for own, parts in blocks if elements[own].label and (t := " ".join("".join(parts).split())))
        right += want == model.text(page)
    assert right >= 0.97 * len(held)


def test_marginals_are_those_of_enumeration():
    """Sum-product against all labellings of a small tree."""
    import itertools
    import math

    model = html_text.default_model()
    elements, _ = html_text.parse("<div class=ad><p>a b c.</p></div><article><h1>x</h1><section><p>y.</p></section></article>")
    unary = [-3.0] + [sum(model.weights[i] * x for i, x in html_text.features(e)) for e in elements[1:]]
    total, on = 0.0, [0.0] * len(elements)
    for labels in itertools.product((0, 1), repeat=len(elements)):
        score = sum(u for u, y in zip(unary, labels, strict=True) if y)
        for k, e in enumerate(elements[1:], 1):
            c = html_text.edge_class(e)
            score += model.both[c] if labels[k] and labels[e.parent] else model.neither[c] if not labels[k] and not labels[e.parent] else 0.0
        total += math.exp(score)
        for k, y in enumerate(labels):
            on[k] += math.exp(score) * y
    assert model.marginals(elements) == pytest.approx([x / total for x in on])


def test_extraction_of_odd_pages(spark):
    body = "<p>One &amp; two&nbsp;three.<br>Four</p> <p>Five <b>six</b>seven.</p>"
    rows = [(1, "u", f"<nav><ul><li><a href=/>m</a></li></ul></nav><article><h1>Title here.</h1>{body}</article><footer>f</footer>"), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", "<article><p>cut off &am"), (5, "u", "<div>" * 3000 + "x")]
    got = {r.page_id: r for r in html_text.extract(pages(spark, rows)).collect()}
    assert got[1].text == "Title here. One & two three. Four Five sixseven."
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[None].text == ""
    assert got[4].text == "cut off " + H.unescape("&am")
    assert html_text.extract(pages(spark, [])).count() == 0


def test_only_what_the_contract_names_is_dropped():
    model = html_text.default_model()
    of = lambda body: model.text(f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>m</a></li></ul></nav><article><h1>Head.</h1>{body}</article></body></html>")
    assert of("<p>Let <math><mi>x</mi></math> be one.</p>") == "Head. Let x be one."
    assert of("<p>See <svg><text>label</text></svg> and <object>fallback</object> here.</p>") == "Head. See label and fallback here."
    assert of("<p>Choose <select><option>a<option>b</select> now.</p>") == "Head. Choose now."
    assert model.text("<html><head><title>t</title><meta charset=utf-8><article><p>An open head ends here.</p></article>") == "An open head ends here."
    assert model.text("<article><p>Before.</p><template><p>After all.</p></article>") == "Before. After all."


def test_layouts_of_another_hand():
    """Pages written apart from the training layouts."""
    model = html_text.default_model()
    main = "<p>The council met on Monday and agreed on the new bridge, which will open next year.</p><p>Work starts in spring. It will take ten months, the mayor said.</p>"
    want = "The council met on Monday and agreed on the new bridge, which will open next year. Work starts in spring. It will take ten months, the mayor said."
    layouts = [
        f'<body><div id="top" class="site-header"><a href="/">Daily News</a></div><div class="main-content">{main}</div><div id="footer"><p>Copyright 2020 Daily News. All rights reserved.</p></div></body>',
        f'<body><header><h1><a href=/>Blog</a></h1><nav><a href=a>Home</a> <a href=b>About</a></nav></header><main><article class="entry">{main}<aside class="related"><h4>More</h4><ul><li><a href=x>Other story</a></li></ul></aside></article></main><section id="comments"><h2>2 comments</h2><div class="comment"><p>Nice read, thanks for it.</p></div></section></body>',
        f'<body><div class="cookie-banner">We use cookies. <button>Accept</button></div><div class="wrapper"><div class="left-sidebar"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div class="content">{main}</div></div><footer>Contact us at any time.</footer></body>',
        f'<body><table><tr><td class="menu"><a href=1>One</a><br><a href=2>Two</a></td></tr></table><article>{main}</article><form action="/s"><label>Search</label><input><button>Go</button></form><div class="advert"><p>Buy one now. Get one free.</p></div></body>',
    ]
    found = [model.text(page) for page in layouts]
    assert sum(x == want for x in found) >= 4, found


def test_stored_weights_are_those_of_training():
    from quarrylens.llm.html_training import labelled_pages

    fresh = html_text.train(labelled_pages(120), steps=60)
    stored = html_text.default_model()
    held = labelled_pages(60, 99)
    assert sum(fresh.text(p) == stored.text(p) for p in held) >= 50


def test_repeated_pages_and_clashing_columns(spark):
    rows = [(1, "u", "<article><p>Twice told here.</p></article>")] * 2
    got = html_text.extract(pages(spark, rows)).collect()
    assert [r.text for r in got] == ["Twice told here."] * 2 and set(got[0].asDict()) == {"page_id", "url", "text", "n_chars"}
